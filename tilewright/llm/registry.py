"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm.decontaminate import op3_templates
from tilewright.llm.jaccard import OP8_SQL, op8_product
from tilewright.llm.mixing import op7_raking
from tilewright.llm.pii import op1_feistel
from tilewright.llm.ppm import op5_ppm
from tilewright.llm.quality import OP10_SQL, op10_hosts
from tilewright.llm.sharding import op4_ring
from tilewright.llm.suffix import op2_runs
from tilewright.llm.toolcalls import op9_links
from tilewright.llm.toxicity import op6_grammar


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_feistel": op1_feistel,
        "op2_runs": op2_runs,
        "op3_templates": op3_templates,
        "op4_ring": op4_ring,
        "op5_ppm": op5_ppm,
        "op6_grammar": op6_grammar,
        "op7_raking": op7_raking,
        "op8_product": op8_product,
        "op9_links": op9_links,
        "op10_hosts": op10_hosts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_product": OP8_SQL, "op10_hosts": OP10_SQL}
