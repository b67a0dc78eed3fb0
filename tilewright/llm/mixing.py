"""Mixing sources to target weights by iterative proportional fitting (native).

Documents are counted into cells (source, language, topic) of tokens.  Raking scales
the cell weights in turn until every marginal has its target share.  A document's
keep probability is its cell's weight over its cell's tokens, scaled so that none
exceeds one but in the scarcest cells, which are clipped there while they hold at most
``CLIPPED_SHARE`` of all tokens together.  A document stays when the hash of its id falls below it.

The fit runs on the cell table alone, whose size is the number of distinct
combinations, not of documents.  Up to ``ONE_TASK_CELLS`` cells (counted first) are
raked in one task without shuffles; more keep Spark's partitioning, by one dimension's
value a step.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.llm.common import settle, table, unit_hash, word_count

ONE_TASK_CELLS = 100_000
SWEEPS_PER_PLAN = 6
CLIPPED_SHARE = 0.001


@dataclass(frozen=True)
class Marginal:
    """Target shares of one dimension.

    ``shares`` names them; values it lacks share ``rest``, but no
    more than their own share, in proportion to their tokens.  Without shares, the targets are the observed shares to the power ``temper``.
    """

    column: str
    shares: Mapping[str, float] | None = None
    rest: float = 0.05
    temper: float = 0.7


#: Topics by the first marker phrase that a text holds; "prose" has none.
TOPIC_MARKERS = (("legal", ("icense", "opyright")), ("secret", ("password=", "token =", "AKIA")), ("contact", ("@", "+1 (")))

DEFAULT_MARGINALS = (
    Marginal("source"),
    Marginal("lang", {"en": 0.55, "de": 0.16, "fr": 0.16, "es": 0.13}),
    Marginal("topic", temper=0.9),
)


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, marks in reversed(TOPIC_MARKERS):
        held = F.lit(False)
        for mark in marks:
            held = held | F.contains(text, F.lit(mark))
        out = F.when(held, F.lit(name)).otherwise(out)
    return out


def rake(cells: DataFrame, marginals: Sequence[Marginal], tolerance: float = 1e-9, max_sweeps: int = 60) -> DataFrame:
    """Cells plus ``weight``, a share of the whole whose marginals meet the targets.

    Targets of values without tokens are dropped and the others scaled up.  Where the
    marginals contradict each other (a value present in one cell only), the last sweep's
    weights are returned with a warning; the last marginal then holds exactly.  Sums over
    all cells are aggregates of one row; windows run over one dimension's value at a time.
    """
    names = [m.column for m in marginals]
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    out = cells.withColumn("weight", F.col("tokens") / F.lit(total))
    for m in marginals:
        by = W.partitionBy(m.column)
        share = F.sum("tokens").over(by) / F.lit(total)
        if m.shares is None:
            goal = F.pow(share, F.lit(m.temper))
        else:
            named = F.create_map(*[F.lit(x) for k, v in m.shares.items() for x in (k, float(v))])
            unlisted = cells.where(~F.coalesce(F.col(m.column).isin(list(m.shares)), F.lit(False))).agg(F.sum("tokens")).first()[0] or 0
            loose = unlisted / total
            goal = F.coalesce(named[F.col(m.column)], F.lit(min(m.rest, loose) / loose if loose else 0.0) * share)
        out = out.withColumn(f"_share_{m.column}", F.col("tokens") / F.sum("tokens").over(by)).withColumn(f"_goal_{m.column}", goal)
    out = settle(out)
    # a value's goal counts once, spread over its cells
    spread = out.agg(*[F.sum(F.col(f"_goal_{n}") * F.col(f"_share_{n}")).alias(n) for n in names]).first()
    out = out.withColumns({f"_goal_{n}": F.col(f"_goal_{n}") / F.lit(spread[n]) for n in names})
    swept = 0
    while True:
        for _ in range(SWEEPS_PER_PLAN):
            for m in marginals:
                out = out.withColumn("weight", F.col("weight") * F.col(f"_goal_{m.column}") / F.sum("weight").over(W.partitionBy(m.column)))
        swept += SWEEPS_PER_PLAN
        out = settle(out)
        gaps = out
        for m in marginals:
            gaps = gaps.withColumn(f"_gap_{m.column}", F.abs(F.sum("weight").over(W.partitionBy(m.column)) - F.col(f"_goal_{m.column}")))
        worst = gaps.agg(F.max(F.greatest(*[F.col(f"_gap_{n}") for n in names], F.lit(0.0)))).first()[0]
        if worst is None or worst <= tolerance:
            return out.select(*names, "tokens", "weight")
        if swept >= max_sweeps:
            warnings.warn(f"the marginals contradict each other: one misses its target by {worst:.2g}", stacklevel=2)
            return out.select(*names, "tokens", "weight")


def common_scale(rated: DataFrame, keep_share: float) -> float:
    """Factor from a cell's ratio of weight to tokens to its keep probability.

    Cells clip at one from the largest ratio on while they hold at most CLIPPED_SHARE of
    all tokens; what they cannot give the others take over.  Ratios are summed in steps
    of a 64th of a power of two first, at most a few thousand rows, so no task sees all cells.
    """
    step = F.floor(F.log2("_ratio") * 64)
    steps = sorted(rated.groupBy(step.alias("step")).agg(F.sum("tokens").alias("tokens"), F.sum("weight").alias("weight"), F.max("_ratio").alias("top")).collect(), key=lambda r: -r["step"])
    total, weight = sum(r["tokens"] for r in steps), sum(r["weight"] for r in steps)
    goal = keep_share * total
    held, taken, scale = 0, 0.0, goal
    for r in steps:
        if held + r["tokens"] > CLIPPED_SHARE * total:
            return min(scale, 1 / r["top"])
        held, taken = held + r["tokens"], taken + r["weight"]
        if weight > taken:
            scale = max(scale, (goal - held) / (weight - taken))
    return scale


def mix(docs: DataFrame, marginals: Sequence[Marginal] = DEFAULT_MARGINALS, keep_share: float = 0.8, seed: int = 11) -> DataFrame:
    """``docs`` plus topic, n_tokens, probability, draw and kept.

    The expected kept tokens meet every target share, but for what the clipped cells
    lack.  Their sum is at most ``keep_share`` of all tokens, less where a cell that is
    not clipped would need more than it has.
    Null sources, languages and texts form the values "" and no tokens; a document
    without tokens takes its cell's probability, or 0 where the whole cell has none.
    Equal doc_ids draw alike.  Extra columns stay; those named like the added are replaced.
    """
    added = ("topic", "n_tokens", "probability", "draw", "kept")
    rows = docs.drop(*added)
    own = rows.columns
    rows = rows.withColumn("topic", topic_of(F.coalesce("text", F.lit("")))).withColumn("n_tokens", word_count(F.col("text")))
    names = [m.column for m in marginals]
    key = {n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names}
    cells = settle(rows.groupBy(*[key[n].alias(n) for n in names]).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"))
    if cells.count() <= ONE_TASK_CELLS:
        cells = settle(cells.coalesce(1).sortWithinPartitions(*names))
    fitted = rake(cells, marginals)
    rated = fitted.withColumn("_ratio", F.col("weight") / F.col("tokens"))
    scale = common_scale(rated, keep_share)
    rates = settle(
        rated.withColumn("_rate", F.least(F.col("_ratio") * F.lit(scale), F.lit(1.0)))
        .select(*[F.col(n).alias(f"_cell_{n}") for n in names], F.round("_rate", 9).alias("_rate"))
    )
    matched = rows.join(F.broadcast(rates) if _bounded(rates) else rates, [key[n] == F.col(f"_cell_{n}") for n in names], "left")
    return matched.select(
        *own,
        "topic",
        "n_tokens",
        F.coalesce("_rate", F.lit(0.0)).alias("probability"),
        unit_hash(seed, "doc_id").alias("draw"),
        (unit_hash(seed, "doc_id") < F.coalesce("_rate", F.lit(0.0))).alias("kept"),
    )


def _bounded(rates: DataFrame) -> bool:
    return rates.count() <= ONE_TASK_CELLS


def op7_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "draw", "kept")
