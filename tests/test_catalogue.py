from __future__ import annotations

import os
import subprocess
import sys

import pytest

from tests.oracle import connect, same_rows
from tilewright.plans import catalogue


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, data, con, name):
    same_rows(con, catalogue.queries()[name](spark, data), catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_without_sql_gives_rows(spark, data, name):
    assert catalogue.queries()[name](spark, data).count() > 0


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


HIDDEN = """
import sys
from importlib.abc import MetaPathFinder

class Hide(MetaPathFinder):
    def find_spec(self, name, path, target=None):
        if name == "tilewright.llm" or name.startswith("tilewright.llm."):
            raise ModuleNotFoundError(name)
import importlib.util
real = importlib.util.find_spec
importlib.util.find_spec = lambda name, package=None: None if name.startswith("tilewright.llm") or (name == "corpus_pipeline" and GONE) else real(name, package)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as entry
names, sql = set(entry.queries()), set(entry.oracle_sql())
assert sql <= names and "eval_matches" in names and not any(n.startswith("op") or n == "pipeline" for n in names), names
"""


@pytest.mark.parametrize("gone", [True, False])
def test_entry_without_the_corpus_subpackage(gone):
    """With the subpackage hidden, with and without the pipeline module beside it."""
    subprocess.run([sys.executable, "-c", f"GONE = {gone}" + HIDDEN], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
