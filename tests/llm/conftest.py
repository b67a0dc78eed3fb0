from __future__ import annotations

import pytest

#: Columns that operators use inside or return, as extra input columns of other types.
CLASHES = ("class_key", "rk", "batch", "label", "kept", "topic", "shard", "slot", "held_out", "n_words", "host", "score", "weight")


@pytest.fixture(scope="session")
def documents(spark):
    """Build a documents table from (doc_id, text) or (doc_id, text, lang, source) rows, with clashing extra columns."""

    def build(rows):
        full = [(*r, *(("en", f"src{(r[0] or 0) % 3}") if len(r) == 2 else ()), None if r[1] is None else len(r[1]), *("x" for _ in CLASHES)) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)).repartition(3)

    return build


LONG = "word " * 30_000

ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "one two"), (5, "one two"), (6, "one two"), (None, "one two"),
    (7, "x" * 5000), (8, "\x00 nul é 日本   end"), (9, "the same words again and again " * 40), (10, "the same words again and again " * 40),
]


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD)


@pytest.fixture(scope="session")
def empty(documents):
    return documents([(1, "x")]).limit(0)
