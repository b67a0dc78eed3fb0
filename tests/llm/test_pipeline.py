"""The pipeline's stages against brute force on the smallest tables, and on odd inputs."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_native import check_shards, naive_rake
from tests.llm.test_text import WORD, naive_components, prior_rates
from tilewright.llm import common as C
from tilewright.llm.common import unit_hash
from tilewright.llm.mixing import DEFAULT_MARGINALS, TOPIC_MARKERS
from tilewright.llm.quality import BAD_RATE


@pytest.fixture(scope="module")
def steps(spark, data):
    """Rows after each stage, every stage on its predecessor's written rows."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs.collect()]
    for name, stage in P.STAGES:
        docs = P.stash(stage(spark, docs, data), name)
        out.append(docs.collect())
    return out


def failures(text):
    """Whether the base rules fail, and how many soft rules."""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + m for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for m in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    chars, upper, letters = sum(map(len, w)), len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
    soft = (5 * len(re.findall(r"[#*$%&|<>]", text)) > len(w), 10 * (len(lines) - len(set(lines))) > 6 * len(lines), 10 * upper > 7 * letters > 0, not 2 * len(w) <= chars <= 20 * len(w))
    return len(w) < 50 or 100 * len(covered) > 50 * len(w), sum(soft)


def test_quality(steps):
    found = {r.doc_id: failures(r.text) for r in steps[0]}
    hosts = {}
    for r in steps[0]:
        n, f = hosts.get(r.source, (0, 0))
        hosts[r.source] = (n + 1, f + (found[r.doc_id][0] or found[r.doc_id][1] > 0))
    rates = prior_rates(hosts)
    passes = lambda r: not found[r.doc_id][0] and found[r.doc_id][1] < (1 if rates[r.source] > BAD_RATE else 2)
    assert sorted(r.doc_id for r in steps[1]) == sorted(r.doc_id for r in steps[0] if passes(r))
    assert steps[1][0].asDict().keys() == steps[0][0].asDict().keys()


def test_near_duplicates(steps):
    rows = sorted(steps[1], key=lambda r: r.doc_id)
    heads = {rows[label].doc_id for _, label, _ in naive_components([r.text for r in rows], 5, 80)}
    assert sorted(r.doc_id for r in steps[2]) == sorted(heads)


def test_benchmark_free(spark, data, steps):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    windows = lambda w: {tuple(w[k : k + 8]) for k in range(len(w) - 7)} or {tuple(w)}
    items = [windows(words(r.text)) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    dirty = {r.doc_id for r in steps[2] for own in (windows(words(r.text)),) if any(2 * len(i & own) >= len(i) for i in items)}
    assert {r.doc_id for r in steps[3]} == {r.doc_id for r in steps[2]} - dirty


def test_mixture(spark, steps):
    rows = steps[3]
    topic = lambda t: next((n for n, marks in TOPIC_MARKERS if any(m in t for m in marks)), "prose")
    cells, key = Counter(), {}
    for r in rows:
        key[r.doc_id] = (r.source, r.lang, topic(r.text))
        cells[key[r.doc_id]] += len(WORD.findall(r.text))
    total, goals = sum(cells.values()), []
    for d, m in enumerate(DEFAULT_MARGINALS):
        seen = Counter()
        for k, n in cells.items():
            seen[k[d]] += n / total
        goal = {v: s**m.temper for v, s in seen.items()} if m.shares is None else {v: m.shares[v] for v in seen}
        goals.append({v: g / sum(goal.values()) for v, g in goal.items()})
    weights = naive_rake(cells, 3, goals)
    scale = min(0.8 * total, 1 / max(weights[k] / n for k, n in cells.items()))
    draws = {r.doc_id: r.u for r in spark.createDataFrame([(i,) for i in key], "doc_id long").select("doc_id", unit_hash(11, "doc_id").alias("u")).collect()}
    clear = {i for i, k in key.items() if abs(draws[i] - scale * weights[k] / cells[k]) > 1e-4}
    want = {i for i in clear if draws[i] < scale * weights[key[i]] / cells[key[i]]}
    assert {r.doc_id for r in steps[4]} & clear == want and len(clear) > 0.9 * len(key)


def test_shards(spark, data, steps):
    check_shards(steps[5], 16)
    assert sorted(r.doc_id for r in steps[5]) == sorted(r.doc_id for r in steps[4])
    mark = C.written(spark)
    assert sorted(P.run(spark, data).collect()) == sorted(steps[5])
    names = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in C._written[spark.sparkContext.applicationId][mark:]]
    assert names[:4] == ["quality", "near_duplicates", "benchmark_free", "mixture"] and set(names[4:]) <= {"step"}  # what stages wrote on their way is gone


def test_stages_on_odd_rows(spark, data, odd, empty):
    for name, stage in P.STAGES:
        out = stage(spark, odd, data)
        ids = [r.doc_id for r in out.collect()]
        assert stage(spark, empty, data).count() == 0
        assert name == "shards" or set(out.columns) >= {"doc_id", "text", "lang", "source", "n_chars"}
        assert name != "quality" or 1 not in ids


def test_repeated_rows_leave_one(spark, data, documents):
    text = "one two three four five six seven " + "eight nine ten eleven twelve"
    docs = documents([(3, text), (3, text), (4, text), (5, text + " more"), (6, "else " * 3), (None, "quite another text of five words"), (None, "quite another text of five words")])
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in P.near_duplicates(spark, docs, data).collect()) == [(False, 3), (False, 6), (True, 0)]


def test_repeated_rows_leave_unlinked_ones(spark, data, documents):
    text = "one two three four five six seven " + "eight nine ten eleven twelve"
    apart = ["alpha beta gamma delta epsilon zeta", "red green blue black white grey", "north east south west up down", "iron gold lead zinc tin silver"]
    docs = documents([(3, text), (3, text), (3, apart[0]), (5, apart[1]), (5, apart[2]), (None, apart[3]), (None, "yes " + apart[0][::-1])])
    got = sorted((r.doc_id or 0, r.text) for r in P.near_duplicates(spark, docs, data).collect())
    assert got == sorted([(3, text), (3, apart[0]), (5, apart[1]), (5, apart[2]), (0, apart[3]), (0, "yes " + apart[0][::-1])])


def test_rows_fall_by_themselves(spark, data, documents):
    """Rows that share an id, or have none, are judged by their own host and text."""
    good = " ".join(f"{a}{b}x" for a in "abcdefghij" for b in "klmnopqrst")
    item = spark.read.parquet(f"{data}/benchmark.parquet").orderBy(F.length("text").desc()).first().text
    docs = documents([(None, good), (None, "short"), (7, good + " end"), (7, "short"), *((20 + i, f"{good} {i}") for i in range(60))])
    kept = [(r.doc_id, r.text) for r in P.quality(spark, docs, data).collect()]
    assert (None, good) in kept and (7, good + " end") in kept and not any(t == "short" for _, t in kept) and len(kept) == 62
    docs = documents([(None, good), (None, f"{good} {item} end"), (8, good), (8, f"lead {item}")])
    assert sorted((r.doc_id or 0, r.text) for r in P.benchmark_free(spark, docs, data).collect()) == [(0, good), (8, good)]
