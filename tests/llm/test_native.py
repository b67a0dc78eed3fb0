"""Sharding, mixing and tool calls."""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tilewright.llm import mixing as M
from tilewright.llm import sharding as S
from tilewright.llm import toolcalls as T
from tilewright.llm.common import components


def check_shards(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    counts = [len(by[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_ring_follows_a_sequential_walk(spark):
    """Each round: rows ask the next open shard clockwise, a shard takes the smallest (bucket, turn) up to its room."""
    shards, buckets, seed = 5, 8, 7
    rows = spark.range(203).select(F.col("id").alias("doc_id"))
    got = {r.doc_id: (r.shard, r.slot) for r in S.ring_shards(rows, F.col("doc_id"), shards, virtual_nodes=6, buckets=buckets, seed=seed).collect()}
    keys = rows.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(S.CELLS)).alias("cell"), F.xxhash64("doc_id", F.lit(seed + 1)).alias("turn")).collect()
    shard, node = F.floor(F.col("id") / 6).cast("int"), (F.col("id") % 6).cast("int")
    nodes = spark.range(shards * 6).select(shard.alias("s"), F.pmod(F.xxhash64(shard, node, F.lit(seed)), F.lit(S.CELLS)).alias("cell")).collect()
    room, taken, want, rest = {s: 203 // shards + (s < 203 % shards) for s in range(shards)}, Counter(), {}, keys
    while rest:
        spots = sorted((n.cell, n.s) for n in nodes if taken[n.s] < room[n.s])
        asked = defaultdict(list)
        for k in rest:
            asked[next((s for c, s in spots if c >= k.cell), spots[0][1])].append(k)
        rest = []
        for s, ks in asked.items():
            ks.sort(key=lambda k: (k.turn % buckets, k.turn))
            free = room[s] - taken[s]
            for k in ks[:free]:
                want[k.doc_id] = (s, taken[s])
                taken[s] += 1
            rest += ks[free:]
    assert got == want


def test_ring_moves_few_rows(spark):
    rows = lambda n: {r.doc_id: r.shard for r in S.ring_shards(spark.range(n).select(F.col("id").alias("doc_id")), F.col("doc_id"), 8).collect()}
    a, b = rows(2000), rows(2040)
    assert sum(a[k] != b[k] for k in a) < 0.1 * len(a)


def test_ring_moves_rows_to_a_new_shard(spark):
    """From 16 to 17 shards every shard gives up a 17th; hard capacities pass some rows on, far fewer than dealing anew would."""
    rows = lambda n: {r.doc_id: r.shard for r in S.ring_shards(spark.range(3400).select(F.col("id").alias("doc_id")), F.col("doc_id"), n).collect()}
    a, b = rows(16), rows(17)
    moved = sum(a[k] != b[k] for k in a) / len(a)
    assert sum(v == 16 for v in b.values()) == 200 and 1 / 17 <= moved < 0.3


def test_rows_without_ids_spread(documents):
    docs = documents([(None, f"text {i}") for i in range(160)])
    rows = S.shard_documents(docs, 16).collect()
    check_shards(rows, 16)


def test_components_of_a_long_path(spark):
    """A path of 10,000 nodes over many partitions: no round limit, and plans stay small."""
    edges = spark.range(9_999, numPartitions=32).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(32, F.xxhash64("a"))
    found = components(edges, "a", "b")
    assert found.count() == 10_000 and found.select("label").distinct().collect() == [(0,)]


def test_shards_of_odd_rows(odd, empty):
    rows = S.shard_documents(odd, 4).collect()
    assert len(rows) == 12
    check_shards(rows, 4)
    assert {r.size for r in rows if r.doc_id in (1, 2)} == {1} and {r.text_crc32 for r in rows if r.doc_id in (1, 2)} == {0}
    assert S.shard_documents(empty).count() == 0


def naive_rake(cells, dims, goals, sweeps=400):
    total = sum(cells.values())
    w = {k: v / total for k, v in cells.items()}
    for _ in range(sweeps):
        for d in range(dims):
            sums = Counter()
            for k, v in w.items():
                sums[k[d]] += v
            w = {k: v * goals[d][k[d]] / sums[k[d]] for k, v in w.items()}
    return w


def test_rake_equals_naive_fit(spark):
    rng = random.Random(3)
    cells = {(s, l, t): rng.randint(1, 900) for s in "abc" for l in ("en", "de", "xx") for t in "pq" if (s, l) != ("a", "xx")}
    table = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens long")
    marginals = (M.Marginal("source", temper=0.5), M.Marginal("lang", {"en": 0.5, "de": 0.3, "zz": 0.4}, rest=0.2), M.Marginal("topic", {"p": 0.5, "q": 0.5}))
    total = sum(cells.values())
    share = lambda d: {v: sum(n for k, n in cells.items() if k[d] == v) / total for v in {k[d] for k in cells}}
    root = {k: v**0.5 for k, v in share(0).items()}
    goals = [{k: v / sum(root.values()) for k, v in root.items()}, {"en": 0.5, "de": 0.3, "xx": 0.2}, {"p": 0.5, "q": 0.5}]
    want = naive_rake(cells, 3, goals)
    for r in M.rake(table, marginals).collect():
        assert r.weight == pytest.approx(want[(r.source, r.lang, r.topic)], rel=1e-5)


def test_mix_keeps_expected_tokens(documents):
    rng = random.Random(1)
    docs = documents([(i, "w " * rng.randint(1, 60), "en" if i % 3 else "fr", f"s{i % 2}") for i in range(1500)])
    marginals = (M.Marginal("source", {"s0": 0.3, "s1": 0.7}), M.Marginal("lang", {"en": 0.6, "fr": 0.4}))
    rows = M.mix(docs, marginals, keep_share=0.3).collect()
    expected = Counter()
    for r in rows:
        expected[r.source] += r.n_tokens * r.probability
        expected[r.lang] += r.n_tokens * r.probability
        assert r.kept == (r.draw < r.probability) and 0 <= r.probability <= 1
    both = expected["s0"] + expected["s1"]
    assert expected["s1"] / both == pytest.approx(0.7, abs=1e-4) and expected["fr"] / both == pytest.approx(0.4, abs=1e-4)
    assert both <= 0.3001 * sum(r.n_tokens for r in rows)


def test_rare_values_leave_the_kept_share(documents):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(40, 60), ("en", "de", "fr", "es")[min(i % 10, 3)], f"s{i % 7}") for i in range(1400)]
    share = lambda extra: (lambda got: sum(r.n_tokens * r.probability for r in got) / sum(r.n_tokens for r in got))(M.mix(documents(rows + extra)).collect())
    plain = share([])
    assert share([(9000, "w " * 20, "xx", "s0")]) == pytest.approx(plain, rel=0.05)
    assert share([(9000, "w " * 20, None, "s0")]) == pytest.approx(plain, rel=0.05)
    assert share([(9000, "w " * 20, "en", "tiny")]) == pytest.approx(plain, rel=0.05)


def test_clipped_cells_hand_on_their_share(documents):
    docs = documents([(i, "w " * 50, "en", "big") for i in range(1000)] + [(2000, "w " * 20, "en", "tiny")])
    rows = M.mix(docs, (M.Marginal("source", {"big": 0.9, "tiny": 0.1}), M.Marginal("lang", {"en": 1.0})), keep_share=0.5).collect()
    assert {r.probability for r in rows if r.source == "tiny"} == {1.0}
    assert sum(r.n_tokens * r.probability for r in rows) == pytest.approx(0.5 * 50_020, rel=1e-6)


def test_mix_of_odd_rows(odd, empty, documents):
    rows = M.mix(odd).collect()
    assert len(rows) == 12 and all(r.n_tokens == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert {r.n_tokens for r in rows if r.doc_id == 4} == {30_000}
    assert M.mix(empty).count() == 0
    assert M.mix(documents([(1, None, None, None), (2, "a b", None, None)])).count() == 2


SCHEMAS = {"add": {"properties": {"a": {"kind": "integer", "minimum": 0, "maximum": 9}, "b": {"kind": "number"}, "note": {"kind": "string", "max_length": 3, "enum": ["x", "yy"]}}, "required": ["a"]}}


def linked(spark, calls, results):
    c = spark.createDataFrame(calls, "call_id string, position long, name string, arguments string, needs array<string>, status string")
    r = spark.createDataFrame(results, "call_id string, position long, content string, errors string")
    return {x.call_id: x for x in T.link_calls(c, r, SCHEMAS).collect()}


def test_validation(spark):
    cases = {
        '{"a": 1, "b": 2.5, "note": "x"}': [], '{"a": "1"}': ["type:a"], '{"b": 1}': ["missing:a"], '{"a": 11, "note": "long"}': ["enum:note", "max_length:note", "maximum:a"],
        '{"a": -1, "z": 0}': ["minimum:a", "unknown:z"], "[1]": ["not_an_object"], "not json": ["not_an_object"], '{"a": null}': ["type:a"],
    }
    rows = [(str(i), i, "add", a, None, "") for i, a in enumerate(cases)]
    got = linked(spark, [*rows, ("n", 90, "gone", "{}", None, ""), ("m", 91, None, "{}", None, "")], [("0", 50, "r", "")])
    for i, errors in enumerate(cases.values()):
        assert got[str(i)].errors == errors, list(cases)[i]
    assert got["0"].status == "ok" and got["1"].status == "missing_result" and got["n"].errors == ["unknown_tool:gone"] and got["m"].errors == ["no_tool"]


def test_order_and_status(spark):
    ok = '{"b": 1, "a": 1}'
    chain = [(f"c{i}", i, "add", ok, [f"c{i - 1}"] if i else None, "") for i in range(40)]
    calls = [*chain, ("d", 50, "add", ok, ["c3", "c39"], ""), ("e", 51, "add", ok, ["d", "nowhere"], ""), ("p", 52, "add", ok, ["q"], ""), ("q", 53, "add", ok, ["p"], ""),
             ("two", 60, "add", ok, None, ""), ("two", 59, "add", '{"a": "late"}', None, ""), (None, 61, "add", ok, None, "")]
    results = [*((f"c{i}", i + 100, "r", "") for i in range(40)), ("d", 1, "early", ""), ("orphan", 5, "o", ""), ("two", 70, "s", ""), ("two", 69, "t", ""), (None, 1, "n", "")]
    got = linked(spark, calls, results)
    assert [got[f"c{i}"].depth for i in range(40)] == list(range(40)) and got["d"].depth == 40
    assert {k: got[k].status for k in ("c0", "d", "e", "p", "q", "orphan", "two")} == {"c0": "ok", "d": "result_before_call", "e": "unmet_need", "p": "cycle", "q": "cycle", "orphan": "orphan_result", "two": "invalid_arguments"}
    assert (got["two"].n_calls, got["two"].n_results) == (2, 2)
    body = json.loads(got["c1"].json)
    assert got["c1"].json == T.canonical(body) and list(body) == sorted(body) and body["arguments"] == {"a": 1, "b": 1}


@pytest.mark.parametrize(("calls", "one_task"), [(200, 200_000), (12, 0)])
def test_long_graphs_of_two_needs(spark, monkeypatch, calls, one_task):
    monkeypatch.setattr(T, "ONE_TASK_LINKS", one_task)
    rows = [(f"c{i}", i, "add", '{"a": 1}', [f"c{k}" for k in (i - 1, i - 2) if k >= 0], "") for i in range(calls)]
    got = linked(spark, [*rows, ("p", 900, "add", '{"a": 1}', ["q", "c3"], ""), ("q", 901, "add", '{"a": 1}', ["p"], "")], [("c0", 999, "r", "")])
    assert [got[f"c{i}"].depth for i in range(calls)] == list(range(calls))
    assert {k for k, r in got.items() if r.status == "cycle"} == {"p", "q"}


@pytest.mark.parametrize("one_task", [200_000, 0])
def test_links_equal_brute_force(spark, monkeypatch, one_task):
    """Random graphs with missing needs, cycles, repeats, orphans and early results."""
    monkeypatch.setattr(T, "ONE_TASK_LINKS", one_task)
    rng = random.Random(7)
    names = [f"k{i}" for i in range(45)]
    calls = [(n, rng.randint(0, 90), "add", '{"a": 1}', rng.sample([*names[: i + (rng.random() < 0.15) * 3], "gone"], rng.choice((0, 0, 1, 1, 2))) if i > 1 else [], "") for i, n in enumerate(names)]
    calls[10] = (*calls[10][:4], ["k20", "k1"], "")
    calls[20] = (*calls[20][:4], ["k10"], "")
    results = [(n, rng.randint(0, 120), "r", "") for n in [*names, "lost"] if rng.random() < 0.7]
    got = linked(spark, calls, results)
    needs = {c[0]: {n for n in c[4] if n in names} for c in calls}
    depth = {}
    while True:
        ready = {c: max((depth[n] + 1 for n in needs[c]), default=0) for c in needs if c not in depth and all(n in depth for n in needs[c])}
        if not ready:
            break
        depth |= ready
    answered = {r[0]: r[1] for r in results}
    for c in calls:
        want = "ok" if c[0] in answered else "missing_result"
        want = "result_before_call" if answered.get(c[0], 999) < c[1] else want
        want = "unmet_need" if "gone" in c[4] else want
        want = "cycle" if c[0] not in depth else want
        assert (got[c[0]].depth, got[c[0]].status) == (depth.get(c[0]), want)
    assert set(got) == set(names) | ({"lost"} if "lost" in answered else set()) and all(got[k].status == "orphan_result" for k in got if k not in needs)
    assert 0 < len(depth) < len(names)


def test_empty_chat(spark, data):
    rows = spark.read.parquet(f"{data}/conversations.parquet")
    assert T.link_calls(*T.chat_calls(rows.limit(0)), T.CHAT_SCHEMAS).count() == 0
    found = T.op9_links(spark, data).collect()
    users = {f"{r.conv_id}:{r.turn}" for r in rows.where("role = 'user'").collect()}
    assert users == {r.call_id for r in found if r.status != "orphan_result"}
