"""Repeated passages by a run-compressed Burrows-Wheeler index.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else too.

1.  Windows of LENGTH bytes are grouped into segments: consecutive windows that share
    the same smallest hash among their ``GRAM``-byte substrings (the anchor).  Equal
    windows have equal anchors at equal distances, so they meet under one hash.
2.  Equal segments fold to one with a count; all windows of a repeated one repeat.
3.  Segments that share their anchor with a different segment are indexed, in blocks by
    anchor hash.  A block takes a few whole anchors at a time, about ``INDEX_BYTES``,
    sorts their suffixes, keeps the Burrows-Wheeler transform as runs with suffix
    positions and common-prefix lengths sampled at the run ends, and streams each
    segment in text order: within a run the length of the longest match falls by one
    per byte, so the samples give every matching statistic.  Matches of LENGTH or more
    mark their windows.
4.  Anchors with over ``CROWD`` different segments (a passage in very many different
    surroundings) would make one block too large; their windows are counted by the
    hash of their own bytes instead, dealt by that hash, with the same result.
5.  Marks join back to their texts, which are cut and hashed.

Scale: all routing is by hash with map-side counts; blocks hold about ``BLOCK_BYTES``;
texts are shuffled twice, once for the segments to index, once for the cut.  Segments of
an anchor or digest met over ``HOT`` times are not dealt by it: such keys are broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import stash, table
from tilewright.llm.kernel import Chunk, chunks, mix, powers, rolling

LENGTH = 400
GRAM = 200
BLOCK_BYTES = 2 << 20
INDEX_BYTES = 512 << 10
CROWD = 3000
CROWD_WINDOWS = 4_000_000
HOT = 2000
_PLACE_BITS = np.uint64(28)
_SHARES = 16  # of a range of counted windows, one after the other
_PACKED = 7  # symbols of nine bits in a first sorting key

# ---------------------------------------------------------------- segments


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values, by prefix and suffix minima of blocks."""
    n = len(values)
    fill = np.full((-n) % width, np.iinfo(np.uint64).max, np.uint64)
    rows = np.concatenate([values, fill]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(chunk: Chunk, length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, anchor hashes, digests, first and last window start) for texts of at least ``length`` bytes."""
    data = chunk.data
    if len(data) < length:
        return
    sums = rolling(data)
    down = powers(len(sums))[1]
    hashes = mix((sums[gram:] - sums[:-gram]) * down[: len(sums) - gram])
    for k in range(len(chunk)):
        a, b = int(chunk.offsets[k]), int(chunk.offsets[k + 1])
        if b - a < length:
            continue
        if (b - a) >> int(_PLACE_BITS):
            raise ValueError(f"a text of {b - a} bytes: places hold at most {1 << int(_PLACE_BITS)}")
        own = hashes[a : b - gram + 1]
        # the place in the low bits: of equal hashes the leftmost wins, in equal windows the same one
        ranked = ((own >> _PLACE_BITS) << _PLACE_BITS) | np.arange(len(own), dtype=np.uint64)
        lowest = sliding_minimum(ranked, length - gram + 1)
        first = np.flatnonzero(np.concatenate(([True], lowest[1:] != lowest[:-1])))
        last = np.append(first[1:], len(lowest)) - 1
        anchor = (lowest[first] & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
        span = last - first + length
        digest = mix((sums[a + first + span] - sums[a + first]) * down[a + first])
        digest = mix(digest ^ mix((span * 100_003 + anchor - first).astype(np.uint64)))
        yield chunk.rows.start + k, own[anchor].view(np.int64), digest.view(np.int64), first, last


def _segments(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                rows = list(segments(chunk, length, gram))
                if not rows:
                    continue
                owner = np.concatenate([np.full(len(h), row) for row, h, _, _, _ in rows])
                cols = [np.concatenate([r[i] for r in rows]) for i in range(1, 5)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32))],
                    ["rk", "anchor", "digest", "first", "last"],
                )

    return run


# ---------------------------------------------------------------- index


def suffix_order(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffix array.  ``symbols``: bytes plus one, 0 closes a segment; ``left``: symbols up to and with that 0.

    Two closing zeros never tie: the one earlier in the text is smaller.
    """
    n = len(symbols)
    key = np.zeros(n, np.int64)
    for k in range(_PACKED):
        key[: n - k] += np.where(left[: n - k] > k, symbols[k:], 0).astype(np.int64) << (9 * (_PACKED - 1 - k))
    by_key = np.argsort(key)
    key = key[by_key]
    order = by_key.astype(np.int32)
    del by_key
    closing = np.flatnonzero(left[order] <= _PACKED)
    order[closing] = order[closing][np.lexsort((order[closing], key[closing]))]
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    fresh[closing] = True
    del key
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), np.int32(0)))
    depth = _PACKED
    tied = np.flatnonzero(~fresh | np.append(~fresh[1:], False)).astype(np.int32)
    while len(tied):
        at = order[tied]
        pair = (rank[at].astype(np.int64) << 32) | rank[at + depth]  # a tied suffix has over ``depth`` symbols left
        inner = np.argsort(pair)
        at, pair = at[inner], pair[inner]
        order[tied] = at
        fresh = np.concatenate(([True], pair[1:] != pair[:-1]))
        rank[at] = np.maximum.accumulate(np.where(fresh, tied, np.int32(0)))
        tied = tied[~fresh | np.append(~fresh[1:], False)]
        depth *= 2
    return order


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the texts at a and b, at most ``room``; ``words``: eight bytes from each place."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        gap = words[a[live] + out[live]] ^ words[b[live] + out[live]]
        low = gap & (~gap + np.uint64(1))
        same = np.where(gap == 0, 8, (np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64)) // 8)
        out[live] += same
        live = live[(gap == 0) & (out[live] < room[live])]
    return np.minimum(out, room)


class RunIndex:
    """Run-length Burrows-Wheeler transform of segments, with samples at the run ends."""

    def __init__(self, parts: list[bytes]):
        lengths = np.array([len(p) + 1 for p in parts], np.int64)
        self.starts = np.cumsum(lengths) - lengths
        joined = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
        self.left = np.repeat((self.starts + lengths).astype(np.int32), lengths) - np.arange(len(joined), dtype=np.int32)
        symbols = joined.astype(np.uint16) + 1
        symbols[self.starts + lengths - 1] = 0
        order = suffix_order(symbols, self.left)
        before = symbols[order - 1].astype(np.int32)  # the transform; a segment's first byte follows a closing zero
        before[before == 0] = -1 - order[before == 0]  # closings differ from each other
        heads = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        self.runs = len(heads)
        self.run_symbols = before[heads]
        self.head_places = order[heads]
        self.tail_places = order[np.append(heads[1:], len(order)) - 1]
        padded = np.concatenate((joined, np.zeros(8, np.uint8)))
        words = np.zeros(len(joined) + 1, np.uint64)
        for k in range(8):
            words |= padded[k : k + len(words)].astype(np.uint64) << np.uint64(8 * k)
        a, b = self.tail_places[:-1], self.head_places[1:]
        shared = common_prefix(words, a, b, np.minimum(self.left[a], self.left[b]) - 1)
        self.head_shared = np.concatenate(([0], shared))  # with the suffix before the run
        self.tail_shared = np.append(shared, 0)  # with the suffix after it
        self.size = len(joined)

    def statistics(self) -> np.ndarray:
        """Per byte the length of the longest match that starts here and elsewhere, streamed from the samples.

        Inside a run a suffix's neighbour in the order is its predecessor's neighbour
        moved by one, so the shared length falls by one per byte since the last sample.
        """
        out = np.zeros(self.size, np.int32)
        at = np.arange(self.size, dtype=np.int32)
        for places, shared in ((self.head_places, self.head_shared), (self.tail_places, self.tail_shared)):
            sampled = np.full(self.size, -1, np.int32)
            sampled[places] = shared
            last = np.maximum.accumulate(np.where(sampled >= 0, at, np.int32(0)))
            out = np.maximum(out, sampled[last] - (at - last))
        return out


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and last places of the runs of true values."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


MARKS = "rk long, lo int, hi int"


def _marks(rows: list[tuple[int, int, int]]) -> pa.Table:
    names, kinds = ("rk", "lo", "hi"), (pa.int64(), pa.int32(), pa.int32())
    return pa.table({n: pa.array([int(r[i]) for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def whole_anchors(anchors: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows sorted by anchor, each of whole anchors and of at most ``most`` bytes, or of one larger anchor."""
    ends = np.append(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, len(anchors)) if len(anchors) else ()
    total = np.append(0, np.cumsum(sizes))
    at = held = 0
    for end in ends:
        if held > at and total[end] - total[at] > most:
            yield slice(at, held)
            at = held
        held = int(end)
    if held > at:
        yield slice(at, held)


def _indexed(length: int, most: int = INDEX_BYTES):
    """A block's marks.  Equal windows share an anchor, so each index needs only whole anchors, and holds few at a time."""

    def run(block: pa.Table) -> pa.Table:
        block = block.select(["anchor", "rk", "first", "copies", "bytes"]).sort_by("anchor")
        out = []
        for some in whole_anchors(block.column("anchor").to_numpy(), pc.binary_length(block.column("bytes")).to_numpy(), most):
            rks, firsts, copies, parts = (c.to_pylist() for c in block.slice(some.start, some.stop - some.start).columns[1:])
            index = RunIndex(parts)
            long = index.statistics() >= length
            for start, part, rk, first, count in zip(index.starts, parts, rks, firsts, copies, strict=True):
                if count == 1:
                    lows, highs = runs_of(long[start : start + len(part) - length + 1])
                    out += [(rk, first + a, first + b) for a, b in zip(lows, highs, strict=True)]
        return _marks(out)

    return run


def _crowded(length: int, ranges: int):
    """Windows of crowded segments as (range, segment, packed starts and hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"range": [], "rk": [], "first": [], "copies": [], "starts": [], "hashes": []}
            for rk, first, copies, part in zip(*(batch.column(c).to_pylist() for c in ("rk", "first", "copies", "bytes")), strict=True):
                data = np.frombuffer(part, np.uint8)
                sums = rolling(data)
                n = len(data) - length + 1
                hashes = mix((sums[length : length + n] - sums[:n]) * powers(len(sums))[1][:n])
                place = ((hashes >> np.uint64(24)) % np.uint64(ranges)).astype(np.int64)
                for r in np.unique(place):
                    some = np.flatnonzero(place == r)
                    for k, v in zip(out, (int(r), rk, first, copies, some.astype(np.int32).tobytes(), hashes[some].tobytes()), strict=True):
                        out[k].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return run


def _counted(parts: pa.Table) -> pa.Table:
    rows = parts.to_pylist()
    each = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
    weights = np.repeat(np.array([min(r["copies"], 2) for r in rows], np.uint8), [len(x) for x in each])
    hashes = np.concatenate(each)
    share = (hashes & np.uint64(_SHARES - 1)).astype(np.uint8)
    often = np.zeros(len(hashes), bool)
    for k in range(_SHARES):  # equal hashes fall into one share
        some = np.flatnonzero(share == k)
        _, which = np.unique(hashes[some], return_inverse=True)
        often[some] = np.bincount(which, weights=weights[some])[which] >= 2
    out, at = [], 0
    for r, own in zip(rows, each, strict=True):
        starts = np.frombuffer(r["starts"], np.int32)[often[at : at + len(own)]]
        at += len(own)
        if r["copies"] == 1 and len(starts):
            cut = np.concatenate(([0], np.flatnonzero(np.diff(starts) != 1) + 1, [len(starts)]))
            out += [(r["rk"], r["first"] + starts[a], r["first"] + starts[b - 1]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return _marks(out)


def _sliced(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("rk", "anchor", "copies", "crowded", "first", "bytes")}
            for rk, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                for w in wanted:
                    values = (rk, w["anchor"], w["copies"], w["crowded"], w["first"], data[w["first"] : w["last"] + length])
                    for k, v in zip(out, values, strict=True):
                        out[k].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, spans, digests, kept_texts = [], [], [], [], []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                gone = np.zeros(len(data) + 1, np.int64)
                for m in marks or ():
                    gone[m["lo"]] += 1
                    gone[m["hi"] + length] -= 1
                flags = np.cumsum(gone[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~flags].tobytes() if marks else data
                n.append(len(data))
                removed.append(len(data) - len(kept))
                spans.append(len(runs_of(flags)[0]) if marks else 0)
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def with_keys(rows: DataFrame, keys: DataFrame, on: list[str], count: str, hot: int = HOT) -> DataFrame:
    """Inner join of ``rows`` with ``keys``, which holds a key once and in ``count`` how many rows have it.

    Rows of a key with over ``hot`` of them stay where they are, as one task would get them all; such
    keys, at most a row in ``hot``, are broadcast.
    """
    many = F.broadcast(keys.where(F.col(count) > hot))
    few = rows.join(many, on, "left_anti").join(keys.where(F.col(count) <= hot), on)
    return few.unionByName(rows.join(many, on))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left).

    A null text counts as empty; a text shorter than ``length`` loses nothing.  Repeated
    rows repeat each other's text and lose it.  Cuts can fall inside a character, so
    ``kept`` is binary.  Texts of up to 256 MB; extra columns are not used.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("rk", F.xxhash64("doc_id", "text"))
    found = stash(rows.select("rk", "text").mapInArrow(_segments(length, gram), "rk long, anchor long, digest long, first int, last int"), "segments")
    # anchors met once, the bulk, leave before anything is folded
    met = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    found = stash(with_keys(found, met, ["anchor"], "n", hot).drop("n"), "met")
    folded = stash(
        found.groupBy("anchor", "digest").agg(F.count("*").alias("copies"), F.min(F.struct("rk", "first", "last")).alias("one")).select("anchor", "digest", "copies", "one.*"),
        "folded",
    )
    copied = folded.where("copies > 1").select("anchor", "digest", "copies")
    repeated = with_keys(found, copied, ["anchor", "digest"], "copies", hot).select("rk", F.col("first").alias("lo"), F.col("last").alias("hi"))
    shared = folded.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).where("kinds > 1 AND least = 1")
    asked = stash(with_keys(folded, shared, ["anchor"], "kinds", hot).select("rk", "anchor", "copies", (F.col("kinds") > crowd).alias("crowded"), "first", "last"), "asked")
    sizes = asked.agg(
        F.coalesce(F.sum(F.when(~F.col("crowded"), F.col("last") - F.col("first") + length)), F.lit(0)).alias("index"),
        F.coalesce(F.sum(F.when(F.col("crowded"), F.col("last") - F.col("first") + 1)), F.lit(0)).alias("windows"),
    ).first()
    wanted = asked.groupBy("rk").agg(F.collect_list(F.struct("anchor", "copies", "crowded", "first", "last")).alias("wanted"))
    # repeated rows share an rk: one of them serves
    slices = rows.join(wanted, "rk").select("rk", "text", "wanted").mapInArrow(
        _sliced(length), "rk long, anchor long, copies long, crowded boolean, first int, bytes binary"
    ).dropDuplicates(["rk", "first"])
    slices = stash(slices, "slices")
    blocks = max(1, ceil(sizes["index"] / BLOCK_BYTES))
    indexed = (
        slices.where("not crowded")
        .withColumn("block", F.pmod("anchor", F.lit(blocks)))
        .groupBy("block")
        .applyInArrow(_indexed(length), MARKS)
    )
    marks = repeated.unionAll(indexed)
    if sizes["windows"]:
        ranges = max(1, ceil(sizes["windows"] / CROWD_WINDOWS))
        counted = slices.where("crowded").mapInArrow(_crowded(length, ranges), "range long, rk long, first int, copies long, starts binary, hashes binary")
        marks = marks.unionAll(counted.groupBy("range").applyInArrow(_counted, MARKS))
    by_text = marks.groupBy("rk").agg(F.collect_set(F.struct("lo", "hi")).alias("marks"))
    return (
        rows.join(by_text, "rk", "left")
        .select("doc_id", "text", "marks")
        .mapInArrow(_cut(length), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    )


def op2_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
