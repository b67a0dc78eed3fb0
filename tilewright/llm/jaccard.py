"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

1.  Every text becomes its set of word n-grams (64-bit hashes).  Rows with the same set
    form one class, kept once with its row count.
2.  Peeling by size.  A class can link only if at least ``t * size`` of its n-grams
    occur in another class.  Columns (n-grams) are dealt to blocks by hash; a block
    counts its columns and reports, per class, how many are shared.  Classes below
    the bound leave; most documents of a corpus do, whatever passages they share.
3.  Signatures.  Two linked sets of sizes in one band differ in at most k n-grams, so
    if the columns are dealt to more than k slices, some non-empty slice holds
    exactly the same n-grams in both.  A class whose non-empty slices do not exceed k
    also gives each of its prefix n-grams.  Classes that share a signature meet in a
    group (connected components of class and smallest class per signature).
4.  Blocked product.  Each group's rows are dealt to tiles of at most ``TILE`` rows;
    every pair of tiles is one task that multiplies the two incidence blocks, adds up
    overlap counts, discards pairs below the size-derived bound and returns a spanning
    forest of the links with each class's number of links.  No pairs are emitted.  A
    row goes to as many tasks as its group has tiles, so the pairs of tiles take turns
    in rounds: the disk for them grows with the rows, not with the tiles.
5.  Components of the forest give the class ids.

Scale: shuffles carry packed hashes of n-grams once (4 bytes each), then signatures of
the survivors only.  The smallest member of a group is found by a map-side minimum, so
a signature or set that a third of all rows share is no hot key.  Distinct near copies
in one group cost tiles squared, spread over tasks; equal sets cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import components, settle, settle_narrow, table
from tilewright.llm.kernel import chunks, gram_hashes, mix, word_hashes

#: Rows of a tile: at least the first, growing with the group to the second once it has TILES tiles.
TILE_ROWS = (64, 1024)
TILES = 32
#: Pairs of tiles are multiplied in rounds that shuffle every set so many times on average, or so many bytes of sets if that is more.
COPIES_AT_ONCE = 3
ROUND_BYTES = 64 << 20
BLOCK_COLUMNS = 4_000_000
CLASSES_IN_RANGE = 50_000
FLUSH_COLUMNS = 500_000
NO_ID = -(1 << 63)
#: Bytes of a class key while columns are counted.  Classes that share a short key are counted as one and all stay if it
#: does; a link is lost only where a class's partners all share its short key, one in 2^48 per pair, as for equal hashes.
KEY_BYTES = 6


def overlap_needed(a, b, percent: int):
    """Smallest overlap with 100 * overlap >= percent * union, for set sizes a and b."""
    return -((-percent * (a + b)) // (100 + percent))


def band_of(size: int, percent: int) -> int:
    """Sizes fall in bands whose bounds grow by 100/percent, so linked sizes lie in one band or two neighbours."""
    band, low = 0, 1
    while True:
        high = max(low, (100 * low) // percent)
        if size <= high:
            return band
        band, low = band + 1, high + 1


def band_top(band: int, percent: int) -> int:
    low = 1
    for _ in range(band + 1):
        high = max(low, (100 * low) // percent)
        low = high + 1
    return high


def differing(size: int, percent: int) -> int:
    """Most n-grams by which two linked sets of at most this size each can differ."""
    return floor((100 - percent) * 2 * size / (100 + percent))


def gram_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes); a shorter text is one n-gram, one without words none."""
    for chunk in chunks(texts):
        words = chunk.words()
        hashes = word_hashes(chunk, words, lower=True)
        grams = gram_hashes(hashes, n)
        for k in range(len(chunk)):
            a, b = int(words.first[k]), int(words.first[k + 1])
            if b - a >= n:
                yield chunk.rows.start + k, np.unique(grams[a : b - n + 1])
            elif b > a:
                yield chunk.rows.start + k, gram_hashes(hashes[a:b], b - a) ^ np.uint64(b - a)
            else:
                yield chunk.rows.start + k, np.zeros(0, np.uint64)


def digest(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of a set; the first half names its class."""
    first = mix(grams).sum(dtype=np.uint64)
    second = mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(first.astype(np.int64)), int(second.astype(np.int64))


def _digests(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.zeros(len(batch), np.int64)
            first, second = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for row, grams in gram_sets(batch.column(1), n):
                size[row] = len(grams)
                first[row], second[row] = digest(grams)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(first), pa.array(second)], ["doc_id", "n_shingles", "class_key", "check"])

    return run


def short_keys(names: np.ndarray) -> np.ndarray:
    """The low KEY_BYTES bytes of class keys, one row each."""
    return np.ascontiguousarray(names, "<i8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]


def long_keys(packed: list[bytes]) -> np.ndarray:
    """Short keys as non-negative longs."""
    short = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, KEY_BYTES)
    names = np.zeros((len(short), 8), np.uint8)
    names[:, :KEY_BYTES] = short
    return names.view("<i8").ravel()


def _packed(keys: list[int], sets: list[np.ndarray], blocks: int) -> pa.RecordBatch:
    """One row per block: the class keys, their counts and their low hash halves that fall in it.

    With many blocks nearly every n-gram of a class falls into a block of its own, so keys
    and counts outweigh the hashes: keys go by KEY_BYTES, counts by one byte, a count over
    255 as the key again.
    """
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    grams = np.concatenate(sets)
    names = np.array(keys, np.int64)
    block = ((grams >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")  # keeps a class's n-grams together
    block, owner, low = block[order], owner[order], grams[order].astype(np.uint32)
    cut = np.searchsorted(block, np.arange(blocks + 1))
    out: dict[str, list] = {"block": [], "keys": [], "counts": [], "grams": []}
    for b in np.flatnonzero(np.diff(cut)):
        part = slice(cut[b], cut[b + 1])
        rows, counts = np.unique(owner[part], return_counts=True)
        out["block"].append(int(b))
        again = -(-counts // 255)  # a count over 255 takes several entries
        last = np.cumsum(again) - 1
        pieces = np.full(int(again.sum()), 255, np.uint8)
        pieces[last] = counts - 255 * (again - 1)
        out["keys"].append(short_keys(names[np.repeat(rows, again)]).tobytes())
        out["counts"].append(pieces.tobytes())
        out["grams"].append(low[part].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(out["block"], pa.int64()), *(pa.array(out[k], pa.binary()) for k in ("keys", "counts", "grams"))], list(out))


def _columns(n: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            for _, grams in gram_sets(batch.column(1), n):
                key = digest(grams)[0]
                if len(grams) and key not in seen:
                    seen[key] = grams
                    held += len(grams)
                if held >= FLUSH_COLUMNS:
                    yield _packed(list(seen), list(seen.values()), blocks)
                    seen, held = {}, 0
        if seen:
            yield _packed(list(seen), list(seen.values()), blocks)

    return run


def _shared(ranges: int):
    """For a block's columns: per class, how many of its n-grams here some other class holds, packed by class range."""

    def run(parts: pa.Table) -> pa.Table:
        names, shared = _shared_columns(parts)
        place, short = (names.view(np.uint64) % np.uint64(ranges)).astype(np.int64), short_keys(names)
        order = np.argsort(place, kind="stable")
        cut = np.searchsorted(place[order], np.arange(ranges + 1))
        full = [int(r) for r in np.flatnonzero(np.diff(cut))]
        pack = lambda x, r: x[order[cut[r] : cut[r + 1]]].tobytes()
        return pa.table(
            {"range": pa.array(full, pa.int64()), "keys": pa.array([pack(short, r) for r in full], pa.binary()), "shared": pa.array([pack(shared, r) for r in full], pa.binary())}
        )

    return run


def _summed(parts: pa.Table) -> pa.Table:
    names, which = np.unique(long_keys(parts.column("keys").to_pylist()), return_inverse=True)
    shared = np.frombuffer(b"".join(parts.column("shared").to_pylist()), np.uint32)
    return pa.table({"short_key": names, "shared": np.bincount(which, weights=shared, minlength=len(names)).astype(np.int64)})


def _shared_columns(parts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    grams = np.frombuffer(b"".join(parts.column("grams").to_pylist()), np.uint32)
    counts = np.frombuffer(b"".join(parts.column("counts").to_pylist()), np.uint8)
    names, which = np.unique(long_keys(parts.column("keys").to_pylist()), return_inverse=True)
    owner = np.repeat(which, counts).astype(np.uint64)
    ranked = np.unique((grams.astype(np.uint64) << np.uint64(32)) | owner)  # a class of several rows counts once
    low = ranked >> np.uint64(32)
    twin = np.zeros(len(ranked), bool)
    same = low[1:] == low[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    shared = np.bincount((ranked[twin] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(names))
    keep = shared > 0
    return names[keep], shared[keep].astype(np.uint32)


def signatures(grams: np.ndarray, percent: int) -> np.ndarray:
    """64-bit signatures of a set, at least one of which any linked set gives too."""
    size = len(grams)
    band = band_of(size, percent)
    out = []
    for scheme in range(max(band - 1, 0), band + 1):  # scheme s serves bands s and s + 1
        top = band_top(scheme + 1, percent)
        k = differing(top, percent)
        if k == 0:
            continue  # such sets link only if equal
        slices = max(k + 3, ceil(1.35 * (k + 1)))
        place = (mix(grams ^ np.uint64(scheme + 77)) % np.uint64(slices)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        place, ranked = place[order], mix(grams[order] + np.uint64(scheme))
        cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        sums = np.add.reduceat(ranked, cut)
        out.append(mix(sums ^ mix((place[cut] * 1_000_003 + scheme).astype(np.uint64))))
        if len(cut) <= k:  # too few slices to be sure of one: the prefix n-grams as well
            prefix = np.sort(mix(grams))[: size - int(overlap_needed(size, ceil(size * percent / 100), percent)) + 1]
            out.append(mix(prefix ^ np.uint64(0xABCDEF + scheme)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _signed(n: int, percent: int):
    """Signatures and n-grams of the rows whose set is the one asked for (column 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(2).to_pylist()
            keys, marks, sets = [], [], []
            for row, grams in gram_sets(batch.column(1), n):
                if digest(grams)[0] == asked[row]:
                    keys.append(asked[row])
                    marks.append(signatures(grams, percent).view(np.int64))
                    sets.append(grams.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(marks, pa.list_(pa.int64())), pa.array(sets, pa.binary())], ["class_key", "marks", "grams"])

    return run


def block_links(ids: np.ndarray, sides: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Spanning forest of the links between rows of side 0 and rows of side 1 (all pairs if one side), and linked copies per row.

    Overlaps accumulate in a dense count block, column by column of the shared n-grams.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = held[column] > 1
    owner, column = owner[keep], np.unique(column[keep], return_inverse=True)[1]
    width = int(column.max()) + 1 if len(column) else 0
    left = np.flatnonzero(sides == 0)
    right = np.flatnonzero(sides == 1) if (sides == 1).any() else left
    overlap = np.zeros((len(left), len(right)), np.float32)
    step = 4096
    for low in range(0, width, step):
        here = (column >= low) & (column < low + step)
        dense = np.zeros((len(sets), min(step, width - low)), np.float32)
        dense[owner[here], column[here] - low] = 1
        overlap += dense[left] @ dense[right].T
    need = overlap_needed(sizes[left][:, None], sizes[right][None, :], percent)
    linked = overlap >= np.maximum(need, 1)
    if right is left:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(sets), np.int64)
    links[left] += linked @ copies[right]
    if right is not left:
        links[right] += copies[left] @ linked
    root = np.arange(len(sets))
    forest = []
    for a, row in enumerate(linked):
        for b in np.flatnonzero(row):
            x, y = int(left[a]), int(right[b])
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            while root[y] != y:
                root[y] = root[root[y]]
                y = root[y]
            if x != y:
                root[y] = x
                forest.append((int(ids[left[a]]), int(ids[right[b]])))
    return forest, links


def _product(percent: int):
    def run(parts: pd.DataFrame) -> pd.DataFrame:
        same = parts["low"].iloc[0] == parts["high"].iloc[0]
        sides = np.zeros(len(parts), np.int64) if same else (parts["tile"] != parts["low"]).to_numpy().astype(np.int64)
        out: list[tuple[int, int, int]] = []
        if len(parts) > 1 and (same or len(set(sides)) > 1):
            names = parts["class_key"].to_numpy(np.int64)
            sets = [np.frombuffer(x, np.uint64) for x in parts["grams"]]
            forest, links = block_links(names, sides, parts["copies"].to_numpy(np.int64), sets, percent)
            out = [(a, b, 0) for a, b in forest] + [(int(i), int(i), int(c)) for i, c in zip(names, links, strict=True) if c]
        return pd.DataFrame(out, columns=["a", "b", "links"]).astype("int64")

    return run


def _round_of_pairs(sets: DataFrame, k: int, rounds: int, percent: int) -> DataFrame:
    """Forest and link counts of those pairs of tiles that fall to round ``k``; every pair falls to one."""
    pair = lambda o: (F.least(F.col("tile"), o), F.greatest(F.col("tile"), o))
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    if rounds > 1:
        others = F.filter(others, lambda o: F.pmod(F.xxhash64("group_id", *pair(o)), F.lit(rounds)) == k)
    dealt = sets.withColumn("other", F.explode(others))
    low, high = pair(F.col("other"))
    dealt = dealt.withColumn("low", low).withColumn("high", high).drop("tiles", "other")
    return dealt.groupBy("group_id", "low", "high").applyInPandas(_product(percent), "a long, b long, links long")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, n_links.

    ``component_id`` is the smallest doc_id reachable over links, ``n_links`` the number
    of other rows that the row links with, rows of the same set included.  A text that
    is null or has no words has size 0, no links and itself as component.  Repeated
    rows link as copies; rows of equal doc_id with different texts are separate.  A
    null doc_id takes part and comes out as null.  Extra columns are not used.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    sized = settle(rows.mapInArrow(_digests(n), "doc_id long, n_shingles long, class_key long, check long"))
    worded = sized.where("n_shingles > 0")
    classes = settle(worded.groupBy("class_key", "check", "n_shingles").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")))

    # peeling: the columns are counted in blocks
    columns, n_classes = classes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("*")).first()
    packed = rows.mapInArrow(_columns(n, max(1, ceil(columns / BLOCK_COLUMNS))), "block long, keys binary, counts binary, grams binary")
    shared = packed.groupBy("block").applyInArrow(_shared(max(1, ceil(n_classes / CLASSES_IN_RANGE))), "range long, keys binary, shared binary")
    left = settle_narrow(
        shared.groupBy("range")
        .applyInArrow(_summed, "short_key long, shared long")
        .join(classes.withColumn("short_key", F.col("class_key").bitwiseAND(F.lit((1 << 8 * KEY_BYTES) - 1))), "short_key")
        .where(F.col("shared") * 100 >= F.col("n_shingles") * percent)
        .select("class_key", "class_id", "copies")
    )

    # signatures of the classes left
    texts = rows.join(left.select(F.col("class_id").alias("doc_id"), "class_key").hint("merge"), "doc_id")
    signed = settle(texts.mapInArrow(_signed(n, percent), "class_key long, marks array<long>, grams binary").dropDuplicates(["class_key"]))
    marks = signed.select("class_key", F.explode("marks").alias("mark"))
    leaders = marks.groupBy("mark").agg(F.min("class_key").alias("leader"), F.count("*").alias("held")).where("held > 1")
    meetings = marks.join(leaders, "mark").where("class_key <> leader").select("class_key", "leader").distinct()
    groups = components(meetings, "class_key", "leader").withColumnsRenamed({"node": "class_key", "label": "group_id"})

    # blocked product of each group's tiles
    least, most = TILE_ROWS
    rows_in = F.count("*")
    tiles = groups.groupBy("group_id").agg(F.greatest(F.least(F.ceil(rows_in / least), F.lit(TILES)), F.ceil(rows_in / most)).cast("int").alias("tiles"))
    sets = settle(
        signed.select("class_key", "grams")
        .join(groups.hint("merge"), "class_key")
        .join(left.select("class_key", "copies").hint("merge"), "class_key")
        .join(tiles, "group_id")
        .withColumn("tile", F.pmod(F.xxhash64("class_key"), F.col("tiles")).cast("int"))
    )
    once, dealt = sets.agg(F.sum(F.length("grams")), F.sum(F.length("grams") * F.col("tiles"))).first()
    rounds = ceil((dealt or 0) / max(COPIES_AT_ONCE * (once or 0), ROUND_BYTES))
    found = reduce(DataFrame.unionByName, [settle(_round_of_pairs(sets, k, rounds, percent)) for k in range(max(1, rounds))])
    labels = components(found.where("a <> b"), "a", "b").withColumnRenamed("node", "class_key")
    counts = found.where("a = b").groupBy(F.col("a").alias("class_key")).agg(F.sum("links").alias("links"))

    linked = settle_narrow(labels.join(classes.select("class_key", "class_id"), "class_key"))
    smallest = linked.groupBy("label").agg(F.min("class_id").alias("component_id"))
    named = linked.join(smallest, "label").select("class_key", "component_id")
    by_class = (
        classes.join(named, "class_key", "left")
        .join(counts, "class_key", "left")
        .select("class_key", "check", "n_shingles", F.coalesce("component_id", "class_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    return sized.join(by_class, ["class_key", "check", "n_shingles"], "left").select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"),
        "n_shingles",
        F.nullif(F.coalesce("component_id", "doc_id"), F.lit(NO_ID)).alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )


def op8_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The same in DuckDB: every pair that shares a shingle is counted, links are closed.
OP8_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) END AS s FROM words),
postings AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM postings a JOIN postings b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, e.y FROM reach JOIN edges e ON e.x = reach.r)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.component_id, coalesce(e.n_links, 0)::BIGINT AS n_links
FROM sets s JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
LEFT JOIN (SELECT x AS doc_id, count(*) AS n_links FROM edges GROUP BY x) e USING (doc_id)
"""
