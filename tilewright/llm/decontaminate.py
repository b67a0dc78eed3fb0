"""Benchmark decontamination by template windows.

Texts are canonicalised to templates: numbers, names and units become the typed
placeholders of their words, other words lower case without punctuation.  Windows of
consecutive template words of the documents are hash-joined with the benchmark's.  The
values behind the placeholders ("slots") of the joined windows must then map one to one
between item and some occurrence in the document, which accepts re-parameterised questions and refuses
windows that agree by shape only.  Windows also join word for word, case ignored, so that
an item in capitals, or one made mostly of numbers or names, meets its own copies.

Scale: one Arrow pass over the documents.  Where the benchmark's window hashes number
at most ``FILTER_WINDOWS`` (counted first), they go to the workers and only windows
that join leave the pass; a larger benchmark joins by shuffle without that filter,
with the same result.  No side of a join is broadcast by hint.  Equal items count as one.
Candidate pairs come from an item's rarest windows alone: a document that holds the
wanted share of an item's windows holds one of them, so phrases that many items share
make no pairs.  Slots are compared as rows and sums, never as one list of a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.llm.common import settle, table
from tilewright.llm.kernel import Chunk, Words, chunks, gram_hashes, grams_of, mix, rolling, span_hashes

WINDOW = 8
CAPITALS = 3  # words in a row without a lower-case letter that are no names
FILTER_WINDOWS = 1_000_000

#: Words read as units directly after a number, by dimension.
UNITS = {
    "length": "mm cm m km inch inches foot feet ft yard yards mile miles meter meters metre metres kilometer kilometers",
    "mass": "mg g kg gram grams kilogram kilograms ounce ounces pound pounds lb lbs ton tons tonne tonnes",
    "time": "ms s sec second seconds minute minutes min hour hours h day days week weeks month months year years",
    "money": "dollar dollars euro euros cent cents usd eur gbp",
    "volume": "ml l liter liters litre litres gallon gallons cup cups",
    "share": "percent percentage",
}

_WORD_BYTE = np.zeros(256, bool)  # letters, digits and every byte of a longer character
_WORD_BYTE[48:58] = _WORD_BYTE[65:91] = _WORD_BYTE[97:123] = _WORD_BYTE[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\n\"'(*"]] = True

LITERAL, NUMBER, NAME, UNIT = range(4)
EXACT = np.uint64(0x9E3779B97F4A7C15)  # sets hashes of words apart from those of templates


def _hash_of(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return span_hashes(rolling(data), np.array([0]), np.array([len(data)]))[0]


_UNIT_HASHES = np.array(sorted({(_hash_of(w), k + 1) for k, words in enumerate(UNITS.values()) for w in words.split()}), dtype=[("hash", np.uint64), ("kind", np.int64)])


def _shouted(data: np.ndarray, words: Words) -> np.ndarray:
    """Words in a run of CAPITALS or more words of capitals within a text; words without letters neither count nor end it."""
    count = lambda held: (lambda c: c[words.ends] - c[words.starts])(np.concatenate(([0], np.cumsum(held))))
    lower, upper = count(((data >= 97) & (data <= 122)) | (data >= 128)), count((data >= 65) & (data <= 90))
    out = np.zeros(len(words.starts), bool)
    spoken = np.flatnonzero(lower + upper > 0)
    if len(spoken):
        high, owner = lower[spoken] == 0, words.owners()[spoken]
        run = np.concatenate(([0], np.cumsum((high[1:] != high[:-1]) | (owner[1:] != owner[:-1]))))
        out[spoken] = high & (np.bincount(run)[run] >= CAPITALS)
    return out


def template_words(chunk: Chunk) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words by letters and digits; per word its template hash, its kind and the hash of its own value.

    A dot or comma between digits belongs to the number.  A name is a word with an
    initial capital that neither opens a sentence nor lies in a run of capitals.
    """
    data = chunk.data
    solid = _WORD_BYTE[data]
    digit = _DIGIT[data]
    if len(data) > 2:
        joint = (data == 46) | (data == 44)
        solid[1:-1] |= joint[1:-1] & digit[:-2] & digit[2:]
    edge = np.zeros(len(data) + 1, bool)
    edge[chunk.offsets] = True
    prior = np.concatenate(([False], solid[:-1])) & ~edge[:-1]
    later = np.concatenate((solid[1:], [False])) & ~edge[1:]
    starts = np.flatnonzero(solid & ~prior)
    ends = np.flatnonzero(solid & ~later) + 1
    words = Words(starts, ends, np.searchsorted(starts, chunk.offsets))
    values = span_hashes(rolling(chunk.lowered()), starts, ends)
    kinds = np.full(len(starts), LITERAL, np.int64)
    if len(starts):
        opens = np.ones(len(starts), bool)  # no word before in this text, or a sentence end between
        stops = np.concatenate(([0], np.cumsum(_STOP[data])))
        opens[1:] = stops[starts[1:]] > stops[ends[:-1]]
        opens[words.first[:-1][words.first[:-1] < len(starts)]] = True
        lead = data[starts]
        kinds[(lead >= 65) & (lead <= 90) & ~opens & ~_shouted(data, words)] = NAME
        number = digit[starts]
        kinds[number] = NUMBER
        after = np.zeros(len(starts), bool)
        after[1:] = number[:-1]
        after[words.first[:-1][words.first[:-1] < len(starts)]] = False
        spots = np.flatnonzero(after & ~number)
        found = np.searchsorted(_UNIT_HASHES["hash"], values[spots])
        held = (found < len(_UNIT_HASHES)) & (_UNIT_HASHES["hash"][np.minimum(found, len(_UNIT_HASHES) - 1)] == values[spots])
        kinds[spots[held]] = UNIT
        code = values.copy()
        code[kinds == NUMBER] = 11
        code[kinds == NAME] = 13
        code[spots[held]] = (100 + _UNIT_HASHES["kind"][found[held]]).astype(np.uint64)
    else:
        code = values
    return words, mix(code), kinds, values


SCHEMA = "_row {kind}, hash long, at int, size int, total int, exact boolean, slots array<long>"


def _windows(batches: Iterator[pa.RecordBatch], sizes: list[int], wanted: np.ndarray | None, whole: bool) -> Iterator[pa.RecordBatch]:
    """Windows of each size: templates that are at least half literal, and ``exact`` ones by the words themselves.

    ``whole``: a text shorter than WINDOW gives itself.
    """
    for batch in batches:
        rows, hashes, ats, used, totals, exacts, slots = [], [], [], [], [], [], []
        for chunk in chunks(batch.column(1)):
            words, code, kinds, values = template_words(chunk)
            literal = np.concatenate(([0], np.cumsum(kinds == LITERAL)))
            counts = np.diff(words.first)
            owner = words.owners()
            verbatim = mix(values ^ EXACT)
            for size, exact in ((s, e) for s in sizes for e in (False, True)):
                grams = gram_hashes(verbatim if exact else code, size).view(np.int64)
                if not len(grams):
                    continue
                at = np.arange(len(grams))
                ok = owner[: len(grams)] == owner[size - 1 :]
                if not exact:
                    ok &= 2 * (literal[at + size] - literal[at]) >= size
                if wanted is not None:
                    near = np.minimum(np.searchsorted(wanted, grams), len(wanted) - 1)
                    ok &= wanted[near] == grams
                if whole:
                    ok &= np.where(counts[owner[: len(grams)]] < WINDOW, counts[owner[: len(grams)]] == size, size == WINDOW)
                for k in np.flatnonzero(ok):
                    row = int(owner[k])
                    rows.append(row + chunk.rows.start)
                    hashes.append(int(grams[k]))
                    ats.append(int(k - words.first[row]))
                    used.append(size)
                    totals.append(int(counts[row]))
                    exacts.append(exact)
                    inside = slice(k, k + size)
                    slots.append(values[inside].view(np.int64)[kinds[inside] != LITERAL].tolist())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(rows, pa.int64())),
                pa.array(hashes, pa.int64()),
                *(pa.array(x, pa.int32()) for x in (ats, used, totals)),
                pa.array(exacts, pa.bool_()),
                pa.array(slots, pa.list_(pa.int64())),
            ],
            ["_row", "hash", "at", "size", "total", "exact", "slots"],
        )


def windows(rows: DataFrame, key: str, sizes: list[int], wanted: np.ndarray | None = None, whole: bool = False) -> DataFrame:
    kind = dict(rows.dtypes)[key]
    base = rows.select(F.col(key).alias("_row"), F.col("text").cast("string").alias("_text"))
    return base.mapInArrow(lambda it: _windows(it, sizes, wanted, whole), SCHEMA.format(kind=kind))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str, share: float = 0.5) -> DataFrame:
    """Pairs (key, item_id) with enough joined windows: matched and all windows of the item, slot consistency, verdict.

    A pair is contaminated if at least ``share`` of the item's windows occur in the
    document and their slots map one to one, at one offset, at offsets near each other or
    in the whole document.  The figures are those of the best such occurrence.  Items of
    equal text are one item of the smallest id, with ``copies``.  Items shorter than a window match as one
    window of their own length; items and documents without words match nothing.
    """
    once = benchmark.groupBy(F.col("text").cast("string").alias("text")).agg(F.min("item_id").alias("item_id"), F.countDistinct("item_id").alias("copies"))
    once = settle(once)
    short = windows(once, "item_id", list(range(1, WINDOW + 1)), whole=True)
    items = settle(short.withColumnsRenamed({"_row": "item_id", "at": "item_at", "slots": "item_slots"}).drop("total"))
    sizes = [r["size"] for r in items.select("size").distinct().collect()]  # at most WINDOW values
    if not sizes:
        sizes = [WINDOW]
    known = items.select("hash").distinct()
    wanted = None
    if known.count() <= FILTER_WINDOWS:
        wanted = np.sort(np.array([r["hash"] for r in known.collect()], np.int64))
        if not len(wanted):
            wanted = np.array([-1], np.int64)
    window = ["hash", "size", "exact"]
    texts = docs.select(F.struct(F.col(key).alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("body")).alias("_key"), "text")
    hits = settle(windows(texts, "_key", sizes, wanted).select("_row.doc", "_row.body", *window, "slots", "at"))

    # an item's places by how many items share their windows: the rarest that no enough-matching document can avoid
    shared = items.join(items.groupBy(*window).agg(F.countDistinct("item_id").alias("held")), window)
    places = shared.groupBy("item_id", "item_at").agg(F.max("held").alias("held"))
    item_sizes = places.groupBy("item_id").agg(F.count("*").alias("item_windows"))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy("held", "item_at"))
    rare = places.withColumn("rank", rank).join(item_sizes, "item_id").where(F.col("rank") <= F.col("item_windows") - F.ceil(F.col("item_windows") * share) + 1)
    rare = items.join(rare.select("item_id", "item_at"), ["item_id", "item_at"]).select("item_id", *window)
    pairs = hits.join(rare, window).select(F.col("doc").alias("_doc"), "item_id").distinct()
    held = pairs.join(items, "item_id")
    same = [F.col(f"h.{c}") == F.col(f"w.{c}") for c in window]
    joined = held.alias("w").join(hits.alias("h"), [F.col("w._doc").eqNullSafe(F.col("h.doc")), *same]).select(
        "_doc", "item_id", "item_at", "item_slots", "body", "at", F.when(F.col("w.exact"), F.col("item_slots")).otherwise(F.col("slots")).alias("slots")  # exact: the words are equal
    )
    # an occurrence: one offset, or offsets that lie near each other, as words put in or left out move them
    offset = F.col("at") - F.col("item_at")
    near = lambda shift: F.floor((offset + shift) / (2 * WINDOW)).cast("long")
    body = F.col("body")
    spots = [(0, None, None), (1, body, offset.cast("long")), (2, body, near(0)), (3, body, near(WINDOW))]
    place = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(b).cast("long").alias("body"), F.lit(o).cast("long").alias("spot")) for k, b, o in spots]))
    met = joined.select("_doc", "item_id", "item_at", F.arrays_zip("item_slots", "slots").alias("zip"), place.alias("_place"))
    by = ["_doc", "item_id", "_place"]
    matched = met.groupBy(*by).agg(F.countDistinct("item_at").alias("matched"))
    slots = met.select(*by, F.explode("zip").alias("p")).select(*by, "p.item_slots", "p.slots").distinct()
    values = slots.groupBy(*by).agg(
        F.count("*").alias("n"), F.countDistinct("item_slots").alias("ours"), F.countDistinct("slots").alias("theirs"), F.bool_and(F.col("item_slots") == F.col("slots")).alias("plain")
    )
    both = matched.alias("m").join(values.alias("v"), [F.col("m._doc").eqNullSafe(F.col("v._doc")), F.col("m.item_id") == F.col("v.item_id"), F.col("m._place").eqNullSafe(F.col("v._place"))], "left")
    agree = F.coalesce((F.col("ours") == F.col("n")) & (F.col("theirs") == F.col("n")), F.lit(True))
    judged = both.select("m._doc", "m.item_id", "matched", agree.alias("agree"), F.coalesce("plain", F.lit(True)).alias("plain")).join(item_sizes, "item_id").select(
        "_doc",
        "item_id",
        "item_windows",
        F.struct(
            (F.col("agree") & (F.col("matched") >= share * F.col("item_windows"))).alias("contaminated"),
            F.col("matched").cast("long").alias("matched"),
            F.col("agree").alias("slots_agree"),
            "plain",
        ).alias("best"),
    )
    best = judged.groupBy("_doc", "item_id").agg(F.max("item_windows").alias("item_windows"), F.max("best").alias("best"))
    return best.join(once.select("item_id", "copies"), "item_id").select(
        F.col("_doc").alias(key),
        "item_id",
        "copies",
        "best.matched",
        "item_windows",
        "best.slots_agree",
        (~F.col("best.plain")).alias("reparameterised"),
        "best.contaminated",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, n_items, first_item, matched, reparameterised.

    Counts cover contaminating items; without any they are 0 and null.  Null and empty
    texts are clean; repeated doc_ids share one verdict, which any of their rows or all
    of them together can bring.  Without items, or without documents, nothing is
    contaminated.  Extra columns, clashing names included, are not used.
    """
    found = (
        contamination(docs, benchmark, "doc_id", share)
        .where("contaminated")
        .groupBy("doc_id")
        .agg(
            F.sum("copies").alias("n_items"),
            F.min("item_id").alias("first_item"),
            F.max("matched").alias("matched"),
            F.bool_or("reparameterised").alias("reparameterised"),
        )
        .withColumnRenamed("doc_id", "_found")
    )
    return docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("_found")), "left").select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        "first_item",
        F.coalesce("matched", F.lit(0)).cast("long").alias("matched"),
        F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"),
    )


def op3_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
