"""Quality rules at host level.

Every document is measured (one Arrow pass over the bytes).  Rule failures are summed
per host; a beta prior, fitted to the hosts' rates by moments, shrinks each host's
failure rate, and the host's verdict joins back to its documents.

Verdict of a document: rejected if the base rules fail, if ``own_rules`` of its soft
rules fail, or if its host is bad (shrunk failure rate over ``bad_rate``) and one of
its soft rules fails.  A clean document is kept whatever its host; a document with a
single soft failure is excused on a good host and rejected on a bad one.

Scale: one pass over the texts, whose narrow measures are written; then a map-side
combined sum per host and a join of the host table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.llm.common import stash, table
from tilewright.llm.kernel import chunks, gram_hashes, grams_of, word_hashes

#: Symbols that the symbol rule counts.
SYMBOLS = b"#*$%&|<>"
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True

#: A host is bad from one failing document in ten.
BAD_RATE = 0.1

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")


def repeated_words(grams: np.ndarray, n_words: int, n: int = 3) -> int:
    """Words that lie in an n-word window found twice or more."""
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twin = np.zeros(len(grams), bool)
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    covered = np.zeros(n_words, bool)
    for k in range(n):
        covered[k : k + len(grams)] |= twin
    return int(covered.sum())


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines), len(lines) - len(set(lines))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {k: np.zeros(len(batch), np.int64) for k in MEASURES}
        for chunk in chunks(batch.column(1)):
            words = chunk.words()
            grams = gram_hashes(word_hashes(chunk, words, lower=False), 3)
            solid = np.zeros(len(chunk.data) + 1, np.int64)
            np.add.at(solid, words.starts, 1)
            np.add.at(solid, words.ends, -1)
            inside = np.cumsum(solid[:-1]) > 0
            rows = chunk.rows
            upper = (chunk.data >= 65) & (chunk.data <= 90)
            out["n_words"][rows] = np.diff(words.first)
            out["word_chars"][rows] = chunk.per_text(inside & ((chunk.data & 0xC0) != 0x80))
            out["n_symbols"][rows] = chunk.per_text(IS_SYMBOL[chunk.data])
            out["n_upper"][rows] = chunk.per_text(upper)
            out["n_letters"][rows] = chunk.per_text(upper | ((chunk.data >= 97) & (chunk.data <= 122)))
            raw = chunk.data.tobytes()
            for k in range(len(chunk)):
                a, b = grams_of(words.first, k, 3)
                row = rows.start + k
                out["n_repeat_words"][row] = repeated_words(grams[a:b], int(words.first[k + 1] - words.first[k]))
                out["n_lines"][row], out["n_dup_lines"][row] = duplicate_lines(raw[chunk.offsets[k] : chunk.offsets[k + 1]])
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out.values())], ["_row", *out])


def measure(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, measures) of every document; a null text has no words."""
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("_row"), F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(_measure, f"_row {kind}, " + ", ".join(f"{m} long" for m in MEASURES))


def with_rules(measured: DataFrame) -> DataFrame:
    """base_failed, and soft_failures: how many of the four soft rules fail."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    soft = (
        (5 * F.col("n_symbols") > F.col("n_words")).cast("int")
        + (10 * F.col("n_dup_lines") > 6 * F.col("n_lines")).cast("int")
        + ((10 * F.col("n_upper") > 7 * F.col("n_letters")) & (F.col("n_letters") > 0)).cast("int")
        + ((F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))).cast("int")
    )
    return measured.withColumn("base_failed", base).withColumn("soft_failures", soft)


def host_verdicts(rows: DataFrame, host: str, bad_rate: float = BAD_RATE) -> DataFrame:
    """Per host: documents, failures, shrunk rate, verdict.

    The beta prior's mean and strength come from the hosts' mean rate and its variance
    between hosts beyond binomial noise; without such variance the strength is that of
    all documents, so every host takes the common rate.
    """
    failing = (F.col("base_failed") | (F.col("soft_failures") > 0)).cast("long")
    sums = rows.groupBy(host).agg(F.count("*").alias("host_docs"), F.sum(failing).alias("host_failures"))
    rate = F.col("host_failures") / F.col("host_docs")
    prior = sums.agg(
        F.sum("host_docs").alias("_n"),
        F.count("*").alias("_hosts"),
        (F.sum("host_failures") / F.sum("host_docs")).alias("_mean"),
        F.sum(F.col("host_docs") * rate * rate).alias("_square"),
        F.sum(F.col("host_docs").cast("double") * F.col("host_docs")).alias("_n2"),
    )
    noise = F.col("_mean") * (1 - F.col("_mean"))
    spread = F.col("_square") / F.col("_n") - F.col("_mean") * F.col("_mean")
    between = (spread - noise * (F.col("_hosts") - 1) / F.col("_n")) / F.nullif(1 - F.col("_n2") / (F.col("_n").cast("double") * F.col("_n")), F.lit(0.0))
    strength = F.when(between > 0, F.greatest(noise / between - 1, F.lit(0.0))).otherwise(F.col("_n").cast("double"))
    prior = prior.select(F.col("_mean").alias("prior_mean"), F.coalesce(strength, F.lit(0.0)).alias("prior_strength"))
    shrunk = (F.col("host_failures") + F.col("prior_mean") * F.col("prior_strength")) / (F.col("host_docs") + F.col("prior_strength"))
    return (
        sums.join(F.broadcast(prior))  # one row
        .withColumn("host_rate", shrunk)
        .withColumn("host_bad", shrunk > bad_rate)
    )


def judge(docs: DataFrame, host: str = "source", bad_rate: float = BAD_RATE, own_rules: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, host, measures, base_failed, host columns, kept.

    Null hosts are one host, apart from empty names; null or empty texts fail the base
    rules.  Repeated rows are judged alike, an empty table gives no rows.  Hosts of one
    rate, or a single host, have no variance between them and take the common rate.
    Other input columns, clashing names included, are not used.
    """
    base = docs.select(F.struct("doc_id", F.col(host).cast("string").alias("host")).alias("_key"), "text")
    rows = with_rules(stash(measure(base, "_key").select("_row.*", *MEASURES), "measures"))
    hosts = stash(host_verdicts(rows, "host", bad_rate), "hosts")
    known = hosts.select(F.col("host").alias("_host"), "host_docs", "host_failures", "host_rate", "host_bad")
    joined = rows.join(known, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    rejected = F.col("base_failed") | (F.col("soft_failures") >= own_rules) | (F.col("host_bad") & (F.col("soft_failures") > 0))
    return joined.withColumn("kept", ~rejected)


def op10_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"),
        *("soft_failures", "host", F.round("host_rate", 6).alias("host_rate"), "host_bad"),
    )


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

#: The contract's columns and this module's verdict, in DuckDB.
OP10_SQL = f"""
WITH split AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT *, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) AS g FROM split),
twice AS (
  SELECT *, map_keys(map_from_entries(list_filter(map_entries(list_histogram(g)), lambda e: e.value > 1))) AS r FROM grams),
measures AS (
  SELECT doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
         CASE WHEN len(r) = 0 THEN 0 ELSE len(list_distinct(flatten(list_transform(
           list_filter(range(1, len(g) + 1), lambda i: list_contains(r, g[i])), lambda i: [i, i+1, i+2])))) END::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
         length(regexp_replace(t, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters
  FROM twice),
ruled AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         (5 * n_symbols > n_words)::INT + (10 * n_dup_lines > 6 * n_lines)::INT
         + (10 * n_upper > 7 * n_letters AND n_letters > 0)::INT
         + (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT AS soft_failures
  FROM measures),
hosts AS (
  SELECT host, count(*)::DOUBLE AS d, sum((base_failed OR soft_failures > 0)::INT)::DOUBLE AS f FROM ruled GROUP BY host),
sums AS (
  SELECT sum(d) AS n, count(*)::DOUBLE AS h, sum(f) / sum(d) AS m, sum(d * (f / d) * (f / d)) AS sq, sum(d * d) AS n2 FROM hosts),
prior AS (
  SELECT m, CASE WHEN b > 0 THEN greatest(m * (1 - m) / b - 1, 0) ELSE n END AS k
  FROM (SELECT m, n, (sq / n - m * m - m * (1 - m) * (h - 1) / n) / nullif(1 - n2 / (n * n), 0) AS b FROM sums)),
verdicts AS (
  SELECT host, (f + m * k) / (d + k) AS host_rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR soft_failures >= 2 OR (host_rate > {BAD_RATE} AND soft_failures > 0)) AS kept,
       soft_failures, r.host, round(host_rate, 6) AS host_rate, host_rate > {BAD_RATE} AS host_bad
FROM ruled r JOIN verdicts v ON v.host IS NOT DISTINCT FROM r.host
"""
