"""Exact duplicates by two-pass Bloom filtering, with built-in functions only.

Pass one fills a register-blocked counting Bloom filter: the hash of a row names a word of the filter and two of its
``COUNTERS`` counters.  Every task adds its rows up in its own part of the filter and sends the words that it touched;
the sums of these parts say which counters were hit more than once, and one bit each of those is all that is kept.
Hashes are neither exchanged nor counted themselves.  Pass two tests every row against these bits: a row with a counter
that only it hit has no equal anywhere and passes straight through, the others (repeats, and rows that share both
counters with other hashes) shuffle and are grouped by SHA-256.

The filter has as many words as there are rows, up to ``max_words``, so what a task sends and what is broadcast has a
fixed bound.  Beyond ``CROWD`` rows a word nearly all rows would pass the test: then no filter is made and every row
takes the exact step.  No result depends on the filter.

Defined cases: null text counts as empty; empty and blank texts are equal to each other; a null doc_id comes after
every other id when the smallest is sought; of rows that repeat the same id and text exactly one is kept; an empty
table gives no rows; other columns, whatever their names, stay with their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.llm.shared import SPACE_CLASS, apart, restored, written

COUNTERS = 8
MAX_WORDS = 1 << 21
CROWD = 8


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", "")


def _counters(h: Column) -> tuple[Column, Column]:
    """Two different counters of a word, from separate bits of the hash."""
    one = h.bitwiseAND(F.lit(COUNTERS - 1))
    return one, (one + 1 + F.pmod(F.shiftrightunsigned(h, 8), F.lit(COUNTERS - 1).cast("bigint"))) % F.lit(COUNTERS)


def _mask(h: Column) -> Column:
    """The bits of the hash's counters."""
    one = F.lit(1).cast("bigint")
    first, second = (F.call_function("shiftleft", one, at.cast("int")) for at in _counters(h))
    return first.bitwiseOR(second)


def _word(h: Column, words: int) -> Column:
    """The word of a hash, from a second hash of it so that word and counters are independent."""
    return F.pmod(F.xxhash64(h), F.lit(words).cast("bigint"))


def repeated_filter(hashes: DataFrame, rows: int, max_words: int = MAX_WORDS) -> tuple[DataFrame, int]:
    """Pass one over column ``h`` of ``rows`` rows: (word, bits) of the counters hit more than once, and the number of words.

    Without rows, or with too many for the filter, there is no filter (0 words).
    """
    words = 1 << 10
    while words < rows:
        words *= 2
    words = min(words, max_words)
    if not 0 < rows <= CROWD * words:
        return hashes.sparkSession.range(0).select(F.col("id").alias("word"), F.col("id").alias("bits")), 0
    first, second = _counters(F.col("h"))
    hit = hashes.select(_word(F.col("h"), words).alias("word"), first.alias("a"), second.alias("b"))
    parts = hit.groupBy("word").agg(*[F.count_if((F.col("a") == i) | (F.col("b") == i)).alias(f"c{i}") for i in range(COUNTERS)])
    bits = sum((F.when(F.col(f"c{i}") > 1, F.lit(1 << i)).otherwise(0) for i in range(COUNTERS)), F.lit(0))
    return parts.select("word", bits.cast("bigint").alias("bits")).filter("bits > 0"), words


def possibly_repeated(df: DataFrame, h: Column, bloom: DataFrame, words: int) -> DataFrame:
    """Pass two: ``df`` with boolean ``_again``, false only where the hash certainly occurs once.

    The filter has at most ``max_words`` rows by construction, so its broadcast is bounded.
    """
    if not words:
        return df.withColumn("_again", F.lit(True))
    probe = df.withColumns({"_w": _word(h, words), "_m": _mask(h)})
    side = F.broadcast(bloom.select(F.col("word").alias("_w"), F.col("bits").alias("_bits")))
    hit = F.coalesce(F.col("_bits").bitwiseAND(F.col("_m")) == F.col("_m"), F.lit(False))
    return probe.join(side, "_w", "left").withColumn("_again", hit).drop("_w", "_m", "_bits")


def _order(length: Column, doc_id: Column, rest: Column) -> Column:
    """Least first: most code points, then smallest id (null last), then a tie-break."""
    return F.struct((-length).alias("l"), doc_id.isNull().alias("z"), doc_id.alias("i"), rest.alias("r"))


def digests(docs: DataFrame) -> DataFrame:
    """One small row per document: id, row number, length, 64-bit hash and SHA-256 of the normalised text."""
    norm = docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("n"), normalised(F.col("text")).alias("norm"))
    return norm.select("doc_id", F.monotonically_increasing_id().alias("row"), "n", F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("text_sha256"))


def exact_duplicates(docs: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    rows = written(digests(docs), "digests")
    bloom, words = repeated_filter(rows.select("h"), rows.count(), max_words)
    rows = written(possibly_repeated(rows, F.col("h"), bloom, words), "tested")
    groups = written(
        rows.filter("_again").groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(_order(F.col("n"), F.col("doc_id"), F.col("row"))).alias("best")),
        "groups",
    )
    straight = rows.filter("not _again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    grouped = (
        rows.filter("_again")
        .join(groups, "text_sha256")
        .select("doc_id", F.col("best.i").alias("keep_id"), "group_size", (F.col("row") == F.col("best.r")).alias("kept"), "text_sha256")
    )
    return straight.unionByName(grouped)


def keep_first(docs: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: full rows shuffle only if their hash may be repeated."""
    hashed = apart(docs).withColumn("_norm", normalised(F.col("text"))).withColumn("_h", F.xxhash64("_norm"))
    bloom, words = repeated_filter(hashed.select(F.col("_h").alias("h")), docs.count(), max_words)
    bloom = written(bloom, "bloom")
    tested = possibly_repeated(hashed, F.col("_h"), bloom, words)
    keyed = tested.filter("_again").withColumns({"_sha": F.sha2("_norm", 256), "_n": F.char_length(F.coalesce("text", F.lit("")))})
    best = written(keyed.groupBy("_sha").agg(F.min(_order(F.col("_n"), F.col("doc_id"), F.lit(0))).alias("_best")), "best")
    stay = keyed.join(best, "_sha").filter((F.col("_n") == -F.col("_best.l")) & F.col("doc_id").eqNullSafe(F.col("_best.i"))).dropDuplicates(["_sha"])
    return restored(tested.filter("not _again"), docs).union(restored(stay, docs))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM t GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""
