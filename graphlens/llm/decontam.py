"""Benchmark decontamination as a prefix-filtered set join, with built-in functions only.

A benchmark item is cut into windows of ``WINDOW`` words (a shorter item is one window).  A window is a set of word
shingles and must be contained whole, so its prefix is a single token: its rarest shingle.  Rarity is the number of
occurrences in all documents, counted in a first pass; a window with a shingle that occurs nowhere can't occur and is
dropped.  A second pass meets each word position of each document with the windows whose prefix token starts there,
bounds the position (the window must start and end inside the document) and compares the words themselves.

Up to ``block_windows`` windows are broadcast, and a document's words are never shuffled, only its hits are.  A larger
benchmark takes the same two passes: the first counts shingles in a sketch of ``SKETCH`` counters, which tells the rarest
one as well; in the second a Bloom filter of the prefix tokens (at most ``FILTER_WORDS`` words) goes to the documents, and
only the positions that pass it, with the words around them, meet the windows by exchange.

Defined cases: null text has no words; an item without words has no window; items of one id count as one; a null
item id marks words but is not listed; each row of ``docs`` gives a row, repeated ids included; a row is known by its id
and a hash of its text, so plans that are evaluated again in another order give the same; columns other than doc_id and
text (item_id and text) play no part; an empty table of documents gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.llm.shared import apart, restored, written

WINDOW = 10
SHINGLE = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SKETCH = 1 << 20
FILTER_WORDS, FILTER_BITS = 1 << 21, 4
#: Parts into which the positions of one token are dealt, as one passage may stand in a third of all documents.
SALTS = 8
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased, other letters as they are."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lower, NOT_WORD), "")


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, win) of ``items`` (item_id, text); win is an array of words."""
    cut = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return cut.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i"), F.lit(window)).alias("win")).distinct()


def _token(w: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(w, at + k) for k in range(length)])


def _positions(texts: DataFrame, keys: list[str], length: int) -> DataFrame:
    """A row per word position, with its shingle token, and one more per document (p = n, token null)."""
    cut = texts.select(*keys, words(F.col("text")).alias("w"))
    rows = cut.select(*keys, "w", F.size("w").alias("n"), F.explode(F.sequence(F.lit(0), F.size("w"))).alias("p"))
    return rows.withColumn("token", F.when(F.col("p") < F.col("n"), _token(F.col("w"), F.col("p"), length)))


def _prefixed(texts: DataFrame, block: DataFrame, length: int) -> DataFrame:
    """(wid, win, off, token) of the windows of ``block`` (wid, win) that may occur, by their rarest shingle."""
    offsets = F.sequence(F.lit(0), F.size("win") - length)
    shingles = block.select("wid", "win", F.explode(offsets).alias("off")).withColumn("token", _token(F.col("win"), F.col("off"), length))
    found = _positions(texts, [], length).join(F.broadcast(shingles.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    # every window needs all its shingles: one that is missing rules the window out
    rated = shingles.join(written(found, "shingle-counts"), "token", "left")
    best = rated.groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "off")).alias("best"), F.first("win").alias("win"))
    return best.filter("best.n > 0").select("wid", "win", "best.off", "best.token")


def _mask(h: Column) -> Column:
    """FILTER_BITS positions in a 64-bit word, from separate bits of a token."""
    one = F.lit(1).cast("bigint")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(FILTER_BITS)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _by_exchange(texts: DataFrame, own: DataFrame, n: int, keys: list[str], length: int) -> DataFrame:
    """The hits of windows ``own`` (wid, win), whatever their number ``n``."""
    cut = texts.select(*keys, words(F.col("text")).alias("w"))
    spots = cut.select(*keys, "w", F.size("w").alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - length, F.lit(0)))).alias("p")).filter(F.col("p") <= F.col("n") - length)
    spots = spots.withColumn("token", _token(F.col("w"), F.col("p"), length))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SKETCH)).cast("int")
    sketch = written(spots.groupBy(slot("token").alias("slot")).agg(F.count("*").alias("seen")), "sketch")  # SKETCH rows at most
    shingles = own.select("wid", "win", F.explode(F.sequence(F.lit(0), F.size("win") - length)).alias("off")).withColumn("token", _token(F.col("win"), F.col("off"), length))
    rated = shingles.withColumn("slot", slot("token")).join(F.broadcast(sketch), "slot", "left")
    best = rated.groupBy("wid").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token", "off")).alias("best"), F.first("win").alias("win"))
    ready = written(best.filter("best.seen > 0").select("wid", "win", "best.off", "best.token"), "prefixes")
    size = 1 << 10
    while size < min(FILTER_WORDS, n // 4):
        size *= 2
    word = lambda c: F.pmod(F.xxhash64(c, F.lit(1)), F.lit(size)).cast("int")
    bloom = written(ready.select(word("token").alias("word"), _mask(F.col("token")).alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits")), "filter")
    probe = spots.withColumns({"word": word("token"), "mask": _mask(F.col("token"))}).join(F.broadcast(bloom), "word").filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    base = F.greatest(F.col("p") - WINDOW, F.lit(0))
    near = probe.select(*keys, "n", "p", "token", base.alias("base"), F.slice("w", base + 1, F.lit(2 * WINDOW)).alias("near")).withColumn("salt", F.pmod(F.xxhash64(*keys, "p"), F.lit(SALTS)))
    side = ready.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    met = near.join(side, ["token", "salt"])
    start = F.col("p") - F.col("off")
    fits = (start >= 0) & (start + F.size("win") <= F.col("n"))
    same = fits & (F.slice("near", F.greatest(start - F.col("base"), F.lit(0)) + 1, F.size("win")) == F.col("win"))
    return met.filter(same).select(*keys, "n", start.alias("start"), F.size("win").alias("size"), "wid")


def _ends(texts: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each document."""
    n = F.size(words(F.col("text")))
    return texts.select(*keys, n.alias("n"), n.alias("start"), F.lit(0).alias("size"), F.lit(None).cast("long").alias("wid"))


def hits(texts: DataFrame, wins: DataFrame, keys: list[str], block_windows: int = 100_000) -> DataFrame:
    """(keys, n, start, size, wid) of each occurrence of a window of ``wins`` (wid, win) in ``texts`` (keys, text).

    Each document also has one row with start = n, size = 0 and a null wid.
    """
    passes = wins.groupBy(F.least(F.size("win"), F.lit(SHINGLE)).alias("length")).agg(F.count("*").alias("n")).collect()
    out = []
    ended = False
    for length, n in sorted(((r["length"], r["n"]) for r in passes), reverse=True) or [(SHINGLE, 0)]:
        own = wins.filter(F.least(F.size("win"), F.lit(SHINGLE)) == length)
        if n > block_windows:
            out.append(_by_exchange(texts, own, n, keys, length))
            continue
        ready = written(_prefixed(texts, own, length), "prefixes")
        end = texts.sparkSession.range(1).select(F.lit(None).cast("long").alias("wid"), F.array().cast("array<string>").alias("win"), F.lit(0).alias("off"), F.lit(None).cast("long").alias("token"))
        side = F.broadcast(ready if ended else ready.unionByName(end))  # at most block_windows rows and one
        ended = True
        rows = _positions(texts, keys, length)
        rows = rows.withColumn("token", F.coalesce("token", F.lit(-1))).join(side.withColumn("token", F.coalesce("token", F.lit(-1))), "token")
        start = F.col("p") - F.col("off")
        fits = (start >= 0) & (start + F.size("win") <= F.col("n"))
        same = F.when(F.col("wid").isNull(), F.col("p") == F.col("n")).otherwise(fits & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.size("win")) == F.col("win")))
        out.append(rows.filter(same).select(*keys, "n", start.alias("start"), F.size("win").alias("size"), "wid"))
    return reduce(DataFrame.unionByName, out if ended else [*out, _ends(texts, keys)])


def numbered(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, win), and (wid, item_id) of the items that have them; both written."""
    owned = written(windows(items, window).withColumn("wid", F.xxhash64("win")), "windows")
    return written(owned.groupBy("wid").agg(F.first("win").alias("win")), "window-texts"), owned.select("wid", "item_id")


def _covered(spans: Column) -> Column:
    """Number of positions in the union of sorted (start, end) spans."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["reach"]), F.lit(0))).alias("n"), F.greatest(a["reach"], x["end"]).alias("reach")),
        lambda a: a["n"],
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of ``docs``."""
    texts = docs.select("doc_id", F.xxhash64("text", F.char_length("text")).alias("row"), "text")
    wins, owners = numbered(items, window)
    span = F.struct(F.col("start").alias("start"), (F.col("start") + F.col("size")).alias("end"))
    by_doc = (
        hits(texts, wins, ["doc_id", "row"])
        .groupBy("doc_id", "row")
        .agg(F.count_if(F.col("wid").isNull()).alias("times"), F.max("n").alias("n_words"), F.sort_array(F.collect_set(span)).alias("spans"), F.collect_set("wid").alias("wids"))
        .select("doc_id", "row", "times", "n_words", _covered(F.col("spans")).alias("n_hit"), F.explode_outer("wids").alias("wid"))
    )
    listed = by_doc.join(owners, "wid", "left").groupBy("doc_id", "row").agg(F.max("times").alias("times"), F.max("n_words").alias("n_words"), F.max("n_hit").alias("n_hit"), F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    # rows that repeat id and text were one so far
    return listed.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("ids"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any word of a benchmark window, with all their columns."""
    texts = docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_h"), "text")
    wins, _ = numbered(items, window)
    bad = written(hits(texts, wins, ["_d", "_h"]).filter("wid IS NOT NULL").select("_d", "_h").distinct(), "contaminated")
    own = apart(docs).withColumn("_h", F.xxhash64("text"))
    return restored(own.join(bad.withColumnRenamed("_h", "_g"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_g")), "left_anti"), docs)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), b AS (
  SELECT item_id, w, len(w) AS n, least(10, len(w)) AS k FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark) WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT item_id, w, k, unnest(range(1, n - k + 2)) AS i FROM b)
), pos AS (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win)
), hit AS (
  SELECT doc_id, i, pos.k AS k, item_id FROM pos JOIN win ON pos.k = win.k AND array_to_string(w[i:i + pos.k - 1], ' ') = win.win
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""
