"""Language identification by rank-order n-gram profiles (out-of-place distance).

A profile lists the ``top`` most frequent letter n-grams (one to three letters, words padded by a blank) of a language.
A document's own ranking is compared to each profile: an n-gram costs the difference of its ranks, or ``top`` where
the profile lacks it; the language with the least sum wins.  Profiles are learned from at most about
``rows_per_language`` labelled documents a language (a documented bound; rows are drawn by a hash of the id), with the
counts added up in Spark.  Scoring reads every whole text.

Defined cases: null text, or text without a letter, is ``und`` with score 0; null ids are never held out and never
learned from; without labelled rows every text is ``und``; ties go to the language first in alphabetical order; a
repeated id is judged row by row; columns of the input named lang_pred or score give way to the operator's own; an
empty table gives no rows; a text of any length is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.llm.shared import crc_mod

TOP = 300
ROWS_PER_LANGUAGE = 1500
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """True for each code point that is a letter; kept for the life of the worker."""
    import sys

    kept = sys.__dict__.get("_letter_table")
    if kept is None:
        kept = sys.__dict__["_letter_table"] = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return kept


def grams(text: str | None, letters: np.ndarray) -> np.ndarray:
    """Codes of all n-grams of one to three letters of ``text``, 21 bits a place; a run of non-letters is one blank."""
    cps = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters[cps]
    if not is_letter.any():
        return np.zeros(0, np.uint64)
    x = np.where(is_letter, cps, 32).astype(np.uint64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first non-letter after a word stays, as the blank
    keep[0] = True
    x = x[keep]
    blank = x == 32
    two = (x[:-1] << np.uint64(21)) | x[1:]
    three = (two[:-1] << np.uint64(21)) | x[2:]
    return np.concatenate([x[~blank], two, three[~blank[1:-1]]])


def ranked(codes: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    own, n = np.unique(codes, return_counts=True)
    if len(own) > 4 * top:
        least = np.partition(n, len(n) - top)[len(n) - top]
        own, n = own[n >= least], n[n >= least]
    return own[np.lexsort((own, -n))][:top]


def learn(labelled: DataFrame, top: int = TOP, rows_per_language: int = ROWS_PER_LANGUAGE) -> dict[str, list[int]]:
    """Profiles of each value of ``lang`` from columns doc_id, text, lang.  The sample bounds what the driver gets."""
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, rows_per_language / n))])
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        letters, found = letter_table(), {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found.setdefault(lang, []).append(grams(text, letters))
        for lang, codes in found.items():
            own, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    added = drawn.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    first = added.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).filter(F.col("place") <= top)
    profiles: dict[str, list[int]] = {}
    for r in sorted(first.select("lang", "place", "code").collect()):  # ``top`` rows a language
        profiles.setdefault(r["lang"], []).append(r["code"])
    return profiles


def identify(docs: DataFrame, profiles: dict[str, list[int]], top: int = TOP) -> DataFrame:
    """``docs`` with lang_pred and score, from column text alone.  The profiles (``top`` codes a language) travel with the code."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    docs = docs.drop("lang_pred", "score")
    langs = sorted(profiles)
    known = np.array(sorted({c for p in profiles.values() for c in p}), np.uint64)
    ranks = np.full((len(known), len(langs)), -1, np.int32)
    for j, lang in enumerate(langs):
        ranks[np.searchsorted(known, np.array(profiles[lang], np.uint64)), j] = np.arange(len(profiles[lang]))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        letters = letter_table()
        for batch in batches:
            pred, score = [], []
            for text in batch.column("text"):
                own = ranked(grams(text.as_py(), letters), top)
                if not len(own) or not langs:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    continue
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                theirs = np.where((known[at] == own)[:, None], ranks[at], -1)
                cost = np.where(theirs < 0, top, np.abs(theirs - np.arange(len(own))[:, None])).sum(axis=0)
                best = int(cost.argmin())
                pred.append(langs[best])
                score.append(float(1 - cost[best] / (top * len(own))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def predicted(docs: DataFrame, top: int = TOP, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; ids with crc32 mod 5 = 0 are never learned from."""
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    profiles = learn(docs.filter(~held), top, rows_per_language)
    scored = identify(docs.select("doc_id", "text"), profiles, top)
    return scored.select("doc_id", held.alias("held_out"), "lang_pred", "score")
