"""Supervised subword embeddings for document quality.

Words, pairs of neighbouring words and character n-grams (three and four bytes, words padded by a blank) are hashed to
``BUCKETS`` learned vectors; a document is their average, a softmax layer on top gives the two classes.  Training is
stochastic gradient descent in numpy on the driver, over at most about ``rows_per_class`` labelled documents of each
class (a documented bound; rows are drawn by a hash of the id).  Averaging and the last layer are linear, so scoring
needs one number a bucket: the executors get a table of ``BUCKETS`` floats, whatever the corpus.

A pair of words is hashed by the exclusive or of its words, so all immediate repetitions share one bucket.

Defined cases: null and empty texts get the score of the bias alone; without rows of both classes every text gets the
smoothed share of good labels; null ids are never held out and never learned from; a repeated id is scored row by row,
and learned from in the order of its texts' hashes; of several labels of an id the greatest counts; texts of more than
``TRAIN_BYTES`` are scored whole but not learned from, which bounds what the driver gets; a column of the input named score gives way to
the operator's own where both would be returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.hashing import chunks, word_hashes
from graphlens.llm.shared import apart, crc_mod, release, restored

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
THRESHOLD = 0.7
ROWS_PER_CLASS = 2000
TRAIN_BYTES = 1 << 17


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature of every text, and the index of its text."""
    raw = b"".join(b" " + t + b" " for t in texts)
    b = np.frombuffer(raw, np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts)))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends, prepend=0))
    space = (b == 32) | ((b >= 9) & (b <= 13))
    c = np.where(space, 32, b).astype(np.uint32)
    shift = np.uint32(32 - BUCKET_BITS)
    three = c[:-2] | (c[1:-1] << np.uint32(8)) | (c[2:] << np.uint32(16))
    at3 = np.flatnonzero(~space[1:-1])
    four = three[:-1] | (c[3:] << np.uint32(24))
    at4 = np.flatnonzero(~(space[1:-2] | space[2:-1]))
    f3 = (three[at3] * np.uint32(2654435761)) >> shift
    f4 = (four[at4] * np.uint32(2246822519) + np.uint32(374761393)) >> shift
    first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    words, of_word = word_hashes([raw])[0], owner[first]
    near = of_word[1:] == of_word[:-1]
    pairs = (words[1:] ^ words[:-1])[near]
    top = np.uint64(64 - BUCKET_BITS)
    f1 = (words * np.uint64(0xC2B2AE3D27D4EB4F)) >> top
    f2 = (pairs * np.uint64(0x165667B19E3779F9)) >> top
    return np.concatenate([f3, f4, f1.astype(np.uint32), f2.astype(np.uint32)]), np.concatenate([owner[at3 + 1], owner[at4 + 1], of_word, of_word[1:][near]])


class Model:
    """A number a bucket and a bias: the log odds of a text are the bias plus the mean over its features."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table.astype(np.float32), float(bias)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        f, owner = features(texts)
        n = np.bincount(owner, minlength=len(texts))
        total = np.bincount(owner, weights=self.table[f], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(n, 1), -40, 40)))


def train(texts: list[bytes], labels: np.ndarray, share: float, dim: int = 16, epochs: int = 12, rate: float = 8.0, seed: int = 7) -> Model:
    """Fit on ``texts``; ``share`` is the share of label 1 among all labelled rows, to which the odds are corrected."""
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS), np.log((share + 1e-3) / (1 - share + 1e-3)))
    rng = np.random.default_rng(seed)
    docs = []
    for t in texts:
        own, n = np.unique(features([t])[0], return_counts=True)
        docs.append((own, (n / max(1, n.sum())).astype(np.float32)))
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            own, w = docs[i]
            step = rate * (1 - done / steps)
            done += 1
            mean = w @ vectors[own]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ out
            out -= 0.1 * step * np.outer(p, mean)
            bias -= 0.02 * step * p
            vectors[own] -= step * w[:, None] * back[None, :]
    drawn = labels.mean()
    prior = np.log(max(share, 1e-6) / max(1 - share, 1e-6)) - np.log(drawn / (1 - drawn))
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0] + prior))


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """Train on labelled rows of ``docs`` (doc_id, text) that aren't held out; labels: doc_id, quality."""
    marked = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").filter(crc_mod(F.col("doc_id"), 4) != 2).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = (counts.get(1, 0) + 1) / (total + 2)
    if not total:
        return train([], np.zeros(0), share)
    part = F.create_map(*[F.lit(x) for q, n in counts.items() for x in (q, min(1.0, rows_per_class / n))])
    drawn = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.element_at(part, F.col("quality")) * (1 << 30))
    # the drawn labels are bounded by rows_per_class, so the small side of this join is
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.xxhash64("text").alias("tie")).filter(F.octet_length("text") <= TRAIN_BYTES)
    rows = texts.join(F.broadcast(drawn), "doc_id").toArrow().sort_by([("doc_id", "ascending"), ("tie", "ascending")])
    return train(rows.column("text").to_pylist(), rows.column("quality").to_numpy(), share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with column score (0 to 1), from column text alone."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    docs = docs.drop("score")
    held = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        own = Model(*held.value)
        for batch in batches:
            texts = [t or b"" for t in pc.cast(batch.column("text"), pa.binary()).to_pylist()]
            found = [own.score(group) for _, group in chunks(texts, 1 << 19)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())], names=[*batch.schema.names, "score"])
        release()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; ids with crc32 mod 4 = 2 are never learned from."""
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    rows = score(docs.select("doc_id", "text"), fit(docs, labels, rows_per_class))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with their own columns."""
    return restored(score(apart(docs), fit(docs, labels, rows_per_class)).filter(F.col("score") >= threshold), docs)
