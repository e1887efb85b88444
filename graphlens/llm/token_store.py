"""Token-id shards with a minimal perfect hash index.

Documents are ordered by id over the whole cluster (range exchange, sort within partitions) and cut into shards.  A
shard is one row, and one file, of the uncompressed Parquet table ``shards``: the raw id payload, the end offset of each
entry, the keys, and the index.  The index is a level-by-level minimal perfect hash (a key lands on the first level
where it is alone on its bit; its slot is the number of set bits before it), with a 32-bit fingerprint and an entry
number a slot: a key is found or refused in constant time, without comparing keys.  The small table ``index`` has the
same indexes and offsets without the payload, a row a shard with the name of its file: ``fetch`` asks it first, and then
opens the files of the shards that hold the keys and no others.  Both tables are written and read by Spark alone, so any
store serves.

Defined cases: null text is empty (an end id alone); null ids come first and are not in the index; rows of one id
stay adjacent, the index names the first of them; an empty table gives an empty store; columns other than doc_id and text
play no part; a text longer than a shard is a shard of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.llm.shared import input_partitions, new_path, release
from graphlens.llm.tokens import default_vocabulary, tokenizer, worker_encoder

SHARD_BYTES = 16 << 20
GAMMA = 2.0
INDEX = "shard long, n_entries long, n_null long, n_tokens long, first_key long, last_key long, width int, ends binary, levels binary, bits binary, ranks binary, prints binary, entries binary"
FIELDS = f"{INDEX}, keys binary, payload binary"
#: Keys that a lookup may ask one by one; more are pruned by their range alone.
PRUNED_KEYS = 500


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over keys and a seed."""
    z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Maps each of n distinct 64-bit keys to its own slot 0..n-1."""

    def __init__(self, levels: np.ndarray, bits: np.ndarray, ranks: np.ndarray):
        self.levels, self.bits, self.ranks = levels, bits, ranks

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = GAMMA) -> PerfectHash:
        left, sizes, words = keys.view(np.uint64), [], []
        while len(left):
            m = 64 * max(1, int(np.ceil(gamma * len(left) / 64)))
            at = (mixed(left, len(sizes)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            words.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        bits = np.concatenate(words).view(np.uint64) if words else np.zeros(0, np.uint64)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits))[:-1]]).astype(np.uint32) if len(bits) else np.zeros(0, np.uint32)
        return cls(np.array(sizes, np.uint32), bits, ranks)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level has its bit.  A foreign key may get a slot: compare fingerprints."""
        keys, out, base = keys.view(np.uint64), np.full(len(keys), -1, np.int64), 0
        open_ = np.arange(len(keys))
        for level, m in enumerate(self.levels.tolist()):
            at = (mixed(keys[open_], level) % np.uint64(m)).astype(np.int64) + base
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (self.ranks[at >> 6] + np.bitwise_count(below))[hit]
            open_, base = open_[~hit], base + m
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.view(np.uint64), 0x5BD1) >> np.uint64(32)).astype(np.uint32)


class Index:
    """The index of one shard: the entry of a key, and the place of an entry's ids in the payload."""

    def __init__(self, row: dict):
        self.ends = np.frombuffer(row["ends"], np.int64)
        self.hash = PerfectHash(np.frombuffer(row["levels"], np.uint32), np.frombuffer(row["bits"], np.uint64), np.frombuffer(row["ranks"], np.uint32))
        self.prints, self.entries = np.frombuffer(row["prints"], np.uint32), np.frombuffer(row["entries"], np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """First entry of each key, -1 where the shard lacks it (up to the fingerprint's 2^-32)."""
        slots = self.hash.slots(keys)
        known = (slots >= 0) & (self.prints[np.maximum(slots, 0)] == fingerprints(keys)) if len(self.prints) else np.zeros(len(keys), bool)
        return np.where(known, self.entries[np.maximum(slots, 0)] if len(self.entries) else 0, -1).astype(np.int64)

    def span(self, entry: int) -> tuple[int, int]:
        return int(self.ends[entry - 1]) if entry else 0, int(self.ends[entry])


def _shard(number: int, keys: list, texts: list[bytes], dtype: str) -> dict:
    width = np.dtype(dtype).itemsize
    null = sum(k is None for k in keys)
    own = np.array([k for k in keys if k is not None], np.int64)
    distinct, first = np.unique(own, return_index=True)
    index = PerfectHash.build(distinct)
    slots = index.slots(distinct)
    prints, entries = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.uint32)
    prints[slots], entries[slots] = fingerprints(distinct), first + null
    ends = np.cumsum([len(t) // width for t in texts], dtype=np.int64)
    return {
        "shard": number, "n_entries": len(keys), "n_null": null, "n_tokens": int(ends[-1]), "first_key": int(own[0]) if len(own) else None, "last_key": int(own[-1]) if len(own) else None, "width": width, "keys": own.tobytes(), "ends": ends.tobytes(),
        "levels": index.levels.tobytes(), "bits": index.bits.tobytes(), "ranks": index.ranks.tobytes(), "prints": prints.tobytes(), "entries": entries.tobytes(), "payload": b"".join(texts),
    }


def write_store(docs: DataFrame, path: str, vocabulary_path: str | None = None, end_id: int = 1, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every text, append ``end_id`` and write shards and index to ``path`` in ascending order of doc_id."""
    vocab = vocabulary_path or default_vocabulary()
    dtype = "<u2" if tokenizer(vocab).get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else "<u4"
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), input_partitions(docs))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, end = worker_encoder(vocab, dtype), np.array([end_id], dtype).tobytes()
        part, made, keys, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            nonlocal made, keys, texts, size
            row = _shard((part << 32) + made, keys, texts, dtype)
            made, keys, texts, size = made + 1, [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        big = pa.binary()
        schema = pa.schema([(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": big}[f.split()[1]]) for f in FIELDS.split(", ")])
        for batch in batches:
            ids = encoder.encode(batch.column("text"))
            for key, raw in zip(batch.column("doc_id").to_pylist(), ids):
                keys.append(key)
                texts.append(raw + end)
                size += len(raw) + len(end)
                if size >= shard_bytes:
                    yield flush()
        if keys:
            yield flush()
        release()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = texts.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(run, FIELDS).write.options(compression="none", maxRecordsPerFile=1).parquet(f"{path}/shards")
    made = _table(docs.sparkSession, path, "shards", FIELDS)
    made.select(*INDEX_COLUMNS, F.col("_metadata.file_name").alias("file")).write.parquet(f"{path}/index")


INDEX_COLUMNS = [f.split()[0] for f in INDEX.split(", ")]


def _table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry: shard, doc_id, at (ids of the shard before it), ids (little-endian unsigned 32-bit), fetched through the index."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                index, own = Index(row), np.frombuffer(row["keys"], np.int64)
                payload = np.frombuffer(row["payload"], f"<u{row['width']}")
                distinct, count = np.unique(own, return_counts=True)
                first = index.find(distinct)
                if (first < 0).any():
                    raise ValueError(f"the index of shard {row['shard']} lacks keys")
                turn = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
                entries = np.concatenate([np.arange(row["n_null"]), np.repeat(first, count) + turn])
                keys = [None] * row["n_null"] + own.tolist()
                for lo in range(0, len(entries), 2000):
                    part = [index.span(e) for e in entries[lo : lo + 2000].tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["shard"]] * len(part), pa.int64()),
                            pa.array(keys[lo : lo + 2000], pa.int64()),
                            pa.array([x for x, _ in part], pa.int64()),
                            pa.array([payload[x:y].astype("<u4").tobytes() for x, y in part], pa.binary()),
                        ],
                        names=["shard", "doc_id", "at", "ids"],
                    )

    return _table(spark, path, "shards", FIELDS).mapInArrow(run, "shard long, doc_id long, at long, ids binary")


def places(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """(doc_id, file, begin, end) of the given keys that the store has, from the index table alone."""
    asked = np.array(sorted(set(keys)), np.int64)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                index = Index(row)
                own = asked[np.searchsorted(asked, row["first_key"]) : np.searchsorted(asked, row["last_key"], side="right")]
                hit = [(k, *index.span(e)) for k, e in zip(own.tolist(), index.find(own).tolist()) if e >= 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _, _ in hit], pa.int64()), pa.array([row["file"]] * len(hit), pa.string()), pa.array([x for _, x, _ in hit], pa.int64()), pa.array([y for _, _, y in hit], pa.int64())],
                    names=["doc_id", "file", "begin", "end"],
                )

    out = "doc_id long, file string, begin long, end long"
    if not len(asked):
        return spark.createDataFrame([], out)
    near = lambda low, high: (F.col("first_key") <= int(high)) & (F.col("last_key") >= int(low))
    # a group of neighbouring keys a condition, so that the scan passes over the shards between them
    groups = np.array_split(asked, min(len(asked), PRUNED_KEYS))
    tests = [near(g[0], g[-1]) for g in groups]
    while len(tests) > 1:
        tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + tests[len(tests) & ~1 :]
    return _table(spark, path, "index", f"{INDEX}, file string").filter(tests[0]).mapInArrow(run, out)


def fetch(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """doc_id and ids of the given keys (a short list): the index names their places, and only the files with them are opened."""
    found: dict[str, list[tuple[int, int, int]]] = {}
    for r in places(spark, path, keys).collect():  # a row a key at most
        found.setdefault(r["file"], []).append((r["doc_id"], r["begin"], r["end"]))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                payload, own = np.frombuffer(row["payload"], f"<u{row['width']}"), found[row["file"]]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in own], pa.int64()), pa.array([payload[x:y].astype("<u4").tobytes() for _, x, y in own], pa.binary())], names=["doc_id", "ids"])

    if not found:
        return spark.createDataFrame([], "doc_id long, ids binary")
    held = spark.read.schema(FIELDS).parquet(*[f"{path}/shards/{f}" for f in found])
    return held.select("width", "payload", F.col("_metadata.file_name").alias("file")).mapInArrow(run, "doc_id long, ids binary")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """shard and the number of ids in all shards before it: totals a partition of the writer, then a running sum inside each."""
    counts = _table(spark, path, "index", f"{INDEX}, file string").select("shard", "n_tokens", F.shiftright("shard", 32).alias("part"))
    totals = counts.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # a row a partition of the writer
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    return counts.withColumn("inside", inside).join(before, "part").select("shard", (F.col("base") + F.col("inside")).alias("before"))


def stored(docs: DataFrame, vocabulary_path: str | None = None, end_id: int = 1) -> DataFrame:
    """Write ``docs`` and read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_store(docs, path, vocabulary_path, end_id)
    entries = read_store(spark, path).select("shard", "doc_id", "at", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return entries.join(starts(spark, path), "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
