"""Helpers shared by the corpus operators: table access, the shared work folder, cluster facts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def release() -> None:
    """Give freed memory of a Python worker back to the system: idle workers keep their place, not their peak."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent (local sessions, tests) a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            found = jvm_dir.get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="graphlens-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders of the open ``scratch`` scopes, the innermost last.
_SCRATCH: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table of that name that no other has."""
    return f"{work_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def removed_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write inside this scope are deleted at its end: write what they return inside it, too."""
    path = new_path(spark, "scratch")
    _SCRATCH.append(path)
    try:
        yield
    finally:
        _SCRATCH.remove(path)
        removed_path(spark, path)


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a reader of it.

    This cuts the lineage: a lost executor costs the tasks it ran, never the steps before the table.
    """
    spark = df.sparkSession
    path = f"{_SCRATCH[-1]}/{name}-{uuid.uuid4().hex}" if _SCRATCH else new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_partitions(df: DataFrame) -> int:
    """Number of partitions the scan of ``df`` has: it grows with the bytes of the input.

    For a plan with exchanges the session's setting serves: asking such a plan for its partitions would run it.
    """
    if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, df.rdd.getNumPartitions())


#: Bytes of text in a block (a bucket) of documents, and in a hash class, on average.
BLOCK_BYTES = 8 << 20


def blocks_of(texts: DataFrame) -> int:
    """Number of blocks for the whole of column ``text``: it follows the bytes of the texts, however well they compress
    and however many partitions the session has, so that what one task holds does not grow with the corpus."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return max(2, -(-size // BLOCK_BYTES), min(cores, -(-size // (1 << 20))))


#: A key is hot if it has more than one in HOT of all rows.
HOT = 10_000


def met_by_key(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``keyed`` (a written table, one row a key; column ``size``: how many of the ``total`` rows have it).

    Hot keys are broadcast, fewer than ``HOT`` by their definition, so that no task gets the rows of one; the others meet by exchange.
    """
    hot = keyed.filter(F.col("size") * HOT > total)
    if not hot.limit(1).count():
        return rows.join(keyed, key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.filter(F.col("size") * HOT <= total), key)
    return cold.unionByName(rows.join(F.broadcast(hot), key))


def apart(docs: DataFrame) -> DataFrame:
    """``docs`` with every column but doc_id and text renamed by its place, so that no name of an operator clashes."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"__c{i}" for i, c in enumerate(docs.columns)])


def restored(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` under their own names, from a frame that came from ``apart``."""
    return kept.select(*[c if c in ("doc_id", "text") else f"__c{i}" for i, c in enumerate(docs.columns)]).toDF(*docs.columns)


def bucket(n: int, *cols: Column) -> Column:
    """Bucket 0..n-1 from the content of a row: the same on each attempt, and spread for copies and hot sources."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null ids: null)."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(n)
