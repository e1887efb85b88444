"""Cutting lineage between the steps of a loop."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only in local sessions that have none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and (at := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = at.get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="graphlens-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: later steps neither recompute it nor lose it with an executor."""
    path = f"{shared_folder(df.sparkSession)}/steps/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Visited:
    """What a loop has found so far: one table in the shared folder that grows by a step at a time.

    A lost executor costs the tasks it ran; no step is planned again after it is written.
    """

    def __init__(self, first: DataFrame):
        self.spark, self.schema = first.sparkSession, first.schema
        self.path, self.n = f"{shared_folder(self.spark)}/steps/{uuid.uuid4().hex}", 0
        self.add(first)

    def add(self, rows: DataFrame) -> int:
        """Append ``rows`` and return how many they are, from the files' footers."""
        rows.select(*self.schema.names).write.mode("append").parquet(self.path)
        before, self.n = self.n, self.rows().count()
        return self.n - before

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)
