"""Rows that Python readers make from texts, dealt out by the bytes of the texts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a task reads, on average, and at least where there are fewer tasks than cores.
TASK_BYTES, LEAST_BYTES = 2 << 20, 64 << 10
#: Rows, and bytes of the texts that they came from, that leave a reader at once.
BATCH_ROWS, BATCH_BYTES = 5_000, 8 << 20


def tasks_of(size: int, cores: int) -> int:
    """Number of tasks for so many bytes of text."""
    return max(1, -(-size // TASK_BYTES), min(cores, -(-size // LEAST_BYTES)))


def dealt(texts: DataFrame, text: str, *keys: str | Column) -> DataFrame:
    """``texts`` dealt out by ``keys``: a small file or one group of rows can hold the numbers that very long texts are made
    from, so that the partitions of the input tell nothing about the work."""
    size = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return texts.repartition(tasks_of(size, texts.sparkSession.sparkContext.defaultParallelism), *keys)


def read(texts: DataFrame, text: str, keys: list[str], rows, schema: str) -> DataFrame:
    """What ``rows`` gives (tuples of ``schema``) for each row of ``texts``, whose columns are its arguments."""
    fields = [f.split() for f in schema.split(", ")]
    at = texts.columns.index(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}

        def packed(out: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*out), fields)], [n for n, _ in fields])

        for batch in batches:
            out, size = [], 0
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                out += rows(*r)
                size += len(r[at] or "")
                if out and (len(out) >= BATCH_ROWS or size >= BATCH_BYTES):
                    yield packed(out)
                    out, size = [], 0
            if out:
                yield packed(out)

    return dealt(texts, text, *keys).mapInArrow(run, schema)
