"""Documents dealt into blocks by content, packed and compressed, a row for the documents of a block in a batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.shared import bucket, release


def blocks(docs: DataFrame, n: int) -> DataFrame:
    """Rows (block, doc_ids, sizes, texts) from doc_id and text; null text is empty.

    Steps that use the result more than once in a query share one exchange, of a partition a block whatever the session says.
    """
    id_type = dict(docs.dtypes)["doc_id"]

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in (whole.slice(lo, 2500) for whole in batches for lo in range(0, whole.num_rows, 2500)):
            table = batch.take(pa.array(np.argsort(batch.column("block").to_numpy(), kind="stable")))
            block, texts, ids = table.column("block").to_numpy(), table.column("text").to_pylist(), table.column("doc_id")
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            spans = [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(block[a]) for a, _ in spans], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(cuts if spans else [0], pa.int32()), ids),
                    pa.array([np.array([len(t) for t in texts[a:b]], np.uint32).tobytes() for a, b in spans], pa.binary()),
                    pa.array([squeeze(b"".join(texts[a:b])) for a, b in spans], pa.binary()),
                ],
                names=["block", "doc_ids", "sizes", "texts"],
            )
        release()

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn("block", bucket(n, F.col("doc_id"), F.col("text")))
    return texts.mapInArrow(pack, f"block int, doc_ids array<{id_type}>, sizes binary, texts binary").repartitionById(n, F.col("block"))


def unpacked_array(sizes: bytes, packed: bytes):
    """The texts of one packed row as an Arrow array, without copies."""
    import numpy as np
    import pyarrow as pa
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(packed)
    places = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.uint32), dtype=np.int64)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(raw)])


def unpacked(sizes: bytes, packed: bytes) -> list[bytes]:
    """The texts of one packed row."""
    import numpy as np
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(packed)
    ends = np.cumsum(np.frombuffer(sizes, np.uint32), dtype=np.int64).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]
