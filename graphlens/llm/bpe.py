"""BPE encoding by a table of distinct words, and decoding by an id-to-piece join.

Documents are dealt into blocks by content.  A block asks once for each of its distinct words; requests are grouped by
a hash class of the word, where every distinct word of the whole corpus is encoded exactly once, and the ids go back to
the blocks that asked.  There the ids are joined to the words by position.  One row carries all words that a block asks
of a class, compressed, so what moves is the texts once and each block's distinct words, never a row per word
occurrence.  No side is broadcast but the vocabulary (id, piece), whose size the file fixes.

Defined cases: null text counts as empty and has no ids; a null or repeated doc_id is carried through, a row a document;
ids outside the vocabulary decode to nothing; a column of the input named decoded gives way to the operator's own; an
empty table gives no rows; a text of any length is encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.blocks import blocks, unpacked_array
from graphlens.llm.hashing import string_hashes
from graphlens.llm.shared import blocks_of, release
from graphlens.llm.tokens import cores, default_vocabulary, joined, joiner, pieces_by_id, taken, word_table, worker_words


def _word_lists(words, classes: int):
    """(order, words, cuts): a block's distinct words by class, in order of their bytes in a class, and where each class
    begins and ends: the same lists in whatever order the block's rows came."""
    import numpy as np
    import pyarrow.compute as pc

    by_name = pc.array_sort_indices(words).to_numpy().astype(np.int64)
    of = (string_hashes(cores(words)) % np.uint64(classes)).astype(np.int64)[by_name]
    order = by_name[np.argsort(of, kind="stable")]
    return order, words.take(order), np.searchsorted(np.sort(of), np.arange(classes + 1))


def _block_texts(table):
    import pyarrow as pa

    return pa.concat_arrays([unpacked_array(s.as_py(), t.as_py()) for s, t in zip(table.column("sizes"), table.column("texts"))])


def _lines(words) -> tuple[bytes, list[int]]:
    """Words with a line feed behind each, and where each begins."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    ended = pc.binary_join_element_wise(words, pa.scalar(b"", pa.binary()), pa.scalar(b"\n", pa.binary()))
    _, places, data = ended.buffers()
    return data.to_pybytes() if data is not None else b"", np.frombuffer(places, np.int32, len(ended) + 1).tolist() if len(ended) else [0]


def _ask(classes: int):
    def ask(table):
        import numpy as np
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        words, _, _ = word_table(_block_texts(table))
        _, words, cuts = _word_lists(words, classes)
        raw, at = _lines(words)
        cuts = cuts.tolist()
        asked = [k for k in range(classes) if cuts[k] < cuts[k + 1]]
        packed = [pack(raw[at[cuts[k]] : at[cuts[k + 1]]]) for k in asked]
        block = table.column("block")[0].as_py()
        del words, raw
        release()
        return pa.table({"class": pa.array(asked, pa.int32()), "block": pa.array(np.full(len(asked), block, np.int32)), "words": pa.array(packed, pa.binary())})

    return ask


def _answer(path: str):
    def answer(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import zstandard

        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
        asked = pa.array([unpack(x.as_py())[:-1] for x in table.column("words")], pa.binary())
        lists = pc.split_pattern(asked.view(pa.string()), "\n")
        found = lists.flatten().dictionary_encode()
        own, at = found.indices.to_numpy(), lists.offsets.to_numpy().tolist()
        ids_of, first, second = worker_words(path).pieces(found.dictionary.view(pa.binary()))
        size = np.fromiter(map(len, ids_of), np.int64, len(ids_of)) // 4
        sizes, ids = [], []
        for a, b in zip(at, at[1:]):
            w = own[a:b]
            n = size[first[w]] + size[second[w]]
            sizes.append(pack(n.astype(np.uint8 if n.max(initial=0) < 256 else np.uint32).tobytes()))
            ids.append(pack(joined(ids_of, np.stack([first[w], second[w]], axis=1).ravel(), "<u4")[0].tobytes()))
        release()
        return pa.table({"block": table.column("block"), "class": table.column("class"), "lens": pa.array(sizes, pa.binary()), "ids": pa.array(ids, pa.binary())})

    return answer


def _pieces(path: str):
    """The piece at each id as an Arrow array, kept over tasks and groups; ids without a piece are null."""
    import sys

    import pyarrow as pa

    kept = sys.__dict__.setdefault("_token_piece_arrays", {})
    if path not in kept:
        kept[path] = pa.array(pieces_by_id(path), pa.string())
    return kept[path]


def _decoded(ids, cuts, path: str, between: str):
    """The id-to-piece join: texts of the pieces of each run of ``ids`` between ``cuts``."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    pieces = _pieces(path)
    known = ids < len(pieces)
    known[known] = pc.is_valid(pieces).to_numpy(zero_copy_only=False)[ids[known]]
    if not known.all():
        cuts = np.concatenate([[0], np.cumsum(known)])[cuts]
        ids = ids[known]
    rows = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pieces.take(pa.array(ids.astype(np.int64))))
    return pc.binary_join(rows, between)


#: Words that are put together at once.
JOINED_WORDS = 200_000


def _assemble(classes: int, path: str, between: str | None):
    """Joins ids to words by position; with ``between``, the pieces to ids as well."""

    def assemble(texts, answers):
        import numpy as np
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        own = pa.chunked_array([ids.values for ids in texts.column("doc_ids")])
        words, at, cuts = word_table(_block_texts(texts))
        order, _, bounds = _word_lists(words, classes)
        given = sorted(zip(*(answers.column(c).to_pylist() for c in ("class", "lens", "ids"))))
        n, raw = np.zeros(len(words), np.int64), []
        for k, packed, ids in given:
            lens, m = unpack(packed), int(bounds[k + 1] - bounds[k])
            n[bounds[k] : bounds[k + 1]] = np.frombuffer(lens, np.uint8 if len(lens) == m else np.uint32)
            raw.append(unpack(ids))
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        own_ids = np.frombuffer(b"".join(raw), np.uint32)
        del raw, words
        found, decoded, lo = [], [], 0
        while lo < len(cuts) - 1:  # a bounded number of words at a time, a text at least
            hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + JOINED_WORDS, side="right")) - 1)
            ids, ends = taken(own_ids, n, place[at[cuts[lo] : cuts[hi]]])
            by_text = np.concatenate([[0], ends])[cuts[lo : hi + 1] - cuts[lo]]
            found.append(_binary(ids, by_text))
            if between is not None:
                decoded.append(_decoded(ids, by_text, path, between))
            lo = hi
        out = {"doc_id": own, "ids": pa.chunked_array(found, pa.binary())} | ({} if between is None else {"decoded": pa.chunked_array(decoded, pa.string())})
        del own_ids, at, place
        release()
        return pa.table(out)

    return assemble


def _binary(ids, cuts):
    """The runs of ``ids`` between ``cuts`` as bytes."""
    import numpy as np
    import pyarrow as pa

    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids.astype("<u4")))])


def encode(docs: DataFrame, vocabulary_path: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of each row of ``docs``; with ``decoded`` their text, too."""
    path = vocabulary_path or default_vocabulary()
    n = classes = blocks_of(docs)
    dealt = blocks(docs, n)
    asked = dealt.groupBy("block").applyInArrow(_ask(classes), "class int, block int, words binary").repartitionById(classes, F.col("class"))
    answers = asked.groupBy("class").applyInArrow(_answer(path), "block int, class int, lens binary, ids binary").repartitionById(n, F.col("block"))
    out = f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary" + (", decoded string" if decoded else "")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_assemble(classes, path, joiner(path) if decoded else None), out)


def decode(encoded: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """``encoded`` with column ``decoded``: the pieces of the ids as the library joins them."""
    from pyspark.sql.types import StringType, StructField, StructType

    path = vocabulary_path or default_vocabulary()
    between, encoded = joiner(path), encoded.drop("decoded")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in (whole.slice(lo, 512) for whole in batches for lo in range(0, whole.num_rows, 512)):
            raw = [x.as_py() or b"" for x in batch.column("ids")]
            cuts = np.cumsum([0, *(len(x) // 4 for x in raw)])
            out = _decoded(np.frombuffer(b"".join(x[: len(x) // 4 * 4] for x in raw), "<u4"), cuts, path, between)
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def round_trip(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of ``docs``."""
    both = encode(docs, vocabulary_path, decoded=True)
    return both.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
