"""Encoding words with a vocabulary file of the tokenizers library, and the pieces behind ids.

The vocabulary splits at white space before anything else, so the ids of a text are the ids of its
white-space-separated words in order; special tokens hold no white space and are found inside a word.
"""

from __future__ import annotations

import os
import re
import sys

#: Words a worker keeps between batches; beyond it the store starts anew (ids don't depend on it).
MAX_CACHED = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


#: Closing punctuation: without the apostrophe (it may open a contraction) and the signs of special tokens.
TAIL = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Letters of words whose ids are those of the lower-cased letters followed by those of their closing punctuation.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


#: The same letters in lower case, as a whole word.
LOWER = "^(?:[a-z]|[ß-öø-ÿ])+$"
#: Closing punctuation of more bytes is rare and goes its own way.
TAIL_BYTES = 7


def cores(words):
    """What plain words with the same letters share, of an Arrow array of words: lower case, no closing punctuation."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.ascii_rtrim(pc.ascii_lower(words.view(pa.string())), characters=TAIL.decode())


def word_table(texts):
    """(distinct, places, cuts) of an Arrow array of texts: the distinct words as they come, the place there of each word
    of the texts, and where each text's words begin and end."""
    import pyarrow as pa
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(pa.concat_arrays([texts]).view(pa.string()))
    words = split.flatten()
    found = words.dictionary_encode()
    cuts = split.offsets.to_numpy() - split.offsets[0].as_py()
    return found.dictionary.view(pa.binary()), found.indices.to_numpy(), cuts


def joined(table: list[bytes], places, dtype):
    """(ids, ends): the ids of ``table`` at ``places``, one after another, and where those of each place end."""
    import numpy as np

    dtype = np.dtype(dtype)
    n = np.fromiter(map(len, table), np.int64, len(table)) // dtype.itemsize
    return taken(np.frombuffer(b"".join(table), dtype), n, places)


def taken(ids, n, places):
    """The runs of ``ids`` at ``places``; ``n`` says how long each run is."""
    import numpy as np

    begin, size = np.cumsum(n) - n, n[places]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(begin[places] - (ends - size), size) + np.arange(total)], ends


def byte_table() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others take code points from 256 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


class WordIds:
    """Ids of words as bytes; letters and closing punctuation are encoded apart, each distinct part once while it is kept.

    A plain part is lower-case, composed and one pre-token as it stands, so it goes to the library's model with a
    blank as the only split; every other word takes the library's whole path.
    """

    def __init__(self, path: str, dtype: str = "<u4", limit: int = MAX_CACHED):
        import numpy as np
        from tokenizers import normalizers, pre_tokenizers

        self.tok, self.model, self.limit, self.parts, self.dtype = tokenizer(path), tokenizer(path), limit, {b"": b""}, np.dtype(dtype)
        self.model.normalizer, self.model.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.bytes = {b: c for b, c in byte_table().items() if b != 0x20}
        pieces = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(pieces.values()) + 1, bool)
        self.ends[[i for piece, i in pieces.items() if piece.endswith("</w>")]] = True

    def _learn(self, parts: list[bytes]) -> None:
        """Encode parts, many in a text, and cut the ids after each word end."""
        import numpy as np

        known, width = self.parts, self.dtype.itemsize
        for at in range(0, len(parts), 1024):
            group = parts[at : at + 1024]
            text = b" ".join(group)
            text = text.decode() if text.isascii() else text.decode("latin-1").translate(self.bytes)
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            cuts = (width * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw, begin = ids.tobytes(), 0
            if len(cuts) != len(group) or cuts[-1] != len(raw):
                raise ValueError("the vocabulary does not end each word by a piece of its own")
            for part, end in zip(group, cuts):
                known[part] = raw[begin:end]
                begin = end

    def _plain(self, word: bytes) -> tuple[bytes, bytes] | None:
        """Letters and closing punctuation of a plain word, None if it is not plain."""
        head = word.rstrip(TAIL)
        text = head.decode("utf-8", "replace")
        return (text.lower().encode(), word[len(head) :]) if text and PLAIN.fullmatch(text) else None

    def pieces(self, words):
        """(table, first, second) of an Arrow array of words (binary, without white space): a list of ids, and the places
        in it of each word's letters and of its closing punctuation."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        words = words.view(pa.string())  # bytes as they are: only byte-wise functions follow
        head = cores(words)
        size, long = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (head, words))
        tail = long - size
        plain = pc.match_substring_regex(head, LOWER).to_numpy(zero_copy_only=False).astype(bool) & (tail <= TAIL_BYTES)
        # closing punctuation as a number: its bytes, first byte lowest
        _, places, data = words.buffers()
        ends = np.frombuffer(places, np.int32, len(words) + 1)[1:].astype(np.int64) if len(words) else np.zeros(0, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        code = np.zeros(len(words), np.uint64)
        for k in range(TAIL_BYTES):
            at = np.flatnonzero(plain & (tail > k))
            if not len(at):
                break
            code[at] |= raw[ends[at] - tail[at] + k].astype(np.uint64) << np.uint64(8 * k)
        codes, second = np.unique(code, return_inverse=True)
        tails = [int(c).to_bytes(8, "little").rstrip(b"\0") for c in codes]
        heads = pc.if_else(pa.array(plain), head, pa.scalar("")).dictionary_encode()
        first, letters = heads.indices.to_numpy().astype(np.int64), heads.dictionary.view(pa.binary()).to_pylist()
        second = second.astype(np.int64) + len(letters)
        odd = np.flatnonzero(~plain).tolist()
        odd_words = words.take(pa.array(odd, pa.int64())).view(pa.binary()).to_pylist()
        split = [self._plain(w) if w else (b"", b"") for w in odd_words]
        need = {*letters, *tails, *(x for p in split if p for x in p)}
        if len(self.parts) + len(need) > self.limit:
            self.parts = {b"": b""}
        self._learn(list(need - self.parts.keys()))
        known = self.parts
        table = [known[x] for x in letters] + [known[x] for x in tails]
        if odd:
            first[odd] = len(table) + 1 + np.arange(len(odd))
            second[odd] = len(table)
            table.append(b"")
            own = [known[p[0]] + known[p[1]] if p else None for p in split]
            rest = [i for i, x in enumerate(own) if x is None]
            for at in range(0, len(rest), 4096):
                group = rest[at : at + 4096]
                for i, e in zip(group, self.tok.encode_batch_fast([odd_words[i].decode("utf-8", "replace") for i in group], add_special_tokens=False)):
                    own[i] = np.array(e.ids, self.dtype).tobytes()
            table += own
        return table, first, second

    def encode(self, words: list[bytes]) -> list[bytes]:
        import pyarrow as pa

        table, first, second = self.pieces(pa.array(words, pa.binary()))
        return [table[a] + table[b] for a, b in zip(first.tolist(), second.tolist())]


class TextIds:
    """Ids of whole texts: their distinct words are encoded once a batch, and put together by position."""

    def __init__(self, path: str, dtype: str, limit: int = 2 * MAX_CACHED):
        self.words = WordIds(path, dtype, limit)

    def encode(self, texts) -> list[bytes]:
        """Ids of each text of an Arrow array (binary)."""
        import numpy as np
        import pyarrow.compute as pc

        out: list[bytes] = []
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):  # about 8 MB of text at a time
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (8 << 20), side="right")))
            out += self._group(texts.slice(at, stop - at))
            at = stop
        return out

    def _group(self, texts) -> list[bytes]:
        import numpy as np

        words, at, cuts = word_table(texts)
        table, first, second = self.words.pieces(words)
        ids, ends = joined(table, np.stack([first[at], second[at]], axis=1).ravel(), self.words.dtype)
        by_word = np.concatenate([[0], ends[1::2]]) * self.words.dtype.itemsize
        raw, cuts = ids.tobytes(), by_word[cuts].tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def worker_words(path: str, limit: int = MAX_CACHED // 2) -> WordIds:
    """The word encoder of this Python worker, kept over tasks and groups; classes of words share little but punctuation."""
    kept = sys.__dict__.setdefault("_token_words", {})
    if path not in kept:
        kept[path] = WordIds(path, "<u4", limit)
    return kept[path]


def pieces_by_id(path: str) -> list[str | None]:
    """The piece at each id, kept over tasks and groups."""
    kept = sys.__dict__.setdefault("_token_pieces", {})
    if path not in kept:
        known = dict(vocabulary(path))
        kept[path] = [known.get(i) for i in range(max(known, default=-1) + 1)]
    return kept[path]


def worker_encoder(path: str, dtype: str) -> TextIds:
    """The encoder of this Python worker, kept over tasks (functions arrive by value, so it hangs on ``sys``)."""
    kept = sys.__dict__.setdefault("_token_encoders", {})
    if (path, dtype) not in kept:
        kept[path, dtype] = TextIds(path, dtype)
    return kept[path, dtype]


def vocabulary(path: str) -> list[tuple[int, str]]:
    """(id, piece) of the whole vocabulary, special tokens included: its size is fixed by the file."""
    return sorted((i, piece) for piece, i in tokenizer(path).get_vocab(with_added_tokens=True).items())


def joiner(path: str) -> str:
    """What the library puts between pieces: a blank where the file names no decoder."""
    import json

    with open(path, encoding="utf-8") as f:
        if json.load(f).get("decoder") is not None:
            raise ValueError("only vocabularies without a decoder step are supported")
    return " "
