"""Removal of repeated passages: confirm recurring windows, compile sharded automata, stream all documents.

A window is ``WINDOW`` consecutive words.  Documents are dealt into blocks (see blocks.py) and three steps follow.

1. Anchors.  A window's anchor is the least hash among its runs of ``ANCHOR`` words, so equal windows have equal
   anchors; about one position in fourteen is an anchor.  Blocks send their distinct anchors to hash classes, which
   answer with those found at more than one place.
2. Confirmation.  Only windows with a repeated anchor are hashed and counted over all blocks in the same way: the
   answer to a block names those of its windows whose words start at another place, too.  Windows are equal if 64 bits
   of their own hash and 32 bits of their anchor's are.
3. Location.  A block joins its confirmed windows to passages (each distinct window in one passage), cuts the passages
   into tiles of 18 words, of which every window holds one, compiles them into Aho-Corasick automata of at most
   ``SHARD_CHARS`` characters, and streams all its documents through them.  A tile found is extended word by word
   against its passage; a stretch of ``WINDOW`` words or more is an occurrence, and its words go.

A row carries all hashes that a block sends to a class, each distinct hash once however often the block has it, so a
passage in a third of all documents costs a class one hash a block.

Defined cases: null and blank texts have no words; null and repeated ids are carried through, a row a document; copies
of one document are occurrences of each other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.blocks import blocks, unpacked
from graphlens.llm.hashing import chunks, sequence_hashes, word_hashes
from graphlens.llm.shared import blocks_of, release

WINDOW = 35
ANCHOR = 8
SHARD_CHARS = 2 << 20


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of ``width`` values, by doubling."""
    have = 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of the window at each start, and the anchors' hashes at the places where they stand."""
    runs = sequence_hashes(words, ANCHOR)
    width = window - ANCHOR + 1
    if len(runs) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    least = _sliding(runs, width, np.minimum)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return least, runs[_sliding(padded, width, np.maximum) == runs]


def _docs(table):
    """The texts of a block, in order, in groups of bounded size."""
    for sizes, packed in zip(table.column("sizes"), table.column("texts")):
        for _, group in chunks(unpacked(sizes.as_py(), packed.as_py())):
            words, bounds = word_hashes(group)
            yield group, words, bounds.tolist()


def _repeats(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and whether each occurs more than once."""
    own, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
    return own, n > 1


def _send(block: int, own: np.ndarray, many: np.ndarray, classes: int, checks: np.ndarray | None = None):
    """Rows (class, block, hashes, many, checks) for each class that gets any."""
    import pyarrow as pa

    of = (own >> np.uint64(40)) % np.uint64(classes)
    order = np.argsort(of, kind="stable")
    keys, at = np.unique(of[order], return_index=True)
    hashes = np.split(own[order], at[1:]) if len(keys) else []
    flags = np.split(many[order], at[1:]) if len(keys) else []
    more = np.split(checks[order], at[1:]) if checks is not None and len(keys) else [np.zeros(0, np.uint32)] * len(keys)
    return pa.table({
        "class": pa.array(keys.astype(np.int32), pa.int32()), "block": pa.array([block] * len(keys), pa.int32()),
        "hashes": pa.array([h.tobytes() for h in hashes], pa.binary()), "many": pa.array([np.packbits(f).tobytes() for f in flags], pa.binary()),
        "checks": pa.array([c.tobytes() for c in more], pa.binary()),
    })


SENT = "class int, block int, hashes binary, many binary, checks binary"


def _ask_anchors(classes: int, window: int):
    def ask(table):
        found = []
        for _, words, bounds in _docs(table):
            got = [anchors(words[a:b], window)[1] for a, b in zip(bounds, bounds[1:]) if b - a >= window]
            if got:
                found.append(np.concatenate(got))
        release()
        return _send(table.column("block")[0].as_py(), *_repeats(found), classes)

    return ask


def _answer(table):
    """To each block, those of its hashes that occur more than once, in it or with other blocks."""
    import pyarrow as pa

    sent = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")]
    flat = np.concatenate(sent)
    many = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(h)).astype(bool) for x, h in zip(table.column("many"), sent)])
    own, first, at, n = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
    checks = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("checks")])
    if len(checks) and (checks != checks[first][at]).any():  # different windows of one hash are told apart
        _, at, n = np.unique(np.stack([at, checks]), axis=1, return_inverse=True, return_counts=True)
        at = at.ravel()
    n[at[many]] = 2
    again = n[at] > 1
    ends = np.cumsum([len(h) for h in sent])
    got = [h[a] for h, a in zip(sent, np.split(again, ends[:-1]))]
    rows = [(b, h.tobytes()) for b, h in zip(table.column("block").to_pylist(), got) if len(h)]
    return pa.table({"block": pa.array([b for b, _ in rows], pa.int32()), "hashes": pa.array([h for _, h in rows], pa.binary())})


def _known(answers) -> np.ndarray:
    """The sorted hashes of all answers to a block."""
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x.as_py(), np.uint64) for x in answers.column("hashes")]]))


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _ask_windows(classes: int, window: int):
    def ask(table, answers):
        import pyarrow as pa

        if not table.num_rows:
            return pa.table({"class": pa.array([], pa.int32()), "block": pa.array([], pa.int32())} | {c: pa.array([], pa.binary()) for c in ("hashes", "many", "checks")})
        repeated, found, checks = _known(answers), [], []
        for _, words, bounds in _docs(table):
            for a, b in zip(bounds, bounds[1:]):
                if b - a >= window:
                    least = anchors(words[a:b], window)[0]
                    may = _among(least, repeated)
                    if may.any():
                        found.append(sequence_hashes(words[a:b], window)[may])
                        checks.append((least[may] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        own, at, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_index=True, return_counts=True)
        checks = np.concatenate(checks)[at] if checks else np.zeros(0, np.uint32)
        release()
        return _send(table.column("block")[0].as_py(), own, n > 1, classes, checks)

    return ask


def passages(docs: list[np.ndarray], recurring: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(document, first word, end) of passages made of recurring windows, each distinct window in one of them."""
    seen, out = np.zeros(len(recurring), bool), []
    for d, words in enumerate(docs):
        hashes = sequence_hashes(words, window)
        hit = np.flatnonzero(_among(hashes, recurring))
        if not len(hit):
            continue
        number = np.searchsorted(recurring, hashes[hit])
        _, first = np.unique(number, return_index=True)
        new = np.zeros(len(hit), bool)
        new[first] = True
        new &= ~seen[number]
        seen[number] = True
        starts = hit[new]
        if len(starts):
            cuts = np.flatnonzero(np.diff(starts) > 1) + 1
            out += [(d, int(run[0]), int(run[-1]) + window) for run in np.split(starts, cuts)]
    return out


class Shard:
    """An automaton over the tiles of some passages (lists of words)."""

    def __init__(self, found: list[list[bytes]], window: int):
        import ahocorasick

        self.passages, self.window = found, window
        size = (window + 1) // 2
        tiles: dict[str, list[tuple[int, int]]] = {}
        for p, words in enumerate(found):
            for at in range(0, len(words) - size + 1, size):
                tiles.setdefault(" " + b" ".join(words[at : at + size]).decode("latin-1") + " ", []).append((p, at))
        self.automaton = ahocorasick.Automaton()
        for tile, where in tiles.items():
            self.automaton.add_word(tile, (size, where))
        self.automaton.make_automaton()

    def mark(self, words: list[bytes], text: str, ends: np.ndarray, covered: np.ndarray) -> None:
        """Mark in ``covered`` the words of all occurrences; ``ends``: where each word ends in ``text``."""
        done: dict[tuple[int, int], int] = {}
        for last, (size, where) in self.automaton.iter(text):
            at = int(np.searchsorted(ends, last)) - size + 1
            for p, offset in where:
                if done.get((p, at - offset), -1) >= at + size:
                    continue
                own = self.passages[p]
                low, high = 0, size
                while at - low > 0 and offset - low > 0 and words[at - low - 1] == own[offset - low - 1]:
                    low += 1
                while at + high < len(words) and offset + high < len(own) and words[at + high] == own[offset + high]:
                    high += 1
                done[p, at - offset] = at + high
                if low + high >= self.window:
                    covered[at - low : at + high] = True


def _locate(window: int, id_type):
    def locate(table, answers):
        import pyarrow as pa

        recurring, texts, hashes, ids = _known(answers), [], [], []
        for x in table.column("doc_ids"):
            ids.append(x.values)
        for group, words, bounds in _docs(table):
            texts += group
            hashes += [words[a:b] for a, b in zip(bounds, bounds[1:])]
        covered = [np.zeros(len(h), bool) for h in hashes]
        spans = passages(hashes, recurring, window)
        at = 0
        while at < len(spans):  # one shard of passages at a time
            shard, size = [], 0
            while at < len(spans) and (not shard or size < SHARD_CHARS):
                d, a, b = spans[at]
                shard.append(texts[d].split()[a:b])
                size += sum(map(len, shard[-1])) + b - a
                at += 1
            automaton = Shard(shard, window)
            for text, own in zip(texts, covered):
                if len(own) >= window:
                    words = text.split()
                    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                    automaton.mark(words, " " + b" ".join(words).decode("latin-1") + " ", ends, own)
        release()
        kept = [b" ".join([w for w, c in zip(t.split(), own.tolist()) if not c]) if own.any() else b" ".join(t.split()) for t, own in zip(texts, covered)]
        return pa.table({
            "doc_id": pa.chunked_array(ids, id_type), "n_words": pa.array([len(c) for c in covered], pa.int64()),
            "n_removed": pa.array([int(c.sum()) for c in covered], pa.int64()), "kept": pa.array(kept, pa.binary()),
        })

    return locate


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept (UTF-8 bytes: the words that stay, joined by blanks) of each row of ``docs``."""
    from pyspark.sql.pandas.types import to_arrow_type

    n = classes = blocks_of(docs)
    dealt = blocks(docs, n)
    answered = lambda sent: sent.repartitionById(classes, F.col("class")).groupBy("class").applyInArrow(_answer, "block int, hashes binary").repartitionById(n, F.col("block"))
    repeated = answered(dealt.groupBy("block").applyInArrow(_ask_anchors(classes, window), SENT))
    recurring = answered(dealt.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(_ask_windows(classes, window), SENT))
    out = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept binary"
    return dealt.groupBy("block").cogroup(recurring.groupBy("block")).applyInArrow(_locate(window, to_arrow_type(docs.schema["doc_id"].dataType)), out)


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of ``docs``."""
    return without_repeats(docs, window).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
