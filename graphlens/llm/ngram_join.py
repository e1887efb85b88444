"""Jaccard self-join on word shingles with adaptive multi-match prefixes, and its components.

A document is the set of its distinct ``SHINGLE``-word shingles (64-bit hashes).  Equal sets form one class, whatever
their number; everything below works on classes.

* Order.  Shingles are ordered rarest first by a counting sketch over all documents (``SKETCH`` counters, a fixed
  size); it only has to be the same for all, so its noise costs speed and never a link.
* Prefixes.  With O = ceil(t * n), the first n - O + l shingles of two documents that reach the threshold share at
  least l.  Each document takes the l of ``CHOICES`` with the least estimated cost: the longer prefix against the
  candidates it lets through, which common shingles raise.  A pair needs l = min(l, l') shared shingles, and with their
  sizes known and the overlap A that they need, only places before n - A + l count on either side.
* First candidates.  A posting list pairs its documents with ``HUBS`` of them, so a list of m gives at most HUBS * m
  pairs; links found make components.
* Other candidates.  Lists in which documents of different components are left are met in full, across components
  only: a link inside a component adds nothing to it.  The documents of such lists are dealt to blocks, and each pair
  of blocks is a task of bounded size that counts shared shingles and passes on the pairs with enough of them.
* Verification.  Pairs are checked on whole sets: a partner is delivered once to each block that needs it.

Components come from smallest labels passed along links with pointer jumping, each step a written table.

The links themselves lie inside components, so ``links`` and the number of links a document compare all classes of a
component on whole sets: shingles of many of its classes by products of matrices, the others by their pairs.  Large
components are dealt to blocks, a task for each pair of blocks.  Numbers of links count documents: the copies of a class
are linked to each other and to all copies of a linked class.

Defined cases: null, empty and blank texts have no shingles and are linked to nothing; a text of fewer words than a
shingle is one shingle; a null id is the component's id only where no other id is in it; repeated ids are separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.llm.blocks import unpacked
from graphlens.llm.hashing import chunks, mix, sequence_hashes, word_hashes
from graphlens.llm.shared import apart, blocks_of, met_by_key, release, restored, written

SHINGLE = 5
#: The threshold as a fraction of whole numbers.
T_NUM, T_DEN = 75, 100
SKETCH_BITS = 20
SLOTS = 64
BLOOM_BITS = 23
#: Matches that a document may ask for.
CHOICES = (1, 2, 4, 8, 16, 32)
HUBS = 3
#: Contested postings in a block of documents, on average.
BLOCK_ROWS = 500_000
VERIFY_COST = 4.0
#: Classes and shingles of a component that are compared in one task.
PART_CLASSES, PART_SHINGLES = 2000, 4_000_000
#: Shingles of more classes than this are compared by matrices.
RARE = 8


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, bounds = word_hashes([t.lower() for t in texts])
    whole, bounds = sequence_hashes(words, k), bounds.tolist()
    return [np.unique(whole[a : b - k + 1]) if b - a >= k else sequence_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64) for a, b in zip(bounds, bounds[1:])]


def set_hash(own: np.ndarray, seed: int = 0xA0761D6478BD642F) -> int:
    """64-bit hash of a set of shingles, as a signed number."""
    with np.errstate(over="ignore"):
        total = mix(own ^ np.uint64(seed)).sum(dtype=np.uint64) + np.uint64(len(own))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def second_hash(own: np.ndarray) -> int:
    """Another one, which tells different sets of one hash apart."""
    return set_hash(own, 0xE7037ED1A0B428DB)


def class_of(own: np.ndarray, shared: frozenset[int] = frozenset()) -> int:
    """Id of a set: its hash, or for the hashes that different sets ``shared``, that with the second one."""
    c = set_hash(own)
    return c ^ second_hash(own) if c in shared else c


def _read(batches: Iterator) -> Iterator:
    """(batch, first row, texts, sets) over groups of bounded size."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for at, group in chunks(texts):
            yield batch, at, group, shingle_sets(group)


SURVEY = ("doc_id", "text_hash", "n", "cls", "second", "slot", "counts", "bucket", "classes", "sizes", "texts")


def survey(texts: DataFrame, buckets: int) -> tuple[DataFrame, np.ndarray, frozenset[int], DataFrame]:
    """One row per document (doc_id, text_hash, n, cls), the sketch of shingle counts, the hashes that different sets share
    (few, if any), and the texts packed by the buckets of their classes, one copy of a class from a task.

    A task counts a set once however many copies it meets; each task sends ``SLOTS`` pieces of the sketch, and the
    driver gets their sums, 2^SKETCH_BITS counters in all.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts, seen = np.zeros(1 << SKETCH_BITS, np.uint32), set()
        kinds, held, size = None, [], 0

        def rows(size_: int, **columns):
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size_, kinds[c]) for c in SURVEY], names=list(SURVEY))

        def packed():
            batch = _pack_rows([c % buckets for c, _ in held], [c for c, _ in held], [t for _, t in held], ("bucket", "classes", "sizes", "texts"))
            held.clear()
            return rows(batch.num_rows, **dict(zip(batch.schema.names, batch.columns)))

        for batch, at, group, sets in _read(batches):
            if kinds is None:
                kinds = {c: pa.int64() for c in ("text_hash", "n", "cls", "second")} | {c: pa.int32() for c in ("slot", "bucket")} | {c: pa.binary() for c in ("counts", "classes", "sizes", "texts")}
                kinds["doc_id"] = batch.schema.field("doc_id").type
            cls, second = [set_hash(s) for s in sets], [second_hash(s) for s in sets]
            fresh = [k for k, c in enumerate(cls) if c not in seen and not seen.add(c)]
            if fresh:
                at_ = np.concatenate([sets[k] for k in fresh]) & np.uint64((1 << SKETCH_BITS) - 1)
                counts += np.bincount(at_.astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32)
            for k in fresh:
                if len(sets[k]):
                    held.append((cls[k], group[k]))
                    size += len(group[k])
            m = len(group)
            whole = [pa.array(x, pa.int64()) for x in ([len(s) for s in sets], cls, second)]
            yield rows(m, doc_id=batch.column("doc_id").slice(at, m), text_hash=batch.column("text_hash").slice(at, m), n=whole[0], cls=whole[1], second=whole[2])
            if size > 16 << 20:
                size = 0
                yield packed()
        if held:
            yield packed()
        if kinds is not None:
            parts = [c.tobytes() for c in np.split(counts, SLOTS)]
            yield rows(SLOTS, slot=pa.array(range(SLOTS), pa.int32()), counts=pa.array(parts, pa.binary()))
        release()

    def add(table):
        import pyarrow as pa

        total = np.zeros((1 << SKETCH_BITS) // SLOTS, np.uint64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_py(), np.uint32)
        return pa.table({"slot": table.column("slot")[:1], "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())})

    schema = f"doc_id {dict(texts.dtypes)['doc_id']}, text_hash long, n long, cls long, second long, slot int, counts binary, bucket int, classes binary, sizes binary, texts binary"
    both = written(texts.mapInArrow(run, schema), "survey")
    pieces = both.filter("slot IS NOT NULL").select("slot", "counts").groupBy("slot").applyInArrow(add, "slot int, counts binary").collect()
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in pieces:
        size = len(sketch) // SLOTS
        sketch[r["slot"] * size : (r["slot"] + 1) * size] = np.frombuffer(r["counts"], np.uint32)
    rows = both.filter("cls IS NOT NULL")
    shared = frozenset(r["cls"] for r in rows.groupBy("cls").agg(F.min("second").alias("lo"), F.max("second").alias("hi")).filter("lo <> hi").select("cls").collect())
    own = F.when(F.col("cls").isin(*shared), F.col("cls").bitwiseXOR(F.col("second"))).otherwise(F.col("cls")) if shared else F.col("cls")
    if shared:  # the texts that were packed as copies of others are among them, too
        texts_ = dealt(texts, buckets, shared)
    else:
        texts_ = both.filter("bucket IS NOT NULL").select("bucket", F.col("classes").alias("cls"), "sizes", "texts")
    return rows.select("doc_id", "text_hash", "n", own.alias("cls")), sketch, shared, texts_


def bucket_of(cls: Column, n: int) -> Column:
    return F.pmod(cls, F.lit(n)).cast("int")


PACKED = "bucket int, cls binary, sizes binary, texts binary"


def _pack_rows(bucket: list[int], cls: list[int], texts: list[bytes], names: tuple[str, ...] = ("bucket", "cls", "sizes", "texts")):
    import pyarrow as pa
    import zstandard

    squeeze, order = zstandard.ZstdCompressor(level=3).compress, np.argsort(np.array(bucket, np.int64), kind="stable").tolist()
    rows: dict[int, list[int]] = {}
    for i in order:
        rows.setdefault(bucket[i], []).append(i)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(rows), pa.int32()),
            pa.array([np.array([cls[i] for i in r], np.int64).tobytes() for r in rows.values()], pa.binary()),
            pa.array([np.array([len(texts[i]) for i in r], np.uint32).tobytes() for r in rows.values()], pa.binary()),
            pa.array([squeeze(b"".join([texts[i] for i in r])) for r in rows.values()], pa.binary()),
        ],
        names=list(names),
    )


def dealt(texts: DataFrame, buckets: int, shared: frozenset[int]) -> DataFrame:
    """Texts packed by the buckets of their classes, one copy of a class from a task, where different sets ``shared`` a hash."""

    def run(batches: Iterator) -> Iterator:
        seen: set[int] = set()
        cls: list[int] = []
        kept: list[bytes] = []
        size = 0
        for _, _, group, sets in _read(batches):
            for t, s in zip(group, sets):
                if len(s) and (c := class_of(s, shared)) not in seen:
                    cls.append(c)
                    kept.append(t)
                    size += len(t)
                    seen.add(c)
            if size > 16 << 20:
                yield _pack_rows([c % buckets for c in cls], cls, kept)
                cls, kept, size = [], [], 0
        if cls:
            yield _pack_rows([c % buckets for c in cls], cls, kept)
        release()

    return written(texts.mapInArrow(run, PACKED), "dealt", "none")


def possible(packed: DataFrame, bloom) -> DataFrame:
    """The packed texts without those of classes that the filter does not hold."""

    def run(batches: Iterator) -> Iterator:
        bits = np.frombuffer(bloom.value, np.uint8)
        for batch in batches:
            for row in range(batch.num_rows):
                cls = np.frombuffer(batch.column("cls")[row].as_py(), np.int64)
                hit = [i for i, c in enumerate(cls.tolist()) if _in_bloom(bits, c)]
                if hit:
                    texts = unpacked(batch.column("sizes")[row].as_py(), batch.column("texts")[row].as_py())
                    yield _pack_rows([batch.column("bucket")[row].as_py()] * len(hit), cls[hit].tolist(), [texts[i] for i in hit])
        release()

    return packed.mapInArrow(run, PACKED)


def by_bucket(packed: DataFrame, buckets: int) -> DataFrame:
    return packed.repartitionById(buckets, F.col("bucket"))


def _unpack_rows(table) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    for cls, sizes, packed in zip(table.column("cls"), table.column("sizes"), table.column("texts")):
        yield np.frombuffer(cls.as_py(), np.int64), unpacked(sizes.as_py(), packed.as_py())


def _distinct(table, size: int = 1 << 20) -> Iterator[tuple[list[int], list[bytes]]]:
    """Classes and texts of a bucket, each class once, in groups of about ``size`` bytes however many packed rows hold them:
    a bucket has a row from each task before, so that groups that end with a row would be more and smaller on a larger corpus."""
    seen: set[int] = set()
    own, kept, held = [], [], 0
    for cls, texts in _unpack_rows(table):
        for c, t in zip(cls.tolist(), texts):
            if c not in seen:
                seen.add(c)
                own.append(c)
                kept.append(t)
                held += len(t)
                if held >= size:
                    yield own, kept
                    own, kept, held = [], [], 0
    if own:
        yield own, kept


def prefixes(sets: list[np.ndarray], sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix shingles of each set, the set they belong to, their places in its order, and the matches each set asks for."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    seen = sketch[(flat & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
    base = float(sketch.mean())
    others = np.maximum(seen - (base + 3 * np.sqrt(base) + 1), 0.0)
    order = np.lexsort((flat, seen, owner))
    flat, others = flat[order], others[order]
    first = np.cumsum(n) - n
    rank = np.arange(len(flat)) - np.repeat(first, n)
    need = -(-n * T_NUM // T_DEN)
    cost = np.concatenate([[0.0], np.cumsum(others)])
    best, price = np.ones(len(sets), np.int64), None
    for l in CHOICES:
        end = np.minimum(n - need + l, n)
        p = np.where(l <= need, end + VERIFY_COST * (cost[first + end] - cost[first]) / l, np.inf)
        if price is None:
            price = p
        else:
            better = p < price
            best[better], price = l, np.minimum(price, p)
    keep = rank < np.repeat(n - need + best, n)
    return flat[keep], owner[keep], rank[keep], best


PREFIX_PARTS = ("cls", "n", "l", "per", "place", "tokens")


def _emit_prefixes(sketch, classes: int):
    def emit(table):
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        parts, before = [], 0
        for cls, texts in _distinct(table):
            sets = shingle_sets(texts)
            tokens, owner, place, l = prefixes(sets, sketch.value)
            parts.append((tokens >> np.uint64(16), owner + before, place.astype(np.uint32), np.array(cls, np.int64), np.fromiter(map(len, sets), np.uint32, len(sets)), l.astype(np.uint8)))
            before += len(cls)
        tokens, owner, place, ids, n, l = (np.concatenate(x) for x in zip(*parts))
        of = (tokens % np.uint64(classes)).astype(np.uint16 if classes <= 1 << 16 else np.int64)
        order = np.argsort(of, kind="stable")  # owners ascend in each class, as they do before
        tokens, owner, of, place = tokens[order], owner[order], of[order], place[order]
        fresh = np.concatenate([[True], of[1:] != of[:-1]])
        run = np.flatnonzero(fresh | np.concatenate([[True], owner[1:] != owner[:-1]]))
        docs, per = owner[run], np.diff(np.append(run, len(of))).astype(np.uint32)
        begin = np.flatnonzero(fresh)
        first = np.searchsorted(run, begin)
        six = np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, :6])
        out = {"class": of[begin].tolist(), "cls": [], "n": [], "l": [], "per": [], "place": [], "tokens": []}
        for lo, hi, a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(of)], first.tolist(), [*first[1:].tolist(), len(run)]):
            own = docs[a:b]
            out["cls"].append(ids[own].tobytes())
            out["n"].append(squeeze(n[own].tobytes()))
            out["l"].append(squeeze(l[own].tobytes()))
            out["per"].append(squeeze(per[a:b].tobytes()))
            out["place"].append(squeeze(place[lo:hi].tobytes()))
            out["tokens"].append(six[lo:hi].tobytes())
        release()
        return pa.table({"class": pa.array(out["class"], pa.int32())} | {c: pa.array(out[c], pa.binary()) for c in PREFIX_PARTS})

    return emit


def _reach(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can reach the threshold."""
    return T_DEN * short.astype(np.int64) >= T_NUM * long.astype(np.int64)


def near_enough(n1, l1, p1, n2, l2, p2) -> np.ndarray:
    """Whether a shared shingle at places p1 and p2 counts for sets of these sizes and matches asked for."""
    n1, n2 = n1.astype(np.int64), n2.astype(np.int64)
    least = np.minimum(l1, l2).astype(np.int64)
    overlap = -(-T_NUM * (n1 + n2) // (T_NUM + T_DEN))
    return _reach(np.minimum(n1, n2), np.maximum(n1, n2)) & (p1 < n1 - overlap + least) & (p2 < n2 - overlap + least)


def hub_pairs(token: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (member, hub) for lists sorted by token: each document with those of the least mixed class ids."""
    if not len(token):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((mix(cls.view(np.uint64)), token))
    begin = np.flatnonzero(np.concatenate([[True], token[order][1:] != token[order][:-1]]))
    size = np.diff(np.append(begin, len(order)))
    first = np.repeat(begin, size)
    rank = np.arange(len(order)) - first
    members, hubs = [], []
    for k in range(HUBS):
        own = np.flatnonzero(rank > k)
        members.append(order[own])
        hubs.append(order[first[own] + k])
    return np.concatenate(members), np.concatenate(hubs)


CANDIDATES = "token long, a long, b long, n int, m int, place int"


def _postings(table):
    """Rows with a token: the documents of lists of two or more; rows without: pairs (member a, hub b) for verification."""
    import pyarrow as pa
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    tokens, cls, n, l, place = [], [], [], [], []
    for c, nn, ll, per, at, raw in zip(*(table.column(x) for x in PREFIX_PARTS)):
        per = np.frombuffer(unpack(per.as_py()), np.uint32)
        six = np.frombuffer(raw.as_py(), np.uint8).reshape(-1, 6)
        wide = np.zeros((len(six), 8), np.uint8)
        wide[:, :6] = six
        tokens.append(wide.view(np.int64).ravel())
        cls.append(np.repeat(np.frombuffer(c.as_py(), np.int64), per))
        n.append(np.repeat(np.frombuffer(unpack(nn.as_py()), np.uint32), per))
        l.append(np.repeat(np.frombuffer(unpack(ll.as_py()), np.uint8), per))
        place.append(np.frombuffer(unpack(at.as_py()), np.uint32))
    tokens, cls, n, l, place = (np.concatenate(x) for x in (tokens, cls, n, l, place))
    own, at, count = np.unique(tokens, return_inverse=True, return_counts=True)
    live = count[at] > 1
    tokens, cls, n, l, place = tokens[live], cls[live], n[live], l[live], place[live]
    # pairs for a first look need no count: of long documents a quarter of the shared shingles shows them
    some = (mix(tokens.view(np.uint64)) % np.uint64(4) == 0) | (n < 64)
    t, c, m, q, w = tokens[some], cls[some], n[some], l[some], place[some]
    i, j = hub_pairs(t, c)
    fit = near_enough(m[i], q[i], w[i], m[j], q[j], w[j])
    pairs = np.unique(np.stack([c[i[fit]], c[j[fit]]], axis=1), axis=0) if fit.any() else np.zeros((0, 2), np.int64)
    k, p = len(tokens), len(pairs)
    return pa.table({
        "token": pa.chunked_array([pa.array(tokens), pa.nulls(p, pa.int64())]), "a": np.concatenate([cls, pairs[:, 0]]), "b": pa.chunked_array([pa.nulls(k, pa.int64()), pa.array(pairs[:, 1])]),
        "n": np.concatenate([n, np.zeros(p)]).astype(np.int32), "m": np.concatenate([l, np.zeros(p)]).astype(np.int32), "place": np.concatenate([place, np.zeros(p)]).astype(np.int32),
    })


def _in_bloom(bits: np.ndarray, c: int) -> bool:
    return all(bits[p >> 3] >> (p & 7) & 1 for p in _bloom_at(c))


def _bloom_at(c: int) -> tuple[int, int, int]:
    mask = (1 << BLOOM_BITS) - 1
    return c & mask, (c >> 20) & mask, (c >> 40) & mask


def class_filter(classes: DataFrame) -> bytes:
    """Bloom filter of column ``cls``: 2^BLOOM_BITS bits, a fixed size; when it is full more texts are read, no fewer."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bits, any_ = np.zeros(1 << BLOOM_BITS, bool), False
        for batch in batches:
            c = batch.column("cls").to_numpy()
            any_ |= len(c) > 0
            for shift in (0, 20, 40):
                bits[(c >> shift) & ((1 << BLOOM_BITS) - 1)] = True
        if any_:
            parts = np.split(np.packbits(bits, bitorder="little"), SLOTS)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLOTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slot", "bits"])

    def join(table):
        import pyarrow as pa

        total = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in table.column("bits")])
        return pa.table({"slot": table.column("slot")[:1], "bits": pa.array([total.tobytes()], pa.binary())})

    got = {r["slot"]: r["bits"] for r in classes.mapInArrow(run, "slot int, bits binary").groupBy("slot").applyInArrow(join, "slot int, bits binary").collect()}
    return b"".join(got.get(i, bytes((1 << BLOOM_BITS) // 8 // SLOTS)) for i in range(SLOTS))


def _repack(table):
    """A bucket's rows with each class once."""
    import pyarrow as pa

    bucket = table.column("bucket")[0].as_py()
    return pa.Table.from_batches([_pack_rows([bucket] * len(cls), cls, texts) for cls, texts in _distinct(table)])


def _ship(table, asked):
    """The texts that other buckets ask for, packed by the bucket they go to."""
    import pyarrow as pa

    wanted: dict[int, list[int]] = {}
    for c, to in zip(asked.column("b").to_pylist(), asked.column("to").to_pylist()):
        wanted.setdefault(c, []).append(to)
    to, cls, texts = [], [], []
    for own, group in _unpack_rows(table):
        for c, t in zip(own.tolist(), group):
            for at in wanted.get(c, ()):
                to.append(at)
                cls.append(c)
                texts.append(t)
    return pa.Table.from_batches([_pack_rows(to, cls, texts)])


def _verify(table, pairs):
    import pyarrow as pa

    a, b = pairs.column("a").to_pylist(), pairs.column("b").to_pylist()
    wanted, sets = {*a, *b}, {}
    for cls, group in _distinct(table):
        own = [i for i, c in enumerate(cls) if c in wanted]
        for i, s in zip(own, shingle_sets([group[i] for i in own])):
            sets[cls[i]] = s
    ok = []
    for x, y in zip(a, b):
        s, t = sets[x], sets[y]
        shared = len(np.intersect1d(s, t, assume_unique=True))
        ok.append(T_DEN * shared >= T_NUM * (len(s) + len(t) - shared))
    sets.clear()
    release()
    keep = pa.array(ok, pa.bool_())
    return pa.table({"a": pairs.column("a"), "b": pairs.column("b")}).filter(keep)


def verified(pairs: DataFrame, live: DataFrame, buckets: int) -> DataFrame:
    """The pairs (a, b) of classes that reach the threshold; ``live`` has their texts by bucket."""
    home = pairs.select("a", "b", bucket_of(F.col("a"), buckets).alias("bucket"))
    asked = home.select("b", F.col("bucket").alias("to")).distinct().withColumn("bucket", bucket_of(F.col("b"), buckets)).filter(F.col("bucket") != F.col("to"))
    at = lambda df: df.repartitionById(buckets, F.col("bucket")).groupBy("bucket")
    shipped = at(live).cogroup(at(asked)).applyInArrow(_ship, PACKED)
    return at(live.unionByName(shipped)).cogroup(at(home)).applyInArrow(_verify, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(cls, label) of each class in ``links`` (a, b): the smallest class that it reaches."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("label")).withColumnRenamed("a", "cls"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("cls", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = written(labels.join(near.withColumnRenamed("a", "cls"), "cls").select("cls", "label", F.least("label", "near").alias("now")), "labels")
        jump = least.select(F.col("cls").alias("now"), F.col("now").alias("far"))
        stepped = written(least.join(jump, "now", "left").select("cls", F.least("now", "far").alias("now"), "label"), "labels")
        changed = stepped.filter("now <> label").limit(1).count()
        labels = stepped.select("cls", F.col("now").alias("label"))
        if not changed:
            return labels


CONTESTED = ("token", "a", "label", "n", "m", "place")
#: Copies of contested rows that are packed together, about.
PACK_ROWS = 500_000


def _pack_contested(batches: Iterator) -> Iterator:
    """Contested rows packed by pair of blocks (i <= j): a copy for each of the blocks that their list has documents in."""
    import pyarrow as pa
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    held: list[tuple[np.ndarray, ...]] = []

    def packed():
        own, other, rows = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held], axis=1)
        held.clear()
        i, j = np.minimum(own, other), np.maximum(own, other)
        order = np.lexsort((own, j, i))
        i, j, own, rows = i[order], j[order], own[order], rows[:, order]
        begin = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (own[1:] != own[:-1])]))
        parts = [squeeze(np.ascontiguousarray(rows[:, lo:hi]).tobytes()) for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(i)])]
        return pa.RecordBatch.from_arrays([pa.array(x[begin].astype(np.int32)) for x in (i, j, own)] + [pa.array(parts, pa.binary())], names=["i", "j", "own", "packed"])

    for batch in batches:
        blocks = batch.column("blocks")
        copies = np.diff(blocks.offsets.to_numpy())
        at = np.repeat(np.arange(batch.num_rows), copies)
        rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in CONTESTED])[:, at]
        held.append((batch.column("own").to_numpy()[at], blocks.flatten().to_numpy(), rows))
        if sum(len(h[0]) for h in held) > PACK_ROWS:
            yield packed()
    if held:
        yield packed()
    release()


#: Pairs of rows that are looked at together, about.
MEET_ROWS = 200_000


def _across(token: np.ndarray, side: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """An order of the rows, and the places (x, y) in it of all pairs of a token and different labels: across the two sides
    where there are two, else each once.

    No list and no pair of one label costs a step of its own: the rows of a label in a list stand together, and a row
    meets those before and after them.
    """
    _, lab = np.unique(label, return_inverse=True)
    sides, half = np.unique(side, return_inverse=True)
    order = np.lexsort((lab, half, token))
    token, half, lab = token[order], half[order], lab[order].astype(np.int64)
    lists = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    width = int(lab.max()) + 1 if len(lab) else 1
    last = len(sides) - 1 if len(sides) else 0
    key = (lists * (last + 1) + half) * width + lab
    row = np.flatnonzero(half == 0)
    run = (lists[row] * (last + 1) + last) * width  # where the rows that these meet begin
    end = np.searchsorted(key, run + width)
    after = np.searchsorted(key, run + lab[row], side="right")
    x, begin, count = row, after, end - after
    if last:
        start, before = np.searchsorted(key, run), np.searchsorted(key, run + lab[row])
        x, begin, count = np.concatenate([x, row]), np.concatenate([begin, start]), np.concatenate([count, before - start])
    some = count > 0
    x, begin, count = x[some], begin[some], count[some]

    def runs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        total = np.cumsum(count)
        cuts = np.unique(np.searchsorted(total, np.arange(0, int(total[-1]) + MEET_ROWS, MEET_ROWS))) if len(total) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(count)]):
            if hi > lo:
                each = count[lo:hi]
                first = np.cumsum(each) - each
                yield np.repeat(x[lo:hi], each), np.arange(int(each.sum())) + np.repeat(begin[lo:hi] - first, each)

    return order, runs()


def _pair_up(table):
    """Pairs (a, b) of the two blocks, of different components, with enough shared shingles."""
    import pyarrow as pa
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    parts = [np.frombuffer(unpack(x.as_py()), np.int64).reshape(len(CONTESTED), -1) for x in table.column("packed")]
    side = np.repeat(table.column("own").to_numpy(), [p.shape[1] for p in parts])
    token, cls, label, n, l, place = np.concatenate(parts, axis=1)
    same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    ids, doc = np.unique(cls, return_inverse=True)
    keys, held, merged = [], 0, (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def merge(keys, merged):
        """Counts of the new keys added to those so far: memory follows the distinct pairs, not how often they stand there."""
        own, count = np.unique(np.concatenate(keys), return_counts=True)
        both, n = np.concatenate([merged[0], own]), np.concatenate([merged[1], count])
        own, at = np.unique(both, return_inverse=True)
        return own, np.bincount(at, weights=n, minlength=len(own)).astype(np.int64)

    order, runs = _across(token, side if not same else np.zeros(len(token), np.int64), label)
    doc, n, l, place = (x[order] for x in (doc, n, l, place))
    for x, y in runs:  # bounded numbers of pairs, of all lists one after the other
        ok = np.flatnonzero(near_enough(n[x], l[x], place[x], n[y], l[y], place[y]))
        if len(ok):
            u, v = doc[x[ok]], doc[y[ok]]
            keys.append(np.minimum(u, v) * len(ids) + np.maximum(u, v))
            held += len(ok)
            if held > max(1_000_000, len(merged[0])):
                merged, keys, held = merge(keys, merged), [], 0
    own, count = merge(keys, merged) if keys else merged
    u, v = own // max(1, len(ids)), own % max(1, len(ids))
    asks = np.zeros(len(ids), np.int64)
    asks[doc] = l
    enough = count >= np.minimum(asks[u], asks[v])
    a, b = ids[u[enough]], ids[v[enough]]
    release()
    return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})


def contested(live: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """Pairs (a, b) across components in the same posting lists, with enough shared prefix shingles.

    The documents are dealt to blocks, and a list is met by the pairs of blocks that it has documents in: its rows are
    copied once for each of its own blocks, not for all blocks there are.
    """
    labelled = written(live.join(labels.withColumnRenamed("cls", "a"), "a", "left").withColumn("label", F.coalesce("label", "a")), "labelled")
    mixed = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).filter("lo <> hi").select("token", "size")
    rows = written(met_by_key(labelled, written(mixed, "mixed"), "token", labelled.count()).select(*CONTESTED), "contested")
    total = rows.count()
    blocks = max(1, -(-total // BLOCK_ROWS))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int"))
    lists = rows.groupBy("token").agg(F.count("*").alias("size"), F.collect_set("own").alias("blocks"))
    met = met_by_key(rows, written(lists, "lists"), "token", total).select(*CONTESTED, "own", "blocks")
    packed = met.mapInArrow(_pack_contested, "i int, j int, own int, packed binary")
    tasks = max(1, min(blocks * (blocks + 1) // 2, max(buckets, blocks)))
    number = F.col("j").cast("long") * (F.col("j") + 1) / 2 + F.col("i")
    dealt_ = packed.withColumn("pair", F.pmod(number.cast("long"), F.lit(tasks)).cast("int")).repartitionById(tasks, F.col("pair"))
    return dealt_.groupBy("pair", "i", "j").applyInArrow(_pair_up, "a long, b long")


def overlaps(sets: list[np.ndarray], left: int | None) -> np.ndarray:
    """Shared shingles of the first ``left`` sets with each other one, or (None) of all with those after them."""
    rows, at = (len(sets), 0) if left is None else (left, left)
    out = np.zeros((rows, len(sets) - at), np.float32)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), np.fromiter(map(len, sets), np.int64, len(sets)))
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    size = np.diff(np.append(begin, len(flat)))
    for k in range(2, RARE + 1):
        lists = owner[begin[size == k][:, None] + np.arange(k)]
        for i, j in zip(*np.triu_indices(k, 1)):
            x, y = lists[:, i], lists[:, j]
            if left is not None:
                across = (x < left) & (y >= left)
                x, y = x[across], y[across]
            np.add.at(out, (x, y - at), 1)
    often = np.flatnonzero(size > RARE)
    for k in range(0, len(often), 4096):
        own = often[k : k + 4096]
        column = np.repeat(np.arange(len(own)), size[own])
        doc = owner[np.repeat(begin[own] - (np.cumsum(size[own]) - size[own]), size[own]) + np.arange(len(column))]
        has = np.zeros((len(sets), len(own)), np.float32)
        has[doc, column] = 1
        out += has[:rows] @ has[at:].T
    return out if left is not None else np.triu(out, 1)


def _ship_parts(table, parts):
    """The texts of a bucket's linked classes, packed by the task they go to: a group of components, or two blocks of one."""
    import pyarrow as pa

    wanted: dict[int, list[dict]] = {}
    for r in parts.to_pylist():
        wanted.setdefault(r["cls"], []).append(r)
    out = {c: [] for c in ("part", "i", "j", "labels", "own", "weights", "cls", "sizes", "texts")}
    for cls, texts in _unpack_rows(table):
        held: dict[tuple, list[tuple[dict, bytes]]] = {}
        for c, t in zip(cls.tolist(), texts):
            for r in wanted.get(c, ()):
                held.setdefault((r["part"], r["i"], r["j"]), []).append((r, t))
        for key, rows in held.items():
            packed = _pack_rows([0] * len(rows), [r["cls"] for r, _ in rows], [t for _, t in rows])
            for c, v in zip(("part", "i", "j"), key):
                out[c].append(v)
            for c, name in (("labels", "label"), ("own", "own"), ("weights", "weight")):
                out[c].append(np.array([r[name] for r, _ in rows], np.int64).tobytes())
            for c in ("cls", "sizes", "texts"):
                out[c].append(packed.column(c)[0].as_py())
    kinds = {"part": pa.int64(), "i": pa.int32(), "j": pa.int32()}
    return pa.table({c: pa.array(v, kinds.get(c, pa.binary())) for c, v in out.items()})


def _meet(pairs: bool):
    """Links of a task: as pairs (a, b) of classes, or as (cls, n) with the documents of the linked classes."""

    def run(table):
        import pyarrow as pa

        label, own, weight = (np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column(c)]) for c in ("labels", "own", "weights"))
        cls, texts = [], []
        for c, t in _unpack_rows(table):
            cls.append(c)
            texts += t
        cls, one = np.concatenate(cls), table.column("i")[0].as_py() == table.column("j")[0].as_py()
        order = np.lexsort((cls, own, label))
        begin = np.flatnonzero(np.concatenate([[True], label[order][1:] != label[order][:-1]])).tolist()
        x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(begin, [*begin[1:], len(order)]):
            at = order[lo:hi]
            sets = shingle_sets([texts[k] for k in at.tolist()])
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            left = None if one else int((own[at] == own[at[0]]).sum())
            shared = overlaps(sets, left)
            i, j = np.nonzero(shared)
            both = shared[i, j].astype(np.int64)
            j = j + (left or 0)
            ok = T_DEN * both >= T_NUM * (n[i] + n[j] - both)
            x.append(at[i[ok]])
            y.append(at[j[ok]])
        release()
        x, y = np.concatenate(x), np.concatenate(y)
        if pairs:
            return pa.table({"a": np.maximum(cls[x], cls[y]), "b": np.minimum(cls[x], cls[y])})
        n = np.zeros(len(cls), np.int64)
        np.add.at(n, x, weight[y])
        np.add.at(n, y, weight[x])
        return pa.table({"cls": cls[n > 0], "n": n[n > 0]})

    return run


def met(classes: DataFrame, kept: DataFrame, buckets: int, pairs: bool) -> DataFrame:
    """All links between classes (cls, label, size, n) of one component; ``kept`` has their texts by bucket."""
    own = classes.groupBy("label").agg(F.count("*").alias("m"), F.sum("n").alias("total")).filter("m > 1")
    own = own.withColumn("blocks", F.ceil(F.greatest(F.col("m") / PART_CLASSES, F.col("total") / PART_SHINGLES)).cast("int"))
    rows = classes.join(own, "label").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    rows = rows.withColumn("part", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label"), F.lit(buckets))).otherwise(F.col("label")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("whole", F.col("blocks") > 1)
    parts = rows.select(
        bucket_of(F.col("cls"), buckets).alias("bucket"), "cls", "label", F.col("size").alias("weight"), "own", "part",
        (F.least("own", "other") + F.when(F.col("whole"), 1).otherwise(0)).cast("int").alias("i"), (F.greatest("own", "other") + F.when(F.col("whole"), 1).otherwise(0)).cast("int").alias("j"),
    )
    at = lambda df: df.repartitionById(buckets, F.col("bucket")).groupBy("bucket")
    shipped = at(kept).cogroup(at(parts)).applyInArrow(_ship_parts, "part long, i int, j int, labels binary, own binary, weights binary, cls binary, sizes binary, texts binary")
    return shipped.repartition(buckets, "part", "i", "j").groupBy("part", "i", "j").applyInArrow(_meet(pairs), "a long, b long" if pairs else "cls long, n long")


def joined(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(members, classes, kept, buckets): documents, classes with least id, size and label, texts of classes by bucket."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.xxhash64("text").alias("text_hash"))
    buckets = classes = blocks_of(texts)
    members, sketch, _, packed = survey(texts, buckets)
    lists = by_bucket(packed, buckets).groupBy("bucket").applyInArrow(_emit_prefixes(spark.sparkContext.broadcast(sketch), classes), "class int, cls binary, n binary, l binary, per binary, place binary, tokens binary")
    found = written(lists.repartitionById(classes, F.col("class")).groupBy("class").applyInArrow(_postings, CANDIDATES), "candidates")
    live = found.filter("token IS NOT NULL")
    first = written(found.filter("token IS NULL").select("a", "b").distinct(), "pairs")
    bloom = spark.sparkContext.broadcast(class_filter(live.select(F.col("a").alias("cls"))))
    kept = written(by_bucket(possible(packed, bloom), buckets).groupBy("bucket").applyInArrow(_repack, PACKED), "live", "none")
    links = written(verified(first, kept, buckets), "links")
    labels = components(links)
    ordered = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    second = written(contested(live, labels, buckets).join(ordered, ["a", "b"], "left_anti"), "pairs")
    more = written(verified(second, kept, buckets), "links")
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    # the smallest id of each class, then of each component; classes without links keep their own
    by_class = members.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("own"), F.count("*").alias("size"), F.min("n").alias("n")).join(labels, "cls", "left")
    by_class = written(by_class.select("cls", "own", "size", "n", F.coalesce("label", "cls").alias("label")), "classes")
    return members, by_class, kept, buckets


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (other documents that reach the threshold) of each row of ``docs``."""
    members, by_class, kept, buckets = joined(docs)
    least = written(by_class.groupBy("label").agg(F.min("own").alias("component_id"), F.count("*").alias("size")), "least")
    ids = met_by_key(by_class.withColumnRenamed("size", "copies"), least, "label", by_class.count()).drop("size").withColumnRenamed("copies", "size")
    partners = written(met(by_class, kept, buckets, False), "partners").groupBy("cls").agg(F.sum("n").alias("partners"))
    n_links = F.col("size") - 1 + F.coalesce("partners", F.lit(0))
    ids = written(ids.join(partners, "cls", "left").select("cls", "component_id", "size", n_links.alias("n_links")), "components")
    some = met_by_key(members.filter("n > 0"), ids, "cls", members.count()).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    none = members.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return some.unionByName(none)


def links(docs: DataFrame) -> DataFrame:
    """All links between different sets, each once: least ids and numbers of documents of both classes (id_a, size_a, id_b, size_b)."""
    _, by_class, kept, buckets = joined(docs)
    pairs = written(met(by_class, kept, buckets, True), "links")
    side = lambda c: by_class.select(F.col("cls").alias(c), F.col("own").alias(f"id_{c}"), F.col("size").alias(f"size_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("id_a", "size_a", "id_b", "size_b")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the row of the smallest id.

    Rows without shingles all stay; of rows that repeat id and text one stays, whichever.
    """
    members, by_class, _, _ = joined(docs.select("doc_id", "text"))
    key = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
    least = members.filter("n > 0").groupBy("cls").agg(F.min(key).alias("least"))
    classes = written(by_class.join(least, "cls").select("cls", "label", "size", "least"), "least")
    best = classes.groupBy("label").agg(F.min("least").alias("best"), F.count("*").alias("size"), F.sum("size").alias("rows")).filter("rows > 1").drop("rows")
    several = met_by_key(classes.withColumnRenamed("size", "copies"), written(best, "best"), "label", classes.count()).select("cls", F.col("copies").alias("size"), "best")
    rows = written(met_by_key(members.filter("n > 0"), written(several, "several"), "cls", members.count()).select("doc_id", "text_hash", (key != F.col("best")).alias("gone")), "grouped")
    gone = rows.filter("gone").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_g")).distinct()
    again = written(rows.filter("NOT gone").groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_g")).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "again")
    hashed = apart(docs).withColumn("_h", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_g"))
    stay = hashed.join(gone, same, "left_anti")
    if again.limit(1).count():
        stay = stay.join(again, same, "left_anti").unionByName(stay.join(again, same, "left_semi").dropDuplicates(["doc_id", "_h"]))
    return restored(stay, docs)
