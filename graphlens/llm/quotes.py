"""Chat formatting by quotation links: messages without their quotes, in reply order.

A line that opens with signs ``>`` is a quote, one level a sign; neighbouring lines of one level are a passage.  A
passage is looked up as a run of consecutive lines of the original text of the same conversation, without quotes, by a
hash of its words (case, white space, blank lines and the places of line ends in the quote do not count).  One that is
no such run is looked up by its paragraphs, and paragraphs that are none by their lines.  Each belongs to the earliest
turn that has it.  A message answers the latest turn that it quotes on the first level; its path lists the turns from the
start of its thread to itself, and rows come ordered by conversation and path, over as many partitions as that takes.

Defined cases: null text is empty; messages with a null conversation or turn are linked to nothing; rows that repeat a
conversation and turn share its place; quotes of unknown origin are dropped and linked to nothing; negative turns come
before others; texts of any length are read whole; columns other than conv_id, turn, role and text are not given; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.shared import bucket, written

#: Words are hashed to 128 bits and runs of words by a polynomial of these modulo a Mersenne prime.
PRIME, BASE = 2**127 - 1, 0x1E3779B97F4A7C15F39CC0605CEDC835

#: Messages of one conversation are dealt over so many keys where they meet the asked lengths.
SALTS = 16


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes, and the quoted passages with their levels."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    open_ = False
    for line in (text or "").split("\n"):
        level, rest = 0, line
        while (stripped := rest.lstrip(" \t")).startswith(">"):
            level, rest = level + 1, stripped[1:]
        if not level:
            own.append(line)
            open_ = False
            continue
        if not open_ and own and own[-1].rstrip().endswith("wrote:"):
            own.pop()  # the line that names who is quoted
        if open_ and passages[-1][0] == level:
            passages[-1][1].append(rest)
        else:
            passages.append((level, [rest]))
        open_ = True
    return "\n".join(own).strip("\n"), [(level, "\n".join(lines)) for level, lines in passages]


def sums(lines: list[list[str]]) -> tuple[list[int], list[int]]:
    """Number of words and hash of the text before each line, and of the whole text at the end."""
    import hashlib

    counts, hashes = [0], [0]
    for line in lines:
        h = hashes[-1]
        for w in line:
            h = (h * BASE + int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).digest(), "big")) % PRIME
        counts.append(counts[-1] + len(line))
        hashes.append(h)
    return counts, hashes


def word_lines(text: str) -> list[list[str]]:
    """The words of the lines that have any."""
    return [w for line in text.split("\n") if (w := line.lower().split())]


def pieces(level: int, passage: str) -> list[dict]:
    """The passage (tier 0), its paragraphs (1) and their lines (2); parts that are equal to the whole are left out."""
    paragraphs: list[list[list[str]]] = [[]]
    for line in passage.split("\n"):
        if w := line.lower().split():
            paragraphs[-1].append(w)
        elif paragraphs[-1]:
            paragraphs.append([])
    paragraphs = [p for p in paragraphs if p]
    parts = [(0, -1, [w for p in paragraphs for w in p])] if paragraphs else []
    for k, p in enumerate(paragraphs):
        parts += [(1, k, p)] if len(paragraphs) > 1 else []
        parts += [(2, k, [w]) for w in p] if len(p) > 1 else []
    found = [(tier, k, counts[-1], f"{hashes[-1]:032x}") for tier, k, lines in parts for counts, hashes in [sums(lines)]]
    return [{"level": level, "passage": found[0][3], "tier": tier, "para": k, "n": n, "hash": h} for tier, k, n, h in found]


def runs(own: str, lengths: list[int]) -> list[str]:
    """Hashes of the runs of whole lines that have one of the given numbers of words."""
    counts, hashes = sums(word_lines(own))
    at, powers = {n: k for k, n in enumerate(counts)}, {n: pow(BASE, n, PRIME) for n in lengths if n <= counts[-1]}
    found = set()
    for k, before in enumerate(counts):
        if len(powers) <= len(counts) - k:
            ends = ((at[before + n], p) for n, p in powers.items() if before + n in at)
        else:
            ends = ((j, powers[counts[j] - before]) for j in range(k + 1, len(counts)) if counts[j] - before in powers)
        found.update(f"{(hashes[j] - hashes[k] * p) % PRIME:032x}" for j, p in ends)
    return sorted(found)


def parsed(messages: DataFrame) -> DataFrame:
    """``messages`` with clean (text without quotes) and quotes (the passages and their pieces)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        quote = pa.list_(pa.struct([("level", pa.int32()), ("passage", pa.string()), ("tier", pa.int32()), ("para", pa.int32()), ("n", pa.int64()), ("hash", pa.string())]))
        for batch in batches:
            found = [parse(t) for t in batch.column("text").to_pylist()]
            quotes = [[x for level, p in q for x in pieces(level, p)] for _, q in found]
            arrays = [*(batch.column(c) for c in ("conv_id", "turn", "role")), pa.array([o for o, _ in found], pa.string()), pa.array(quotes, quote)]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "turn", "role", "clean", "quotes"])

    kinds = dict(messages.dtypes)
    quote = "struct<level: int, passage: string, tier: int, para: int, n: bigint, hash: string>"
    return messages.select("conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role {kinds['role']}, clean string, quotes array<{quote}>")


def originals(rows: DataFrame, quotes: DataFrame) -> DataFrame:
    """(conv_id, turn, hash) of the runs of lines that have as many words as a piece asked for in their conversation."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            hashes = [runs(*x) for x in zip(batch.column("clean").to_pylist(), batch.column("lengths").to_pylist(), strict=True)]
            arrays = [batch.column("conv_id"), batch.column("turn"), pa.array(hashes, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "turn", "hashes"])

    kinds = dict(rows.dtypes)
    lengths = quotes.groupBy("conv_id").agg(F.collect_set("n").alias("lengths")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = rows.select("conv_id", "turn", "clean", bucket(SALTS, F.col("turn")).alias("salt")).join(lengths, ["conv_id", "salt"])
    found = met.select("conv_id", "turn", "clean", "lengths").mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, hashes array<string>")
    return found.select("conv_id", "turn", F.explode("hashes").alias("hash"))


def parents(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, n_linked) of the messages that quote an earlier one."""
    quotes = written(rows.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*").distinct(), "quotes")
    if not quotes.limit(1).count():
        return quotes.select("conv_id", "turn", F.col("turn").alias("parent"), F.lit(0).cast("long").alias("n_linked"))
    asked = quotes.select("conv_id", "hash").distinct()
    first = originals(rows, quotes).join(asked, ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    of = lambda tier: F.max(F.when(F.col("tier") == tier, F.col("origin")))
    linked = quotes.join(first, ["conv_id", "hash"]).filter("origin < turn")
    parts = linked.groupBy("conv_id", "turn", "level", "passage", "para").agg(of(0).alias("whole"), F.coalesce(of(1), of(2)).alias("part"))
    passages = parts.groupBy("conv_id", "turn", "level", "passage").agg(F.coalesce(F.max("whole"), F.max("part")).alias("origin"))
    return passages.groupBy("conv_id", "turn").agg(F.max(F.when(F.col("level") == 1, F.col("origin"))).alias("parent"), F.count("*").alias("n_linked"))


def paths(links: DataFrame) -> DataFrame:
    """(conv_id, turn, path) of linked messages: the turns from the start of the thread to the message, by doubling."""
    state = written(links.filter("parent IS NOT NULL").select("conv_id", "turn", F.col("parent").alias("up"), F.array("parent", "turn").alias("path")), "paths")
    while state.limit(1).count():
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        joined = state.join(above, ["conv_id", "up"], "left")
        stepped = joined.select("conv_id", "turn", "next", F.when(F.col("head").isNull(), F.col("path")).otherwise(F.concat(F.slice("head", F.lit(1), F.size("head") - 1), "path")).alias("path"))
        found = written(stepped, "paths")
        more = found.filter("next IS NOT NULL").limit(1).count()
        state = found.select("conv_id", "turn", F.coalesce("next", F.get("path", F.lit(0))).alias("up"), "path")
        if not more:
            break
    return state.select("conv_id", "turn", "path")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), parent_turn, depth, path, n_quotes, n_linked of each message, ordered by conversation and path."""
    rows = written(parsed(messages), "messages")
    links = written(parents(rows), "links")
    placed = paths(links)
    # of one width, and in the order of numbers: negative turns count from the least number there is
    negative = lambda t: F.concat(F.lit("-"), F.lpad((t + F.lit(9223372036854775807)).cast("string"), F.lit(19), F.lit("0")))
    step = lambda t: F.when(t < 0, negative(t.cast("long"))).otherwise(F.lpad(t.cast("string"), F.lit(20), F.lit("0")))
    key = F.array_join(F.transform(F.coalesce("path", F.array("turn")), step), "/")
    out = rows.join(links, ["conv_id", "turn"], "left").join(placed, ["conv_id", "turn"], "left")
    out = out.select(
        "conv_id", "turn", "role", F.col("clean").alias("text"), F.col("parent").alias("parent_turn"), (F.size(F.coalesce("path", F.array("turn"))) - 1).cast("long").alias("depth"),
        F.coalesce(key, F.lit("")).alias("path"), F.size(F.filter("quotes", lambda q: q["tier"] == 0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )
    return out.repartitionByRange("conv_id", "path", "turn").sortWithinPartitions("conv_id", "path")
