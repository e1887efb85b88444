"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties and repetitions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlens.llm import bpe, decontam, exact_dedup, langid, licences, ngram_join, quality, quotes, substrings, token_store
from graphlens.llm.tokens import WordIds, default_vocabulary, tokenizer

DOCS = "doc_id long, text string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Documents with copies, near copies, shared passages, blanks, a long text and repeated rows."""
    rng = random.Random(5)
    base = [words(rng, rng.choice([3, 8, 40, 120, 200])) for _ in range(40)]
    shared = words(rng, 60)
    out = [" ".join(w) for w in base]
    out += [out[0], out[3].upper(), "  " + out[3].replace(" ", "\n\t"), out[3]]
    for i in range(12):  # near copies at many distances
        w = list(base[4 + i % 3] + words(random.Random(77), 150))
        for _ in range(i):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
        out.append(" ".join(w))
    out += [" ".join(words(rng, 20) + shared + words(rng, 20)) for _ in range(5)]
    out += ["", "   \n", None, None, "é ß Ω <|endoftext|> it's á x y \x1c z", "same " * 100, " ".join(words(rng, 9000)), "a", "Ab, c!"]
    numbered = [(i * 3 % 97 + 100 * (i // 97), t) for i, t in enumerate(out)]
    return [*numbered, numbered[2], (5000, numbered[2][1]), (None, "null id"), (None, out[3])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def ordered(rows):
    return sorted(rows, key=repr)


def test_exact_dedup(docs, rows, empty):
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]", "", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0))
    want = ordered((i, None if min(groups[norm(t)])[1] else min(groups[norm(t)])[2], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    got = exact_dedup.exact_duplicates(docs).collect()
    assert ordered((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.exact_duplicates(empty).collect() == []
    wide = docs.withColumn("_h", F.lit(1)).withColumn("keep_id", F.lit("x")).withColumn("_again", F.lit("s"))
    kept = exact_dedup.keep_first(wide)
    assert kept.columns == wide.columns and kept.count() == len(groups)
    assert {(r["_h"], r["keep_id"], r["_again"]) for r in kept.collect()} == {(1, "x", "s")}


@pytest.mark.parametrize("words", [1, 64, 1 << 21])
def test_exact_dedup_whatever_the_filter(docs, words):
    """No filter, one with more rows than words, one with room."""
    a = exact_dedup.exact_duplicates(docs).drop("kept").collect()
    b = exact_dedup.exact_duplicates(docs, max_words=words).drop("kept").collect()
    assert ordered(a) == ordered(b)
    kept = exact_dedup.keep_first(docs, max_words=words).collect()
    assert len(kept) == len({re.sub(r"[\x20\x09-\x0d]", "", r["text"] or "") for r in docs.collect()})


def test_only_possible_repeats_shuffle(spark):
    """Pass one exchanges words of the filter, and few rows without an equal reach the exchange of pass two."""
    n, again = 20_000, 300
    texts = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") < again, F.lit("copy ")).otherwise(F.lit("own ")).alias("a"))
    rows = exact_dedup.digests(texts.select("doc_id", F.concat("a", F.when(F.col("doc_id") < again, F.col("doc_id") % 100).otherwise(F.col("doc_id")).cast("string")).alias("text")))
    bloom, size = exact_dedup.repeated_filter(rows.select("h"), n)
    plan = bloom._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(word" in plan and "hashpartitioning(h" not in plan
    tested = exact_dedup.possibly_repeated(rows, F.col("h"), bloom, size)
    assert tested.filter("_again AND doc_id < 300").count() == again
    assert tested.filter("_again").count() <= again + 0.15 * n


def brute_windows(rows, items, size=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = defaultdict(set)
    for i, t in items:
        w = find(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wins[tuple(w[k : k + size])].add(i)
    out = []
    for i, t in rows:
        w, hit, ids = find(t), set(), set()
        for win, own in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    ids |= own
        text = ",".join(sorted(str(x) for x in ids if x is not None))
        out.append((i, len(w), len(hit), len(ids - {None}), hashlib.sha256(text.encode()).hexdigest(), bool(hit)))
    return ordered(out)


def test_decontamination(spark, docs, rows, empty):
    long = next(t for _, t in rows if t and len(t) > 5000).split()
    items = [(1, " ".join(long[100:130])), (10, " ".join(long[110:122])), (2, "ab c"), (3, "A"), (4, ""), (5, None), (6, rows[3][1]), (6, "same same"), (None, "ß Ω"), (7, "never seen words in any of these texts at all here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs, bench)
    assert ordered(tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got.collect()) == brute_windows(rows, items)
    wins, _ = decontam.numbered(bench)
    one = decontam.hits(docs, wins, ["doc_id"]).filter("wid IS NOT NULL").collect()
    many = decontam.hits(docs, wins, ["doc_id"], block_windows=4).filter("wid IS NOT NULL").collect()
    assert one and ordered(one) == ordered(many)
    kept = decontam.clean(docs.withColumn("_d", F.lit(0)).withColumn("_h", F.lit(1)), bench)
    assert kept.columns == ["doc_id", "text", "_d", "_h"] and kept.count() == sum(not r[-1] for r in brute_windows(rows, items))
    assert decontam.contamination(empty, bench).collect() == []
    shuffled = docs.orderBy(F.rand()).repartition(5, F.rand())  # another order each time the plan runs
    assert ordered(tuple(r)[:3] for r in decontam.contamination(shuffled, bench).collect()) == ordered(r[:3] for r in brute_windows(rows, items))
    none = decontam.contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r["contaminated"] for r in none)


def test_licences(spark, docs, rows, empty):
    mit = dict(licences.KNOWN)["MIT"].replace("Copyright (c) <year> <holder>", "COPYRIGHT 2020 Ann").replace("\n\n", "\n \n").upper()
    own = [(1, mit), (2, "text\n  Released under the MIT Licence\nmore"), (3, None), (4, "All rights reserved."), (4, "...")]
    got = licences.scan(spark.createDataFrame(own, DOCS), licences.known_licences(spark)).collect()
    assert ordered((r["doc_id"], r["license_id"], r["notices"]) for r in got) == ordered([(1, "MIT", ""), (2, None, "MIT-notice"), (3, None, ""), (4, "all-rights-reserved", "all-rights-reserved"), (4, None, "")])
    assert licences.scan(docs, licences.known_licences(spark, [])).count() == len(rows)
    assert licences.scan(empty, licences.known_licences(spark)).count() == 0


@pytest.mark.parametrize("licence", ["MIT", "Apache-2.0", "BSD-3-Clause"])
def test_licences_whatever_the_width(spark, licence):
    """Paragraphs wrapped at every width from 40 to 120, a notice of the holder first, ties, a long text around nothing."""
    import textwrap

    shipped = Path(licences.__file__).parent / "licence_texts" / f"{licence}.txt"
    text = shipped.read_text(encoding="utf-8") if shipped.exists() else dict(licences.KNOWN)[licence]
    text = re.sub(r"(?m)^[ \t]*copyright[ \t]*(\(c\)|[0-9\[]).*$", "", text, flags=re.I)
    wrap = lambda width: "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in re.split(r"\n\s*\n", text))
    made = [(width, f"Copyright (c) 2021 Ann\n\n{wrap(width)}") for width in range(40, 121)] + [(1000, wrap(60)), (1000, wrap(61)), (1001, wrap(60) + " word " * 50_000)]
    got = licences.scan(spark.createDataFrame(made, DOCS), licences.known_licences(spark)).collect()
    assert len(got) == len(made) and {(r["doc_id"], r["license_id"]) for r in got if r["license_id"] != licence} == {(1001, None)}


def brute_quotes(messages):
    """(conv, turn) -> parent, by trying every run of lines of every earlier message."""
    split = lambda t: [line.lower().split() for line in t.split("\n") if line.split()]
    own = {(c, i): split(quotes.parse(t)[0]) for c, i, _, t in messages}
    flat = lambda lines: tuple(w for line in lines for w in line)
    runs = {k: {flat(v[a:b]) for a in range(len(v)) for b in range(a + 1, len(v) + 1)} for k, v in own.items()}
    out = {}
    for c, i, _, t in messages:
        origins = []
        for level, passage in quotes.parse(t)[1]:
            paragraphs = [p for p in (split(x) for x in re.split(r"\n\s*\n", passage)) if p]
            earliest = lambda words: min((j for (d, j), found in runs.items() if d == c and words in found), default=None)
            before = lambda words: j if words and (j := earliest(words)) is not None and j < i else None
            whole = before(flat([line for p in paragraphs for line in p]))
            parts = [before(flat(p)) if before(flat(p)) is not None else max((j for line in p if (j := before(tuple(line))) is not None), default=None) for p in paragraphs]
            at = whole if whole is not None else max((p for p in parts if p is not None), default=None)
            if at is not None and level == 1:
                origins.append(at)
        out[c, i] = max(origins, default=None)
    return out


def test_quotes_of_a_generated_mailbox_equal_brute_force(spark):
    """Threads with whole, partial, nested and unknown quotes, inline replies and repeated lines."""
    rng, data = random.Random(12), []
    for conv in range(12):
        plain_lines = []
        for turn in range(14):
            new = [" ".join(words(rng, rng.randrange(1, 6), 40)) for _ in range(rng.randrange(1, 6))]
            text = []
            if turn:
                source = plain_lines[rng.randrange(turn)]
                a = rng.randrange(len(source))
                b = rng.randrange(a, len(source)) + 1
                quoted = source[a:b]
                if rng.random() < 0.2:
                    quoted = [*quoted, "nobody wrote this line " + str(rng.random())]
                text += [f"> {line.upper() if rng.random() < 0.3 else line}" for line in quoted]
                if rng.random() < 0.3:
                    text += [">> " + plain_lines[0][0], ">"]
            middle = rng.randrange(len(new) + 1)
            data.append((conv, turn, "u", "\n".join([*new[:middle], *text, *new[middle:]])))
            plain_lines.append(new)
    got = quotes.reply_ordered(spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    want = brute_quotes(data)
    assert {(r["conv_id"], r["turn"]): r["parent_turn"] for r in got} == want and sum(v is not None for v in want.values()) > 100


def test_quotes_of_negative_turns_and_long_texts(spark):
    long = "\n".join(f"line {i} of many" for i in range(20_000))
    data = [(1, -5, "u", "first words"), (1, -2, "u", "> first words\nsecond"), (1, 3, "u", long), (1, 4, "u", "> line 19998 of many\n> line 19999 of many\nok"), (1, 10, "u", "tail")]
    got = quotes.reply_ordered(spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x"))).collect()
    assert [(r["turn"], r["parent_turn"]) for r in got] == [(-5, None), (-2, -5), (3, None), (4, 3), (10, None)]


def test_language_identification(spark, empty):
    rng = random.Random(1)
    parts = {"aa": ["ka", "ro", "mi", "ta"], "bb": ["schl", "ung", "ver", "ei"], "cc": ["ção", "inho", "lha", "que"]}
    made = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(30))
    data = [(i, made(lang), lang) for i in range(90) for lang in [("aa", "bb", "cc")[i % 3]]] + [(200, None, "aa"), (201, "123 !!", "bb"), (202, "", None), (None, made("aa"), "aa")]
    got = {r["doc_id"]: r for r in langid.predicted(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(data)
    held = [(r, data[i]) for i, r in got.items() if i is not None and i < 90 and r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert np.mean([r["lang_pred"] == d[2] for r, d in held]) >= 0.95 and all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (200, 201, 202)] == ["und"] * 3
    assert langid.predicted(empty.withColumn("lang", F.lit(None).cast("string"))).collect() == []


def test_out_of_place_distance_by_hand():
    letters = langid.letter_table()
    codes = langid.grams("ab  ab!", letters)
    text = Counter("".join(chr((int(c) >> (21 * k)) & 0x1FFFFF) for k in (2, 1, 0)).replace("\0", "") for c in codes)
    assert text == Counter({"a": 2, "b": 2, " a": 2, "ab": 2, "b ": 2, " ab": 2, "ab ": 2})
    assert len(langid.grams("12 !", letters)) == 0


def brute_language(data, top=langid.TOP):
    """Profiles and out-of-place distances from strings alone."""
    letters = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()

    def rank(texts):
        count = Counter()
        for t in texts:
            for w in letters(t):
                padded = f" {w} "
                count.update(w)
                count.update(padded[k : k + 2] for k in range(len(padded) - 1))
                count.update(padded[k : k + 3] for k in range(len(padded) - 2))
        code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
        return [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], code(x[0])))[:top]]

    known = defaultdict(list)
    for i, t, lang in data:
        if None not in (i, t, lang) and zlib.crc32(str(i).encode()) % 5:
            known[lang].append(t)
    profiles = {lang: rank(texts) for lang, texts in known.items()}
    out = []
    for i, t, _ in data:
        own = rank([t or ""])
        if not own:
            out.append((i, "und", 0.0))
            continue
        cost = {lang: sum(abs(k - p.index(g)) if g in p else top for k, g in enumerate(own)) for lang, p in sorted(profiles.items())}
        best = min(cost, key=cost.get)
        out.append((i, best, round(1 - cost[best] / (top * len(own)), 9)))
    return ordered(out)


def test_language_identification_equals_brute_force(spark):
    """Ties, a long text, repeated ids, mixed languages, letters outside ASCII."""
    rng = random.Random(8)
    parts = {"aa": "kaţ ro mi ta ßü".split(), "bb": "schl ung ver ei ka".split(), "cc": "ção inho lha que mi".split()}
    made = lambda langs, n: " ".join("".join(rng.choice(parts[rng.choice(langs)]) for _ in range(3)) + rng.choice(["", ",", " 12 "]) for _ in range(n))
    data = [(i, made([("aa", "bb", "cc")[i % 3]], rng.randrange(1, 60)), ("aa", "bb", "cc")[i % 3]) for i in range(60)]
    data += [(100 + i, made(["aa", "bb", "cc"], 12), None) for i in range(30)] + [(300, made(["bb"], 20_000), None), (3, data[3][1], "aa"), (301, "ka", None), (302, None, None), (303, " 1!", None), (None, "schl", "cc")]
    got = langid.predicted(spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)).collect()
    assert ordered((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in got) == brute_language(data)


def test_own_columns_win_over_columns_of_their_names(spark):
    docs = spark.createDataFrame([(1, "ka ro", "x", 5)], "doc_id long, text string, lang_pred string, score long")
    got = langid.identify(docs, {"aa": [ord("k")]})
    assert got.columns == ["doc_id", "text", "lang_pred", "score"] and got.select("lang_pred").first()[0] == "aa"
    model = quality.Model(np.zeros(quality.BUCKETS), 0.0)
    assert [tuple(r) for r in quality.score(docs, model).collect()] == [(1, "ka ro", "x", 0.5)]
    ids = spark.createDataFrame([(1, np.array([320], "<u4").tobytes(), 7)], "doc_id long, ids binary, decoded long")
    assert [r["decoded"] for r in bpe.decode(ids).collect()] == ["a</w>"]


def brute_repeats(rows, size):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    count = Counter(tuple(w[k : k + size]) for _, w in split for k in range(len(w) - size + 1))
    out = []
    for i, w in split:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - size + 1):
            if count[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = True
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return ordered(out)


@pytest.mark.parametrize("size", [35, 12])
def test_substring_dedup(docs, rows, empty, size):
    got = substrings.removed(docs, size).collect()
    assert ordered(tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in got) == brute_repeats(rows, size)
    assert substrings.removed(empty, size).collect() == []


def test_bpe_round_trip(spark, docs, rows, empty):
    tok = tokenizer(default_vocabulary())
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = bpe.round_trip(docs).collect()
    assert ordered(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in got) == ordered(want)
    assert bpe.round_trip(empty).collect() == []
    apart = bpe.decode(spark.createDataFrame([(1, np.array([320, 60000, 49407], "<u4").tobytes()), (2, None)], "doc_id long, ids binary")).orderBy("doc_id").collect()
    assert [r["decoded"] for r in apart] == ["a</w> <|endoftext|>", ""]


def test_word_ids_equal_the_library():
    rng = random.Random(3)
    alphabet = "abzAZéÀßñ0 9.,!?'-_()́İΣς<|>中"
    made = [b for b in {"".join(rng.choice(alphabet.replace(" ", "")) for _ in range(rng.randrange(1, 9))).encode() for _ in range(3000)}] + [b"it's", b"<|endoftext|>", b"\xff\xfe"]
    tok = tokenizer(default_vocabulary())
    got = WordIds(default_vocabulary()).encode(made)
    assert got == [np.array(tok.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes() for w in made]


def test_quality(spark, empty):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "sed"]) + rng.choice(["a", "o", ""]) for _ in range(60))
    bad = lambda: rng.choice([lambda: " ".join([rng.choice("xyzuvw") * 4] * 60), lambda: good().upper().replace(" ", "!! ")])()
    data = [(i, good() if i % 4 else bad(), int(i % 4 > 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(900, None), (901, ""), (None, "x")], DOCS)
    labels = spark.createDataFrame([(i, q) for i, _, q in data] + [(5, None), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.scored(docs, labels).collect()}
    held = [i for i, _, _ in data if got[i]["held_out"]]
    assert held == [i for i, _, _ in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["predicted"] == data[i][2] for i in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values()) and len(got) == 303
    wide = docs.withColumn("score", F.lit("own")).withColumn("_c0", F.lit(3))
    kept = quality.keep_good(wide, labels)
    assert kept.columns == wide.columns and {r["score"] for r in kept.collect()} == {"own"}
    assert quality.scored(docs, labels.limit(0)).count() == 303 and quality.scored(empty, labels).count() == 0


def plain_features(text):
    """The features of one text, as Counter of buckets, from strings of bytes alone."""
    mask, found = (1 << 64) - 1, Counter()
    mixed = lambda x: ((y := (((z := (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask) ^ (z >> 27)) * 0x94D049BB133111EB) & mask)) ^ (y >> 31)
    value = [mixed((b + 1) * 0xD1B54A32D192ED03 & mask) for b in range(256)]
    hashed = lambda w: mixed(sum(value[b] * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(w)) & mask)
    padded = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in b" " + text + b" ")
    for k in range(len(padded) - 2):
        if padded[k + 1] != 32:
            found[(int.from_bytes(padded[k : k + 3], "little") * 2654435761 & 0xFFFFFFFF) >> 14] += 1
    for k in range(len(padded) - 3):
        if 32 not in padded[k + 1 : k + 3]:
            found[(int.from_bytes(padded[k : k + 4], "little") * 2246822519 + 374761393 & 0xFFFFFFFF) >> 14] += 1
    words_ = [hashed(w) for w in padded.split()]
    found.update((h * 0xC2B2AE3D27D4EB4F & mask) >> 46 for h in words_)
    found.update(((a ^ b) * 0x165667B19E3779F9 & mask) >> 46 for a, b in zip(words_, words_[1:]))
    return found


def test_quality_features_and_score_equal_brute_force():
    texts = [b"", b"a", b"one two  two\tthree", "é ß x".encode(), b"same same same", b" long " * 3000]
    buckets, owner = quality.features(texts)
    for k, t in enumerate(texts):
        assert Counter(buckets[owner == k].tolist()) == plain_features(t)
    model = quality.Model(np.random.default_rng(1).normal(size=quality.BUCKETS), 0.3)
    for t, score in zip(texts, model.score(texts)):
        own = plain_features(t)
        mean = sum(float(model.table[b]) * n for b, n in own.items()) / max(1, sum(own.values()))
        assert abs(score - 1 / (1 + np.exp(-(0.3 + mean)))) < 1e-5


def test_quality_training_follows_its_gradient():
    """One pass over few documents against the same steps with the loss's gradient by differences."""
    texts, labels = [b"aa bb", b"cc dd ee", b"aa cc"], np.array([1, 0, 1])
    model = quality.train(texts, labels, 0.6, dim=3, epochs=1, rate=0.5, seed=3)
    rng = np.random.default_rng(3)
    vectors, out, bias = rng.uniform(-1 / 3, 1 / 3, (quality.BUCKETS, 3)).astype(np.float32).astype(float), np.zeros((2, 3)), np.zeros(2)
    for done, i in enumerate(rng.permutation(3)):
        own = plain_features(texts[i])
        keys, share = list(own), np.array(list(own.values())) / sum(own.values())

        def loss(rows, out, bias, i=i, share=share):
            z = out @ (share @ rows) + bias
            return np.log(np.exp(z).sum()) - z[labels[i]]

        def slope(f, x):
            g = np.zeros_like(x)
            for at in np.ndindex(x.shape):
                up, down = x.copy(), x.copy()
                up[at] += 1e-5
                down[at] -= 1e-5
                g[at] = (f(up) - f(down)) / 2e-5
            return g

        rows, step = vectors[keys], 0.5 * (1 - done / 3)
        g_out, g_bias, g_rows = slope(lambda x: loss(rows, x, bias), out), slope(lambda x: loss(rows, out, x), bias), slope(lambda x: loss(x, out, bias), rows)
        out, bias = out - 0.1 * step * g_out, bias - 0.02 * step * g_bias
        vectors[keys] = rows - step * g_rows
    prior = np.log(0.6 / 0.4) - np.log((2 / 3) / (1 / 3))
    assert np.allclose(model.table, vectors @ (out[1] - out[0]), atol=1e-4) and abs(model.bias - (bias[1] - bias[0] + prior)) < 1e-4


def test_quality_of_repeated_ids_and_long_texts(spark):
    """The same model whatever the order of the rows; texts beyond the bound are scored, not learned from."""
    rng = random.Random(9)
    data = [(i % 40, " ".join(words(rng, 30)) if i % 3 else "junk!! " * 20) for i in range(120)] + [(1, "x " * quality.TRAIN_BYTES)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0)], "doc_id long, quality int")
    runs = [quality.scored(spark.createDataFrame(data, DOCS).orderBy(F.rand(seed)).repartition(seed + 1), labels).collect() for seed in (1, 2)]
    assert ordered(runs[0]) == ordered(runs[1]) and len(runs[0]) == len(data)


def test_quotes(spark):
    data = [
        (1, 0, "user", "Hello there.\n\nSecond  paragraph here."), (1, 1, "assistant", "Ann wrote:\n> second paragraph HERE.\nI agree."), (1, 2, "user", ">> second paragraph here.\n> I agree.\nGreat"),
        (1, 3, "user", "> Hello there.\nlate reply"), (2, 0, "user", "> I agree.\nx"), (None, 1, "u", None), (1, 4, "user", "> Great\nok"), (1, 4, "user", "> Great\nok"),
    ]
    schema = "conv_id long, turn long, role string, text string"
    got = [(r["conv_id"], r["turn"], r["text"], r["parent_turn"], r["depth"], r["n_linked"]) for r in quotes.reply_ordered(spark.createDataFrame(data, schema).withColumn("path", F.lit(1))).collect()]
    one = [
        (1, 0, "Hello there.\n\nSecond  paragraph here.", None, 0, 0), (1, 1, "I agree.", 0, 1, 1), (1, 2, "Great", 1, 2, 2), (1, 4, "ok", 2, 3, 1), (1, 4, "ok", 2, 3, 1), (1, 3, "late reply", 0, 1, 1),
    ]
    assert [r for r in got if r[0] == 1] == one
    assert [r for r in got if r[0] != 1] == [(None, 1, "", None, 0, 0), (2, 0, "x", None, 0, 0)]
    assert quotes.reply_ordered(spark.createDataFrame([], schema)).collect() == []


def test_quotes_of_several_lines(spark):
    """Runs of lines and paragraphs, inline replies, blank lines with spaces, CRLF, new line ends, lines left out."""
    data = [
        (1, 0, "u", "one a\ntwo b\nthree c"), (1, 1, "u", "> one a\n> two b\nreply one"), (2, 0, "u", "p one\n\np two\nline\n\np three"), (2, 1, "u", "> p two\n> line\n>\n> p three\nr"),
        (3, 0, "u", "q one\nq two"), (3, 1, "u", "> q one\nfirst own\n> q two\nsecond own"), (3, 2, "u", "> first own\n> second own\nx"), (4, 0, "u", "a b\r\n \t\r\nc d\r\ne f\r\n\r\ng"), (4, 1, "u", "> C d e\n> f\n>\n> g\ny"),
        (5, 0, "u", "l one\nl two\nl three"), (5, 1, "u", "> l one\n> l three\nz"), (6, 0, "u", "s t u v"), (6, 1, "u", "s t"), (6, 2, "u", "> s t\n> u v\nw"), (7, 0, "u", "m n o"), (7, 1, "u", "> m n\nk"),
    ]
    got = quotes.reply_ordered(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()
    want = {(1, 1): 0, (2, 1): 0, (3, 1): 0, (3, 2): 1, (4, 1): 0, (5, 1): 0, (6, 2): 0}
    assert {(r["conv_id"], r["turn"]): r["parent_turn"] for r in got if r["parent_turn"] is not None} == want
    assert [(r["depth"], r["n_quotes"], r["n_linked"]) for r in got if r["conv_id"] == 3] == [(0, 0, 0), (1, 2, 2), (2, 1, 1)]


def test_long_threads_keep_their_path(spark):
    data = [(7, i, "u", f"message {i}" if i == 0 else f"> message {i - 1}\nmessage {i}") for i in range(20)]
    got = quotes.reply_ordered(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()
    assert [(r["turn"], r["depth"]) for r in got] == [(i, i) for i in range(20)]


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                label[find(a)] = find(b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    smallest = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return ordered((d, len(sets[i]), smallest[find(i)]) for i, (d, _) in enumerate(rows)), len(least)


def test_ngram_join(docs, rows, empty):
    want, groups = brute_components(rows)
    got = ngram_join.linked(docs).collect()
    assert ordered((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert ngram_join.linked(empty).collect() == []
    kept = ngram_join.keep_one(docs.withColumn("label", F.lit("own")).withColumn("_g", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "label", "_g"] and kept.count() == groups
    once = ngram_join.keep_one(docs.sparkSession.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "A b c"), (None, "a b C"), (3, ""), (3, "")], DOCS)).collect()
    assert ordered(tuple(r) for r in once) == ordered([(1, "a b c"), (3, ""), (3, "")])


def brute_links(rows):
    """Links of each row, and the number of pairs of rows with different sets that are linked."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else (frozenset([tuple(w)]) if w else frozenset()))
    near = lambda a, b: bool(s := len(a & b)) and 100 * s >= 75 * (len(a) + len(b) - s)
    pairs = [(x, y) for x in range(len(rows)) for y in range(x) if near(sets[x], sets[y])]
    count = Counter(k for p in pairs for k in p)
    return ordered((d, count[k]) for k, (d, _) in enumerate(rows)), sum(sets[x] != sets[y] for x, y in pairs)


@pytest.mark.parametrize("part", [2000, 3])
def test_ngram_links_are_all_met(spark, docs, rows, part, monkeypatch):
    """Numbers of links inside components too, with components in one task and in pairs of blocks."""
    monkeypatch.setattr(ngram_join, "PART_CLASSES", part)
    rng, made = random.Random(3), []
    for f in range(3):  # families with shingles of many members and of few
        base = words(rng, 120, 10**6)
        for _ in range(14):
            own = list(base)
            for _ in range(rng.randrange(6)):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
            made.append((len(made) + 10**6, " ".join(own)))
    every = [*rows, *made, made[0]]
    want, pairs = brute_links(every)
    frame = spark.createDataFrame(every, DOCS).repartition(3)
    assert ordered((r["doc_id"], r["n_links"]) for r in ngram_join.linked(frame).collect()) == want
    assert sum(r["size_a"] * r["size_b"] for r in ngram_join.links(frame).collect()) == pairs


def test_ngram_join_where_different_sets_share_a_hash(docs, rows, monkeypatch):
    """Hashes of four bits: the second hash tells the sets apart."""
    whole = ngram_join.set_hash

    def short(own, seed=0xA0761D6478BD642F):
        return whole(own, seed) & 15 if seed == 0xA0761D6478BD642F else whole(own, seed)

    monkeypatch.setattr(ngram_join, "set_hash", short)
    got = ngram_join.linked(docs).collect()
    assert ordered((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)[0]


def test_windows_of_one_hash_are_told_apart():
    """Blocks that send one hash get it back only if their windows' checks agree, or if one has it twice."""
    import pyarrow as pa

    def answers(*sent):
        tables = [substrings._send(b, np.array(h, np.uint64), np.array(m), 1, np.array(c, np.uint32)) for b, h, m, c in sent]
        got = substrings._answer(pa.concat_tables(tables))
        return {b: np.frombuffer(h, np.uint64).tolist() for b, h in zip(got.column("block").to_pylist(), got.column("hashes").to_pylist())}

    assert answers((0, [5, 9], [False, False], [1, 1]), (1, [5, 8], [False, False], [1, 1])) == {0: [5], 1: [5]}
    assert answers((0, [5, 9], [False, False], [1, 1]), (1, [5, 8], [False, False], [2, 1])) == {}
    assert answers((0, [5, 9], [True, False], [1, 1]), (1, [5, 9], [False, False], [2, 1]), (2, [9], [False], [7])) == {0: [5, 9], 1: [9]}


def test_ngram_join_on_chains_of_near_copies(spark, monkeypatch):
    """Families whose pairs lie on both sides of the threshold, with many blocks of contested lists."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 500)
    rng = random.Random(11)
    made = []
    for f in range(4):
        w = words(rng, 90, 10**6)
        for i in range(40):
            own = list(w)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**9)}"
            made.append(" ".join(own))
            if i % 4 == 0:
                w = own
    data = list(enumerate(made))
    got = ngram_join.linked(spark.createDataFrame(data, DOCS)).collect()
    assert ordered((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(data)[0]


def test_token_store(spark, docs, rows, empty, tmp_path):
    tok = tokenizer(default_vocabulary())
    texts = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    encoded = defaultdict(list)
    for i, t in rows:
        encoded[i].append(tok.encode(t or "", add_special_tokens=False).ids + [1])
    got = token_store.stored(docs).collect()
    assert len(got) == len(rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
        assert (r["n_tokens"], r["ids_crc32"]) in {(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in encoded[r["doc_id"]]}
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [i for i, _ in texts]
    token_store.write_store(docs, str(tmp_path / "store"), shard_bytes=2000)
    key = rows[8][0]
    found = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_store.fetch(spark, str(tmp_path / "store"), [key, 77777]).collect()}
    assert set(found) == {key} and found[key] in encoded[key]
    assert token_store.stored(empty).collect() == []


def test_token_store_opens_only_the_shards_with_the_keys(spark, docs, rows, tmp_path):
    """Far keys, a null id, repeated ids, and no key at all; every key of the store is found."""
    path, tok = str(tmp_path / "store"), tokenizer(default_vocabulary())
    token_store.write_store(docs.withColumn("shard", F.lit("own")), path, shard_bytes=3000)
    assert len(list(Path(path, "shards").glob("*.parquet"))) == spark.read.parquet(f"{path}/index").count() > 8
    ids = sorted({i for i, _ in rows if i is not None})
    far = [ids[0], ids[-1], ids[len(ids) // 2], 10**12, -5]
    where = token_store.places(spark, path, far).collect()
    assert {r["doc_id"] for r in where} == set(far[:3])
    opened = token_store.fetch(spark, path, far)
    assert len(opened.inputFiles()) == len({r["file"] for r in where}) <= 3
    encoded = defaultdict(list)
    for i, t in rows:
        encoded[i].append(tok.encode(t or "", add_special_tokens=False).ids + [1])
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_store.fetch(spark, path, ids).collect()}
    assert set(got) == set(ids) and all(v in encoded[k] for k, v in got.items())
    assert token_store.fetch(spark, path, []).collect() == []


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    made = token_store.PerfectHash.build(keys)
    assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))


def test_shipped_licences(spark):
    """Whole texts as they are published, re-wrapped and without appendix, and notices behind comment marks."""
    folder = Path(licences.__file__).parent / "licence_texts"
    texts = {f.stem: f.read_text(encoding="utf-8") for f in folder.glob("*.txt")}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause"} <= set(texts)
    whole = [(i, i, t) for i, t in texts.items()] + [(f"{i} wide", i, re.sub(r"[ \t]+", " ", t.upper() if i != "CC0-1.0" else t)) for i, t in texts.items()]
    whole.append(("short", "Apache-2.0", texts["Apache-2.0"].split("APPENDIX:")[0]))
    lines = [("spdx", "GPL-2.0-notice", "# SPDX-License-Identifier: GPL-2.0-only"), ("gpl", "GPL-2.0-notice", "This work is licensed under the GNU General Public License, version 2."), ("mpl", "MPL-2.0-notice", "// Licensed under the Mozilla Public License 2.0")]
    docs = spark.createDataFrame([(k, t) for k, _, t in whole] + [(k, f"text\n{t}\nmore") for k, _, t in lines], "doc_id string, text string")
    got = {r["doc_id"]: r for r in licences.scan(docs, licences.known_licences(spark)).collect()}
    assert {k: got[k]["license_id"] for k, _, _ in whole} == {k: i for k, i, _ in whole}
    assert {k: got[k]["notices"] for k, _, _ in lines} == {k: i for k, i, _ in lines}


def test_ngram_join_groups_of_a_bucket_do_not_follow_its_packed_rows():
    """A bucket of many small packed rows, as a larger corpus has, is hashed and sent in as few steps as one of a single row."""
    import pyarrow as pa

    texts = [f"word{i} common words of text {i % 7}".encode() for i in range(300)]
    names = ("bucket", "cls", "sizes", "texts")
    whole = pa.Table.from_batches([ngram_join._pack_rows([0] * 300, list(range(300)), texts, names)])
    small = pa.Table.from_batches([ngram_join._pack_rows([0], [i], [t], names) for i, t in [*enumerate(texts), *enumerate(texts[:40])]])
    (cls, kept), = ngram_join._distinct(small)
    assert cls == list(range(300)) and kept == texts
    groups = list(ngram_join._distinct(small, 1000))
    assert [t for _, g in groups for t in g] == texts and all(sum(map(len, g)) < 1100 for _, g in groups)
    emit = ngram_join._emit_prefixes(SimpleNamespace(value=np.zeros(1 << ngram_join.SKETCH_BITS, np.uint32)), 16)
    assert emit(small).equals(emit(whole)) and emit(whole).num_rows == 16


def test_ngram_join_meets_all_pairs_of_a_list_across_labels(monkeypatch):
    """Against brute force, for lists of one and of two blocks, in pieces of any size."""
    rng = np.random.default_rng(5)
    for trial in range(60):
        monkeypatch.setattr(ngram_join, "MEET_ROWS", int(rng.integers(1, 50)))
        m = int(rng.integers(2, 60))
        token, label, side = rng.integers(0, 8, m), rng.integers(0, 5, m) * 7 - 9, rng.integers(0, 2, m) * 3 * (trial % 2)
        order, runs = ngram_join._across(token, side, label)
        got = sorted(tuple(sorted(p)) for x, y in runs for p in zip(order[x].tolist(), order[y].tolist()))
        two = len(set(side.tolist())) == 2
        assert got == [(i, j) for i in range(m) for j in range(i + 1, m) if token[i] == token[j] and label[i] != label[j] and (not two or side[i] != side[j])]
