"""Each stage of the pipeline on its own input against a brute-force version."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from graphlens.llm import quality
from tests.llm.test_operators import brute_components, brute_windows, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    at, rng = tmp_path_factory.mktemp("tables"), random.Random(4)
    texts = [" ".join(words(rng, 60, 5000)) for _ in range(60)]
    texts += [t for t in texts[:5]] + [t + " more" for t in texts[5:10]] + [texts[20] + " " + " ".join(f"bench{i}" for i in range(12))] + ["JUNK!! " * 60 for _ in range(20)] + ["", None]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{i}" for i in range(12)))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, int("JUNK" not in (t or "JUNK")), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, held = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = pairs(docs)
        docs = stage(spark, docs, folder)
        if name != "bpe":
            assert docs.columns == columns
            held[name] = (before, pairs(docs))
    before, after = held["quality"]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scores = quality.scored(spark.createDataFrame(before, "doc_id long, text string"), labels.select("doc_id", "quality"))
    assert {i for i, _ in after} == {r["doc_id"] for r in scores.filter("predicted = 1").collect()}
    assert not any("JUNK" in (t or "") for _, t in after) and len(after) >= 60
    before, after = held["exact_dedup"]
    assert len(after) == len({"".join((t or "").split()) for _, t in before})
    before, after = held["near_dedup"]
    assert len(after) == brute_components(before)[1] and {i for i, _ in after} == {c if c is not None else d for d, _, c in brute_components(before)[0]}
    before, after = held["decontamination"]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert {i for i, _ in after} == {r[0] for r in brute_windows(before, bench) if not r[-1]}
    assert docs.count() == len(after) and docs.filter(F.col("n_tokens") > 0).count() >= len(after) - 1


def test_run_leaves_its_result_alone(spark, folder, monkeypatch, tmp_path):
    from pathlib import Path

    from graphlens.llm import shared

    monkeypatch.setattr(shared, "work_dir", lambda spark: str(tmp_path))
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert [p.name.split("-")[:2] for p in Path(tmp_path, "tables").iterdir()] == [["stage", "bpe"]] and found.count() > 0


def test_stages_on_odd_rows(spark, folder):
    """Null ids, repeated rows, long and empty texts and columns named like those of the operators."""
    base = pairs(spark.read.parquet(f"{folder}/documents.parquet"))
    long = " ".join(f"long{i}" for i in range(30_000))
    odd = [*base, (None, base[3][1]), (None, None), (None, "only here and with words enough for it"), base[7], base[7], (900, long), (901, long + " x"), (902, " \n")]
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    for c in ("score", "label", "_h", "_norm", "kept", "block", "item_id", "cls"):
        docs = docs.withColumn(c, F.lit(c))
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality", "exact_dedup", "near_dedup", "decontamination"):
        got = stages[name](spark, docs, folder)
        assert got.columns == docs.columns
        rows = got.collect()
        assert all(r["score"] == "score" and r["_h"] == "_h" and r["cls"] == "cls" for r in rows)
        kept = [(r["doc_id"], r["text"]) for r in rows]
        assert not set(kept) - set(odd)
        if name == "exact_dedup":
            assert len(kept) == len({"".join((t or "").split()) for _, t in odd})
        if name == "near_dedup":
            assert len(kept) == brute_components(odd)[1]
        if name == "decontamination":
            bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert sorted(map(repr, kept)) == sorted(repr(r) for r, hit in zip(odd, [brute_windows([r], bench)[0][-1] for r in odd]) if not hit)
    encoded = stages["bpe"](spark, docs, folder)
    assert encoded.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and encoded.count() == len(odd)


def test_stages_equal_the_library_at_the_end(spark, folder):
    import hashlib

    import numpy as np
    from graphlens.llm.tokens import default_vocabulary, tokenizer

    tok = tokenizer(default_vocabulary())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = sorted((i, len(ids := tok.encode(t or "", add_special_tokens=False).ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) for i, t in pairs(docs))
    got = dict(corpus_pipeline.STAGES)["bpe"](spark, docs, folder).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in got) == want


def test_stages_on_empty_tables(spark, folder, tmp_path):
    """No documents; and documents, but neither labels nor benchmark."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
        if name == "decontamination":
            assert stage(spark, docs, str(tmp_path)).count() == docs.count()
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
