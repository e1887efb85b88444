"""Every registered query outside the corpus operators against DuckDB on the smallest tables."""

import pytest

import __spark_entry__
from tests.oracle import SMALL, compare

QUERIES = {k: f for m in __spark_entry__.MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in __spark_entry__.MODULES for k, q in m.ORACLE_SQL.items()}

pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="the tables are not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, QUERIES[name], SQL[name]) > 0


def test_graph_rag_gives_seeds_and_expansion(spark):
    rows = QUERIES["v6_graph_rag"](spark, str(SMALL)).collect()
    assert {"VECTOR", "KEYWORD"} & {r["source"] for r in rows} and len({r["qualified_name"] for r in rows}) == len(rows)
    scores = [r["score"] for r in rows]
    assert scores == sorted(scores, reverse=True)


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["id", "qualified_name", "kind", "file_path"] and found.count() > 0


def test_redaction(spark, tmp_path):
    texts = ["password: x1", "my api_key=x2, ok", "Authorization: Bearer abc", "plain", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["text"] for r in QUERIES["p18_redaction"](spark, str(tmp_path)).collect()}
    assert got == {0: "password: [REDACTED]", 1: "my api_key=[REDACTED], ok", 2: "Authorization: Bearer [REDACTED]", 3: "plain", 4: None}
