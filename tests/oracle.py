"""Comparison of a registered query with its DuckDB counterpart."""

from pathlib import Path

SMALL = Path("/root/testdata/sf0.001")


def rounded(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(rounded, v)) if isinstance(v, (list, tuple)) else v


def compare(spark, query, sql) -> int:
    """Rows of both, which must be equal as multisets with the same column names."""
    import duckdb

    con = duckdb.connect()
    for f in SMALL.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    rel = con.sql(sql)
    df = query(spark, str(SMALL))
    assert sorted(df.columns) == sorted(rel.columns)
    columns = sorted(df.columns)
    place = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(rounded(r[i]) for i in place) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want
    return len(got)
