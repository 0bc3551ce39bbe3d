"""Comparison of a query's rows with DuckDB's over the same tables."""

from pathlib import Path

import duckdb


def same(spark, sf_dir, f, sql):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    got, want = f(spark, sf_dir).toPandas(), con.execute(sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (d[columns].sort_values(columns).reset_index(drop=True) for d in (got, want))
    assert len(got) == len(want)
    for c in columns:
        equal = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        assert equal.all(), (c, got[~equal].head(3), want[~equal].head(3))
