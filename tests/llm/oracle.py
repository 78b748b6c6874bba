"""A query's rows against DuckDB's for its SQL."""

import glob

import duckdb


def same(spark, sf_dir, name, queries, oracle):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {p.rsplit('/', 1)[1][:-8]} as select * from '{p}'")
    cur = con.execute(oracle[name])
    cols = [c[0] for c in cur.description]
    want = sorted((dict(zip(cols, r)) for r in cur.fetchall()), key=lambda r: str(sorted(r.items())))
    df = queries[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(cols)
    got = sorted((r.asDict() for r in df.collect()), key=lambda r: str(sorted(r.items())))
    assert got == want
    return got
