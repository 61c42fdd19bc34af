"""Hold queries against their SQL in DuckDB."""

import glob
import os

import duckdb

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def connection(sf_dir=SF):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(r[k] for k in order) for r in found], key=repr)


def differs(spark, query, sql, con, sf_dir=SF):
    """None if both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want = rows([d[0] for d in rel.description], rel.fetchall())
    if sorted(df.columns) != sorted(d[0] for d in rel.description):
        return f"columns {df.columns}"
    if len(got) != len(want):
        return f"{len(got)} rows, not {len(want)}; {got[:2]} {want[:2]}"
    for g, w in zip(got, want, strict=True):
        if g != w:
            return f"{g} is not {w}"
    return None
