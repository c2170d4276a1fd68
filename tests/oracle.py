"""Runs a registered query and its SQL on the same tables and compares the rows."""

import os

import duckdb

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(rows):
    one = lambda x: "NULL" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(one(x) for x in r) for r in rows)


def compare(spark, query, sql, sf_dir=SF_DIR):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    expected = found.fetchall()
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert shown(tuple(r) for r in df.select(*names).collect()) == shown(expected)


def available():
    return os.path.isdir(SF_DIR)
