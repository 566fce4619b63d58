"""Comparing a query with its SQL on the driver's tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(None if r[i] is None else repr(r[i]) if isinstance(r[i], float) else str(r[i]) for i in order) for r in values]
    return sorted(out, key=str)


def both(spark, query, sql, sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    ours, theirs = query(spark, sf), c.sql(sql)
    assert sorted(ours.columns) == sorted(theirs.columns)
    return rows(ours.columns, ours.collect()), rows(theirs.columns, theirs.fetchall())
