import duckdb
import pytest

import __spark_entry__ as entry
from kelpie.plans import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def same(spark, name, query, sql):
    df = query(spark, DIR)
    names = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    assert sorted(columns) == names
    expected = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in got.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr) == expected, name


SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    same(spark, name, queries.QUERIES[name], SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
