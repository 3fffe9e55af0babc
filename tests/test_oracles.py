"""Every registered query with a SQL check, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from conftest import DATA

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return 0.0 if v == 0 else float(v) if not math.isnan(v) else "nan"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rel = duck.execute(oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    index = [names.index(c) for c in cols]
    want = sorted(repr(tuple(plain(r[i]) for i in index)) for r in rel.fetchall())
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    assert got == want


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "home_attack_strength_10" in df.columns


def test_every_check_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())
