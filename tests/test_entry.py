"""Registered queries against DuckDB on the smallest tables, and the entry point."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tessera import plans

DIR = "/root/testdata/sf0.001"
#: These need more rows than the smallest tables have.
LARGER = {"fold_guard", "bootstrap_auc", "paired_bootstrap", "fold_bootstrap", "gate"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = plans.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(DIR).is_dir(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    def connect(folder):
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        return con

    return {folder: connect(folder) for folder in (DIR, DIR.replace("0.001", "0.01"))}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    folder = DIR.replace("0.001", "0.01") if name in LARGER else DIR
    df = entry.queries()[name](spark, folder)
    found = duck[folder].execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    names = sorted(columns)
    want = sorted(repr(tuple(plain(r[columns.index(c)]) for c in names)) for r in found.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 6


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
