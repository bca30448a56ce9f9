"""Registered queries against their reference SQL on the given tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql
from pitscore.plans.catalog import QUERIES

DATA = "/root/testdata/sf0.001"
# Sectors of more than a name and buckets need more data.
LARGER = "/root/testdata/sf0.01"
LARGER_QUERIES = ("sector_zscore", "score_buckets", "calibrate_thresholds", "winsor_bounds", "composite", "weight_search")
ORACLES = oracle_sql()


def connected(folder):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.fixture(scope="module")
def con():
    return connected(DATA)


@pytest.fixture(scope="module")
def larger():
    return connected(LARGER)


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else str(v)


def check(spark, con, name, folder):
    df = QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    expected = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == expected


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    check(spark, con, name, DATA)


@pytest.mark.parametrize("name", LARGER_QUERIES)
def test_query_on_more_rows(spark, larger, name):
    check(spark, larger, name, LARGER)


def test_entry(spark):
    assert entry(spark).count() > 0
