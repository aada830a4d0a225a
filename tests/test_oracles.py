"""Every registered query against its SQL on the same tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

EMPTY = {"arp_poisoning"}
ONLY = [n for n in os.environ.get("ONLY", "").split(",") if n]


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, (int, float)):
        value = float(value)
        return None if math.isnan(value) else round(value, 6)
    return str(value)


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", ONLY or sorted(queries()))
def test_query(spark, sf_dir, duck, name):
    df = queries()[name](spark, sf_dir)
    got = as_rows(df.columns, [tuple(r) for r in df.collect()])
    # A query may be empty only where nothing of its kind is in the smallest tables.
    assert got or name in EMPTY
    sql = oracle_sql().get(name)
    if sql is None:
        return
    result = duck.execute(sql)
    columns = [d[0] for d in result.description]
    want = as_rows(columns, result.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert len(got) == len(want)
    different = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not different, different[:5]


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
