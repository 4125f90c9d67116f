"""Every query of the catalogue against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from patchlens.plans.queries import QUERIES

SF_DIR = Path("/root/testdata/sf0.001")
NAMES = sorted(QUERIES)
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="tables not present")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_sql():
    assert set(NAMES) <= set(entry_point.queries())
    assert set(NAMES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry_point.queries()[name](spark, str(SF_DIR))
    columns = sorted(df.columns)
    got = Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = duck.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = Counter(repr([plain(r[i]) for i in at]) for r in cursor.fetchall())
    assert got == want


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_run_comparison_joins_its_tables_once(spark):
    """Both sides read findings written once."""
    files = entry_point.queries()["run_comparison"](spark, str(SF_DIR)).inputFiles()
    assert files and not any("lineitem" in f for f in files)
