"""Every registered query with an SQL twin, against DuckDB on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()
NAMES = [n for n in entry.queries() if n in SQL and not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(str([plain(row[c]) for c in columns]) for row in df.collect())
    answer = duck.sql(SQL[name])
    assert sorted(answer.columns) == columns
    at = [answer.columns.index(c) for c in columns]
    assert got == sorted(str([plain(row[i]) for i in at]) for row in answer.fetchall())


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in SQL and not n.startswith("op") and n != "pipeline"])
def test_runs_without_sql(spark, name):
    df = entry.queries()[name](spark, DATA)
    assert df.columns
    df.count()


def test_entry(spark):
    assert entry.entry(spark).columns


def test_snapshot_manifest_against_a_plain_version(spark):
    """Each row's fields chained through a 64-bit hash, the hashes of a day added up, and their sum hashed."""
    import hashlib
    import struct

    import xxhash

    from skylattice.plans import bindings

    wide, narrow = (lambda v, h: xxhash.xxh64_intdigest(struct.pack("<q", v), h)), (lambda v, h: xxhash.xxh64_intdigest(struct.pack("<i", v), h))
    days = {}
    for row in bindings.obs_grid(spark, DATA).collect():
        h = wide(row["day"], 42)
        h = narrow(row["iy"], narrow(row["ix"], h))
        h = xxhash.xxh64_intdigest(struct.pack("<d", row["v"]), wide(row["n"], h))
        count, total = days.get(row["day"], (0, 0))
        days[row["day"]] = (count + 1, total + (h - (1 << 64) if h >> 63 else h))
    plain_version = {d: (n, hashlib.sha256(f"day,ix,iy,n,v:{n}:{t}".encode()).hexdigest()) for d, (n, t) in days.items()}
    assert {r["day"]: (r["rows"], r["content"]) for r in entry.queries()["q3_snapshot_manifest"](spark, DATA).collect()} == plain_version
