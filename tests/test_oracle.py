"""Every registered query against its check SQL on the given tables."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def test_every_query_has_a_check():
    # The training-text operators that SQL cannot express have tests of their own.
    assert {n for n in QUERIES if n not in ORACLES and not n.startswith("op")} <= {"pipeline"}
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted([tuple(map(plain, r)) for r in frame.select(*columns).collect()], key=str)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted([tuple(plain(r[i]) for i in at) for r in result.fetchall()], key=str)
    assert got == want


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0
