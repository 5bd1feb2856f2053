"""Every registered query equals its SQL counterpart on the test tables."""
import os

import duckdb
import pytest

import __spark_entry__ as entry
from spoor.contract.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP"}
EMPTY = ("find_brute_force", "find_enum_404", "find_traffic_spike", "pivot_time")    # find nothing in the smallest tables
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF_DIR}/events.parquet'")
    return con


def _sorted(rows):
    def cell(v):
        return round(v, 9) if isinstance(v, float) else v
    return sorted([tuple(map(cell, r)) for r in rows],
                  key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


def test_each_query_has_a_counterpart():
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = entry.queries()[name](spark, SF_DIR)
    columns = sorted(found.columns)
    result = duck.execute(entry.oracle_sql()[name])
    kinds = {d[0]: str(d[1]) for d in result.description}
    assert sorted(kinds) == columns
    assert {n: TYPES[t] for n, t in found.dtypes} == kinds
    places = [list(kinds).index(c) for c in columns]
    expected = _sorted([[r[i] for i in places] for r in result.fetchall()])
    assert expected or name in EMPTY
    assert _sorted([[r[c] for c in columns] for r in found.collect()]) == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
