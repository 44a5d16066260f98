"""A selection of queries against their SQL on the smallest tables; the rest run the same way in the driver."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
NAMES = ["p3_found", "p4_found", "p4_report", "current_facts", "scd_slots", "graph_filter_modes", "hybrid_search", "spreading_activation", "effective_confidence", "entity_resolution_alias", "communities", "collision_merge"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    got = entry.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    have = Counter(tuple(r[c] for c in cols) for r in got.collect())
    res = db.execute(entry.oracle_sql()[name])
    at = {c[0]: i for i, c in enumerate(res.description)}
    assert sorted(at) == cols
    assert have == Counter(tuple(r[at[c]] for c in cols) for r in res.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
