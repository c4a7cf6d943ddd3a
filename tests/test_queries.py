"""The queries against their SQL, over the smallest tables."""

import math
from functools import lru_cache

import duckdb
import pytest

import __spark_entry__ as entry
from bidweave.plans import queries
from bidweave.plans.catalogue import ORACLES, QUERIES
from bidweave.sources.files import kind_of

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return str(v) if isinstance(v, (bool, str)) or not isinstance(v, (int, float)) else f"{float(v) + 0.0:.5f}"

    return sorted(columns), sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module", autouse=True)
def shared():
    """Entities and decisions are written once for all queries of this module, not once a query."""
    with pytest.MonkeyPatch.context() as patch:
        for name in ("entities", "decided"):
            patch.setattr(queries, name, lru_cache(getattr(queries, name)))
        yield


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name in ORACLES:
        relation = con.sql(ORACLES[name])
        assert canonical(df.columns, rows) == canonical(relation.columns, relation.fetchall())
    else:
        assert df.columns


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_kinds_are_told_from_columns():
    assert kind_of(["商品管理番号", "クリック数(合計)"]) == "rakuten_rpp_item_report"
