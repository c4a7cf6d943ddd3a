"""Current state in buckets: what it says, what moves, and when the history is read instead."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bidweave.operators import state
from bidweave.plans import current
from bidweave.schema import KEYS, STATE_TABLES
from bidweave.sources.state_store import StateStore

DAY = datetime(2026, 7, 1)
KEY = ("rakuten", "ITEM")


@pytest.fixture(scope="module")
def shuffled(spark):
    """Joins by shuffle, as of tables that are too large to broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def rows(spark, name, *values):
    columns = [f.split(" ")[0] for f in STATE_TABLES[name].split(", ")]
    return spark.createDataFrame([tuple({**dict(zip(KEYS, (*KEY, "", ""))), **v}.get(c) for c in columns) for v in values], STATE_TABLES[name])


def events(spark, *found):
    return spark.createDataFrame([(*KEY, p, "", e, r) for p, e, r in found], ", ".join(f"{k} string" for k in KEYS) + ", event_type string, planned_run_id string")


def a_run(store, n, *, closes=()):
    """Applied bids, plans, metrics and overrides of run n, for products that differ from run to run."""
    spark, now, run = store.spark, DAY + timedelta(days=n), f"run_{n}"
    tables, found = store.transaction(), events(spark, *closes)
    tables.update("planned_settings", lambda r: state.update_plans(r, found))
    tables.append("applied_settings", rows(spark, "applied_settings", *[{"product_id": f"P{k}", "applied_cpc": 10.0 * n + k, "effective_at": None if k == 3 else now - timedelta(days=2 * n * (k % 2)), "source": run} for k in range(n, n + 5)]))
    tables.append("planned_settings", rows(spark, "planned_settings", *[{"product_id": f"P{k}", "planned_cpc": 50.0 + n, "planned_status": "pending", "planned_at": now, "run_id": run} for k in range(n % 3, 6)]))
    tables.append("metric_history", rows(spark, "metric_history", *[{"product_id": f"P{k}", "period_end": None if (k, n) == (2, 1) else now.date() - timedelta(days=k * n % 3), "captured_at": None if k == 4 else now, "clicks": float(n * 10 + k)} for k in range(6)]))
    tables.append("manual_overrides", rows(spark, "manual_overrides", *[
        {"product_id": "P0", "override_mode": "LOCK_CPC", "override_cpc": float(n), "effective_from": now, "active": True},
        {"product_id": "P1", "override_mode": "future", "override_cpc": float(n), "effective_from": now + timedelta(days=2), "active": True},
        {"product_id": "P2", "override_mode": "short", "override_cpc": float(n), "effective_from": now, "effective_until": now + timedelta(hours=30), "active": n != 2},
        {"product_id": "P3", "override_mode": "undated", "override_cpc": float(n), "active": n == 1},
    ]))
    current.merge(tables, found, now).commit()
    return now


def from_history(store, now):
    at = F.lit(now).cast("timestamp")
    return [state.latest_applied(store.read("applied_settings")), state.latest_pending(store.read("planned_settings")), state.latest_metrics(store.read("metric_history")), state.active_overrides(store.read("manual_overrides"), at)]


def same(store, now):
    for kept, whole in zip(current.joined(store, store.number(), now), from_history(store, now), strict=True):
        assert kept.columns == whole.columns
        assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_current_state_is_what_the_history_says_after_each_run(shuffled, tmp_path):
    store = StateStore(shuffled, f"{tmp_path}/state")
    for n in range(3):
        now = a_run(store, n, closes=[("P1", "PLAN_CONFIRMED", f"run_{n - 1}"), ("P2", "EXTERNAL_MANUAL_CHANGE", f"run_{n - 1}"), ("P4", "INITIAL_BASELINE", f"run_{n - 1}")] if n else [])
        manifest = store.manifest()
        assert all(current.is_current(manifest, name, now) for name in current.HISTORY)
        for hours in (0, 25, 24 * 30):
            same(store, now + timedelta(hours=hours))
    # An override that another without end has replaced is not kept, a past one neither.
    kept = {(r["product_id"], r["override_cpc"]) for r in store.read("current_overrides").collect()}
    assert ("P0", 2.0) in kept and ("P0", 1.0) not in kept and ("P2", 0.0) not in kept and ("P1", 2.0) in kept
    assert store.read("current_applied").count() == 7


def test_an_earlier_time_and_rows_that_came_another_way_are_read_from_the_history(shuffled, tmp_path):
    store = StateStore(shuffled, f"{tmp_path}/state")
    now = a_run(store, 0)
    now = a_run(store, 1)
    same(store, now - timedelta(days=1))
    store.append("applied_settings", rows(shuffled, "applied_settings", {"product_id": "P1", "applied_cpc": 77.0, "effective_at": now + timedelta(days=9), "source": "x"}))
    assert not current.is_current(store.manifest(), "current_applied", now)
    same(store, now)
    now = a_run(store, 2)
    assert current.is_current(store.manifest(), "current_applied", now)
    same(store, now)


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if re.search(r"\bExchange\b", line)]


def test_no_row_of_the_state_moves_in_the_joins(shuffled, tmp_path):
    store = StateStore(shuffled, f"{tmp_path}/state")
    for n in range(2):
        now = a_run(store, n)
    entities = shuffled.createDataFrame([(*KEY, f"P{k}", "", float(k)) for k in range(9)], ", ".join(f"{k} string" for k in KEYS) + ", registered_cpc double")
    out = entities
    for t in current.joined(store, store.number(), now):
        out = out.join(t, KEYS, "left")
    moved = exchanges(out)
    # The entities alone, once for the four joins.
    assert len(moved) == 1 and out.count() == 9
    # Without the buckets each state side moves as well.
    plain = entities
    for t in from_history(store, now):
        plain = plain.join(t, KEYS, "left")
    assert len(exchanges(plain)) >= 4
    assert sorted(map(str, plain.collect())) == sorted(map(str, out.collect()))


def test_buckets_grow_with_the_rows(shuffled, tmp_path, monkeypatch):
    store = StateStore(shuffled, f"{tmp_path}/state")
    a_run(store, 0)
    assert store.manifest()["marks"]["buckets"] == 4
    monkeypatch.setattr(current, "BUCKET_ROWS", 0.2)
    a_run(store, 1)
    now = a_run(store, 2)
    assert store.manifest()["marks"]["buckets"] > 4
    same(store, now)


def test_null_keys_and_empty_tables(shuffled, tmp_path):
    store = StateStore(shuffled, f"{tmp_path}/state")
    current.merge(store.transaction(), events(shuffled), DAY).commit()
    same(store, DAY)
    tables = store.transaction().append("applied_settings", rows(shuffled, "applied_settings", {"product_id": None, "applied_cpc": 1.0}, {"product_id": "P", "applied_cpc": 2.0}))
    current.merge(tables, events(shuffled), DAY).commit()
    assert [r["product_id"] for r in current.joined(store, store.number(), DAY)[0].collect()] == ["P"]


def test_a_store_is_read_by_another_session_and_vacuumed(shuffled, tmp_path):
    store = StateStore(shuffled, f"{tmp_path}/state")
    for n in range(2):
        now = a_run(store, n)
    # The catalog of a new application knows none of the tables.
    for r in shuffled.sql("SHOW TABLES LIKE 'bidweave_current*'").collect():
        shuffled.sql(f"DROP TABLE {r['tableName']}")
    same(store, now)
    assert store.vacuum(keep=1, seconds=0) > 0
    same(store, now)
