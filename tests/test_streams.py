"""Streams against batches: the events of reconciliation for any cuts and restarts, and what absorbing leaves behind."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bidweave.operators import state
from bidweave.plans import absorbed
from bidweave.schema import KEYS, STATE_TABLES, Policy
from bidweave.session import scratch, shared_dir, written
from bidweave.streaming.incremental import absorb_stream
from bidweave.streaming.reconcile import ROWS, reconcile_stream
from tests.test_store import performance  # noqa: F401

START, DAYS = datetime(2026, 7, 1), [1, 2, 4, 5, 9, 12]


def key(p):
    return "rakuten", "ITEM", p, ""


def history(products=14):
    """Settings of every day, plans between them (some on the day of a setting), and bids from before."""
    draw = random.Random(4)
    known = [(*key(f"P{p}"), "APPLIED", float(draw.choice([30, 35])), None if p % 4 == 1 else START - timedelta(days=p % 9), None) for p in range(products) if p % 3]
    plans = [(*key(f"P{p}"), "PLAN", float(draw.choice([40, 50])), START + timedelta(days=d, hours=-12 if p % 2 else 0), f"run_{d}") for p in range(products) for d in (2, 4, 9) if draw.random() < 0.5]
    settings = [(*key(f"P{p}"), "SETTING", float(draw.choice([30, 35, 40, 40, 50])), START + timedelta(days=d), None) for p in range(products) for d in DAYS]
    return known, plans, settings


def batch_events(spark, known, plans, settings):
    """Day by day with the batch operators, the tables carried from one day to the next."""
    applied = [(*r[:4], r[5], "ACTIVE", r[6], "x", "run", n) for n, r in enumerate(known)]
    planned = [(*r[:4], r[5], "PENDING", r[6], "x", r[7]) for r in plans]
    out = []
    for d in DAYS:
        now = START + timedelta(days=d)
        seen = spark.createDataFrame([(*r[:4], r[5]) for r in settings if r[6] == now], ", ".join(f"{k} string" for k in KEYS) + ", registered_cpc double")
        past = spark.createDataFrame(applied, f"{STATE_TABLES['applied_settings']}, ord int")
        ahead = spark.createDataFrame([(*r, n) for n, r in enumerate(planned)], f"{STATE_TABLES['planned_settings']}, ord int")
        known_now = state.latest_pending(ahead.where(F.col("planned_at") <= F.lit(now)))
        events = state.setting_events(state.reconcile(seen.join(state.latest_applied(past), KEYS, "left").join(known_now, KEYS, "left"), F.lit(now).cast("timestamp"))).collect()
        out += [(r["product_id"], now, r["event_type"], r["setting_cpc"], r["prior_cpc"], r["planned_cpc"], r["planned_run_id"], r["effective_at"]) for r in events]
        status = {"PLAN_CONFIRMED": "CONFIRMED", "PLAN_NOT_APPLIED": "NOT_APPLIED", "EXTERNAL_MANUAL_CHANGE": "SUPERSEDED"}
        answer = {(r["product_id"], r["planned_run_id"]): status[r["event_type"]] for r in events if r["planned_run_id"] and r["event_type"] in status}
        planned = [(*p[:5], answer.get((p[2], p[8]), p[5]), *p[6:]) for p in planned]
        applied += [(*key(r["product_id"]), r["setting_cpc"], "ACTIVE", r["effective_at"], "x", "run", len(applied) + n) for n, r in enumerate(events) if r["event_type"] != "PLAN_NOT_APPLIED"]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def wanted(spark):
    return batch_events(spark, *history())


@pytest.mark.parametrize("cuts", [1, 4])
def test_stream_gives_the_events_of_batches_for_any_cuts(spark, tmp_path, wanted, cuts):
    """Rows in one micro-batch, or shuffled over four with some given twice, and a restart before the last."""
    known, plans, settings = history()
    rows = plans + settings
    if cuts > 1:
        random.Random(cuts).shuffle(rows)
        rows += rows[:7]
    parts = [rows[k::cuts] for k in range(cuts)]

    def put(name, part):
        spark.createDataFrame(part, ROWS).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        out = reconcile_stream(stream, Policy(change_observation_days=3), delay="30 days", known=spark.createDataFrame(known, ROWS))
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    for k, part in enumerate(parts):
        put(f"part{k}", part)
        if k in (cuts - 2, cuts - 1):
            run()
    put("clock", [("", "", "", "", "CLOCK", None, START + timedelta(days=80), None)])
    run()
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    events = [(r["product_id"], r["at"], r["event_type"], r["setting_cpc"], r["prior_cpc"], r["planned_cpc"], r["planned_run_id"], r["effective_at"]) for r in found if r["event_type"] != "OBSERVATION_ENDED"]
    assert sorted(events, key=str) == wanted
    # The end of observation: once for each bid that lasted, three days after its own time.
    ended = [r for r in found if r["event_type"] == "OBSERVATION_ENDED"]
    assert ended and all(r["at"] - r["effective_at"] == timedelta(days=3) for r in ended)
    assert len({(r["product_id"], r["at"]) for r in ended}) == len(ended)
    for r in found:
        if r["event_type"] in ("PLAN_CONFIRMED", "EXTERNAL_MANUAL_CHANGE"):
            assert r["observing"] == (r["at"] - r["effective_at"] < timedelta(days=3))


def test_absorbing_a_stream_leaves_no_intermediate_tables(spark, tmp_path, performance):  # noqa: F811
    policy = Policy()
    store = absorbed.open_store(spark, f"{tmp_path}/state")
    performance.repartition(3).write.parquet(f"{tmp_path}/in")
    files = absorbed.StateStore(spark, f"{tmp_path}/x").files
    folder = f"{shared_dir(spark)}/bidweave-{spark.sparkContext.applicationId}"
    before = files.names(folder)
    stream = spark.readStream.schema(performance.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):
        absorb_stream(stream, store, policy).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert files.names(folder) == before
    assert store.manifest()["marks"]["stream"] == 2
    whole = absorbed.entity_state(absorbed.ingest.dedupe_snapshots(performance), policy)
    columns = sorted(whole.columns)
    assert sorted(map(str, absorbed.current_windows(store).select(*columns).collect())) == sorted(map(str, whole.select(*columns).collect()))


def test_scratch_is_deleted_whatever_happens(spark):
    files = absorbed.StateStore(spark, f"{shared_dir(spark)}/x").files
    folder = f"{shared_dir(spark)}/bidweave-{spark.sparkContext.applicationId}"
    before = files.names(folder)
    with pytest.raises(ZeroDivisionError), scratch(spark):
        assert written(spark.range(3), "x").count() == 3
        with scratch(spark):
            written(spark.range(3), "y")
        1 / 0
    assert files.names(folder) == before
