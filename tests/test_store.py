"""Atomic runs: writers that die at any step, writers that meet, and folders that nothing names."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bidweave.operators import state
from bidweave.plans import absorbed, runner
from bidweave.schema import KEYS, STATE_TABLES, Policy
from bidweave.sources import state_store
from bidweave.sources.state_store import ConcurrentCommit, StateStore

KEY = ("rakuten", "ITEM")


def plans(spark, *rows):
    return spark.createDataFrame([(*KEY, p, "", cpc, status, datetime(2026, 7, 1), "x", run) for p, cpc, status, run in rows], STATE_TABLES["planned_settings"])


def runs(spark, name):
    return spark.createDataFrame([(name, datetime(2026, 7, 1), "h", "p", "PASS", 100.0, 1, 1, False)], STATE_TABLES["run_history"])


def events(spark, *rows):
    return spark.createDataFrame([(*KEY, p, "", e, run) for p, e, run in rows], ", ".join(f"{k} string" for k in KEYS) + ", event_type string, planned_run_id string")


def seen(store):
    return sorted((r["product_id"], r["planned_cpc"], r["planned_status"], r["run_id"]) for r in store.read("planned_settings").collect()), sorted(r["run_id"] for r in store.read("run_history").collect())


class Died(RuntimeError):
    pass


def the_run(spark, store, base):
    tables = store.transaction(base=base)
    tables.update("planned_settings", lambda rows: state.update_plans(rows, events(spark, ("A", "PLAN_CONFIRMED", "run_0"))))
    tables.append("planned_settings", plans(spark, ("C", 3.0, "PENDING", "run_1"))).append("run_history", runs(spark, "run_1"))
    return tables.mark("run", "run_1")


def test_a_run_that_dies_at_any_step_leaves_the_state_before_or_after(spark, tmp_path, monkeypatch):
    """Steps: each table's write, what comes before the manifest's name is given, and what comes after."""
    write, publish = state_store.Transaction._write, state_store._Files.publish
    for step in range(5):
        store = StateStore(spark, f"{tmp_path}/state{step}")
        store.append("planned_settings", plans(spark, ("A", 1.0, "PENDING", "run_0"), ("B", 2.0, "CONFIRMED", "run_0")))
        before = seen(store)
        after = ([("A", 1.0, "CONFIRMED", "run_0"), ("B", 2.0, "CONFIRMED", "run_0"), ("C", 3.0, "PENDING", "run_1")], ["run_1"])
        calls = []

        def dying_write(self, *a):
            calls.append(1)
            out = write(self, *a)
            if len(calls) == step + 1:
                raise Died
            return out

        def dying_publish(self, *a):
            if step == 3:
                raise Died
            out = publish(self, *a)
            if step == 4:
                raise Died
            return out

        monkeypatch.setattr(state_store.Transaction, "_write", dying_write)
        monkeypatch.setattr(state_store._Files, "publish", dying_publish)
        with pytest.raises(Died):
            the_run(spark, store, store.number()).commit()
        monkeypatch.undo()
        assert seen(store) == (after if step == 4 else before)
        # The rerun appends once, whether the first had been seen through or not.
        if not runner.carried(store, "run_1"):
            the_run(spark, store, store.number()).commit()
        assert seen(store) == after and runner.carried(store, "run_1")
        assert store.vacuum(keep=1, seconds=0) > 0
        assert seen(store) == after


def test_of_two_writers_one_commits(spark, tmp_path):
    store = StateStore(spark, f"{tmp_path}/state")
    a, b = store.transaction(), store.transaction()
    a.append("run_history", runs(spark, "a"))
    b.append("run_history", runs(spark, "b"))
    assert b.commit() == 1
    with pytest.raises(ConcurrentCommit):
        a.commit()
    assert seen(store)[1] == ["b"]
    store.transaction().append("run_history", runs(spark, "a")).commit()
    assert seen(store)[1] == ["a", "b"]


def test_readers_keep_their_manifest_and_closed_rows_are_not_written_anew(spark, tmp_path):
    store = StateStore(spark, f"{tmp_path}/state")
    store.append("planned_settings", plans(spark, ("A", 1.0, "PENDING", "run_0"), ("B", 2.0, "NOT_APPLIED", "run_0")))
    old = store.read("planned_settings")
    closed = [f["path"] for f in store.manifest()["tables"]["planned_settings"]["folders"] if not f["open"]]
    store.transaction().update("planned_settings", lambda rows: state.update_plans(rows, events(spark, ("A", "EXTERNAL_MANUAL_CHANGE", "run_0"), ("B", "PLAN_CONFIRMED", "run_0")))).commit()
    assert sorted(r["planned_status"] for r in old.collect()) == ["NOT_APPLIED", "PENDING"]
    table = store.manifest()["tables"]["planned_settings"]
    assert {f["path"] for f in table["folders"]} > set(closed) and not any(f["open"] for f in table["folders"])
    # A plan that was closed before stays as it is.
    assert seen(store)[0] == [("A", 1.0, "SUPERSEDED", "run_0"), ("B", 2.0, "NOT_APPLIED", "run_0")]
    assert store.read("planned_settings", part="open").count() == 0 and store.read("planned_settings", at=1, part="open").count() == 1
    assert store.version("planned_settings") == 1


def test_order_of_arrival_goes_on_and_compaction_keeps_it(spark, tmp_path, monkeypatch):
    store = StateStore(spark, f"{tmp_path}/state")
    for k in range(4):
        store.append("planned_settings", plans(spark, ("A", float(k), "PENDING", f"run_{k}"), ("B", float(k), "CONFIRMED", f"run_{k}")))
    rows = sorted(tuple(r) for r in store.read("planned_settings").collect())
    assert [r[-1] for r in rows if r[2] == "A"] == [1, 2, 3, 4]
    assert not store.compact("planned_settings")
    monkeypatch.setattr(state_store, "MOST_FOLDERS", 2)
    assert store.compact("planned_settings")
    assert sorted(tuple(r) for r in store.read("planned_settings").collect()) == rows
    assert len(store.manifest()["tables"]["planned_settings"]["folders"]) == 2
    store.append("planned_settings", plans(spark, ("A", 9.0, "PENDING", "run_9")))
    assert store.read("planned_settings").where("planned_cpc = 9").first()["ord"] == 5


def test_vacuum_leaves_what_is_young_or_named(spark, tmp_path):
    store = StateStore(spark, f"{tmp_path}/state")
    store.append("run_history", runs(spark, "a"))
    store.transaction().append("run_history", runs(spark, "lost"))
    assert store.vacuum() == 0
    assert store.vacuum(seconds=0) == 1
    assert seen(store)[1] == ["a"] and store.vacuum(seconds=0) == 0


PERFORMANCE = "platform string, entity_type string, product_id string, keyword string, clicks double, orders_attr double, sales_attr double, cost double, period_start date, period_end date, snapshot_id string, source_hash string, window_days int, ord long"


def reports(spark):
    """Rows of several snapshots of products and keywords: given twice, with errors, without a period, and in no order."""
    rows = []
    for n, (snapshot, start, end) in enumerate([("s7", "2026-07-01", "2026-07-07"), ("s7b", "2026-07-02", "2026-07-08"), ("s28", "2026-06-11", "2026-07-08"), ("old", "2026-05-01", "2026-05-07"), ("none", None, None)]):
        for p in range(6):
            for k in ("", "bed", "sofa"):
                if (p + n + len(k)) % 4 == 0:
                    continue
                clicks = None if (p, n) == (5, 1) else float(10 + p * 7 + n * 3 + len(k))
                rows.append(("rakuten", "KEYWORD" if k else "ITEM", f"P{p}", k, clicks, float(p % 3), 1000.0 * p, float(-1 if (p, n, k) == (4, 2, "bed") else 300 + p), start, end, snapshot, f"h{snapshot}", 7 if n < 2 else 28, n * 100 + p))
    rows += [(*r[:4], 99.0, *r[5:13], r[13] + 5000) for r in rows[::7]]
    out = spark.createDataFrame([(*r[:8], *(datetime.fromisoformat(x).date() if x else None for x in r[8:10]), *r[10:]) for r in rows], PERFORMANCE)
    out = out.withColumn("entity_key", F.concat_ws("|", *KEYS))
    types = dict(f.split(" ") for f in absorbed.PERFORMANCE.split(", "))
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()])


@pytest.fixture(scope="module")
def performance(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows"))
    reports(spark).write.parquet(f"{path}/p")
    return spark.read.parquet(f"{path}/p")


def inputs(spark):
    settings = spark.createDataFrame([("", f"P{p}", "n", "1", "u", str(30 + p), k, "31" if k else "", "", p) for p in range(6) for k in ("", "bed")], "control string, product_id string, product_name string, price string, url string, item_cpc string, keyword string, keyword_cpc string, guide_cpc string, ord long")
    master = spark.createDataFrame([(f"P{p}", f"C{p % 2}", "40", p) for p in range(5)], "product_id string, category string, gross_margin_rate string, ord long")
    return settings, master


def decided(run):
    return sorted((tuple(sorted(r.asDict().items(), key=lambda x: x[0])) for r in run.decisions.collect()), key=str), run.gate.collect(), run.run_id, run.duplicate


def figures(store):
    """What decisions are made from: windows, and sums of products."""
    rows = [r for table in (absorbed.current_windows(store), absorbed.product_sums(store)) for r in table.select(*sorted(table.columns)).collect()]
    return sorted(str(r) for r in rows if r.asDict().get("rows"))


def test_absorbed_in_any_parts_decides_as_one_batch(spark, tmp_path, performance, monkeypatch):
    """Rows are dealt to parts without regard to snapshots or entities, so windows and sums change back and forth."""
    policy, as_of, (settings, master) = Policy(), datetime(2026, 7, 10), inputs(spark)
    store = absorbed.open_store(spark, f"{tmp_path}/state")
    for k in range(3):
        absorbed.absorb(performance.where(F.pmod(F.hash("ord", "product_id"), F.lit(3)) == k), store, policy, mark=("parts", k))
    one = runner.build(absorbed.ingest.dedupe_snapshots(performance), settings, master, StateStore(spark, f"{tmp_path}/none"), policy, as_of)
    assert decided(one) == decided(runner.build_from_state(store, settings, master, policy, as_of))
    number, before = store.number(), figures(store)
    assert absorbed.absorb(performance, store, policy, mark=("parts", 2)) == number == store.number()
    # Given again under a new mark, nothing changes.
    kept = store.read("snapshots").count()
    absorbed.absorb(performance.where("product_id = 'P1'"), store, policy, mark=("parts", 3))
    assert figures(store) == before and store.number() == number + 1 and store.read("snapshots").count() == kept == performance.count()
    monkeypatch.setattr(state_store, "MOST_FOLDERS", 1)
    absorbed.compact(store)
    assert all(len(t["folders"]) == 1 for t in store.manifest()["tables"].values())
    assert store.read("entity_windows").count() == absorbed.current_windows(store).count() and figures(store) == before
    absorbed.absorb(performance.where("product_id = 'P3'"), store, policy)
    assert figures(store) == before


def test_a_run_is_carried_once_and_not_from_an_older_state(spark, tmp_path, performance):
    policy, as_of, (settings, master) = Policy(), datetime(2026, 7, 10), inputs(spark)
    store = absorbed.open_store(spark, f"{tmp_path}/state")
    absorbed.absorb(performance, store, policy)
    run = runner.build_from_state(store, settings, master, policy, as_of)
    absorbed.absorb(performance.where("product_id = 'P2'"), store, policy)
    with pytest.raises(ConcurrentCommit):
        runner.carry(run, runner.answered(run), store, policy)
    assert store.read("run_history").count() == 0
    run = runner.build_from_state(store, settings, master, policy, as_of)
    assert runner.carry(run, runner.answered(run), store, policy)
    assert not runner.carry(run, runner.answered(run), store, policy)
    assert store.read("run_history").count() == 1 and store.read("metric_history").count() == run.decisions.count()
    assert runner.build_from_state(store, settings, master, policy, datetime(2026, 7, 11)).duplicate
