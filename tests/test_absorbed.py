"""What absorbing a delivery does no more than once, or not at all."""

from pyspark.sql import functions as F

from bidweave.plans import absorbed
from bidweave.plans.bindings import POLICY
from bidweave.plans.queries import bound

SF = "/root/testdata/sf0.001"


def test_rows_given_again_write_nothing_and_new_ones_are_not_sorted(spark, tmp_path, monkeypatch):
    rows = bound(spark, SF, "performance").where("product_id IN ('S1', 'S2', 'S25')")
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    store = absorbed.open_store(spark, f"{tmp_path}/state")
    plans, plain = {}, absorbed.StateStore.transaction

    def watched(self, **given):
        tables = plain(self, **given)
        write = tables._write
        tables._write = lambda name, df: (plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()), write(name, df))[1]
        return tables

    monkeypatch.setattr(absorbed.StateStore, "transaction", watched)
    absorbed.absorb(rows.where("snapshot_id <> 'snap90'"), store, POLICY)
    # No window gives the new rows places, and no join asks a state that is empty.
    assert "Window" not in plans["snapshots"] and "Join" not in plans["snapshots"]
    absorbed.absorb(rows, store, POLICY)
    before = store.manifest()["tables"]
    absorbed.absorb(rows.where("snapshot_id = 'snap90'"), store, POLICY)
    assert store.manifest()["tables"] == before
    assert store.read("snapshots").count() == rows.count()
    whole = absorbed.entity_state(absorbed.ingest.dedupe_snapshots(rows), POLICY)
    now = absorbed.current_windows(store)
    assert sorted(map(str, now.collect())) == sorted(map(str, whole.select(*now.columns).collect()))
    sums = {r["product_id"]: r["clicks"] for r in absorbed.product_sums(store).where("entity_type = 'ITEM'").collect()}
    assert sums == {r["product_id"]: r["c"] for r in whole.where("entity_type = 'ITEM'").groupBy("product_id").agg(F.sum("clicks").alias("c")).collect()}
