"""The state as the next run joins it: small tables in buckets of the keys, merged by each run from the rows that it adds.

Histories grow with every run, and a run needs the last of each key alone. The tables here hold that, all in the same number of
buckets, so that joins and picks of the latest by key move no row of them. A merge reads a table's buckets where they lie and
sends the new rows there. A table remembers which folders of its history it was made from: where they aren't those of the
manifest any more (rows that came by another way, or an as_of before the last merge's), the history itself is read, and the next
merge makes the table anew. Rows with a null in their key join with nothing and are left out.
"""

from __future__ import annotations

import hashlib
import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidweave.functions.columns import truthy
from bidweave.operators import state
from bidweave.schema import KEYS
from bidweave.sources.state_store import StateStore, Transaction

HISTORY = {"current_applied": "applied_settings", "current_planned": "planned_settings", "current_metrics": "metric_history", "current_overrides": "manual_overrides"}
#: Rows a bucket is made for. The number of buckets is doubled until they fit, and again when there are four times as many.
BUCKET_ROWS = 1_000_000
PLACE = {
    "current_applied": ["effective_at", "ord"],
    "current_metrics": ["__no_end", "period_end", "__no_capture", "captured_at", "ord"],
}


def _folders(tables: dict, name: str) -> str:
    """A digest of what a history consists of."""
    return hashlib.sha256(json.dumps(sorted(f["path"] for f in tables.get(HISTORY[name], {}).get("folders", []))).encode()).hexdigest()


def is_current(manifest: dict, name: str, as_of: datetime) -> bool:
    """Whether the table has all of its history, and nothing was left out of it that still counts at as_of."""
    table, merged = manifest["tables"].get(name), manifest["marks"].get("merged_at")
    return table is not None and table.get("of") == _folders(manifest["tables"], name) and (name != "current_overrides" or merged <= as_of.isoformat())


def joined(store: StateStore, base: int, as_of: datetime) -> list[DataFrame]:
    """The state's tables that entities are joined with by KEYS, one row a key: applied bids, pending plans, metrics and overrides."""
    manifest, now = store.manifest(base), F.lit(as_of).cast("timestamp")

    def rows(name: str) -> DataFrame:
        if is_current(manifest, name, as_of):
            return store.read(name, at=base)
        return store.read(HISTORY[name], at=base, part="open" if name == "current_planned" else None)

    return [state.latest_applied(rows("current_applied")), state.latest_pending(rows("current_planned")), state.latest_metrics(rows("current_metrics")), state.active_overrides(rows("current_overrides"), now)]


def merge(tables: Transaction, events: DataFrame, as_of: datetime, *, least_buckets: int | None = None) -> Transaction:
    """Brings the tables up to what the transaction has appended, and to the plans that its events close. Part of its commit.

    events: setting events with planned_run_id; none of its columns may be null for a plan that is to be closed. least_buckets:
    the session's shuffle partitions by default, as Spark would move fewer buckets than those.
    """
    start = tables.store.manifest(tables.base)
    known = {name: is_current(start, name, as_of) for name in HISTORY}
    columns = {name: [*tables.store.columns(name), "ord"] for name in HISTORY}
    least = least_buckets or int(tables.store.spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, grown = _buckets(tables, start, known, least)
    # One number for all tables: where it changes, every bucket is divided anew.
    alike = {name: known[name] and not grown for name in HISTORY}
    for name, history in HISTORY.items():
        if not known[name]:
            # Once, and where the history has changed by another way.
            new = tables.rows(history, "open" if name == "current_planned" else None)
        else:
            new = tables.added(history)
        new = _keyed(new.select(*columns[name]))
        old = tables.rows(name) if known[name] else None
        if old is not None and not alike[name]:
            old = old.repartition(buckets, *KEYS)
        if name in PLACE:
            out = _last(old, new, name)
        elif name == "current_planned":
            out = _open(old, new, events if known[name] else None, buckets)
        else:
            out = _counting(old, new, F.lit(as_of).cast("timestamp"), buckets)
        if old is None:
            out = out.repartition(buckets, *KEYS)
        tables.put_bucketed(name, out, buckets, _folders(tables.tables, name))
    return tables.mark("merged_at", max(as_of.isoformat(), start["marks"].get("merged_at", ""))).mark("buckets", buckets)


def _buckets(tables: Transaction, start: dict, known: dict[str, bool], least: int) -> tuple[int, bool]:
    """How many buckets, and whether that is another number than before."""
    before = start["marks"].get("buckets", 0)
    rows = max(sum(f["rows"] for f in (start if known[name] else {"tables": tables.tables})["tables"].get(name if known[name] else history, {}).get("folders", [])) for name, history in HISTORY.items())
    if before >= least and rows <= 4 * BUCKET_ROWS * before:
        return before, False
    n = 1
    while n < least or n * BUCKET_ROWS < rows:
        n *= 2
    return n, n != before


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.where(" AND ".join(f"{k} IS NOT NULL" for k in KEYS))


def _placed(rows: DataFrame, name: str) -> DataFrame:
    """KEYS and `last`: a row's place and then its values, as a struct that compares by place."""
    if name == "current_metrics":
        rows = rows.withColumns({"__no_end": F.col("period_end").isNull(), "__no_capture": F.col("captured_at").isNull()})
    values = [c for c in rows.columns if c not in (*KEYS, *PLACE[name])]
    return rows.select(*KEYS, F.struct(*PLACE[name], *values).alias("last"))


def _last(old: DataFrame | None, new: DataFrame, name: str) -> DataFrame:
    """The last row of each key. New rows are reduced to one a key and task before they move."""
    late = _placed(new, name).groupBy(*KEYS).agg(F.max("last").alias("last"))
    if old is not None:
        late = _placed(old, name).withColumnRenamed("last", "__old").join(late.withColumnRenamed("last", "__new"), KEYS, "full").select(*KEYS, F.greatest("__old", "__new").alias("last"))
    return late.select(*KEYS, "last.*")


def _open(old: DataFrame | None, new: DataFrame, events: DataFrame | None, buckets: int) -> DataFrame:
    """Plans that can still change: without those that events close, with the new ones."""
    new = new.where("upper(planned_status) = 'PENDING'")
    if old is None:
        return new
    status = F.col("event_type").isin("PLAN_CONFIRMED", "PLAN_NOT_APPLIED", "EXTERNAL_MANUAL_CHANGE")
    closed = _keyed(events).where(status & F.col("planned_run_id").isNotNull()).groupBy(*KEYS).agg(F.collect_set("planned_run_id").alias("__closed"))
    there = old.join(closed, KEYS, "left").where(~F.coalesce(F.array_contains("__closed", F.col("run_id")), F.lit(False))).drop("__closed")
    return there.select(*new.columns).unionByName(new.repartition(buckets, *KEYS))


def _order() -> Column:
    """Overrides compare by this: undated ones last, so they win, then by start and arrival."""
    return F.struct(F.col("effective_from").isNull(), F.col("effective_from"), F.col("ord"))


def _strong(now: Column) -> Column:
    """In effect without an end: what comes before it will never count again."""
    return truthy(F.col("active")) & F.coalesce(F.col("effective_from") <= now, F.lit(True)) & F.col("effective_until").isNull()


def _pruned(rows: DataFrame, now: Column) -> DataFrame:
    """Overrides that count at `now` or may later: active, not over, and none that is in effect without an end comes after them."""
    after = Window.partitionBy(*KEYS).orderBy(F.col("effective_from").desc_nulls_first(), F.col("ord").desc()).rowsBetween(Window.unboundedPreceding, -1)
    live = rows.where(truthy(F.col("active")) & F.coalesce(F.col("effective_until") >= now, F.lit(True)))
    return live.withColumn("__ruled", F.coalesce(F.max(_strong(now)).over(after), F.lit(False))).where("NOT __ruled").drop("__ruled")


def _counting(old: DataFrame | None, new: DataFrame, now: Column, buckets: int) -> DataFrame:
    new = _pruned(new, now)
    if old is None:
        return new
    ruling = new.where(_strong(now)).groupBy(*KEYS).agg(F.max(_order()).alias("__ruling"))
    there = _pruned(old, now).join(ruling, KEYS, "left").where(F.col("__ruling").isNull() | (_order() > F.col("__ruling"))).drop("__ruling")
    return there.select(*new.columns).unionByName(new.repartition(buckets, *KEYS))
