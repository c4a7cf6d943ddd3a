"""Reports that arrive as a stream, absorbed micro-batch by micro-batch, and decided on all that has come so far."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from bidweave.plans.absorbed import absorb, compact, with_tables
from bidweave.plans.runner import answered, build_from_state, carry
from bidweave.schema import Policy
from bidweave.session import scratch, written
from bidweave.sources.state_store import StateStore


def once_each(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """The stream without rows of an entity and snapshot that were seen within the delay."""
    return stream.withWatermark("executed_at", delay).dropDuplicatesWithinWatermark(["snapshot_id", "entity_key"])


def absorb_stream(stream: DataFrame, store: StateStore, policy: Policy, *, name: str = "stream") -> DataStreamWriter:
    """A writer that absorbs each micro-batch once, under its number; a micro-batch that is run again changes nothing."""

    store = with_tables(store)

    def take(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            absorb(batch, store, policy, mark=(name, number))
            compact(store)

    return stream.writeStream.foreachBatch(take)


def decide_stream(stream: DataFrame, settings: Callable[[], DataFrame], master: Callable[[], DataFrame], store: StateStore, policy: Policy, clock: Callable[[], datetime], out: str, *, name: str = "stream") -> DataStreamWriter:
    """A writer that absorbs each micro-batch, decides on all that was absorbed so far, writes the decisions under `out` and carries
    the state on.

    settings and master are read anew for each micro-batch. A micro-batch that is run again is not absorbed again;
    its run has the same id and its input counts as a duplicate if its state was carried, so nothing is approved twice.
    """

    store = with_tables(store)

    def decide(batch: DataFrame, number: int) -> None:
        if batch.limit(1).count() == 0:
            return
        with scratch(batch.sparkSession):
            absorb(batch, store, policy, mark=(name, number))
            run = build_from_state(store, settings(), master(), policy, clock())
            final = written(answered(run), "final")
            final.select(*[c for c, t in final.dtypes if not t.startswith(("array", "struct", "map"))]).write.mode("overwrite").parquet(f"{out}/batch={number}")
            carry(run, final, store, policy)
            compact(store)

    return stream.writeStream.foreachBatch(decide)
