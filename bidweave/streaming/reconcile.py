"""Reconciliation as keyed stream state: what a key's settings show against what was planned, in the order of event time.

Each key keeps its applied bid, its open plans, and the rows that the watermark has not passed yet. A row waits for a timer at
its own time, so a key's rows are worked on in order, however micro-batches cut the stream and in whatever order they bring
them within the delay. A second kind of timer ends the days during which a changed bid is only observed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bidweave.schema import KEYS, Policy

#: What a row says: a bid that was applied before, a plan of a run, a setting that was seen, or that time has come so far.
APPLIED, PLAN, SETTING, CLOCK = "APPLIED", "PLAN", "SETTING", "CLOCK"
#: Rows of one instant: what is known of the past comes before what is seen.
RANK = {APPLIED: 0, PLAN: 1, SETTING: 2}
ROWS = ", ".join(f"{k} string" for k in KEYS) + ", kind string, cpc double, at timestamp, run_id string"
_OUT = ", ".join(f"{k} string" for k in KEYS) + ", event_type string, setting_cpc double, prior_cpc double, planned_cpc double, planned_us long, planned_run_id string, effective_us long, at_us long, observing boolean"
DAY_US, BEFORE_ALL = 86_400_000_000, -(1 << 62)
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Reconciler(StatefulProcessor):
    """Events of each key. Times are microseconds; a bid without a time is older than all others."""

    def __init__(self, observation_days: int):
        self.days = observation_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.applied = handle.getValueState("applied", "cpc double, at long, until long")
        self.plans = handle.getMapState("plans", "at long, run_id string, cpc double", "place long")
        self.waiting = handle.getMapState("waiting", "at long, rank int, cpc double, run_id string", "there boolean")

    def close(self) -> None:
        pass

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.sort_values("at_us").itertuples(index=False):
            self._known(r.kind, r.cpc, r.at_us, r.run_id)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for r in part[part["kind"].isin(RANK)].itertuples(index=False):
                # A row that is given again is the same entry.
                self.waiting.updateValue((int(r.at_us), RANK[r.kind], float(r.cpc), r.run_id or ""), (True,))
                self.handle.registerTimer(-(-int(r.at_us) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        now = timerValues.getCurrentWatermarkInMs() * 1000
        for row in sorted(k for k, _ in self.waiting.iterator() if k[0] <= now):
            out += self._ended(key, row[0])
            out += self._seen(key, *row)
            self.waiting.removeKey(row)
        out += self._ended(key, now)
        if out:
            yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in _OUT.split(", ")])

    def _state(self) -> tuple:
        """(cpc, at, until): the latest bid by its own time, and until when it is only observed; nulls where there is none."""
        return self.applied.get() if self.applied.exists() else (None, None, None)

    def _known(self, kind: str, cpc: float, at: int, run_id: str | None) -> None:
        if kind == PLAN:
            place = max([p[0] for _, p in self.plans.iterator()], default=0) + 1
            self.plans.updateValue((int(at), run_id or "", float(cpc)), (place,))
        elif kind == APPLIED:
            self._apply(float(cpc), None if pd.isna(at) or at == BEFORE_ALL else int(at), BEFORE_ALL)

    def _apply(self, cpc: float, at: int | None, now: int) -> None:
        """A bid counts from its own time: one that is older than the latest known doesn't replace it."""
        old_cpc, old_at, _ = self._state()
        if old_cpc is not None and (BEFORE_ALL if at is None else at) < (BEFORE_ALL if old_at is None else old_at):
            return
        until = None if at is None or at + self.days * DAY_US <= now else at + self.days * DAY_US
        self.applied.update((cpc, at, until))
        if until is not None:
            self.handle.registerTimer(-(-until // 1000))

    def _ended(self, key, now: int) -> list[tuple]:
        """The end of observation, if it has come by now."""
        cpc, at, until = self._state()
        if until is None or until > now:
            return []
        self.applied.update((cpc, at, None))
        return [(*key, "OBSERVATION_ENDED", None, cpc, None, None, None, at, until, False)]

    def _seen(self, key, at: int, rank: int, cpc: float, run_id: str) -> list[tuple]:
        if rank != RANK[SETTING]:
            self._known(APPLIED if rank == RANK[APPLIED] else PLAN, cpc, at, run_id)
            return []
        prior, effective, _ = self._state()
        plans = [(p[0][0], p[1][0], p[0]) for p in self.plans.iterator()]
        plan = max(plans)[2] if plans else None
        event, new = None, effective
        if plan and abs(cpc - plan[2]) < 1:
            event, new = "PLAN_CONFIRMED", at if plan[0] == BEFORE_ALL else plan[0]
        elif prior is None:
            event, new = "INITIAL_BASELINE", None
        elif abs(cpc - prior) >= 1:
            event, new = "EXTERNAL_MANUAL_CHANGE", at
        elif plan and (plan[0] == BEFORE_ALL or at - plan[0] >= DAY_US):
            event = "PLAN_NOT_APPLIED"
        if event is None:
            return []
        if plan and event != "INITIAL_BASELINE":
            # Every open plan of that run is answered.
            for p in [p for *_, p in plans if p[1] == plan[1]]:
                self.plans.removeKey(p)
        if event != "PLAN_NOT_APPLIED":
            self._apply(cpc, new, at)
        observing = new is not None and at - new < self.days * DAY_US
        return [(*key, event, cpc, prior, plan and plan[2], plan and plan[0], plan and plan[1], new, at, observing)]


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("at_us", F.coalesce(F.unix_micros("at"), F.lit(BEFORE_ALL)))


def reconcile_stream(rows: DataFrame, policy: Policy, *, delay: str = "2 days", known: DataFrame | None = None) -> DataFrame:
    """Events of a stream of settings and plans: KEYS, event_type, setting_cpc, prior_cpc, planned_cpc, planned_at, planned_run_id,
    effective_at, at and observing.

    rows: KEYS, kind (PLAN, SETTING, APPLIED or CLOCK), cpc, at and run_id. A CLOCK row only says that time has come to its `at`, for
    streams that rest. known: rows of kinds APPLIED and PLAN from before the stream; at may be null. Events are those that
    `state.reconcile` makes of every setting in turn, with each run's state before the next. OBSERVATION_ENDED says that
    the policy's days of observation are over since the bid has changed last. observing: whether the days of the event's own bid were not
    over then. Rows of an instant come as applied bids, plans, settings. Rows that are given twice count once, those without `at` or
    a bid are left out, and so are those that come later than the delay. The state of a key is its last bid and its open plans.
    """
    # Timers need this state store; the session keeps it for streams that start later.
    rows.sparkSession.conf.set(PROVIDER, ROCKS)
    fit = _timed(rows.where("at IS NOT NULL AND (cpc IS NOT NULL OR kind = 'CLOCK')")).withWatermark("at", delay)
    first = None if known is None else _timed(known.where("cpc IS NOT NULL")).groupBy(*KEYS)
    out = fit.groupBy(*KEYS).transformWithStateInPandas(Reconciler(policy.change_observation_days), _OUT, "Append", "EventTime", first)
    at = lambda c: F.when(F.col(c) > BEFORE_ALL, F.timestamp_micros(c))
    return out.select(*KEYS, "event_type", "setting_cpc", "prior_cpc", "planned_cpc", at("planned_us").alias("planned_at"), "planned_run_id", at("effective_us").alias("effective_at"), at("at_us").alias("at"), "observing")
