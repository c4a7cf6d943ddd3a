"""Queries over what lives longer than a run: keyed stream state, the atomic store and incremental state. Their SQL is beside them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.functions.columns import truthy
from bidweave.operators import decide, ingest, search, state
from bidweave.plans import absorbed, current
from bidweave.plans.bindings import AS_OF, DAY, POLICY, as_of, bound, ctes
from bidweave.plans.oracles import ORACLES as BATCH
from bidweave.plans.oracles import chained
from bidweave.plans.queries import joined_entities, master, r6
from bidweave.schema import KEYS
from bidweave.session import shared_dir, written
from bidweave.sources.state_store import ConcurrentCommit, StateStore
from bidweave.streaming import reconcile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


#: Settings of every product as seen on four days, and the open plans.
OBSERVED = f"""
  SELECT 'S' || CAST(s_suppkey AS STRING) AS product_id, 'SETTING' AS kind,
         CAST(CASE WHEN n = 0 AND s_suppkey % 4 = 1 THEN 24 + s_suppkey % 77 ELSE 24 + (s_suppkey * 3 + CASE WHEN s_suppkey % 5 = n THEN 7 ELSE 0 END) % 77 END AS DOUBLE) AS cpc,
         CAST({DAY} - n * 4 AS TIMESTAMP) AS at_time, CAST(NULL AS STRING) AS run_id, n AS part
  FROM supplier JOIN (VALUES (0), (1), (2), (3)) AS steps(n) ON n * 10 < s_suppkey
  UNION ALL
  SELECT product_id, 'PLAN', planned_cpc, planned_at, run_id, 4 FROM planned WHERE upper(planned_status) = 'PENDING'"""

#: The walk takes a key's rows one by one; `until` is when the observation of its last bid ends.
_EVENTS = ctes().replace("WITH ", "WITH RECURSIVE ", 1) + f""",
observed AS ({OBSERVED}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY at_time, kind, cpc) AS n FROM observed),
walk AS (
  SELECT product_id, CAST(0 AS BIGINT) AS n, b.cpc, b.at_time AS bid_at, CAST(NULL AS DOUBLE) AS plan, CAST(NULL AS TIMESTAMP) AS plan_at, CAST(NULL AS VARCHAR) AS plan_run,
         CAST(NULL AS VARCHAR) AS event, CAST(NULL AS DOUBLE) AS setting, CAST(NULL AS DOUBLE) AS prior, CAST(NULL AS DOUBLE) AS planned, CAST(NULL AS TIMESTAMP) AS planned_at, CAST(NULL AS VARCHAR) AS planned_run,
         CAST(NULL AS TIMESTAMP) AS effective, CAST(NULL AS TIMESTAMP) AS at_time, b.cpc IS NOT NULL AS changed
  FROM (SELECT product_id FROM observed UNION SELECT product_id FROM applied) LEFT JOIN (SELECT product_id, arg_max(applied_cpc, (coalesce(effective_at, TIMESTAMP '1900-01-01'), ord)) AS cpc, max(effective_at) AS at_time FROM applied GROUP BY product_id) AS b USING (product_id)
  UNION ALL
  SELECT product_id, n, CASE WHEN newer THEN setting ELSE cpc END, CASE WHEN newer THEN effective ELSE bid_at END,
         CASE WHEN kind = 'PLAN' THEN row_cpc WHEN event IS NULL OR event = 'INITIAL_BASELINE' THEN plan END, CASE WHEN kind = 'PLAN' THEN row_at WHEN event IS NULL OR event = 'INITIAL_BASELINE' THEN plan_at END,
         CASE WHEN kind = 'PLAN' THEN run_id WHEN event IS NULL OR event = 'INITIAL_BASELINE' THEN plan_run END, event, setting, cpc, plan, plan_at, plan_run, effective, row_at, newer
  FROM (
    SELECT *, coalesce(event IN ('PLAN_CONFIRMED', 'INITIAL_BASELINE', 'EXTERNAL_MANUAL_CHANGE') AND (cpc IS NULL OR coalesce(effective, TIMESTAMP '1900-01-01') >= coalesce(bid_at, TIMESTAMP '1900-01-01')), false) AS newer
    FROM (
      SELECT *, CASE event WHEN 'PLAN_CONFIRMED' THEN plan_at WHEN 'EXTERNAL_MANUAL_CHANGE' THEN row_at WHEN 'PLAN_NOT_APPLIED' THEN bid_at END AS effective
      FROM (
        SELECT w.product_id, r.n, w.cpc, w.bid_at, w.plan, w.plan_at, w.plan_run, r.kind, r.cpc AS row_cpc, r.at_time AS row_at, r.run_id, CASE WHEN r.kind = 'SETTING' THEN r.cpc END AS setting,
               CASE WHEN r.kind = 'PLAN' THEN NULL WHEN abs(r.cpc - w.plan) < 1 THEN 'PLAN_CONFIRMED' WHEN w.cpc IS NULL THEN 'INITIAL_BASELINE' WHEN abs(r.cpc - w.cpc) >= 1 THEN 'EXTERNAL_MANUAL_CHANGE'
                    WHEN w.plan IS NOT NULL AND r.at_time - w.plan_at >= INTERVAL 1 DAY THEN 'PLAN_NOT_APPLIED' END AS event
        FROM walk AS w JOIN numbered AS r ON r.product_id = w.product_id AND r.n = w.n + 1))
  )
),
bids AS (SELECT product_id, cpc, bid_at, at_time, bid_at + INTERVAL 7 DAY AS until, lead(at_time) OVER (PARTITION BY product_id ORDER BY n) AS next_at FROM walk WHERE changed)
SELECT product_id, event AS event_type, setting AS setting_cpc, prior AS prior_cpc, planned AS planned_cpc, planned_run AS planned_run_id, CAST(effective AS VARCHAR) AS effective_at, CAST(at_time AS VARCHAR) AS at_time,
       coalesce(at_time - effective < INTERVAL 7 DAY, false) AS observing
FROM walk WHERE event IS NOT NULL
UNION ALL
SELECT product_id, 'OBSERVATION_ENDED', NULL, cpc, NULL, NULL, CAST(bid_at AS VARCHAR), CAST(until AS VARCHAR), false FROM bids
WHERE bid_at IS NOT NULL AND (at_time IS NULL OR until > at_time) AND (next_at IS NULL OR until <= next_at)"""


@query(_EVENTS.replace("AS STRING", "AS VARCHAR"))
def setting_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events of a stream of settings and plans that comes in several micro-batches, is stopped, and goes on from its checkpoint."""
    path = f"{shared_dir(spark)}/observed-{uuid.uuid4().hex}"
    sources = {s: spark.read.parquet(f"{d}/{s}.parquet") for s in ("supplier",)}
    planned = bound(spark, d, "planned")
    rows = spark.sql(OBSERVED.replace("FROM supplier", "FROM {supplier}").replace("FROM planned", "FROM {planned}"), planned=planned, **sources)
    rows = rows.select(F.lit("rakuten").alias("platform"), F.lit("ITEM").alias("entity_type"), "product_id", F.lit("").alias("keyword"), "kind", "cpc", F.col("at_time").alias("at"), "run_id", "part")
    rows.repartition(3, "part").write.parquet(f"{path}/in/rows")
    known = bound(spark, d, "applied").select(*KEYS, F.lit(reconcile.APPLIED).alias("kind"), F.col("applied_cpc").alias("cpc"), F.col("effective_at").alias("at"), F.lit(None).cast("string").alias("run_id"))

    def run() -> None:
        stream = spark.readStream.schema(reconcile.ROWS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
        events = reconcile.reconcile_stream(stream, replace(POLICY, change_observation_days=7), delay="60 days", known=known)
        events.writeStream.format("parquet").option("path", f"{path}/events").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    run()
    # The stream goes on, and the clock says that all that was due has come.
    spark.range(1).select(*[F.lit("").alias(k) for k in KEYS], F.lit(reconcile.CLOCK).alias("kind"), F.lit(None).cast("double").alias("cpc"), F.lit("2002-03-01").cast("timestamp").alias("at"), F.lit(None).cast("string").alias("run_id")).write.parquet(f"{path}/in/clock")
    run()
    out = spark.read.parquet(f"{path}/events")
    return out.select("product_id", "event_type", "setting_cpc", "prior_cpc", "planned_cpc", "planned_run_id", F.col("effective_at").cast("string").alias("effective_at"), F.col("at").cast("string").alias("at_time"), "observing")


def _absorbed(spark: SparkSession, d: str) -> StateStore:
    """Performance as three deliveries, not in the order of their time, one of them twice."""
    store = absorbed.open_store(spark, f"{shared_dir(spark)}/absorbed-{uuid.uuid4().hex}")
    rows = written(bound(spark, d, "performance"), "performance")
    part = F.pmod(F.hash("product_id", "snapshot_id"), F.lit(3))
    for number, k in enumerate((2, 0, 1, 0)):
        absorbed.absorb(rows.where(part == k), store, POLICY, mark=("deliveries", number))
    return store


@query(BATCH["analysis_windows"])
def incremental_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of all entities after the deliveries: the same as over all rows at once."""
    return absorbed.current_windows(_absorbed(spark, d)).select("entity_key", "snapshot_id_shortwin", "snapshot_id_longwin", "trend_available", "clicks", "clicks_long", "sales_attr", "sales_attr_long")


def _from_state(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Entities from the state that has absorbed the deliveries, and products' sums with their groups."""
    store = _absorbed(spark, d)
    rows = absorbed.current_windows(store).withColumn("row_quality_block", F.col("row_errors") > 0).drop("rows", "row_errors")
    products = ingest.with_master(absorbed.product_sums(store).drop("rows", "row_errors"), master(spark, d))
    return joined_entities(spark, d, rows), products


@query(BATCH["group_priors"])
def incremental_priors(spark: SparkSession, d: str) -> DataFrame:
    """Priors of groups from the products' sums."""
    return decide.group_priors(*_from_state(spark, d)).select("entity_key", *r6("prior_cvr", "prior_aov"))


@query(BATCH["parent_child_hierarchy"])
def incremental_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions from the state: the same as over all rows at once."""
    rows, products = _from_state(spark, d)
    out = decide.with_hierarchy(decide.decisions(written(rows, "entities"), POLICY, as_of(), products))
    return out.select("entity_key", "action", "decision_status", "reason_code", "recommended_cpc", "auto_approved_default", *r6("delta_cpc", "delta_pct"))


@query(ctes() + f"""
SELECT {', '.join(KEYS)}, planned_cpc, CASE WHEN upper(planned_status) = 'PENDING' AND planned_cpc >= 90 THEN 'CONFIRMED' ELSE planned_status END AS planned_status, run_id FROM planned
UNION ALL SELECT {', '.join(KEYS)}, planned_cpc + 1, 'PENDING', 'run_1' FROM planned WHERE planned_cpc < 90""")
def atomic_runs(spark: SparkSession, d: str) -> DataFrame:
    """Plans after two runs: the second's writer dies before its manifest, another writer commits from the same state, and the rerun of
    the first is turned away by it once."""
    store = StateStore(spark, f"{shared_dir(spark)}/state-{uuid.uuid4().hex}")
    plans = written(bound(spark, d, "planned").drop("ord").withColumn("source", F.lit("x")), "plans")
    store.append("planned_settings", plans)
    events = plans.where("planned_cpc >= 90").select(*KEYS, F.lit("PLAN_CONFIRMED").alias("event_type"), F.col("run_id").alias("planned_run_id"))
    new = plans.where("planned_cpc < 90").withColumns({"planned_cpc": F.col("planned_cpc") + 1, "planned_status": F.lit("PENDING"), "run_id": F.lit("run_1")})

    def changed(base: int):
        return store.transaction(base=base).update("planned_settings", lambda rows: state.update_plans(rows, events)).append("planned_settings", new)

    changed(store.number())  # dies: its folders are there, and no manifest names them
    late = changed(store.number())
    store.append("run_history", spark.createDataFrame([], store.read("run_history").drop("ord").schema))
    try:
        late.commit()
    except ConcurrentCommit:
        changed(store.number()).commit()
    return store.read("planned_settings").select(*KEYS, "planned_cpc", "planned_status", "run_id")


@query(chained(f"""
SELECT i.product_id, state_applied_cpc, CAST(state_effective_at AS VARCHAR) AS state_effective_at, state_source, planned_cpc, planned_run_id, prev_clicks, prev_cvr_attr, override_mode, override_cpc
FROM (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS product_id FROM supplier) AS i LEFT JOIN o_applied USING (product_id) LEFT JOIN (SELECT * FROM o_planned WHERE planned_cpc < 90) USING (product_id)
LEFT JOIN o_hist USING (product_id) LEFT JOIN o_over USING (product_id)"""))
def current_state(spark: SparkSession, d: str) -> DataFrame:
    """Every product with its state, from tables in buckets that two runs have merged; the second closes plans of the first."""
    store, now = StateStore(spark, f"{shared_dir(spark)}/current-{uuid.uuid4().hex}"), datetime.fromisoformat(AS_OF)
    given = {name: written(bound(spark, d, source), source) for name, source in (("applied_settings", "applied"), ("planned_settings", "planned"), ("metric_history", "history"), ("manual_overrides", "overrides"))}
    given["manual_overrides"] = given["manual_overrides"].withColumn("active", truthy(F.col("active")))
    closed = given["planned_settings"].where("planned_cpc >= 90").select(*KEYS, F.lit("PLAN_CONFIRMED").alias("event_type"), F.col("run_id").alias("planned_run_id"))
    for n in (1, 2):
        tables, events = store.transaction(), closed if n == 2 else closed.limit(0)
        tables.update("planned_settings", lambda rows, events=events: state.update_plans(rows, events))
        for name, rows in given.items():
            fields = [f.split(" ") for f in store.schemas[name].split(", ")]
            tables.append(name, rows.where(F.col("ord") == n).select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in fields]))
        current.merge(tables, events, now).commit()
    out = spark.read.parquet(f"{d}/supplier.parquet").select(F.lit("rakuten").alias("platform"), F.lit("ITEM").alias("entity_type"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("product_id"), F.lit("").alias("keyword"))
    for t in current.joined(store, store.number(), now):
        out = out.join(t, KEYS, "left")
    return out.select("product_id", "state_applied_cpc", F.col("state_effective_at").cast("string").alias("state_effective_at"), "state_source", "planned_cpc", "planned_run_id", "prev_clicks", "prev_cvr_attr", "override_mode", "override_cpc")


@query("""
SELECT needle, p_partkey FROM part JOIN (SELECT DISTINCT substr(p_name, 3, 6) AS needle FROM part WHERE p_partkey % 50 = 0 AND length(p_name) >= 5) ON contains(lower(p_name), lower(needle))""")
def substring_search(spark: SparkSession, d: str) -> DataFrame:
    """The keywords that hold a piece of one of the others, by a stored index of trigrams that came in two parts."""
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    path = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    for part in (0, 1):
        search.save(search.postings(rows.where(F.col("id") % 2 == part)), path)
    needles = rows.where("id % 50 = 0 AND length(text) >= 5").select(F.substring("text", 3, 6).alias("needle"))
    return search.matches(spark.read.parquet(path), rows, needles).select("needle", F.col("id").alias("p_partkey"))
