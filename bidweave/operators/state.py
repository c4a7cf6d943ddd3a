"""State between runs: what was planned, what a later settings file shows, and what one run leaves to the next."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.functions.columns import days_between, latest_by, truthy
from bidweave.schema import KEYS, Policy


def latest_applied(applied: DataFrame) -> DataFrame:
    """The last applied bid of each key; undated ones lose. applied has ord."""
    out = latest_by(applied, KEYS, ["effective_at", "ord"], ["applied_cpc", "effective_at", "source"])
    return out.withColumnsRenamed({"applied_cpc": "state_applied_cpc", "effective_at": "state_effective_at", "source": "state_source"})


def latest_pending(planned: DataFrame) -> DataFrame:
    """The last pending plan of each key; undated ones lose."""
    out = latest_by(planned, KEYS, ["planned_at", "ord"], ["planned_cpc", "planned_at", "run_id"], where=F.upper("planned_status") == "PENDING")
    return out.withColumnRenamed("run_id", "planned_run_id")


def latest_metrics(history: DataFrame) -> DataFrame:
    """The last metrics of each key by period end and capture; undated ones win."""
    values = ["clicks", "cvr_attr", "roas_attr_pct", "actual_cpc"]
    dated = history.withColumns({"__no_end": F.col("period_end").isNull(), "__no_capture": F.col("captured_at").isNull()})
    last = latest_by(dated, KEYS, ["__no_end", "period_end", "__no_capture", "captured_at", "ord"], values)
    return last.withColumnsRenamed({v: f"prev_{v}" for v in values})


def active_overrides(overrides: DataFrame, as_of: Column) -> DataFrame:
    """The last override of each key that is active and whose interval holds as_of; undated ones win."""
    now = truthy(F.col("active")) & F.coalesce(F.col("effective_from") <= as_of, F.lit(True)) & F.coalesce(F.col("effective_until") >= as_of, F.lit(True))
    dated = overrides.where(now).withColumn("__no_start", F.col("effective_from").isNull())
    last = latest_by(dated, KEYS, ["__no_start", "effective_from", "ord"], ["override_mode", "override_cpc"])
    return last.withColumn("override_mode", F.upper("override_mode"))


def reconcile(entities: DataFrame, as_of: Column) -> DataFrame:
    """entities with event_type and the state that it makes: PLAN_CONFIRMED, INITIAL_BASELINE, EXTERNAL_MANUAL_CHANGE or
    PLAN_NOT_APPLIED, by registered_cpc against the plan and the prior state; null where nothing has happened."""
    setting, prior, plan = F.col("registered_cpc"), F.col("state_applied_cpc"), F.col("planned_cpc")
    age = F.coalesce(days_between(as_of, F.col("planned_at")), F.lit(999.0))
    event = (
        F.when(setting.isNull(), None)
        .when(F.abs(setting - plan) < 1, "PLAN_CONFIRMED")
        .when(prior.isNull(), "INITIAL_BASELINE")
        .when(F.abs(setting - prior) >= 1, "EXTERNAL_MANUAL_CHANGE")
        .when((F.abs(setting - plan) >= 1) & (age >= 1), "PLAN_NOT_APPLIED")
    )
    out = entities.withColumns({"event_type": event, "prior_cpc": prior})
    now = F.col("event_type")
    new = now.isin("PLAN_CONFIRMED", "INITIAL_BASELINE", "EXTERNAL_MANUAL_CHANGE")
    at = F.when(now == "PLAN_CONFIRMED", F.coalesce("planned_at", as_of)).when(now == "EXTERNAL_MANUAL_CHANGE", as_of)
    return out.withColumns({
        "state_applied_cpc": F.when(new, setting).otherwise(prior), "state_effective_at": F.when(new, at).otherwise(F.col("state_effective_at")),
        "state_source": F.when(now == "INITIAL_BASELINE", "INITIAL_SETTING").when(new, now).otherwise(F.col("state_source")),
    })


def setting_events(reconciled: DataFrame) -> DataFrame:
    return reconciled.where("event_type IS NOT NULL").select(*KEYS, "event_type", F.col("registered_cpc").alias("setting_cpc"), "prior_cpc", "planned_cpc", "planned_at", "planned_run_id", F.col("state_effective_at").alias("effective_at"))


def input_hash(performance: DataFrame) -> DataFrame:
    """One row: the SHA-256 of the sorted distinct file hashes joined by `|`; of the empty text without files."""
    return performance.agg(F.sha2(F.array_join(F.sort_array(F.collect_set("source_hash")), "|"), 256).alias("input_hash"))


def policy_hash(policy: Policy) -> str:
    return hashlib.sha256(json.dumps(policy.to_dict(), sort_keys=True).encode()).hexdigest()


def run_id(hash_of_input: str, policy: Policy, as_of: datetime) -> str:
    """Depends on input, policy and as_of alone, so that a rerun keeps its id."""
    return f"run_{as_of:%Y%m%dT%H%M%SZ}_{hash_of_input[:8]}_{policy_hash(policy)[:6]}"


def update_plans(planned: DataFrame, events: DataFrame) -> DataFrame:
    """Plans with the status that the events of their run and key give them."""
    status = F.when(F.col("event_type") == "PLAN_CONFIRMED", "CONFIRMED").when(F.col("event_type") == "PLAN_NOT_APPLIED", "NOT_APPLIED").when(F.col("event_type") == "EXTERNAL_MANUAL_CHANGE", "SUPERSEDED")
    news = events.where("planned_run_id IS NOT NULL").select(*KEYS, F.col("planned_run_id").alias("run_id"), status.alias("__status")).where("__status IS NOT NULL")
    return planned.join(news, [*KEYS, "run_id"], "left").withColumn("planned_status", F.coalesce("__status", "planned_status")).drop("__status").select(*planned.columns)


def update_actions(actions: DataFrame, events: DataFrame) -> DataFrame:
    """Actions whose plan was confirmed have been applied, and their outcome is pending."""
    news = events.where("event_type = 'PLAN_CONFIRMED'").select(*KEYS, F.col("planned_run_id").alias("run_id"), F.col("effective_at").alias("__at"), F.lit(True).alias("__hit"))
    out = actions.join(news, [*KEYS, "run_id"], "left")
    return out.withColumns({"applied_at": F.coalesce("__at", "applied_at"), "outcome_status": F.when(F.col("__hit"), "PENDING").otherwise(F.col("outcome_status"))}).select(*actions.columns)


def new_state(finalised: DataFrame, events: DataFrame, gate: DataFrame, policy: Policy, *, run: str, hash_of_input: str, as_of: datetime, duplicate: bool = False) -> dict[str, DataFrame]:
    """The rows that a run appends to each state table."""
    now, rid = F.lit(as_of).cast("timestamp"), F.lit(run)
    applied = events.where("event_type <> 'PLAN_NOT_APPLIED'").select(*KEYS, F.col("setting_cpc").alias("applied_cpc"), F.lit("ACTIVE").alias("applied_status"), "effective_at", F.col("event_type").alias("source"), rid.alias("run_id"))
    planned = finalised.where("upload_eligible").select(*KEYS, F.col("final_cpc").cast("double").alias("planned_cpc"), F.lit("PENDING").alias("planned_status"), now.alias("planned_at"), F.col("operator_action").alias("source"), rid.alias("run_id"))
    period = [F.col("period_start_shortwin").alias("period_start"), F.col("period_end_shortwin").alias("period_end")]
    metrics = finalised.select(rid.alias("run_id"), *KEYS, *period, "clicks", "cost", "sales_attr", "orders_attr", "actual_cpc", "cvr_attr", "roas_attr_pct", F.col("current_bid").alias("registered_cpc"), now.alias("captured_at"))
    due = (as_of + timedelta(days=policy.change_observation_days)).date()
    actions = finalised.select(
        rid.alias("run_id"), *KEYS, *period, F.col("current_bid").alias("previous_cpc"), "recommended_cpc", F.col("operator_cpc").cast("double").alias("operator_cpc"), "final_cpc", "action", "decision_status", "operator_action", "operator_reason",
        F.lit(None).cast("timestamp").alias("applied_at"), F.lit(due).alias("outcome_due_date"), F.when(F.col("upload_eligible"), "PLANNED").otherwise("NOT_APPLIED").alias("outcome_status"),
    )
    overrides = finalised.where("operator_action IN ('LOCK', 'FORCE_STOP')").select(
        F.concat_ws("_", rid, F.sha2(F.concat_ws("|", *KEYS), 256)).alias("override_id"), *KEYS, F.when(F.col("operator_action") == "LOCK", "LOCK_CPC").otherwise("FORCE_STOP").alias("override_mode"), F.col("final_cpc").cast("double").alias("override_cpc"),
        now.alias("effective_from"), F.lit(None).cast("timestamp").alias("effective_until"), F.lit(True).alias("active"), F.col("operator_reason").alias("reason"), rid.alias("created_run_id"),
    )
    counts = finalised.agg(F.count_if(F.col("entity_type") == "ITEM").alias("item_rows"), F.count_if(F.col("entity_type") == "KEYWORD").alias("keyword_rows"))
    # Both are aggregates of one row.
    runs = gate.select("status", "score").crossJoin(counts).select(rid.alias("run_id"), now.alias("created_at"), F.lit(hash_of_input).alias("input_hash"), F.lit(policy_hash(policy)).alias("policy_hash"), F.col("status").alias("quality_status"), F.col("score").alias("quality_score"), "item_rows", "keyword_rows", F.lit(duplicate).alias("duplicate_input"))
    return {"applied_settings": applied, "planned_settings": planned, "manual_overrides": overrides, "action_history": actions, "metric_history": metrics, "run_history": runs}
