"""One snapshot of each entity for the short and one for the long view, in one aggregation."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidweave.functions.columns import ratio, spread_of
from bidweave.schema import KEYS, Policy

METRICS = ["impressions", "clicks", "cost", "actual_cpc", "sales_short", "orders_short", "sales_attr", "orders_attr", "ctr_pct"]
SNAPSHOT = ["snapshot_id", "source_name", "source_hash", "period_start", "period_end", "executed_at", "window_days", "registered_bid_report", *METRICS]
#: What ratios are made of.
RATED = ["clicks", "cost", "sales_attr", "orders_attr"]


def fresh(performance: DataFrame) -> DataFrame:
    """Each entity's snapshots that end within a day of its latest; all of one that has no end."""
    latest = F.max("period_end").over(Window.partitionBy(*KEYS, "entity_key"))
    return performance.withColumn("__latest", latest).where("__latest IS NULL OR datediff(__latest, period_end) <= 1").drop("__latest")


def _rank(target: int, prefer_longer: bool) -> Column:
    """Ascending: nearest to the target, then latest, then first given. A shorter one counts as five days further off for the long view."""
    away = F.coalesce(F.abs(F.col("window_days") - target).cast("double"), F.lit(100_000.0))
    if prefer_longer:
        away = away + F.when(F.col("window_days") < target, 5.0).otherwise(0.0)
    return F.struct(away, F.coalesce(-F.unix_date("period_end"), F.lit(1 << 30)), F.col("ord"))


def pick_snapshot(performance: DataFrame, target: int, prefer_longer: bool) -> DataFrame:
    best = fresh(performance).groupBy(*KEYS, "entity_key").agg(F.min_by(F.struct(*SNAPSHOT), _rank(target, prefer_longer)).alias("best"))
    return best.select(*KEYS, "entity_key", "best.*")


def analysis_windows(performance: DataFrame, policy: Policy, *more: Column, without: Collection[str] = ()) -> DataFrame:
    """A row an entity: the short snapshot's columns with `_shortwin`, the long one's with `_longwin`, and their ratios.

    more: named aggregates of all of the entity's rows, of old snapshots too, to be added. without: columns that nobody reads; what
    they alone need of the snapshots isn't picked.
    """
    keys = ["__spread", "entity_key", *KEYS]
    latest = F.max("period_end").over(Window.partitionBy(*keys))
    now = F.expr("__latest IS NULL OR datediff(__latest, period_end) <= 1")
    always = {"snapshot_id", *RATED}
    short = [c for c in SNAPSHOT if c in always or f"{c}_shortwin" not in without or c in METRICS and c not in without]
    long = [c for c in SNAPSHOT if c in always or f"{c}_longwin" not in without or c in METRICS and f"{c}_long" not in without]
    both = performance.withColumn("__spread", spread_of(performance)).withColumn("__latest", latest).groupBy(*keys).agg(
        F.min_by(F.struct(*short), F.when(now, _rank(policy.short_window_days, False))).alias("s"),
        F.min_by(F.struct(*long), F.when(now, _rank(policy.long_window_days, True))).alias("l"), *more,
    )
    added = [c for c in both.columns if c not in (*keys, "s", "l")]
    out = both.select(
        *KEYS, "entity_key", *[F.col(f"s.{c}").alias(f"{c}_shortwin") for c in short], *[F.col(f"l.{c}").alias(f"{c}_longwin") for c in long],
        (~F.col("s.snapshot_id").eqNullSafe(F.col("l.snapshot_id"))).alias("trend_available"),
        *[F.col(f"s.{c}").alias(c) for c in METRICS if c in short], *[F.col(f"l.{c}").alias(f"{c}_long") for c in METRICS if c in long], *added,
    )
    return with_ratios(with_ratios(out, ""), "_long").drop(*without)


def with_ratios(df: DataFrame, suffix: str = "") -> DataFrame:
    clicks, cost, sales, orders = (F.col(f"{c}{suffix}") for c in RATED)
    return df.withColumns({f"cvr_attr{suffix}": ratio(orders, clicks), f"roas_attr_pct{suffix}": ratio(sales, cost, 100.0), f"aov_attr{suffix}": ratio(sales, orders)})
