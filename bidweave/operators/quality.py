"""The gate in front of decisions: errors of rows, and a verdict on the run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidweave.functions.columns import spread_of
from bidweave.schema import Policy


def error_codes() -> Column:
    """A row's error codes joined by `|`, which leaves nulls out; empty without errors."""
    codes = [F.when(F.trim("product_id") == "", F.lit("MISSING_PRODUCT_ID"))]
    for c in ("clicks", "cost", "sales_attr", "orders_attr"):
        codes.append(F.when(F.col(c).isNull(), F.lit(f"MISSING_{c.upper()}")).when(F.col(c) < 0, F.lit(f"NEGATIVE_{c.upper()}")))
    codes.append(F.when(F.col("period_start").isNull() | F.col("period_end").isNull(), F.lit("MISSING_PERIOD")))
    return F.array_join(F.array(*codes), "|")


def with_blocks(performance: DataFrame) -> DataFrame:
    """Rows with row_quality_block: whether any row of their entity has an error."""
    bad = F.max(error_codes() != "").over(Window.partitionBy(spread_of(performance), "entity_key"))
    return performance.withColumn("row_quality_block", bad & F.col("entity_key").isNotNull())


def row_errors(performance: DataFrame) -> DataFrame:
    """Rows with errors, and their codes."""
    return performance.withColumn("errors", error_codes()).where("errors <> ''")


def run_gate(performance: DataFrame, policy: Policy, previous: DataFrame | None = None, duplicates: DataFrame | None = None) -> DataFrame:
    """One row: status, score, rows, row_error_count, row_error_rate, duplicate_rows, row_count_drop.

    previous: rows of the run before by entity_type (entity_type, rows). duplicates: the rows before deduplication, of which
    those that share snapshot and entity are counted.
    """
    return gate_of(performance.groupBy("entity_type").agg(F.count("*").alias("rows"), F.count_if(error_codes() != "").alias("row_errors")), policy, previous, duplicates)


def gate_of(by_type: DataFrame, policy: Policy, previous: DataFrame | None = None, duplicates: DataFrame | None = None) -> DataFrame:
    """`run_gate` from counts by entity_type: rows and row_errors."""
    spark = by_type.sparkSession
    counts = by_type.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("row_errors"), F.lit(0)).alias("row_error_count"))
    if duplicates is None:
        twice = spark.range(1).select(F.lit(0).cast("long").alias("duplicate_rows"))
    else:
        twice = duplicates.groupBy("snapshot_id", "entity_key").agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"))
    if previous is None:
        drop = spark.range(1).select(F.lit(False).alias("row_count_drop"))
    else:
        now = by_type.groupBy("entity_type").agg(F.sum("rows").alias("n")).join(previous.withColumnRenamed("rows", "before"), "entity_type")
        drop = now.agg(F.coalesce(F.max((F.col("before") > 0) & (F.col("n") < F.col("before") * (1 - policy.row_count_drop_block_rate))), F.lit(False)).alias("row_count_drop"))
    # Each of the three is an aggregate of one row.
    out = counts.crossJoin(twice).crossJoin(drop).withColumn("row_error_rate", F.col("row_error_count") / F.greatest("rows", F.lit(1)))
    score = 100 - F.col("row_error_rate") * 100 - F.when(F.col("row_count_drop"), 20.0).otherwise(0.0) - F.least(F.lit(10.0), F.col("duplicate_rows") * 0.1)
    blocked = (F.col("rows") == 0) | (F.col("row_error_rate") > policy.data_missing_block_rate) | F.col("row_count_drop")
    warned = (F.col("row_error_count") > 0) | (F.col("duplicate_rows") > 0)
    return out.select(
        F.when(blocked, "BLOCK").when(warned, "WARN").otherwise("PASS").alias("status"),
        F.when(F.col("rows") == 0, 0.0).otherwise(F.round(F.greatest(score, F.lit(0.0)), 1)).alias("score"),
        "rows", "row_error_count", "row_error_rate", "duplicate_rows", "row_count_drop",
    )
