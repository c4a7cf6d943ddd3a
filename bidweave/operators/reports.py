"""Figures over decisions: totals, shares, roll-ups, rank correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidweave.session import written


def or_zero(num: Column, den: Column, factor: float = 1.0) -> Column:
    return F.when(den != 0, num / den * factor).otherwise(0.0)


def kpis(rows: DataFrame, entity_type: str = "ITEM") -> DataFrame:
    """Totals and ratios of totals, of one grain; of all rows if there is none of it."""
    mine = F.col("entity_type") == entity_type
    sums = ["clicks", "cost", "sales_attr", "orders_attr"]
    out = rows.agg(F.count_if(mine).alias("n"), *[F.coalesce(F.sum(F.when(mine, F.col(c))), F.lit(0.0)).alias(f"m_{c}") for c in sums], *[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"a_{c}") for c in sums])
    out = out.select(*[F.when(F.col("n") > 0, F.col(f"m_{c}")).otherwise(F.col(f"a_{c}")).alias(c) for c in sums])
    return out.withColumns({"roas_attr_pct": or_zero(F.col("sales_attr"), F.col("cost"), 100.0), "cvr_attr": or_zero(F.col("orders_attr"), F.col("clicks")), "actual_cpc": or_zero(F.col("cost"), F.col("clicks"))})


def with_total(df: DataFrame, value: Column, name: str = "__total") -> DataFrame:
    """df with the sum over all rows in each: an aggregate of one row joined back, so that no task sees all rows."""
    return df.crossJoin(df.agg(F.sum(value).alias(name)))


def status_counts(decided: DataFrame) -> DataFrame:
    out = with_total(decided.groupBy("decision_status").agg(F.count("*").alias("n")), F.col("n"))
    return out.select("decision_status", "n", (F.col("n") * 100.0 / F.col("__total")).alias("share_pct"))


def category_rollup(items: DataFrame, metric: str = "sales_attr") -> DataFrame:
    """Value and value-weighted return by category and product, by category, and of all."""
    weighted = F.try_divide(F.sum(F.col(metric) * F.coalesce("roas_attr_pct", F.lit(0.0))), F.sum(metric))
    out = items.where(F.col("entity_type") == "ITEM").rollup("category", "product_id").agg(F.coalesce(F.sum(metric), F.lit(0.0)).alias("value"), F.coalesce(weighted, F.lit(0.0)).alias("roas_attr_pct"), F.grouping_id().alias("level"))
    return out.select(F.coalesce("category", F.lit("")).alias("category"), F.coalesce("product_id", F.lit("")).alias("product_id"), "value", "roas_attr_pct", "level")


def run_profile(finalised: DataFrame) -> DataFrame:
    """One row of counts. Rows are counted by product or keyword first, so that no row is moved once for each distinct count."""
    flags = {"approved": F.col("final_approved"), "changed": F.col("final_changed"), "eligible": F.col("upload_eligible"), "unmatched": F.col("final_changed") & ~F.col("upload_match")}
    kind = F.col("entity_type")
    name = F.when(kind == "ITEM", F.col("product_id")).when(kind == "KEYWORD", F.col("keyword"))
    groups = finalised.groupBy(kind.alias("kind"), name.alias("name")).agg(F.count("*").alias("rows"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    named = F.col("name").isNotNull()
    return groups.agg(
        F.count_if((F.col("kind") == "ITEM") & named).alias("products"), F.count_if((F.col("kind") == "KEYWORD") & named).alias("keywords"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("rows", *flags)],
    )


#: Into how many ranges the values of a metric are dealt for ranking.
RANGES = 128


def average_ranks(counts: DataFrame, keys: list[str], value: str, ranges: int = RANGES) -> DataFrame:
    """(keys, value, rank) of counts (keys, value, n), the average rank of n equal values.

    Values are dealt out by ranges, which are ranked by themselves and moved up by what lies in the ranges below.
    """
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, F.array(*[F.lit(i / ranges) for i in range(1, ranges)])).alias("__cuts"))
    # A row a pair of metrics.
    dealt = counts.join(F.broadcast(cuts), keys).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    below = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, "__range").agg(F.sum("n").alias("__held")).select(*keys, "__range", F.coalesce(F.sum("__held").over(below), F.lit(0)).alias("__before"))
    upto = F.sum("n").over(Window.partitionBy(*keys, "__range").orderBy(value))
    # At most a row a range.
    return dealt.withColumn("__upto", upto).join(F.broadcast(starts), [*keys, "__range"]).select(*keys, value, (F.col("__before") + F.col("__upto") - (F.col("n") - 1) / 2).alias("rank"))


def spearman(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """(left, right, rho) for every two metrics, by average ranks over the rows that have both; 0 where it is undefined.

    Each two metrics are ranked once. Equal pairs of values are counted first, so that a common value is one row.
    """
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i:]]
    x, y = F.col("x"), F.col("y")
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs])).alias("p")).select("p.*")
    counts = written(long.where(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)).groupBy("left", "right", "x", "y").agg(F.count("*").alias("n")), "value_pairs")
    ranked = counts
    for c in ("x", "y"):
        of_value = average_ranks(counts.groupBy("left", "right", c).agg(F.sum("n").alias("n")), ["left", "right"], c)
        ranked = ranked.join(of_value.withColumnRenamed("rank", f"r{c}"), ["left", "right", c])
    # Ranks around their mean, which is (rows + 1) / 2.
    sizes = counts.groupBy("left", "right").agg(((F.sum("n") + 1) / 2).alias("mean"))
    n, rx, ry = F.col("n"), F.col("rx") - F.col("mean"), F.col("ry") - F.col("mean")
    rho = F.try_divide(F.sum(n * rx * ry), F.sqrt(F.sum(n * rx * rx)) * F.sqrt(F.sum(n * ry * ry)))
    half = ranked.join(F.broadcast(sizes), ["left", "right"]).groupBy("left", "right").agg(F.coalesce(rho, F.lit(0.0)).alias("rho"))
    both = F.array(F.struct("left", "right"), F.struct(F.col("right").alias("left"), F.col("left").alias("right")))
    return half.select(F.explode(F.array_distinct(both)).alias("p"), "rho").select("p.left", "p.right", "rho")


def top_products(items: DataFrame, n: int = 10) -> DataFrame:
    """Products by return on ad spend, with their share of all sales."""
    mine = with_total(items.where("entity_type = 'ITEM' AND cost > 0").select("product_id", "clicks", "cost", "sales_attr", "roas_attr_pct"), F.col("sales_attr"))
    out = mine.withColumn("sales_share_pct", F.col("sales_attr") * 100.0 / F.col("__total")).drop("__total")
    return out.orderBy(F.desc_nulls_last("roas_attr_pct"), "product_id").limit(n)


def roas_band(roas: Column, target: float) -> Column:
    r = roas / target
    return F.when(roas.isNull(), "NONE").when(r < 0.55, "LOW").when(r < 0.9, "BELOW").when(r < 1.2, "NEAR").otherwise("ABOVE")
