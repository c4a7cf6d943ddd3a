"""Reports, settings and product master in their own layouts to canonical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidweave.functions.columns import clean_number, clean_text, entity_key, or_default, period_from_text, rate, spread_of, window_days

#: The columns of the two marketplace reports, by their canonical names.
REPORT_COLUMNS = {
    "product_id": "商品管理番号",
    "keyword": "キーワード",
    "impressions": "表示回数",
    "clicks": "クリック数(合計)",
    "cost": "実績額(合計)",
    "actual_cpc": "CPC実績(合計)",
    "sales_short": "売上金額(合計12時間)",
    "orders_short": "売上件数(合計12時間)",
    "sales_attr": "売上金額(合計720時間)",
    "orders_attr": "売上件数(合計720時間)",
    "ctr_pct": "CTR(%)",
}
ITEM_BID, KEYWORD_BID, PERIOD = "入札単価", "キーワードCPC", "日付"
NUMBERS = ["impressions", "clicks", "cost", "actual_cpc", "sales_short", "orders_short", "sales_attr", "orders_attr", "ctr_pct"]


def column_or(df: DataFrame, name: str, default: Column) -> Column:
    """The column, or the default if the table has none of that name."""
    return F.col(f"`{name}`") if name in df.columns else default


def normalise_report(raw: DataFrame, kind: str, *, platform: str = "rakuten") -> DataFrame:
    """One file's rows as performance. raw: text columns and the file's source_name, source_hash, executed_at, file_start,
    file_end and ord. Kinds: normalized_performance, rakuten_rpp_item_report and rakuten_rpp_keyword_report."""
    empty = F.lit("")
    if kind == "normalized_performance":
        text = {
            "platform": F.lower(clean_text(column_or(raw, "platform", F.lit(platform)))), "entity_type": F.upper(clean_text(column_or(raw, "entity_type", F.lit("ITEM")))),
            "product_id": clean_text(column_or(raw, "product_id", empty)), "keyword": clean_text(column_or(raw, "keyword", empty)),
        }
        numbers = {n: clean_number(column_or(raw, n, empty)) for n in NUMBERS}
        bid = clean_number(column_or(raw, "registered_bid", empty))
        start, end = (clean_text(column_or(raw, f"period_{x}", F.col(f"file_{x}").cast("string"))).try_cast("date") for x in ("start", "end"))
    elif kind in ("rakuten_rpp_item_report", "rakuten_rpp_keyword_report"):
        keyword = kind == "rakuten_rpp_keyword_report"
        text = {
            "platform": F.lit("rakuten"), "entity_type": F.lit("KEYWORD" if keyword else "ITEM"),
            "product_id": clean_text(column_or(raw, REPORT_COLUMNS["product_id"], empty)), "keyword": clean_text(column_or(raw, REPORT_COLUMNS["keyword"], empty)) if keyword else empty,
        }
        numbers = {n: clean_number(column_or(raw, REPORT_COLUMNS[n], empty)) for n in NUMBERS}
        bid = clean_number(column_or(raw, KEYWORD_BID if keyword else ITEM_BID, empty))
        first, last = period_from_text(column_or(raw, PERIOD, empty))
        start, end = F.coalesce(first, F.col("file_start")), F.coalesce(last, F.col("file_end"))
    else:
        raise ValueError(f"no layout of a performance report: {kind}")
    return (
        raw.select(*[c.alias(n) for n, c in text.items()], bid.alias("registered_bid_report"), *[c.alias(n) for n, c in numbers.items()], start.alias("period_start"), end.alias("period_end"), "source_name", "source_hash", F.substring("source_hash", 1, 16).alias("snapshot_id"), "executed_at", "ord")
        .withColumn("window_days", window_days(F.col("period_start"), F.col("period_end")))
        .withColumn("entity_key", entity_key())
    )


def dedupe_snapshots(performance: DataFrame) -> DataFrame:
    """The last row of each entity in each snapshot: a file given twice counts once."""
    order = Window.partitionBy(spread_of(performance), "entity_key", "snapshot_id").orderBy(F.col("ord").desc())
    return performance.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def item_settings(raw: DataFrame) -> DataFrame:
    """One row a product: its first with a bid, or its first. raw: product_id, item_cpc, keyword, keyword_cpc as text and ord."""
    rows = raw.select(clean_text(F.col("product_id")).alias("product_id"), clean_number(F.col("item_cpc")).alias("cpc"), "ord").where("product_id <> ''")
    # Numbers are picked by numbers, so that Spark adds them up by hash and needn't sort the rows. A row without a bid isn't in the running.
    best = rows.groupBy("product_id").agg(F.min_by("cpc", F.when(F.col("cpc").isNotNull(), F.col("ord"))).alias("best"))
    return best.select(F.lit("rakuten").alias("platform"), F.lit("ITEM").alias("entity_type"), "product_id", F.lit("").alias("keyword"), F.col("best").alias("registered_cpc"))


def keyword_settings(raw: DataFrame) -> DataFrame:
    """One row a product and keyword: the last."""
    rows = raw.select(clean_text(F.col("product_id")).alias("product_id"), clean_text(F.col("keyword")).alias("keyword"), clean_number(F.col("keyword_cpc")).alias("cpc"), "ord").where("product_id <> '' AND keyword <> ''")
    last = rows.groupBy("product_id", "keyword").agg(F.max_by("cpc", "ord").alias("last"))
    return last.select(F.lit("rakuten").alias("platform"), F.lit("KEYWORD").alias("entity_type"), "product_id", "keyword", F.col("last").alias("registered_cpc"))


def setting_table(raw: DataFrame) -> DataFrame:
    return item_settings(raw).unionByName(keyword_settings(raw)).withColumn("setting_row_exists", F.lit(True))


def normalise_master(raw: DataFrame, *, platform: str = "rakuten") -> DataFrame:
    """One row a platform and product, the last; rates of more than 1 are percentages. raw has ord."""
    empty, none = F.lit(""), F.lit(None).cast("string")
    out = raw.select(
        F.lower(or_default(column_or(raw, "platform", empty), platform)).alias("platform"),
        clean_text(column_or(raw, "product_id", empty)).alias("product_id"),
        clean_text(column_or(raw, "common_product_id", empty)).alias("common_product_id"),
        clean_text(column_or(raw, "product_name", empty)).alias("product_name"),
        or_default(column_or(raw, "category", empty), "UNKNOWN").alias("category"),
        or_default(column_or(raw, "product_group", empty), "UNKNOWN").alias("product_group"),
        rate(clean_number(column_or(raw, "gross_margin_rate", none))).alias("gross_margin_rate"),
        rate(clean_number(column_or(raw, "other_promo_cost_rate", F.lit("0")))).alias("other_promo_cost_rate"),
        *[clean_number(column_or(raw, c, none)).alias(c) for c in ("item_min_cpc", "item_max_cpc", "stock_qty")],
        F.upper(or_default(column_or(raw, "product_status", empty), "ACTIVE")).alias("product_status"),
        column_or(raw, "launch_date", none).cast("string").try_cast("date").alias("launch_date"),
        F.upper(or_default(column_or(raw, "role", empty), "PROFIT")).alias("role"),
        "ord",
    )
    values = [c for c in out.columns if c not in ("platform", "product_id", "ord")]
    last = out.groupBy("platform", "product_id").agg(F.max_by(F.struct(*values), "ord").alias("last"))
    return last.select("platform", "product_id", *[F.col(f"last.{c}").alias(c) for c in values])


def with_master(entities: DataFrame, master: DataFrame) -> DataFrame:
    """entities with their product's master row, or defaults where there is none."""
    out = entities.join(master, ["platform", "product_id"], "left")
    defaults = {"category": "UNKNOWN", "product_group": "UNKNOWN", "product_status": "ACTIVE", "role": "PROFIT"}
    out = out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()} | {"other_promo_cost_rate": F.coalesce("other_promo_cost_rate", F.lit(0.0))})
    return out.withColumn("common_product_id", F.coalesce("common_product_id", "product_id"))
