"""The driver's tables as advertising data: one SQL text for each table, which Spark and DuckDB both run.

Suppliers are products and part names keywords. Sums are made of whole numbers, so that they are the same in any order.
"""

from __future__ import annotations

import re
from datetime import timedelta
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.schema import Policy

POLICY = Policy(short_window_days=90, long_window_days=365)
AS_OF = "2001-11-08 00:00:00"
DAY = "DATE '2001-11-08'"

TABLES = {
    "lines": """
        SELECT CAST(l_suppkey AS BIGINT) AS s, p_name AS k, CAST(l_shipdate AS DATE) AS d, CAST(l_quantity AS BIGINT) AS q,
               CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_returnflag AS f
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "snaps": """
        SELECT * FROM (VALUES ('snap90', 90, DATE '2001-11-05'), ('snap80', 80, DATE '2001-11-04'), ('snap365', 365, DATE '2001-11-05'), ('old100', 100, DATE '2001-10-01'))
        AS t(snapshot_id, days, ends)""",
    "sums": """
        SELECT snapshot_id, days, ends, s, CASE WHEN GROUPING(k) = 1 THEN '' ELSE k END AS keyword, GROUPING(k) AS g,
               CAST(floor(CAST(sum(q * disc) AS DOUBLE) / 5) AS DOUBLE) AS clicks, CAST(sum(CASE WHEN f = 'N' THEN 1 ELSE 0 END) AS DOUBLE) AS orders,
               CAST(sum(CASE WHEN f = 'N' THEN cents ELSE 0 END) AS DOUBLE) / 500 AS sales
        FROM lines JOIN snaps ON d > ends - days AND d <= ends
        WHERE NOT (s % 6 = 5 AND snapshot_id IN ('snap90', 'snap365'))
        GROUP BY GROUPING SETS ((snapshot_id, days, ends, s), (snapshot_id, days, ends, s, k))""",
    "performance_once": """
        SELECT 'rakuten' AS platform, CASE WHEN g = 1 THEN 'ITEM' ELSE 'KEYWORD' END AS entity_type, 'S' || CAST(s AS STRING) AS product_id, keyword,
               CAST(20 + s % 50 AS DOUBLE) AS registered_bid_report, clicks * 40 AS impressions,
               CASE WHEN s % 41 = 7 AND g = 0 THEN NULL ELSE clicks END AS clicks, CASE WHEN s % 53 = 11 THEN -1 ELSE clicks END * (25 + s % 20) AS cost,
               CAST(25 + s % 20 AS DOUBLE) AS actual_cpc, sales / 2 AS sales_short, orders AS orders_short, sales AS sales_attr, orders AS orders_attr, CAST(2 AS DOUBLE) AS ctr_pct,
               ends - days + 1 AS period_start, ends AS period_end, snapshot_id || '.csv' AS source_name, 'hash_' || snapshot_id AS source_hash, snapshot_id,
               CAST(ends + 2 AS TIMESTAMP) AS executed_at, days AS window_days,
               'rakuten|' || CASE WHEN g = 1 THEN 'ITEM' ELSE 'KEYWORD' END || '|S' || CAST(s AS STRING) || '|' || keyword AS entity_key, s AS ord
        FROM sums""",
    "performance": """
        SELECT * FROM performance_once UNION ALL
        SELECT platform, entity_type, product_id, keyword, registered_bid_report, impressions, clicks, cost, actual_cpc, sales_short, orders_short, sales_attr, orders_attr + 1, ctr_pct,
               period_start, period_end, source_name, source_hash, snapshot_id, executed_at, window_days, entity_key, ord + 1000000
        FROM performance_once WHERE ord % 25 = 0 AND snapshot_id = 'snap90'""",
    "settings": """
        SELECT '' AS control, 'S' || CAST(s_suppkey AS STRING) AS product_id, s_name AS product_name, CAST(1000 + s_suppkey AS STRING) AS price, 'https://example.com/' || CAST(s_suppkey AS STRING) AS url,
               CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE CAST(24 + s_suppkey % 77 AS STRING) || '円' END AS item_cpc, '' AS keyword, '' AS keyword_cpc, '' AS guide_cpc, CAST(s_suppkey AS BIGINT) AS ord
        FROM supplier UNION ALL
        SELECT '', 'S' || CAST(s AS STRING), 'Supplier', '1', 'https://example.com/', CAST(30 + s % 40 AS STRING), k, CASE WHEN s % 13 = 0 THEN '-' ELSE CAST(24 + (s * 7 + length(k)) % 77 AS STRING) END, '', s + 1000000
        FROM (SELECT DISTINCT s, k FROM lines WHERE (s + length(k)) % 3 = 0) AS pairs""",
    "master": f"""
        SELECT 'S' || CAST(s_suppkey AS STRING) AS product_id, s_name AS product_name, n_name AS category, r_name AS product_group,
               CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE CAST(20 + s_suppkey % 40 AS STRING) || '%' END AS gross_margin_rate, CAST(s_suppkey % 3 * 2 AS STRING) AS other_promo_cost_rate,
               '24' AS item_min_cpc, '100' AS item_max_cpc, CAST(s_suppkey % 17 AS STRING) AS stock_qty, CASE WHEN s_suppkey % 29 = 0 THEN 'discontinued' ELSE '' END AS product_status,
               CAST({DAY} - CAST(s_suppkey * 13 % 400 AS INT) AS STRING) AS launch_date, CAST(s_suppkey AS BIGINT) AS ord
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 19 <> 3""",
    "applied": f"""
        SELECT 'rakuten' AS platform, 'ITEM' AS entity_type, 'S' || CAST(s_suppkey AS STRING) AS product_id, '' AS keyword, CAST(24 + s_suppkey * 3 % 77 AS DOUBLE) AS applied_cpc,
               CAST({DAY} - CAST(s_suppkey % 20 AS INT) AS TIMESTAMP) AS effective_at, 'INITIAL_BASELINE' AS source, CAST(1 AS BIGINT) AS ord FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL
        SELECT 'rakuten', 'ITEM', 'S' || CAST(s_suppkey AS STRING), '', CAST(24 + s_suppkey % 77 AS DOUBLE), CAST(NULL AS TIMESTAMP), 'UNDATED', CAST(2 AS BIGINT) FROM supplier WHERE s_suppkey % 3 < 2""",
    "planned": f"""
        SELECT 'rakuten' AS platform, 'ITEM' AS entity_type, 'S' || CAST(s_suppkey AS STRING) AS product_id, '' AS keyword, CASE WHEN s_suppkey % 8 = 1 THEN CAST(24 + s_suppkey % 77 AS DOUBLE) ELSE CAST(90 AS DOUBLE) END AS planned_cpc,
               CASE WHEN s_suppkey % 16 = 9 THEN 'CONFIRMED' ELSE 'pending' END AS planned_status, CAST({DAY} - CAST(s_suppkey % 5 * 3 AS INT) AS TIMESTAMP) AS planned_at, 'run_0' AS run_id, CAST(1 AS BIGINT) AS ord
        FROM supplier WHERE s_suppkey % 4 = 1""",
    "history": f"""
        SELECT 'rakuten' AS platform, 'ITEM' AS entity_type, 'S' || CAST(s_suppkey AS STRING) AS product_id, '' AS keyword, {DAY} - CAST(s_suppkey % 30 AS INT) AS period_end,
               CASE WHEN s_suppkey % 6 = 0 THEN CAST(NULL AS TIMESTAMP) ELSE CAST({DAY} AS TIMESTAMP) END AS captured_at, CAST(100 + s_suppkey AS DOUBLE) AS clicks, CAST(s_suppkey % 10 AS DOUBLE) / 100 AS cvr_attr,
               CAST(s_suppkey % 9 * 400 AS DOUBLE) AS roas_attr_pct, CAST(10 + s_suppkey % 12 AS DOUBLE) AS actual_cpc, CAST(1 AS BIGINT) AS ord FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL
        SELECT 'rakuten', 'ITEM', 'S' || CAST(s_suppkey AS STRING), '', {DAY} - 12, CAST({DAY} AS TIMESTAMP), CAST(50 AS DOUBLE), CAST(1 AS DOUBLE) / 50, CAST(500 AS DOUBLE), CAST(30 AS DOUBLE), CAST(2 AS BIGINT) FROM supplier WHERE s_suppkey % 5 = 0""",
    "overrides": f"""
        SELECT 'rakuten' AS platform, 'ITEM' AS entity_type, 'S' || CAST(s_suppkey AS STRING) AS product_id, '' AS keyword,
               CASE s_suppkey % 4 WHEN 0 THEN 'LOCK_CPC' WHEN 1 THEN 'FORCE_STOP' WHEN 2 THEN 'EXCLUDE' ELSE 'BASELINE' END AS override_mode, CAST(40 + s_suppkey % 30 AS DOUBLE) AS override_cpc,
               CASE WHEN s_suppkey % 22 = 0 THEN CAST(NULL AS TIMESTAMP) ELSE CAST({DAY} - CAST(s_suppkey % 9 AS INT) AS TIMESTAMP) END AS effective_from,
               CASE WHEN s_suppkey % 33 = 0 THEN CAST({DAY} - 1 AS TIMESTAMP) ELSE CAST(NULL AS TIMESTAMP) END AS effective_until, CASE WHEN s_suppkey % 55 = 0 THEN 'no' ELSE 'Yes' END AS active, CAST(1 AS BIGINT) AS ord
        FROM supplier WHERE s_suppkey % 11 = 0""",
}
SOURCES = ["lineitem", "part", "supplier", "nation", "region"]


@cache
def ctes() -> str:
    """WITH and the tables, for an SQL text of the driver's."""
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in TABLES.items())


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables over the driver's Parquet files, of which those are opened that it reads."""
    if name == "performance":
        # What its SQL joins to the rows by a second reading of all lines: some come twice, as of a file given again. The platform comes
        # out as a column: a constant drops out of sort orders, and what groups by it would sort the rows anew.
        again = F.expr("ord % 25 = 0 AND snapshot_id = 'snap90'")
        copies = [F.struct(F.lit(n).alias("n"), "platform") for n in (0, 1)]
        once = bound(spark, sf_dir, "performance_once").withColumn("__copy", F.explode(F.when(again, F.array(*copies)).otherwise(F.array(copies[0]))))
        n = F.col("__copy.n")
        return once.withColumns({"platform": F.col("__copy.platform"), "orders_attr": F.col("orders_attr") + n, "ord": F.col("ord") + 1000000 * n}).drop("__copy")
    wanted = needed(name)
    text = "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in TABLES.items() if n in wanted)
    sources = {s: spark.read.parquet(f"{sf_dir}/{s}.parquet") for s in SOURCES if s in wanted}
    if [t for t in wanted & set(TABLES) if "lines" in _reads(t)] == ["sums"]:
        # Lines of days in no snapshot join none: they needn't reach their parts.
        spans = spark.sql(TABLES["snaps"]).collect()
        day = F.col("l_shipdate").cast("date")
        sources["lineitem"] = sources["lineitem"].where((day > min(r["ends"] - timedelta(days=r["days"]) for r in spans)) & (day <= max(r["ends"] for r in spans)))
    for s in sources:
        text = re.sub(rf"\b(FROM|JOIN) {s}\b", rf"\1 {{{s}}}", text)
    return spark.sql(f"{text}\nSELECT * FROM {name}", **sources)


@cache
def needed(name: str) -> frozenset[str]:
    """The table and those that its SQL reads, directly or not."""
    return frozenset({name}.union(*map(needed, _reads(name))))


def _reads(name: str) -> set[str]:
    return set(re.findall(r"\b(?:FROM|JOIN) (\w+)", TABLES.get(name, ""))) & (set(TABLES) | set(SOURCES))


def as_of():
    return F.lit(AS_OF).cast("timestamp")
