"""The operators as queries over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidweave.functions import columns as c
from bidweave.operators import decide, graph, ingest, quality, reports, state, text, windows
from bidweave.plans.bindings import AS_OF, POLICY, as_of, bound
from bidweave.schema import KEYS
from bidweave.session import shared_dir, written
from bidweave.sources import files
from bidweave.sources.state_store import StateStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def performance(spark: SparkSession, d: str) -> DataFrame:
    return ingest.dedupe_snapshots(bound(spark, d, "performance"))


def by_entity(spark: SparkSession, d: str) -> DataFrame:
    """Performance with an entity's rows in one task: its snapshots are told apart, judged and picked without another shuffle, by sorts of which one serves two steps."""
    return ingest.dedupe_snapshots(bound(spark, d, "performance").repartition("entity_key").withColumn("__spread", c.spread("entity_key")))


def setting_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of settings, written once for all that read them: behind them lie all order lines and their parts."""
    return written(bound(spark, d, "settings"), "settings")


def settings(spark: SparkSession, d: str, *given: DataFrame) -> DataFrame:
    """Both kinds of settings. given: the rows, where they have been written already."""
    return ingest.setting_table(given[0] if given else setting_rows(spark, d))


def master(spark: SparkSession, d: str) -> DataFrame:
    return ingest.normalise_master(bound(spark, d, "master"))


def entities(spark: SparkSession, d: str, *given: DataFrame) -> DataFrame:
    """Windows with settings, state, plans, master, history, overrides and the quality flag, made once and written. given: see `settings`."""
    rows = quality.with_blocks(by_entity(spark, d))
    return entities_of(spark, d, windows.analysis_windows(rows, POLICY, F.max("row_quality_block").alias("row_quality_block"), without=UNREAD), *given)


def entities_of(spark: SparkSession, d: str, out: DataFrame, *given: DataFrame) -> DataFrame:
    """out: windows with row_quality_block. The entities are written."""
    return written(joined_entities(spark, d, out, *given), "entities")


#: Of the picked snapshots, what neither joins nor decisions read: it isn't picked, moved and written with each entity.
UNREAD = [
    *[f"{n}_longwin" for n in windows.SNAPSHOT], *[f"{n}_shortwin" for n in windows.SNAPSHOT if n not in ("registered_bid_report", "period_start", "period_end", "executed_at")],
    "impressions", "sales_short", "orders_short", "ctr_pct", *[f"{n}_long" for n in windows.METRICS], "roas_attr_pct_long", "aov_attr_long",
]


def joined_entities(spark: SparkSession, d: str, out: DataFrame, *given: DataFrame) -> DataFrame:
    out = out.drop(*UNREAD)
    tables = [settings(spark, d, *given), state.latest_applied(bound(spark, d, "applied")), state.latest_pending(bound(spark, d, "planned")), state.latest_metrics(bound(spark, d, "history")), state.active_overrides(bound(spark, d, "overrides"), as_of())]
    out = out.withColumn("__spread", c.spread(*KEYS))
    for t in tables:
        out = out.join(t.withColumn("__spread", c.spread(*KEYS)), ["__spread", *KEYS], "left")
    out = ingest.with_master(out.drop("__spread"), master(spark, d)).withColumn("row_quality_block", F.coalesce("row_quality_block", F.lit(False)))
    return state.reconcile(out, as_of())


def first_decisions(spark: SparkSession, d: str, *given: DataFrame) -> DataFrame:
    return decide.decisions(entities(spark, d, *given), POLICY, as_of())


def decided(spark: SparkSession, d: str, *given: DataFrame) -> DataFrame:
    """Decisions after the parent's word, from written entities. Queries that read them once take what they need of them; others write that."""
    return decide.with_hierarchy(first_decisions(spark, d, *given))


def answered(rows: DataFrame) -> DataFrame:
    """Decisions answered: some proposals to scale up are accepted, some rows locked, stopped or rejected."""
    n = F.length("entity_key") + F.coalesce("clicks", F.lit(0.0)).cast("long")
    answer = F.when((F.col("action") == "SCALE_UP") & (n % 2 == 0), "ACCEPT").when(n % 23 == 0, "LOCK").when(n % 29 == 0, "force_stop").when(n % 31 == 0, "REJECT").otherwise(F.col("operator_action"))
    return decide.finalise(rows.withColumn("operator_action", answer))


#: What graphs show of decisions.
SHOWN = ["entity_type", "product_id", "keyword", "product_name", "category", "product_group", "decision_status", "action", "clicks", "cost", "sales_attr", "orders_attr", "roas_attr_pct", "current_bid", "recommended_cpc", "expected_incremental_profit"]


def shown(spark: SparkSession, d: str) -> DataFrame:
    """Decisions as graphs read them, written: they are read more than once, and most columns not at all."""
    return written(decided(spark, d).select(*SHOWN), "shown")


def finalised(spark: SparkSession, d: str, *given: DataFrame) -> DataFrame:
    return answered(decided(spark, d, *given))


@query
def kpi_summary(spark, d):
    return reports.kpis(windows.analysis_windows(performance(spark, d), POLICY)).select(*r6("clicks", "cost", "sales_attr", "orders_attr", "roas_attr_pct", "cvr_attr", "actual_cpc"))


@query
def top_products_by_roas(spark, d):
    return reports.top_products(windows.analysis_windows(performance(spark, d), POLICY)).select("product_id", *r6("clicks", "cost", "sales_attr", "roas_attr_pct", "sales_share_pct"))


@query
def ratio_metrics(spark, d):
    return windows.analysis_windows(performance(spark, d), POLICY).select("entity_key", *r6("cvr_attr", "roas_attr_pct", "aov_attr", "cvr_attr_long", "roas_attr_pct_long", "aov_attr_long"))


@query
def clean_numeric(spark, d):
    raw = bound(spark, d, "settings")
    return raw.select("product_id", "keyword", "ord", c.clean_number(F.col("item_cpc")).alias("item_cpc"), c.clean_number(F.col("keyword_cpc")).alias("keyword_cpc"), c.clean_number(F.concat(F.lit(" 1,"), "price", F.lit("%"))).alias("price"))


@query
def clean_text(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet")
    messy = F.concat(F.lit("　 "), F.col("p_name"), F.lit("　x　"))
    return parts.select("p_partkey", c.clean_text(messy).alias("cleaned"), F.upper(c.or_default(F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(F.col("p_type")), "none")).alias("kind"), c.short_label(F.col("p_name"), 6).alias("label"))


@query
def entity_keys(spark, d):
    return performance(spark, d).select("snapshot_id", "ord", c.entity_key().alias("entity_key"), F.substring(F.sha2("source_hash", 256), 1, 16).alias("digest"))


@query
def date_periods(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    day = F.col("o_orderdate").cast("date")
    text = F.concat(F.date_format(day, "yyyy年MM月dd日"), F.lit("～"), F.date_format(F.date_add(day, (F.col("o_orderkey") % 40).cast("int")), "yyyy年MM月dd日"))
    start, end = c.period_from_text(F.when(F.col("o_orderkey") % 7 == 0, "none").otherwise(text))
    return orders.select("o_orderkey", start.cast("string").alias("period_start"), end.cast("string").alias("period_end"), c.window_days(start, end).alias("window_days"), F.round(c.days_between(F.lit("2002-01-01").cast("timestamp"), F.col("o_orderdate").cast("timestamp")), 6).alias("age_days"))


@query
def quality_row_errors(spark, d):
    return quality.row_errors(performance(spark, d)).select("snapshot_id", "entity_key", "errors")


@query
def quality_run_gate(spark, d):
    before = bound(spark, d, "performance_once").groupBy("entity_type").agg((F.count("*") * 2).alias("rows"))
    rows = written(performance(spark, d), "performance")
    gate = quality.run_gate(rows, POLICY, before, bound(spark, d, "performance"))
    return gate.select("status", "score", "rows", "row_error_count", *r6("row_error_rate"), "duplicate_rows", "row_count_drop")


@query
def dedupe_snapshot(spark, d):
    return performance(spark, d).select("snapshot_id", "entity_key", "ord", "orders_attr")


@query
def snapshot_short(spark, d):
    return windows.pick_snapshot(performance(spark, d), POLICY.short_window_days, False).select("entity_key", "snapshot_id", "clicks", F.col("period_end").cast("string").alias("period_end"))


@query
def snapshot_long(spark, d):
    return windows.pick_snapshot(performance(spark, d), POLICY.long_window_days, True).select("entity_key", "snapshot_id", "clicks", F.col("period_end").cast("string").alias("period_end"))


@query
def analysis_windows(spark, d):
    return windows.analysis_windows(performance(spark, d), POLICY).select("entity_key", "snapshot_id_shortwin", "snapshot_id_longwin", "trend_available", "clicks", "clicks_long", "sales_attr", "sales_attr_long")


@query
def settings_item_pick(spark, d):
    return ingest.item_settings(bound(spark, d, "settings"))


@query
def settings_keyword_pick(spark, d):
    return ingest.keyword_settings(bound(spark, d, "settings"))


@query
def master_enrich(spark, d):
    products = windows.analysis_windows(performance(spark, d), POLICY).select("platform", "product_id").distinct()
    return ingest.with_master(products, master(spark, d)).select("product_id", "common_product_id", "category", "product_group", "gross_margin_rate", "other_promo_cost_rate", "item_min_cpc", "stock_qty", "product_status", F.col("launch_date").cast("string").alias("launch_date"), "role")


@query
def latest_setting(spark, d):
    return state.latest_applied(bound(spark, d, "applied"))


@query
def latest_pending_plan(spark, d):
    return state.latest_pending(bound(spark, d, "planned"))


@query
def latest_metric_history(spark, d):
    return state.latest_metrics(bound(spark, d, "history"))


@query
def active_overrides(spark, d):
    return state.active_overrides(bound(spark, d, "overrides"), as_of())


@query
def reconcile_events(spark, d):
    return state.setting_events(entities(spark, d)).select(*KEYS, "event_type", "setting_cpc", "prior_cpc", "planned_cpc", "effective_at")


@query
def planned_status_update(spark, d):
    return state.update_plans(bound(spark, d, "planned"), state.setting_events(entities(spark, d))).select("product_id", "planned_cpc", "planned_status", "run_id")


@query
def input_hash(spark, d):
    return state.input_hash(bound(spark, d, "performance"))


@query
def group_priors(spark, d):
    return decide.group_priors(entities(spark, d)).select("entity_key", *r6("prior_cvr", "prior_aov"))


@query
def inherited_cvr(spark, d):
    return decide.inherit_parent_cvr(decide.group_priors(entities(spark, d))).where("entity_type = 'KEYWORD'").select("entity_key", *r6("prior_cvr"))


@query
def beta_posterior(spark, d):
    return first_decisions(spark, d).select("entity_key", *r6("smoothed_cvr", "cvr_lower_bound", "cvr_posterior_sd", "expected_aov"))


@query
def current_bid(spark, d):
    return first_decisions(spark, d).select("entity_key", "current_bid", "current_bid_source", "min_cpc", "max_cpc")


@query
def attribution_maturity(spark, d):
    return first_decisions(spark, d).select("entity_key", *r6("attribution_maturity"))


@query
def anomaly_signals(spark, d):
    return first_decisions(spark, d).select("entity_key", "anomaly_signals")


@query
def dual_guard_cpc(spark, d):
    return first_decisions(spark, d).select("entity_key", "margin_source", *r6("margin_rate_used", "profit_guard_cpc", "roas_guard_cpc", "trend_multiplier", "raw_target_cpc"))


@query
def step_limited_cpc(spark, d):
    return first_decisions(spark, d).select("entity_key", "stepped_cpc", *r6("deadband"))


@query
def decision_case(spark, d):
    return first_decisions(spark, d).select("entity_key", "action", "decision_status", "reason_code", "recommended_cpc", "auto_approved_default", "operator_action", *r6("expected_incremental_profit"))


@query
def parent_child_hierarchy(spark, d):
    return decided(spark, d).select("entity_key", "action", "decision_status", "reason_code", "recommended_cpc", "auto_approved_default", *r6("delta_cpc", "delta_pct"))


@query
def duplicate_input_hold(spark, d):
    return decide.hold_duplicates(decided(spark, d), True).select("entity_key", "decision_status", "operator_action", "auto_approved_default")


@query
def finalize_ops(spark, d):
    return finalised(spark, d).select("entity_key", "operator_action", "final_approved", "final_cpc", "final_changed", "upload_match", "upload_eligible")


@query
def upload_validation(spark, d):
    return decide.upload_validation(finalised(spark, d)).select("entity_key", "final_cpc", "upload_validation_status")


@query
def review_table(spark, d):
    return decide.review_table(finalised(spark, d)).drop("operator_cpc").withColumn("current_bid", F.round("current_bid", 6))


def _outputs(spark, d):
    """Of the decisions, what is uploaded is written; the rows of settings are those that the decisions were made from."""
    given = setting_rows(spark, d)
    ready = finalised(spark, d, given).where("upload_eligible").select("upload_eligible", "entity_type", "product_id", "keyword", "final_cpc")
    return decide.full_outputs(given, written(ready, "ready"))


@query
def setting_full_output(spark, d):
    o = _outputs(spark, d)
    return o["item_full"].withColumn("file", F.lit("item")).unionByName(o["keyword_full"].withColumn("file", F.lit("keyword"))).select("file", "control", "product_id", "keyword", "item_cpc", "keyword_cpc")


@query
def rollback_output(spark, d):
    o = _outputs(spark, d)
    return o["item_rollback"].withColumn("file", F.lit("item")).unionByName(o["keyword_rollback"].withColumn("file", F.lit("keyword"))).select("file", "control", "product_id", "keyword", "item_cpc", "keyword_cpc")


@query
def status_counts(spark, d):
    return reports.status_counts(decided(spark, d)).select("decision_status", "n", *r6("share_pct"))


@query
def treemap_rollup(spark, d):
    return reports.category_rollup(entities(spark, d)).select("category", "product_id", *r6("value", "roas_attr_pct"), F.col("level").cast("long").alias("level"))


@query
def run_profile(spark, d):
    return reports.run_profile(finalised(spark, d))


SPEARMAN = ["clicks", "cost", "sales_attr", "orders_attr"]


@query
def spearman_matrix(spark, d):
    return reports.spearman(windows.analysis_windows(performance(spark, d), POLICY), SPEARMAN).select("left", "right", *r6("rho"))


def keywords(spark, d):
    """Keyword rows of the windows with their terms, written: totals, ranks and pairs read them."""
    return written(text.with_terms(windows.analysis_windows(performance(spark, d), POLICY).where("entity_type = 'KEYWORD'"), compatible=False), "keywords")


@query
def term_frequency(spark, d):
    return text.term_frequency(keywords(spark, d)).select("term", "keyword_count", *r6("weighted_value", "share_pct"))


@query
def term_cooccurrence(spark, d):
    return text.term_cooccurrence(keywords(spark, d)).select("term_i", "term_j", *r6("score"))


@query
def keyword_similarity(spark, d):
    names = spark.read.parquet(f"{d}/part.parquet").select(text.phrase(F.col("p_name"), compatible=False).alias("id")).distinct().select("id", F.col("id").alias("text"))
    return text.cosine_pairs(text.tfidf(names), 0.34).select("left", "right", *r6("similarity"))


@query
def paired_similarity(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet")
    pairs = parts.select(F.col("p_partkey").alias("id"), text.phrase(F.col("p_name"), compatible=False).alias("left"), text.phrase(F.concat_ws(" ", "p_type", "p_name"), compatible=False).alias("right"))
    return text.paired_similarity(pairs).select("id", *r6("similarity"))


def edges_of(rows: DataFrame) -> DataFrame:
    return written(graph.bipartite_edges(rows, max_products=48, compatible=False, relevance=False), "edges")


def edges(spark, d):
    return edges_of(decided(spark, d))


@query
def bipartite_edges(spark, d):
    return edges(spark, d).select("source", "target", *r6("edge_value", "clicks", "layout_weight"))


@query
def product_nodes(spark, d):
    rows = decided(spark, d)
    return graph.product_nodes(edges_of(rows), rows).select("node_id", "label", "action", "decision_status", "recommended_cpc", *r6("value", "clicks"))


@query
def keyword_nodes(spark, d):
    return graph.keyword_nodes(edges(spark, d)).select("node_id", "label", "product_count", *r6("value", "clicks", "sales_attr"))


@query
def product_similarity(spark, d):
    return graph.product_similarity_edges(shown(spark, d), compatible=False).select("source", "target", *r6("similarity", "shared_keyword_jaccard", "layout_weight"))


@query
def weighted_degree(spark, d):
    return graph.weighted_degree(edges(spark, d)).select("node_id", "degree", *r6("weighted_degree"))


@query
def roas_bands(spark, d):
    return decided(spark, d).select("entity_key", reports.roas_band(F.col("roas_attr_pct"), POLICY.target_roas_pct).alias("band"), c.action_class(F.col("action"), F.col("decision_status")).alias("action_class"))


def network(spark, d, layout: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes with their metrics, and edges; both are written, as every report reads them more than once."""
    rows = decided(spark, d)
    links = edges_of(rows)
    both = graph.product_nodes(links, rows).unionByName(graph.keyword_nodes(links), allowMissingColumns=True)
    nodes = both.join(graph.graph_metrics(both, links, layout=layout), "node_id").join(graph.weighted_degree(links), "node_id", "left")
    return written(nodes, "nodes"), links


@query
def network_summary(spark, d):
    nodes, links = network(spark, d)
    return graph.summary(nodes, links).select("products", "keywords", "edges", "clusters", *r6("density", "top10_share_pct", "largest_cluster_share_pct"))


@query
def top_entities(spark, d):
    return graph.top_entities(network(spark, d)[0], "PRODUCT").select("node_id", *r6("weighted_degree", "value"))


@query
def betweenness_and_communities(spark, d):
    return network(spark, d)[0].select("node_id", "community", *r6("bridge_score"))


@query
def ego_network(spark, d):
    """Around the product whose edges have the greatest value."""
    links = edges(spark, d)
    return graph.ego(links, graph.leading(links)).select("source", "target", *r6("edge_value"))


@query
def search_neighbourhood(spark, d):
    rows = decided(spark, d)
    links = edges_of(rows)
    nodes = graph.product_nodes(links, rows).unionByName(graph.keyword_nodes(links), allowMissingColumns=True)
    return graph.neighbourhood(nodes, links, "bolt").select("node_id", "hit")


@query
def graph_payload(spark, d):
    nodes, links = network(spark, d, layout=True)
    return graph.payload(nodes, links, graph.summary(nodes, links), target_roas_pct=POLICY.target_roas_pct)


def _plain_payload(spark, d) -> DataFrame:
    """The payload without the product whose edges have the greatest value, whose edges dangle then; and what needs no kernel."""
    rows = decided(spark, d)
    links = edges_of(rows)
    nodes = graph.product_nodes(links, rows).unionByName(graph.keyword_nodes(links), allowMissingColumns=True)
    nodes = written(nodes.where(F.col("node_id") != graph.leading(links)).withColumn("community", F.lit(0)), "nodes")
    return graph.payload(nodes, links, graph.summary(nodes, links))


@query
def payload_nodes(spark, d):
    """The payload's nodes, read back from its JSON."""
    kind = "struct<nodes:array<struct<id:string,type:string,label:string,productId:string,keyword:string,category:string,value:double,sales:double,clicks:double,productCount:long,action:string,status:string,recommendedCpc:double>>>"
    nodes = _plain_payload(spark, d).select(F.inline(F.from_json("payload", kind)["nodes"]))
    product = F.col("type") == "PRODUCT"
    return nodes.select(F.col("id").alias("node_id"), F.col("type").alias("node_type"), "label", F.col("productId").alias("product_id"), "category", *r6("value", "sales", "clicks"), F.col("productCount").alias("product_count"), F.when(product, F.col("action")).alias("action_class"), F.when(product, F.col("status")).alias("decision_status"), F.when(product, F.col("recommendedCpc")).alias("recommended_cpc"))


@query
def payload_edges(spark, d):
    """The payload's edges, read back from its JSON: none of the product that is no node."""
    edges = _plain_payload(spark, d).select(F.inline(F.from_json("payload", "struct<edges:array<struct<source:string,target:string,value:double,sales:double,clicks:double>>>")["edges"]))
    return edges.select("source", "target", *r6("value", "sales", "clicks"))


@query
def keyword_nearest(spark, d):
    return text.keyword_similarity(keywords(spark, d), k=3).select("source", "target", *r6("similarity"))


@query
def graph_components(spark, d):
    links = edges(spark, d).select("source", "target", "layout_weight")
    nodes = graph.both_ways(links).select("node_id").distinct()
    return graph.connected_components(nodes, links)


def _next_state(spark, d, table: str) -> DataFrame:
    run = datetime.fromisoformat(AS_OF)
    rows = decided(spark, d)
    gate = quality.run_gate(performance(spark, d), POLICY)
    return state.new_state(answered(rows), state.setting_events(rows), gate, POLICY, run="run_1", hash_of_input="0" * 64, as_of=run)[table]


@query
def next_plans(spark, d):
    return _next_state(spark, d, "planned_settings").select(*KEYS, "planned_cpc", "planned_status", "source", "run_id")


@query
def metric_append(spark, d):
    return _next_state(spark, d, "metric_history").select(*KEYS, "clicks", "cost", "sales_attr", "orders_attr", *r6("cvr_attr", "roas_attr_pct", "registered_cpc"), F.col("period_start").cast("string").alias("period_start"))


@query
def action_append(spark, d):
    return _next_state(spark, d, "action_history").select(*KEYS, *r6("previous_cpc"), "recommended_cpc", "final_cpc", "action", "decision_status", "operator_action", "outcome_status", F.col("outcome_due_date").cast("string").alias("outcome_due_date"))


@query
def next_overrides(spark, d):
    return _next_state(spark, d, "manual_overrides").select(*KEYS, "override_mode", "override_cpc", "active", "created_run_id")


@query
def run_append(spark, d):
    return _next_state(spark, d, "run_history").select("run_id", "input_hash", "quality_status", "item_rows", "keyword_rows", "duplicate_input")


@query
def network_totals(spark, d):
    """The figures of a graph that need no communities."""
    rows = decided(spark, d)
    links = edges_of(rows)
    nodes = written(graph.product_nodes(links, rows).unionByName(graph.keyword_nodes(links), allowMissingColumns=True).withColumn("community", F.lit(0)), "nodes")
    return graph.summary(nodes, links).select("products", "keywords", "edges", *r6("density", "top10_share_pct"))


@query
def top_bridges(spark, d):
    return graph.top_bridges(network(spark, d)[0]).select("node_id", *r6("bridge_score", "weighted_degree"))


@query
def semantic_edges(spark, d):
    """Edges as the operator makes them by default: phrases after NFKC, and each keyword's likeness to its product's name."""
    return graph.bipartite_edges(decided(spark, d)).select("source", "target", *r6("edge_value", "layout_weight", "semantic_relevance"))


@query
def normalised_phrases(spark, d):
    """Part names in full-width letters with other marks between the words come out as the plain names."""
    parts = spark.read.parquet(f"{d}/part.parquet")
    plain = "abcdefghijklmnopqrstuvwxyz#0123456789 "
    wide = "".join(chr(ord(c) + 0xFEE0) if c != " " else "／" for c in plain)
    return parts.select("p_partkey", text.phrase(F.translate(F.lower("p_name"), plain, wide)).alias("phrase"))


def _keyword_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = written(windows.analysis_windows(performance(spark, d), POLICY), "windows")
    return graph.keyword_similarity_graph(rows)


@query
def keyword_graph_nodes(spark, d):
    return _keyword_graph(spark, d)[0].select("node_id", "node_type", "keyword", *r6("value"))


@query
def keyword_graph_edges(spark, d):
    return _keyword_graph(spark, d)[1].select("source", "target", *r6("similarity", "layout_weight"))


@query
def decision_view(spark, d):
    rows = decide.decision_view(decided(spark, d), entity_types=["KEYWORD"], statuses=["KEEP", "KEEP_UNCERTAIN_UPSIDE", "SCALE_DOWN_AUTO_READY", "SCALE_UP_REVIEW_REQUIRED", "PARENT_STOP_AUTO_READY"], least_profit=-500.0, text=" BOLT ")
    return rows.select("entity_key", "decision_status", *r6("expected_incremental_profit", "sales_attr"))


@query
def decisions_in_order(spark, d):
    """The first hundred decisions in the order in which they are read."""
    rows = decided(spark, d).where("entity_type = 'ITEM'")
    return rows.orderBy(*decide.decision_order()).limit(100).select("entity_key", "decision_status", *r6("expected_incremental_profit", "cost"))


@query
def report_files(spark, d):
    """Performance written as report files, one a snapshot, and read again: found, decoded, told apart and normalised."""
    rows = bound(spark, d, "performance_once")
    names = ["platform", "entity_type", "product_id", "keyword", "clicks", "cost", "sales_attr", "orders_attr", "impressions", "actual_cpc"]
    path = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    out = rows.select("snapshot_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names], *[F.col(c).cast("string").alias(c) for c in ("period_start", "period_end")])
    out.repartition(4, "snapshot_id").write.partitionBy("snapshot_id").option("header", True).csv(path)
    read = files.read_performance(spark, f"{path}/*/*.csv")
    return read.select("entity_key", F.col("period_end").cast("string").alias("period_end"), F.col("window_days").cast("long").alias("window_days"), *r6("clicks", "cost", "sales_attr", "orders_attr", "impressions", "actual_cpc"))


@query
def file_profiles(spark, d):
    """What is known of each settings file: kind, encoding, rows. Files have an item of each region."""
    lines = spark.read.parquet(f"{d}/supplier.parquet").join(spark.read.parquet(f"{d}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey"))
    path = f"{shared_dir(spark)}/settings-{uuid.uuid4().hex}"
    named = {"コントロールカラム": F.lit(""), "商品管理番号": F.concat(F.lit("S"), "s_suppkey"), "商品名": F.col("s_name"), "価格": F.lit("1000"), "商品URL": F.lit("https://example.com"), "商品CPC": F.col("s_suppkey").cast("string"), "キーワード": F.lit(""), "キーワードCPC": F.lit(""), "目安CPC": F.lit("")}
    out = lines.select(F.col("n_regionkey").alias("region"), *[c.alias(n) for n, c in named.items()])
    out.repartition(4, "region").write.partitionBy("region").option("header", True).csv(path)
    found = files.profile(files.read_files(spark, f"{path}/*/*.csv"))
    return found.select(F.regexp_extract("path", "region=([0-9]+)", 1).cast("long").alias("region"), "kind", "encoding", F.size("header").alias("columns"), "rows")


@query
def state_appended(spark, d):
    """Plans kept in the store over two runs, with the order of their arrival."""
    store = StateStore(spark, f"{shared_dir(spark)}/state-{uuid.uuid4().hex}")
    plans = bound(spark, d, "planned").drop("ord").withColumn("source", F.lit("x"))
    store.append("planned_settings", plans)
    store.append("planned_settings", plans.withColumns({"run_id": F.lit("run_1"), "planned_status": F.lit("PENDING")}))
    return store.read("planned_settings").select(*KEYS, "planned_cpc", "planned_status", "run_id", F.dense_rank().over(Window.partitionBy(*KEYS).orderBy("ord")).alias("place"))


@query
def store_latest_plan(spark, d):
    """The pending plan of each key that a store of two runs ends with."""
    store = StateStore(spark, f"{shared_dir(spark)}/state-{uuid.uuid4().hex}")
    plans = bound(spark, d, "planned").drop("ord").withColumn("source", F.lit("x"))
    store.append("planned_settings", plans)
    store.append("planned_settings", plans.where("planned_cpc < 90").withColumn("run_id", F.lit("run_1")))
    return state.latest_pending(store.read("planned_settings")).select("product_id", "planned_cpc", "planned_run_id")
