"""Steps that all decision queries share do their work once, and no more of it than is read."""

import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from bidweave.operators import graph, ingest, quality, reports, text, windows
from bidweave.plans import bindings, queries

SF = "/root/testdata/sf0.001"


def test_rows_given_twice_are_not_read_twice(spark):
    got = bindings.bound(spark, SF, "performance")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("l_shipdate#") and len(re.findall(r"Relation \[[^\]]*l_orderkey", got._jdf.queryExecution().optimizedPlan().toString())) == 1
    sources = {s: spark.read.parquet(f"{SF}/{s}.parquet") for s in ("lineitem", "part")}
    plain = bindings.ctes()
    for s in ("lineitem", "part", "supplier", "nation", "region"):
        sources[s] = spark.read.parquet(f"{SF}/{s}.parquet")
        plain = re.sub(rf"\b(FROM|JOIN) {s}\b", rf"\1 {{{s}}}", plain)
    want = spark.sql(f"{plain}\nSELECT * FROM performance", **sources)
    assert got.columns == want.columns and got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_an_entitys_rows_are_sorted_twice(spark):
    rows = quality.with_blocks(queries.by_entity(spark, SF))
    plan = windows.analysis_windows(rows, bindings.POLICY)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Sort \[__spread", plan)) == 2 and "Sort [_w" not in plan


def test_columns_that_nobody_reads_are_not_picked(spark):
    rows = queries.by_entity(spark, SF)
    whole = windows.analysis_windows(rows, bindings.POLICY)
    part = windows.analysis_windows(rows, bindings.POLICY, without=queries.UNREAD)
    assert part.columns == [c for c in whole.columns if c not in queries.UNREAD]
    assert part.exceptAll(whole.select(*part.columns)).isEmpty()
    assert "impressions" not in part._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[1]


def test_settings_are_picked_without_sorting(spark):
    rows = spark.createDataFrame([("P", "", "", "", 1), ("P", "30", "k", "-", 2), ("P", "40", "k", "25", 3), ("P", "50", "k", "", 4), ("Q", "-", "", "", 1)], "product_id string, item_cpc string, keyword string, keyword_cpc string, ord long")
    out = ingest.setting_table(rows)
    assert {(r["product_id"], r["keyword"]): r["registered_cpc"] for r in out.collect()} == {("P", ""): 30.0, ("Q", ""): None, ("P", "k"): None}
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_outputs_read_the_settings_that_decisions_were_made_from(spark, monkeypatch):
    names, plain = [], queries.written
    monkeypatch.setattr(queries, "written", lambda df, name: (names.append(name), plain(df, name))[1])
    assert queries.rollback_output(spark, SF).count() and names.count("settings") == 1


def test_counts_of_a_run_do_not_multiply_its_rows(spark):
    rows = [("ITEM", "P", "", True, False, True, False), ("KEYWORD", "P", "k", False, True, True, False), ("KEYWORD", "Q", "k", True, True, False, True), ("ITEM", None, "", None, None, None, None), ("OTHER", "R", "x", True, True, True, True)]
    df = spark.createDataFrame(rows, "entity_type string, product_id string, keyword string, final_approved boolean, final_changed boolean, upload_match boolean, upload_eligible boolean")
    out = reports.run_profile(df)
    assert out.first() == Row(products=1, keywords=1, rows=5, approved=3, changed=3, eligible=2, unmatched=1)
    assert reports.run_profile(df.limit(0)).first() == Row(products=0, keywords=0, rows=0, approved=0, changed=0, eligible=0, unmatched=0)
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("compatible", [True, False])
def test_edges_are_ranked_before_their_decisions_are_made(spark, monkeypatch, compatible):
    rows = [("KEYWORD", f" P{p}", k, f"name {p}", float(p + len(k)), "KEEP") for p in range(6) for k in ("red bolt", "ＲＥＤ－bolt", "nut")]
    df = spark.createDataFrame(rows, "entity_type string, product_id string, keyword string, product_name string, sales_attr double, action string")
    df = df.withColumns({c: F.col("sales_attr") for c in ("clicks", "cost", "orders_attr", "roas_attr_pct")}).withColumn("decision_status", F.concat(F.lit("said "), "action"))
    plans, plain = {}, graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: (plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}), plain(df, name))[1])
    out = graph.bipartite_edges(df, max_products=2, compatible=compatible, relevance=False)
    got = {(r["product_id"], r["keyword_normalized"]): (r["edge_value"], r["decision_status"]) for r in out.collect()}
    words = {"red bolt": 2 * 8.0 + 5, "nut": 3.0} if compatible else None
    assert {p for p, _ in got} == {"P4", "P5"} and all(s == "said KEEP" for _, s in got.values())
    if words:
        assert got[("P4", "red bolt")][0] == (4 + 8.0) + (4 + 8.0) and got[("P4", "nut")][0] == 4 + 3.0
    assert "said " not in plans["edge_sums"] and "said " in plans["top_edges"]


def test_plain_keywords_do_not_go_through_python(spark, monkeypatch):
    seen, plain = [], text.nfkc
    df = spark.createDataFrame([("KEYWORD", "P", "Red-bolt"), ("KEYWORD", "P", "ｒｅｄ"), ("KEYWORD", "P", None), ("ITEM", "P", "x")], "entity_type string, product_id string, keyword string")
    out = graph.keyword_rows(df)
    assert sorted(r["keyword_normalized"] for r in out.collect()) == ["red", "red bolt"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and re.search(r"octet_length\(keyword#\d+\) = length\(keyword#\d+\)", plan)
