"""The code that Spark makes of decisions is short enough for the JVM to compile: methods over 8000 bytes are interpreted for good."""

import re

import pytest

from bidweave.operators import quality
from bidweave.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def entities(spark):
    return queries.entities(spark, SF)


@pytest.mark.parametrize("name", ["parent_child_hierarchy", "duplicate_input_hold", "finalize_ops", "review_table"])
def test_no_method_of_decisions_is_too_long_to_compile(spark, entities, monkeypatch, name):
    monkeypatch.setattr(queries, "entities", lambda spark, d: entities)
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(queries.QUERIES[name](spark, SF)._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000
    # Products' rows are few and written, so no join moves the decisions.
    assert "SortMergeJoin" not in plan.executedPlan().toString()


def test_error_codes_leave_nulls_out_without_a_lambda(spark):
    df = spark.createDataFrame([("", None, 1.0, -1.0, 1.0, None, None), ("P", 1.0, 1.0, 1.0, 1.0, "2001-01-01", "2001-01-02")], "product_id string, clicks double, cost double, sales_attr double, orders_attr double, period_start string, period_end string")
    out = df.select(quality.error_codes().alias("e"))
    assert [r["e"] for r in out.collect()] == ["MISSING_PRODUCT_ID|MISSING_CLICKS|NEGATIVE_SALES_ATTR|MISSING_PERIOD", ""]
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
