"""Substring search equals a scan, for texts that come in parts, odd needles and common grams."""

from pyspark.sql import functions as F

from bidweave.operators import search

TEXTS = ["red cotton Shirt", "cotton", "aaaa", "aaa", "AAAaab", "", None, "楽天 送料無料 市場", "料無料送", "cot ton", "xcottony", "ab", "a%b_c\\d"]
NEEDLES = ["cotton", "COTTON", "aaa", "aaaa", "送料無料", "zzz", "tton s", "ab", "", None, "%b_", "cotton", "n sh"]


def test_matches_and_containing_equal_a_scan(spark, tmp_path):
    rows = spark.createDataFrame([*enumerate(TEXTS), (99, "aaa")], "id long, text string").withColumn("gram", F.lit("x"))
    path = f"{tmp_path}/postings"
    search.save(search.postings(rows.where("id % 2 = 0")), path)
    search.save(search.postings(rows.where("id % 2 = 1")), path)
    index = spark.read.parquet(path)
    assert index.count() == index.distinct().count()
    needles = spark.createDataFrame([(n,) for n in NEEDLES], "needle string")
    found = {(r["needle"], r["id"]) for r in search.matches(index, rows, needles).collect()}
    known = [*enumerate(TEXTS), (99, "aaa")]
    assert found == {(n, i) for n in NEEDLES if n and len(n) >= 3 for i, t in known if t and n.lower() in t.lower()}
    for n in ("ab", "", "aaa", "CotTon", "送料無料", "%b_"):
        assert sorted(r["id"] for r in search.containing(index, rows, n).collect()) == sorted(i for i, t in known if n.lower() in (t or "").lower())


def test_the_grams_reach_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([(1, "cotton")], "id long, text string")
    search.save(search.postings(rows), f"{tmp_path}/postings")
    plan = search.containing(spark.read.parquet(f"{tmp_path}/postings"), rows, "cotton")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "id long, text string")
    assert search.matches(search.postings(rows), rows, spark.createDataFrame([("abc",)], "needle string")).count() == 0
