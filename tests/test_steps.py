"""Steps that many queries share: cheaper forms give what the plain ones give, and no more work is done than is asked for."""

import random
import re

from pyspark.sql import functions as F

from bidweave.functions import columns as c
from bidweave.operators import quality, text, windows
from bidweave.plans import absorbed, bindings, queries

SF = "/root/testdata/sf0.001"


def test_maturity_is_the_mean_of_the_days_shares(spark):
    rows = [(d, h, p) for d in (1, 2, 7, 29, 30, 31, 90, 365) for h in (-50, 0, 1, 47, 48, 719, 720, 5000) for p in ("rakuten", "yahoo")]
    df = spark.createDataFrame(rows, "days int, hours int, platform string").withColumn("end", F.lit("2001-11-05").cast("date"))
    df = df.withColumn("start", F.expr("date_add(end, 1 - days)")).withColumn("executed", F.expr("cast(end AS timestamp) + make_interval(0, 0, 0, 0, hours)"))
    share = c.maturity(F.col("platform"), F.col("start"), F.col("end"), F.col("executed"), F.lit("2001-11-08").cast("timestamp"), 720, 24)
    for r in df.withColumn("m", share).collect():
        horizon, lag = (30.0 if r["platform"] == "rakuten" else 1.0), max(r["hours"], 0) / 24
        assert abs(r["m"] - sum(min((i + lag) / horizon, 1.0) for i in range(r["days"])) / r["days"]) < 1e-12
    assert "lambda" not in df.select(share)._jdf.queryExecution().optimizedPlan().toString()


def test_text_is_trimmed_as_by_the_pattern(spark):
    random.seed(5)
    texts = ["".join(random.choices("ab,円% \t\n\r\v\f　 1.", k=random.randrange(9))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.withColumn("x", c.clean_text(F.col("t"))).collect():
        assert r["x"] == re.sub("^[ \t\n\r\v\f　 ]+|[ \t\n\r\v\f　 ]+$", "", r["t"].replace("　", " "))


def test_equal_texts_have_their_grams_made_once(spark, monkeypatch):
    rows = [(k, "red bolt", "big bolt") for k in range(40)] + [(50, "", "x"), (51, "old nut", "old nut")]
    pairs = spark.createDataFrame(rows, "id long, left string, right string")
    seen = []
    plain = text.gram_counts
    monkeypatch.setattr(text, "gram_counts", lambda docs: (seen.append(docs.count()), plain(docs))[1])
    got = {r["id"]: r["similarity"] for r in text.paired_similarity(pairs).collect()}
    assert seen == [5] and len(got) == 42 and got[50] == 0 and abs(got[51] - 1) < 1e-9
    docs = pairs.selectExpr("2 * id AS id", "left AS text").unionAll(pairs.selectExpr("2 * id + 1", "right"))
    want = {r["left"]: r["similarity"] for r in text.cosine_pairs(text.tfidf(docs)).where("left % 2 = 0 AND right = left + 1").collect()}
    assert all(abs(v - want.get(2 * k, 0.0)) < 1e-9 for k, v in got.items())


def test_lines_of_no_snapshot_do_not_reach_their_parts(spark):
    plan = bindings.bound(spark, SF, "performance_once")._jdf.queryExecution().optimizedPlan().toString()
    scan = plan[plan.index("l_shipdate") :]
    assert re.search(r"cast\(l_shipdate#\d+ as date\) [<>]|l_shipdate#\d+ >=? ", scan)
    every = bindings.bound(spark, SF, "settings")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in re.sub(r"Relation.*", "", every)


def test_an_entitys_rows_are_moved_once(spark):
    rows = quality.with_blocks(queries.by_entity(spark, SF))
    plan = windows.analysis_windows(rows, bindings.POLICY)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(entity_key#\d+[^,]*,", plan)) == 1 and not re.search(r"Exchange hashpartitioning\((snapshot_id#\d+, entity_key|platform)", plan)


def test_state_has_entities_without_joining_their_counts(spark):
    rows = queries.by_entity(spark, SF)
    state = absorbed.entity_state(rows, bindings.POLICY)
    assert "SortMergeJoin" not in state.select("entity_key", "rows")._jdf.queryExecution().executedPlan().toString().split("Window")[0]
    assert state.agg(F.sum("rows")).first()[0] == rows.count()
