import duckdb
import pytest

import corpus_pipeline
from bidweave.llm.queries import ORACLES, QUERIES
from bidweave.llm.pii import ANY

SF = "/root/testdata/sf0.001"


def test_stages_each_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.count()
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert new.columns == docs.columns, name
        assert new.join(docs, "doc_id", "left_anti").count() == 0
        if name == "pseudonyms":
            both = new.join(docs.withColumnsRenamed({"text": "old"}), "doc_id")
            assert both.where("text <> old").count() > 0
            assert both.where("text <> old").select("old").first()["old"]
        docs = new
        counts.append(docs.count())
    assert rows >= counts[0] > counts[1] > counts[2] == counts[3] > rows * 0.5
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in placed.collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_url_query_matches_its_sql(spark):
    found = sorted(tuple(r) for r in QUERIES["op9_url_filters"](spark, SF).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert found == sorted(con.sql(ORACLES["op9_url_filters"]).fetchall())


@pytest.mark.parametrize("name", ["op1_pii_pseudonyms", "op3_fingerprints", "op6_quality", "op8_language_id"])
def test_queries_return_every_document(spark, name):
    rows = QUERIES[name](spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count() and rows.columns[0] == "doc_id"


def test_pattern_has_no_capturing_groups():
    import regex

    assert regex.compile(ANY).groups == 0
