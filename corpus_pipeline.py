"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.llm import language, minhash, packing, pii, quality
from bidweave.session import ship, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay: those without a letter go, and those that no language is likely for."""
    ship(spark)
    return language.keep_identified(docs, language.train(docs, use=quality.remainder("doc_id", 4) != 2))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier good than not stay, by a model of the labelled ones among them."""
    ship(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), use=quality.remainder("doc_id", 3) != 1)
    return quality.keep_good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their five-word shingles, the one of the smallest id stays."""
    ship(spark)
    return minhash.one_of_each(docs, shingle=5, percent=80)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses become pseudonyms; n_chars follows the text."""
    done = pii.pseudonymise(docs, key=pii.QUERY_KEY)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in sequences of 4096 tokens."""
    ship(spark)
    return packing.pack_documents(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("pseudonyms", pseudonyms),
    ("sequence_packing", sequence_packing),
]

#: SQL can express neither the models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
