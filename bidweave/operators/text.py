"""Phrases, terms and character n-grams of product names and keywords."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidweave.operators.reports import with_total
from bidweave.session import written

#: What separates terms, what counts as Japanese, what a tokenizer's term may hold, the parts of speech that
#: are terms, and terms that say nothing.
PUNCTUATION = r"[\s　,，.。/／・|｜+＋:：;；!?！？()（）\[\]【】{}「」『』<>＜＞\-_]+"
JAPANESE = "[ぁ-んァ-ヶ一-龠々ー]"
VALID_TERM = "^[0-9A-Za-zぁ-んァ-ヶ一-龠々ー]+$"
PARTS_OF_SPEECH = ["名詞", "動詞", "形容詞"]
STOP_TERMS = [
    "する", "ある", "いる", "なる", "できる", "付き", "つき", "用", "対応", "タイプ", "セット", "商品", "楽天",
    "送料無料", "アストロ", "公式", "限定", "人気", "おすすめ", "ランキング", "サイズ", "カラー", "入り", "組", "枚", "個",
    "本", "cm", "mm", "kg", "new", "られる", "れる", "せる", "ため", "これ", "もの", "こと",
]
#: Lengths of the n-grams that texts are compared by.
GRAMS = (2, 3, 4)


def nfkc(c: Column) -> Column:
    """Compatibility characters in their plain forms; Spark has no function for it."""

    @F.pandas_udf("string")
    def normalised(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return normalised(c)


def phrase(c: Column, *, compatible: bool = True) -> Column:
    """Lower case with single spaces for punctuation; empty for null. compatible: after NFKC, which takes Python."""
    text = nfkc(c) if compatible else c
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, " "))


def terms(normalised: Column, *, min_length: int = 2, max_terms: int = 12) -> Column:
    """The distinct terms of a phrase in order: its words, and all three-character pieces of long Japanese ones."""

    def of_word(w: Column) -> Column:
        own = F.when(F.length(w) >= 2, F.array(w)).otherwise(F.array().cast("array<string>"))
        pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substr(w, i, F.lit(3)))
        return F.concat(own, F.when((F.length(w) >= 5) & w.rlike(JAPANESE), pieces).otherwise(F.array().cast("array<string>")))

    found = F.flatten(F.transform(F.split(normalised, " "), of_word))
    return F.slice(F.array_distinct(F.filter(found, lambda t: (F.length(t) >= min_length) & ~t.isin(STOP_TERMS))), 1, max_terms)


def tokenised_terms(normalised: Column, tokenizer: Callable[[str], list[tuple[str, str]]], *, min_length: int = 2, max_terms: int = 12) -> Column:
    """The distinct terms among a tokenizer's (base form, part of speech): nouns, verbs and adjectives that aren't numbers alone.

    Phrases in which it finds none have the terms of `terms`. Only the tokenizer runs in Python.
    """

    @F.pandas_udf("array<struct<base:string,pos:string>>")
    def tokens(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"base": base, "pos": pos} for base, pos in tokenizer(t)])

    def base(t: Column) -> Column:
        return F.replace(phrase(t["base"], compatible=False), F.lit(" "), F.lit(""))

    def good(t: Column) -> Column:
        return (F.length(t) >= min_length) & ~t.isin(STOP_TERMS) & t.rlike(VALID_TERM) & ~t.rlike("^[0-9]+$")

    spoken = F.filter(tokens(normalised), lambda t: t["pos"].isin(PARTS_OF_SPEECH))
    found = F.slice(F.array_distinct(F.filter(F.transform(spoken, base), good)), 1, max_terms)
    return F.when(F.size(found) > 0, found).otherwise(terms(normalised, min_length=min_length, max_terms=max_terms))


def with_terms(rows: DataFrame, keyword_col: str = "keyword", *, compatible: bool = True, tokenizer: Callable[[str], list[tuple[str, str]]] | None = None) -> DataFrame:
    """rows with keyword_normalized, terms and term_count. A tokenizer sees each different phrase once."""
    out = rows.withColumn("keyword_normalized", phrase(F.col(keyword_col), compatible=compatible))
    if tokenizer is None:
        return out.withColumn("terms", terms(F.col("keyword_normalized"))).withColumn("term_count", F.size("terms"))
    known = out.select(F.col("keyword_normalized").alias("__phrase")).distinct().withColumn("terms", tokenised_terms(F.col("__phrase"), tokenizer))
    return out.join(known, F.col("keyword_normalized") == F.col("__phrase"), "left").drop("__phrase").withColumn("term_count", F.size("terms"))


def weighted(rows: DataFrame, weight: str) -> DataFrame:
    """rows with `weight`: that column, null as 0; 1 for all if they sum to nothing."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    total = rows.agg(F.coalesce(F.sum(w), F.lit(0.0)).alias("__total"))
    # One row.
    return rows.crossJoin(total).withColumn("weight", F.when(F.col("__total") > 0, w).otherwise(1.0)).drop("__total")


def term_frequency(rows: DataFrame, weight: str = "sales_attr", top: int | None = 30) -> DataFrame:
    """(term, keyword_count, weighted_value, share_pct): the share is of all terms, before the top are taken."""
    counts = weighted(rows, weight).select(F.explode("terms").alias("term"), "weight").groupBy("term").agg(F.count("*").alias("keyword_count"), F.sum("weight").alias("weighted_value"))
    total = F.col("__total")
    out = with_total(counts, F.col("weighted_value")).withColumn("share_pct", F.when(total > 0, F.col("weighted_value") / total * 100).otherwise(0.0)).drop("__total")
    return out.orderBy(F.desc("weighted_value"), F.desc("keyword_count"), "term").limit(top) if top else out


def term_cooccurrence(rows: DataFrame, weight: str = "clicks", top: int = 16) -> DataFrame:
    """(term_i, term_j, score) of the top terms: their common weight over the geometric mean of their own; 1 with themselves."""
    best = F.broadcast(term_frequency(rows, weight, top).select("term"))
    terms_i = weighted(rows, weight).select("weight", F.explode("terms").alias("term_i"), "terms").join(best.withColumnRenamed("term", "term_i"), "term_i", "left_semi")
    terms_j = terms_i.select("weight", "term_i", F.explode("terms").alias("term_j")).join(best.withColumnRenamed("term", "term_j"), "term_j", "left_semi")
    pairs = terms_j.groupBy("term_i", "term_j").agg(F.sum("weight").alias("w"))
    own = pairs.where("term_i = term_j").select(F.col("term_i").alias("term"), F.col("w").alias("own"))
    out = pairs.join(F.broadcast(own.withColumnsRenamed({"term": "term_i", "own": "own_i"})), "term_i").join(F.broadcast(own.withColumnsRenamed({"term": "term_j", "own": "own_j"})), "term_j")
    same = F.col("term_i") == F.col("term_j")
    return out.select("term_i", "term_j", F.when(same, (F.col("own_i") > 0).cast("double")).when((F.col("own_i") > 0) & (F.col("own_j") > 0), F.col("w") / F.sqrt(F.col("own_i") * F.col("own_j"))).otherwise(F.col("w")).alias("score"))


def gram_counts(docs: DataFrame) -> DataFrame:
    """(id, gram, n, copies) of docs (id, text, and copies where an id stands for several documents of one text)."""

    def of_size(n: int) -> Column:
        return F.when(F.length("text") >= n, F.transform(F.sequence(F.lit(1), F.length("text") - (n - 1)), lambda i: F.substr("text", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    copies = F.col("copies") if "copies" in docs.columns else F.lit(1).cast("long")
    return docs.select("id", copies.alias("copies"), F.explode(F.concat(*[of_size(n) for n in GRAMS])).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("n"), F.max("copies").alias("copies"))


def tfidf(docs: DataFrame) -> DataFrame:
    """(id, gram, weight, df) of docs (id, text, and copies or none): sublinear counts, smoothed idf, rows of length 1, and the gram's documents.

    Counts and weights are written, as idf, norms and both sides of a comparison read them.
    """
    counts = written(gram_counts(docs), "grams")
    # One row.
    size = docs.agg((F.sum("copies") if "copies" in docs.columns else F.count("*")).alias("docs"))
    idf = counts.groupBy("gram").agg(F.sum("copies").alias("df")).crossJoin(size).select("gram", "df", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = written(counts.join(idf, "gram").select("id", "gram", ((1 + F.log("n")) * F.col("idf")).alias("w"), "df"), "weights")
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "id").select("id", "gram", (F.col("w") / F.col("norm")).alias("weight"), "df")


def rare_grams(vectors: DataFrame, least: float) -> DataFrame:
    """The rarest grams of each id, up to where what is left of the vector is shorter than `least`.

    Grams are in one order for all ids, from rare to common. The first gram that two vectors share lies among these of both if
    their cosine is `least` or more: behind it one of them would be too short. So common grams needn't be looked up.
    """
    upto = Window.partitionBy("id").orderBy(F.desc("df"), F.desc("gram"))
    return vectors.withColumn("__rest", F.sum(F.col("weight") * F.col("weight")).over(upto)).where(F.col("__rest") >= least * least * (1 - 1e-9)).drop("__rest")


def cosine_pairs(vectors: DataFrame, least: float = 0.0) -> DataFrame:
    """(left, right, similarity) of ids left < right that share a gram, with `least` or more.

    Above 0, candidates share one of their rarest grams, and each pair is summed up once over all of its grams.
    """

    def side(df: DataFrame, name: str, w: str) -> DataFrame:
        return df.select(F.col("id").alias(name), "gram", F.col("weight").alias(w))

    a, b = side(vectors, "left", "wa"), side(vectors, "right", "wb")
    if least > 0:
        rare = written(rare_grams(vectors, least).select("id", "gram"), "rare_grams")
        pairs = rare.withColumnRenamed("id", "left").join(rare.withColumnRenamed("id", "right"), "gram").where("left < right").select("left", "right").distinct()
        joined = pairs.join(a, "left").join(b, ["right", "gram"])
    else:
        joined = a.join(b, "gram").where("left < right")
    out = joined.groupBy("left", "right").agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity"))
    return out.where(F.col("similarity") >= least) if least > 0 else out


def top_keywords(rows: DataFrame, value: str, most: int) -> DataFrame:
    """Keywords (keyword_normalized) by summed value, the first `most`."""
    return rows.where("keyword_normalized <> ''").groupBy("keyword_normalized").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("value")).orderBy(F.desc("value"), "keyword_normalized").limit(most)


def keyword_similarity(rows: DataFrame, *, value: str = "sales_attr", most: int = 120, threshold: float = 0.34, k: int = 3) -> DataFrame:
    """(source, target, similarity): each keyword's k nearest at the threshold or above, each pair once."""
    docs = top_keywords(rows, value, most).select(F.col("keyword_normalized").alias("id"), F.col("keyword_normalized").alias("text"))
    pairs = cosine_pairs(tfidf(docs), threshold)
    both = pairs.unionByName(pairs.select(F.col("right").alias("left"), F.col("left").alias("right"), "similarity"))
    order = Window.partitionBy("left").orderBy(F.desc(F.round("similarity", 9)), "right")
    near = both.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    return near.groupBy(F.least("left", "right").alias("source"), F.greatest("left", "right").alias("target")).agg(F.max("similarity").alias("similarity"))


def paired_similarity(pairs: DataFrame) -> DataFrame:
    """(id, similarity) of pairs (id, left, right), with n-gram weights of both sides' texts together; 0 without n-grams.

    Each different text has its n-grams made once, and each different pair of texts is compared once.
    """
    docs = pairs.select(F.col("left").alias("id")).unionByName(pairs.select(F.col("right").alias("id"))).groupBy("id").agg(F.count("*").alias("copies"))
    v = tfidf(written(docs.withColumn("text", F.col("id")), "texts"))
    a, b = v.select(F.col("id").alias("left"), "gram", F.col("weight").alias("wa")), v.select(F.col("id").alias("right"), "gram", F.col("weight").alias("wb"))
    dot = pairs.select("left", "right").distinct().join(a, "left").join(b, ["right", "gram"]).groupBy("left", "right").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    return pairs.join(dot, ["left", "right"], "left").select("id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("dot", F.lit(0.0)))).alias("similarity"))
