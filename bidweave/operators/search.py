"""Substring search through the trigrams of texts: postings, their intersection, and a check of the text itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many of a needle's rarest trigrams are looked up. More would cost more than the checks that they save.
LOOKED_UP = 3


def folded(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1)))
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def postings(rows: DataFrame) -> DataFrame:
    """(gram, id) of rows (id, text), each once. Postings of new rows are appended to those of the old: no id is in both."""
    return rows.where("id IS NOT NULL").select("id", F.explode(trigrams(folded(F.col("text")))).alias("gram")).distinct().select("gram", "id")


def save(index: DataFrame, path: str, *, mode: str = "append") -> None:
    """Postings as a table in ranges of grams, so that statistics of its files say where a gram is."""
    index.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.mode(mode).parquet(path)


def containing(index: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """The rows (id, text, ...) whose text contains a given one, in any case. Under three characters there is no gram, and all rows are read."""
    low = text.lower()
    fits = F.contains(folded(F.col("text")), F.lit(low))
    grams = {low[i : i + 3] for i in range(len(low) - 2)}
    if not grams:
        return rows.where(fits)
    # The filter on grams reaches the scan of the postings.
    found = index.where(F.col("gram").isin(*sorted(grams))).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
    return rows.join(found.select("id"), "id", "left_semi").where(fits)


def matches(index: DataFrame, rows: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle, id): every needle (needle) with the rows (id, text) whose text contains it, in any case.

    A needle's rarest trigrams are looked up, and rows that have them all are checked. Needles of fewer than three characters have
    no trigram and match nothing here: they are for a scan (`containing`). Null needles match nothing; repeated ones count once.
    """
    wanted = needles.where("needle IS NOT NULL").select("needle").distinct().select("needle", F.explode(trigrams(folded(F.col("needle")))).alias("gram"))
    mine = index.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("needle").orderBy(F.coalesce("df", F.lit(0)), "gram")
    used = wanted.join(mine, "gram", "left").withColumn("k", F.row_number().over(rarest)).where(F.col("k") <= LOOKED_UP)
    used = used.withColumn("asked", F.count("*").over(Window.partitionBy("needle")))
    # A gram without postings ends its needle's search before the join.
    possible = used.withColumn("least", F.min(F.coalesce("df", F.lit(0))).over(Window.partitionBy("needle"))).where("least > 0")
    candidates = possible.select("needle", "gram", "asked").join(index, "gram").groupBy("needle", "id").agg(F.count("*").alias("n"), F.first("asked").alias("asked")).where("n = asked")
    return candidates.select("needle", "id").join(rows.select("id", "text"), "id").where(F.contains(folded(F.col("text")), folded(F.col("needle")))).select("needle", "id")
