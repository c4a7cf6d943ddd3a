"""Quality classifier: learned vectors of hashed words and character n-grams, averaged over a document, with a softmax.

The model is fitted on the driver by numpy stochastic gradient descent on a bounded sample of labelled documents. As the
output is linear in the average, a document's score is the mean of one number a feature: executors look words up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidweave.llm.bpe import blocks
from bidweave.llm.subwords import WordSums, bag

SIZES, BUCKETS, DIM = (3, 4, 5), 1 << 16, 16
#: The most labelled documents that a fit takes, and the characters of text that they may have together.
SAMPLE, CHARS = 3000, 24_000_000


@dataclass(frozen=True)
class QualityModel:
    """Logit of label 1: bias and, for each bucket, its vector's product with the output's weights."""

    words: WordSums
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        means, _ = self.words.means(texts)
        return 1 / (1 + np.exp(-np.clip(means[:, 0] + self.bias, -500, 500)))


def fit(texts: list[str], labels: list[int], *, epochs: int = 8, rate: float = 0.5, seed: int = 7) -> QualityModel:
    """labels: 0 or 1. Without texts the model gives 0.5; with one label alone, that label's share of the prior."""
    rng = np.random.default_rng(seed)
    bags = [bag(t, SIZES, BUCKETS, True, False) for t in texts]
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    seen_v, seen_o, seen_b = np.zeros(BUCKETS, np.float32), np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    target = np.eye(2, dtype=np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(texts)):
            ids, shares = bags[i]
            mean = shares @ vectors[ids]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            error = p / p.sum() - target[labels[i]]
            back = error @ out
            grad = np.outer(error, mean)
            seen_o += grad**2
            seen_b += error**2
            out -= step * grad / np.sqrt(seen_o + 1e-8)
            bias -= step * error / np.sqrt(seen_b + 1e-8)
            size = float(back @ back)
            if len(ids) and size:
                seen_v[ids] += shares**2 * (size / DIM)
                vectors[ids] -= (step * shares / np.sqrt(seen_v[ids] + 1e-12))[:, None] * back[None, :]
    table = (vectors @ (out[1] - out[0])).astype(np.float64)[:, None]
    return QualityModel(WordSums(table, SIZES, True, False), float(bias[1] - bias[0]))


def within(drawn: list[tuple[int, object, int]], chars: int) -> list[int]:
    """Of drawn (id, class, length), the ids that come first in each class until its share of the characters is used up.

    The first of a class is always among them, however long it is.
    """
    share, used, kept = chars // max(1, len({c for _, c, _ in drawn})), {}, []
    for i, c, n in drawn:
        if c not in used or used[c] + n <= share:
            used[c] = used.get(c, 0) + n
            kept.append(i)
    return kept


def train(docs: DataFrame, labels: DataFrame, *, use: Column | None = None, sample: int = SAMPLE, chars: int = CHARS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fits on up to `sample` whole documents that have a text, a label of 0 or 1 (the least, of several), and where `use` holds.

    They are drawn by a hash of the id, with up to `chars` characters in all, evenly over the labels; a label's first document
    is taken whatever its length. Nothing but texts and labels is read. Of rows with one id one text is learnt from.
    """
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (F.lit(True) if use is None else use))
    there = docs.where(F.col(text_col).isNotNull()).select(id_col, F.length(text_col).alias("__length"))
    drawn = there.join(marked.select(id_col, F.col(label_col).alias("__label")), id_col).groupBy(id_col).agg(F.min("__label").alias("label"), F.max("__length").alias("length"))
    drawn = [tuple(r) for r in drawn.orderBy(F.xxhash64(F.col(id_col), F.lit("quality")), id_col).limit(sample).collect()]
    of = {i: label for i, label, _ in drawn}
    ids = within([(i, label, n) for i, label, n in drawn], chars)
    # At most `sample` ids.
    chosen = docs.sparkSession.createDataFrame([(i,) for i in ids], T.StructType([docs.schema[id_col]]))
    rows = docs.select(id_col, text_col).where(F.col(text_col).isNotNull()).join(F.broadcast(chosen), id_col).groupBy(id_col).agg(F.min(text_col).alias("text")).collect() if ids else []
    rows.sort(key=lambda r: r[0])
    return fit([r[1] for r in rows], [int(of[r[0]]) for r in rows])


def score(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): how likely the model holds label 1, from 0 to 1, for each row of docs by its whole text alone.

    Texts without words (null, empty, white space) have the score of the bias; repeated rows score alike; other columns
    are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in blocks(batch.column(1), 1_000_000):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(model.scores(texts))], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())]))


def keep_good(docs: DataFrame, model: QualityModel, *, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that score at least that much, each by its whole text alone.

    Null and empty texts and those without words have the score of the bias: all of them stay, or none. Repeated rows stay or
    go together; an empty table stays empty; other columns may have any names.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in blocks(batch.column(place), 1_000_000):
                yield batch.slice(at, len(texts)).filter(pa.array(model.scores(texts) >= least))

    return docs.mapInArrow(run, docs.schema)


def remainder(id_col: str, n: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), use=remainder("doc_id", 3) != 1)
    return score(docs, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
