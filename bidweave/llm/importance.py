"""Importance resampling towards a target distribution, by hashed n-grams that word-id suffix arrays enumerate.

A block of texts becomes one array of word ids, and the suffixes of that array are sorted as far as an n-gram reaches. Suffixes
that begin with the same n-gram are then one run, whose borders are where the longest common prefix of neighbours is shorter. An
n-gram is hashed once a run, however often the block repeats it, and its bucket is scattered back to the positions of the
run. Corpus-wide counts of buckets give each bucket a gain, a document's weight is the sum of its positions' gains, and
the documents with the highest of the weights with Gumbel noise are drawn.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidweave.session import written

#: Words of UTF-8 text whose A-Z are lower-cased: what isn't an ASCII character other than a digit or letter.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of text that a block holds, but for the last text of it, which may be longer; and rows that a range of ranks has about.
BLOCK, RANGE = 4_000_000, 200_000


def suffix_order(ids: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ids in the order of their first `depth` ids, and how many each has in common with the one before it.

    ends: for each position, where its text ends. A suffix has the ids of its own text alone, and a shorter one comes first.
    """
    n = len(ids)
    padded = np.concatenate([ids, np.full(depth, -1, ids.dtype)])
    at = np.arange(n)
    columns = [np.where(at + k < ends, padded[k : n + k], -1) for k in range(depth)]
    order = np.lexsort(columns[::-1]) if depth > 1 else np.argsort(ids, kind="stable")
    common, open_ = np.zeros(n, np.int64), np.ones(max(n - 1, 0), bool)
    for column in columns:
        own = column[order]
        open_ &= (own[1:] == own[:-1]) & (own[1:] >= 0)
        common[1:] += open_
    return order, common


def gram_buckets(texts: list[bytes], n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, positions): the bucket of the n-gram of 1, 2, ... n words at each word of all texts after each other, -1 where there is
    none; the number of words of each text; and (n, texts): how many n-grams of each length a text has."""
    known: dict[bytes, int] = {}
    found = [WORD.findall(t.lower()) for t in texts]
    words = np.array([len(f) for f in found], np.int64)
    ids = np.array([known.setdefault(w, len(known)) for f in found for w in f], np.int64)
    spelled = list(known)
    ends = np.repeat(np.cumsum(words), words)
    order, common = suffix_order(ids, ends, n)
    out = []
    for k in range(1, n + 1):
        whole = ends[order] - order >= k
        # Suffixes too short for k words begin no run: they differ from both of their neighbours within the first k.
        first = np.flatnonzero(whole & (common < k))
        run = np.cumsum(whole & (common < k)) - 1
        hashed = np.array([zlib.crc32(b" ".join(spelled[i] for i in ids[p : p + k].tolist())) % buckets for p in order[first].tolist()], np.int64)
        at = np.full(len(ids), -1, np.int64)
        at[order[whole]] = hashed[run[whole]]
        out.append(at)
    return np.stack(out), words, np.stack([np.maximum(words - k, 0) for k in range(n)])


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose texts have BLOCK bytes together, or one text more."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        start = total = 0
        for i, size in enumerate(sizes.tolist()):
            total += size
            if total >= BLOCK:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < len(batch):
            yield batch.slice(start)


def features(docs: DataFrame, *, n: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, buckets) a row: the bucket of each n-gram of 1 to n consecutive words, repeats included, as packed
    16- or 32-bit numbers. A null text has none. Whole texts, in blocks of BLOCK bytes or one longer text."""
    kind = np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches, 1):
            texts = [b"" if not v.is_valid else v.as_buffer().to_pybytes() for v in part.column(1)]
            grams, words, counts = gram_buckets(texts, n, buckets)
            stops = np.cumsum(words)
            packed = []
            for i, (stop, size) in enumerate(zip(stops.tolist(), words.tolist(), strict=True)):
                packed.append(b"".join(grams[k, stop - size : stop - size + counts[k, i]].astype(kind).tobytes() for k in range(n)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words), pa.array(counts.sum(axis=0)), pa.array(packed, pa.binary())], names=["id", "n_words", "n_features", "buckets"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(found, f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_features long, buckets binary")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all rows of `features`. A task adds up its own; what reaches the driver is one sum a bucket."""
    kind = np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                sums += np.bincount(np.frombuffer(packed.as_buffer(), kind), minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("buckets").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray, *, scale: float = 1000.0) -> np.ndarray:
    """Each bucket's logarithm of its share of the target against its share of the raw corpus, both with one more occurrence, in whole parts of 1 / scale."""
    size, all_raw, all_target = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(scale * math.log((t + 1.0) * (all_raw + size) / ((s + 1.0) * (all_target + size)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weights(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """rows of `features` with weight, the sum of their buckets' gains, instead of buckets."""
    kind = np.dtype("<u2") if len(gain) <= 1 << 16 else np.dtype("<u4")

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gain[np.frombuffer(v.as_buffer(), kind)].sum()) for v in batch.column(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())], names=["id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(weighed, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: str, scale: float = 1000.0) -> Column:
    """Noise of a key, in whole parts of 1 / scale: the same for the same key and seed. A null key counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-scale) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column], *, each: int = RANGE) -> DataFrame:
    """rows with rank, from 1, by the order. Ranges of about `each` rows are ranked by themselves and follow each other."""
    parts = max(1, -(-rows.count() // each))
    # Written, as the borders of ranges are drawn from samples: a second run would draw others.
    ranges = written(rows.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    # One row a range.
    before = F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    sizes = ranges.groupBy("__range").agg(F.count("*").alias("n")).select(F.col("__range").alias("__r"), before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranges.withColumn("rank", place).join(F.broadcast(sizes), F.col("__range") == F.col("__r")).withColumn("rank", (F.col("rank") + F.col("__before")).cast("long")).drop("__range", "__r", "__before")


def resampled(docs: DataFrame, target: DataFrame, *, n: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) for each row of docs, of which `percent` of those with `least_words` words have a rank.

    Features are the runs of 1 to n words, repeats counted. Buckets' gains come from all rows of docs and of target. rank is 1, 2, 3, ...
    by score, ties by smaller id, and null for what isn't drawn. A null text has no words and weight 0. A null id has the noise of an empty
    one and comes first among ties; repeated rows count each. Empty docs give no rows; an empty target leaves every bucket to what
    docs lacks. Other columns are left out. Texts are read once: their buckets are written, 2 bytes a word.
    """
    rows = written(features(docs, n=n, buckets=buckets, id_col=id_col, text_col=text_col), "features")
    wanted = features(target.select(F.lit(0).alias("id"), F.col(target_text_col).alias("text")), n=n, buckets=buckets, id_col="id")
    gain = gains(bucket_counts(rows, buckets), bucket_counts(wanted, buckets))
    scored = written(weights(rows, gain).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "scores")
    most = percent * scored.where(F.col("n_words") >= least_words).count() // 100
    drawn = ranked(scored.where(F.col("n_words") >= least_words), [F.desc("score"), F.asc("id")])
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    out = drawn.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def op13_suffix_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Buckets are CRC-32 of the distinct words' UTF-8 bytes, by a table of 256 entries that the first expressions make.
OP13_SQL = """
WITH crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))
), found AS (
  SELECT 0 AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 1, NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), words AS (
  SELECT word, list_transform(range(CAST(len(hex(word)) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(word), 2 * i + 1, 2) AS BIGINT)) AS b FROM (SELECT DISTINCT word FROM found)
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM words, crc_table
), sizes AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM found JOIN hashed USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM sizes
), weights AS (
  SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM found JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN weights USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 10 * count(*) OVER () // 100 AS most FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank FROM scored LEFT JOIN ranked USING (doc_id)"""
