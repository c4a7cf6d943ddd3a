"""Document fingerprints: a threshold-scaled sketch of the hashes of all character shingles below a fixed fraction.

The threshold is the same for all documents, so sketches of parts merge by union, and the share of one document's hashes
that another has estimates containment, however unequal the two are.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points of a shingle (a power of two), and how many hashes one is kept of (likewise).
SHINGLE, ONE_OF = 16, 16
#: Code points that are hashed at a time.
BLOCK = 1_000_000
BASE, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def sketches(texts: list[str]) -> list[np.ndarray]:
    """For each text the ascending 32-bit values of its kept shingle hashes.

    A text shorter than a shingle is one shingle. A text of which no hash is below the threshold keeps its least one, so that
    only the empty text has an empty sketch.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
    bits = ONE_OF.bit_length() - 1
    down = np.uint64(64 - bits - 32)
    if len(codes) >= SHINGLE:
        h, n = codes.astype(np.uint64) * MIX, 1
        while n < SHINGLE:
            h = h[: len(h) - n] * np.uint64(pow(BASE, n, 1 << 64)) + h[n:]
            n *= 2
        h ^= h >> np.uint64(32)
        h *= MIX
        h ^= h >> np.uint64(29)
        kept = np.flatnonzero(h < np.uint64(1 << (64 - bits)))
        doc = np.searchsorted(starts, kept, "right") - 1
        inside = kept + SHINGLE <= (starts + lengths)[doc]
        both = np.unique(doc[inside].astype(np.uint64) << np.uint64(32) | h[kept[inside]] >> down)
        owner = (both >> np.uint64(32)).astype(np.int64)
        values = both.astype(np.uint32)
        ends = np.searchsorted(owner, np.arange(len(texts) + 1))
        out = [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        for i in np.flatnonzero((np.diff(ends) == 0) & (lengths >= SHINGLE)):
            least = h[starts[i] : starts[i] + lengths[i] - SHINGLE + 1].min()
            out[i] = np.array([least >> np.uint64(32)], np.uint32)
    for i in np.flatnonzero((lengths > 0) & (lengths < SHINGLE)):
        out[i] = np.frombuffer(hashlib.blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=4).digest(), "<u4")
    return out


def fingerprint(text: str, sketch: np.ndarray) -> str:
    """The text's digest and its sketch in base64. Equal texts have equal fingerprints, and others differ."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest() + "." + base64.b64encode(sketch.astype("<u4").tobytes()).decode()


def sketch_of(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint.partition(".")[2]), "<u4")


def merged(*some: np.ndarray) -> np.ndarray:
    """The sketch of all shingles of several texts together."""
    return np.unique(np.concatenate(some))


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimates which share of a's shingles b has; 1 for an empty a."""
    return _shared(a, b) / len(a) if len(a) else 1.0


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Estimates the shared part of the shingles of both together; 1 for two empty sketches."""
    shared = _shared(a, b)
    return shared / (len(a) + len(b) - shared) if len(a) + len(b) else 1.0


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of every row's whole text; null is empty. Other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at, part in _parts(texts):
                found = [fingerprint(t, s) for t, s in zip(part, sketches(part), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(map(len, part), pa.int64()), pa.array(found, pa.string())], names=[id_col, "n_chars", "fingerprint"])

    schema = T.StructType([docs.schema[id_col], T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _parts(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK or i + 1 == len(texts):
            yield at, texts[at : i + 1]
            at, size = i + 1, 0


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of texts, and of the same with their last third replaced by the beginning of the next document.

    The next document is the one of the next lower id (of rows with one id: the next lower text; null ids and texts are the
    lowest, and null texts are empty), after the last the first. Of n_chars code points the last floor(n_chars / 3) are
    replaced by the next document's first as many, or by all that it has. Returns (id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next) for each row of docs, by resemblance of sketches. Whole texts move once,
    to about `parts` ranges of ids, each with a copy of the document that follows its last. A single document follows
    itself; an empty table gives no rows; other columns are left out; ids are integers.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or 4 * tasks
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.select("id")
    cuts = ids.approxQuantile("id", [i / parts for i in range(1, parts)], 1 / (8 * parts)) if parts > 1 else []
    bounds = np.unique(np.array(cuts or [], np.float64))

    @F.pandas_udf("int")
    def part_of(id_: pd.Series) -> pd.Series:
        """0 for the highest ids; nulls are in the last part."""
        found = len(bounds) - np.searchsorted(bounds, id_.fillna(-np.inf).to_numpy(np.float64))
        return pd.Series(found.astype("int32"))

    # What reaches the driver: the highest id of each part.
    first = sorted((r["part"], r["top"]) for r in ids.groupBy(part_of("id").alias("part")).agg(F.max("id").alias("top")).collect())
    follow = [(first[k - 1][0], top) for k, (_, top) in enumerate(first)]
    tops = spark.createDataFrame(follow, "part int, top long")
    after = rows.join(F.broadcast(tops), F.col("id").eqNullSafe(F.col("top"))).groupBy("part").agg(F.max("text").alias("text"))
    dealt = (
        rows.select(part_of("id").alias("part"), F.lit(0).alias("guest"), "id", "text")
        .unionByName(after.select("part", F.lit(1).alias("guest"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "text"))
        .repartition(tasks, "part")
        .sortWithinPartitions("part", "guest", F.col("id").desc_nulls_last(), F.col("text").desc())
        .select("guest", "id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held: list[tuple[int, int | None, str]] = []

        def told(rows: list[tuple[int, int | None, str]]) -> pa.RecordBatch:
            """Of all rows but the last and the guests: a guest is only what the row before it is compared with."""
            texts = [r[2] for r in rows]
            own = [i for i, r in enumerate(rows[:-1]) if not r[0]]
            edited = [texts[i][: len(texts[i]) - len(texts[i]) // 3] + texts[i + 1][: len(texts[i]) // 3] for i in own]
            a, b = sketches(texts), sketches(edited)
            columns = [
                pa.array([rows[i][1] for i in own], kind), pa.array([len(texts[i]) for i in own], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                pa.array([fingerprint(texts[i], a[i]) for i in own], pa.string()), pa.array([fingerprint(t, s) for t, s in zip(edited, b, strict=True)], pa.string()),
                pa.array([resemblance(a[i], s) for i, s in zip(own, b, strict=True)], pa.float64()), pa.array([resemblance(a[i], a[i + 1]) for i in own], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        size, kind = 0, None
        for batch in batches:
            kind = batch.column(1).type
            for guest, id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                held.append((guest, id_, text.as_py()))
                size += len(held[-1][2])
                if size >= BLOCK:
                    yield told(held)
                    held, size = held[-1:], len(held[-1][2])
        if len(held) > 1:
            yield told(held)

    text, number = T.StringType(), T.DoubleType()
    schema = T.StructType([docs.schema[id_col], T.StructField("n_chars", T.LongType()), *[T.StructField(n, t) for n, t in (("edited_sha256", text), ("fingerprint", text), ("edited_fingerprint", text), ("near_edited", number), ("near_next", number))]])
    return dealt.mapInArrow(run, schema)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
