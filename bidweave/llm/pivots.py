"""Embedding near-duplicates by a pivot-permutation index.

Pivots are vectors of a bounded sample that lie apart from each other, so a dense group has few of them and its members
have their nearest pivots in common, however many they are. A vector is described by its nearest pivots in order, and stands in one inverted
list for every two of them, so the vectors that meet in a list are those with two shared pivots at least. Long lists are
dealt out in blocks. Within a list, shared-pivot counts say which of the two vectors' common lists answers for them, and the
cosine in double precision decides. What leaves a list is a count a vector and links enough to connect what is linked.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.llm.components import components, contiguous, roots
from bidweave.session import written

#: The fewest and the most pivots of vectors of one size; between them there is one for every vector's square root.
PIVOTS, MOST_PIVOTS = 256, 8192
#: Nearest pivots that describe a vector, by the number of pivots: of random pairs in 64 dimensions at a cosine of 0.90, 0.976
#: share two of 6 nearest of 256, 0.970 of 7 of 1024, 0.956 of 8 of 4096.
NEAREST = [(512, 6), (2048, 7), (MOST_PIVOTS, 8)]
#: Distinct vectors that are drawn for every pivot that is chosen.
DRAWN = 16
#: Vectors of a list that one block holds, and those that are compared with all pivots at a time.
BLOCK, SOME = 512, 512


def _vector(v: list[float] | None) -> np.ndarray | None:
    """In double precision; None if it is null, zero, or has a null or non-finite component."""
    if v is None or any(x is None for x in v):
        return None
    a = np.array(v, np.float64) + 0.0
    return a if np.isfinite(a).all() and a.any() else None


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. They are scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _spread(drawn: np.ndarray, most: int, threshold: float) -> np.ndarray:
    """At most so many of the drawn unit vectors, each at least twice the threshold's angle from those before it.

    If there are too few of them, others follow that are at least the threshold's angle apart. Linked vectors are then never
    divided by many pivots of their own group.
    """
    chosen: list[int] = []
    for cosine in (2 * threshold**2 - 1 if threshold > 0 else threshold, threshold):
        if len(chosen) >= most:
            break
        # In blocks: all drawn vectors against all chosen ones are 16 numbers for every two pivots.
        free = np.concatenate([(drawn[k : k + SOME] @ drawn[chosen].T < cosine).all(axis=1) for k in range(0, len(drawn), SOME)])
        while len(chosen) < most and free.any():
            chosen.append(int(free.argmax()))
            free &= drawn @ drawn[chosen[-1]] < cosine
            free[chosen[-1]] = False
    return drawn[chosen]


def _nearest(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The numbers of each row's k nearest pivots, ascending."""
    if k >= len(pivots):
        return np.tile(np.arange(len(pivots)), (len(x), 1))
    return np.sort(np.argpartition(x @ pivots.T, len(pivots) - k, axis=1)[:, len(pivots) - k :], axis=1)


def _pairs(nearest: np.ndarray) -> np.ndarray:
    """The list of every two of a row's ascending pivots, as one number each."""
    return np.stack([nearest[:, i].astype(np.int64) << 32 | nearest[:, j] for i, j in combinations(range(nearest.shape[1]), 2)], axis=1)


def _alone(nearest: np.ndarray) -> np.ndarray:
    """The list of a single pivot."""
    return nearest[:, 0].astype(np.int64) << 32 | nearest[:, 0]


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of ascending pivots: the list of the two smallest that both have, which exist. With one pivot there is one list."""
    if a.shape[1] < 2:
        return _alone(a)
    shared = (a[:, :, None] == b[:, None, :]).any(axis=2)
    order = np.argsort(~shared, axis=1, kind="stable")[:, :2]
    first = np.take_along_axis(a, order, axis=1).astype(np.int64)
    return first[:, 0] << 32 | first[:, 1]


def _judged(lists: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Lists' blocks, each contiguous: (node, linked, null) counts and (node, null, other) links."""

    def of_block(block: pa.Table) -> pd.DataFrame | None:
        key = block.column("key")[0].as_py()
        nodes, copies = block.column("node").to_numpy(), block.column("copies").to_numpy()
        x = _unit(np.stack([np.frombuffer(v.as_buffer(), np.float64) for c in block.column("vector").chunks for v in c]))
        nearest = np.stack([np.frombuffer(v.as_buffer(), np.int32) for c in block.column("nearest").chunks for v in c])
        second = block.column("second").to_numpy()
        if block.column("i")[0].as_py() == block.column("j")[0].as_py():
            rows, columns = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        else:
            a, b = np.flatnonzero(second == 0), np.flatnonzero(second == 1)
            if not len(a) or not len(b):
                return None
            rows, columns = np.nonzero(x[a] @ x[b].T >= threshold)
            rows, columns = a[rows], b[columns]
        if not len(rows):
            return None
        # A pair counts in the first of its lists alone.
        own = np.concatenate([_first_shared(nearest[rows[k : k + 20_000]], nearest[columns[k : k + 20_000]]) for k in range(0, len(rows), 20_000)]) == key
        counts = np.bincount(rows[own], copies[columns[own]], len(nodes)) + np.bincount(columns[own], copies[rows[own]], len(nodes))
        root = roots(len(nodes), rows, columns)
        some, tied = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(nodes)))
        return pd.concat([pd.DataFrame({"node": nodes[some], "linked": counts[some].astype("int64")}), pd.DataFrame({"node": nodes[tied], "other": nodes[root[tied]]})])

    for block in contiguous(lists, ["key", "i", "j"]):
        if (found := of_block(block)) is not None:
            out = found.reindex(columns=["node", "linked", "other"])
            yield pa.RecordBatch.from_pandas(out, pa.schema([("node", pa.int64()), ("linked", pa.int64()), ("other", pa.int64())]), preserve_index=False)


@dataclass(frozen=True)
class Points:
    """The pivots of vectors of one size, their first number, and how many nearest ones describe a vector."""

    points: np.ndarray
    first: int
    nearest: int


def _index(rows: DataFrame, threshold: float, pivots: int | None, nearest: int | None) -> dict[int, Points]:
    """Pivots for each size of vectors, from DRAWN distinct ones a pivot. Their numbers differ, so lists hold one size alone."""
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    there = rows.where(fine)
    sizes = {r["size"]: r["n"] for r in there.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).collect()}
    index, first = {}, 0
    for size, n in sorted(sizes.items()):
        most = pivots or min(MOST_PIVOTS, max(PIVOTS, math.isqrt(n)))
        sample = there.where(F.size("vector") == size).select("vector").distinct().orderBy(F.xxhash64("vector"), "vector").limit(DRAWN * most).toArrow()
        points = _spread(_unit(np.array(sample.column("vector").combine_chunks().flatten()).reshape(-1, size)), most, threshold)
        index[size] = Points(points, first, min(len(points), nearest or next(k for top, k in NEAREST if len(points) <= top)))
        first += len(points)
    return index


def near_vectors(vectors: DataFrame, *, threshold: float = 0.9, pivots: int | None = None, nearest: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for each row of vectors.

    Rows of one size are linked where their cosine is at least the threshold, of those that share two of their nearest pivots;
    equal vectors always are. With pivots=1 there is one list, whose blocks hold every pair: that is the exact way, at the price
    of all pairs. n_links counts the other rows linked directly, component_id is the smallest id that links lead
    to, and kept marks the row whose id that is. Vectors that are null, zero, or hold null or non-finite components link with
    nothing. Ids are unique 64-bit integers; repeated rows count as copies of each other. An empty table gives no rows; other
    columns are left out. Each size of vectors has its own pivots, as many as the square root of its vectors, from PIVOTS to
    MOST_PIVOTS, if their number isn't given. What reaches the driver is DRAWN vectors a pivot. Outside dense groups a list
    has about a vector in pivots ** 2 / nearest ** 2. A dense group shares its lists, so all its pairs are compared, as n_links
    counts them; a pair that meets in several lists counts in the first, and to know which costs more than to multiply.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    index = _index(rows, threshold, pivots, nearest)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SOME):
                part = batch.slice(at, SOME)
                found = [_vector(v) for v in part.column(1).to_pylist()]
                digests, packed, near = ([None] * len(found) for _ in range(3))
                for size, of in index.items():
                    there = [i for i, v in enumerate(found) if v is not None and len(v) == size]
                    if not there:
                        continue
                    x = np.stack([found[i] for i in there])
                    order = (_nearest(_unit(x), of.points, of.nearest) + of.first).astype(np.int32)
                    for i, v, o in zip(there, x, order, strict=True):
                        digests[i], packed[i], near[i] = hashlib.blake2b(v.tobytes(), digest_size=16).digest(), v.tobytes(), o.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.binary()) for c in (digests, packed, near))], names=["id", "digest", "vector", "nearest"])

    table = written(rows.mapInArrow(signed, "id long, digest binary, vector binary, nearest binary"), "vectors")
    classes = table.where("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector"), F.first("nearest").alias("nearest"))
    classes = written(classes, "classes")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [np.frombuffer(v.as_buffer(), np.int32) for v in batch.column(1)]
            sizes = np.array([len(x) for x in near], np.int64)
            for k in np.unique(sizes):
                rows = np.flatnonzero(sizes == k)
                some = np.stack([near[i] for i in rows])
                keys = _pairs(some) if k > 1 else _alone(some)[:, None]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy()[rows], keys.shape[1])), pa.array(keys.ravel())], names=["node", "key"])

    lists = classes.select("node", "nearest").mapInArrow(listed, "node long, key long")
    long = lists.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select((F.col("key") + F.lit(0)).alias("list"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        lists.join(long, F.col("key") == F.col("list")).withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("second"))
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    full = dealt.join(classes.drop("digest"), "node").repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    judged = written(full.select("key", "i", "j", "second", "node", "copies", "vector", "nearest").mapInArrow(lambda b: _judged(b, threshold), "node long, linked long, other long"), "judged")

    labels = components(judged.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = judged.where("linked IS NOT NULL").groupBy("node").agg(F.sum("linked").alias("linked"))
    known = classes.select("digest", "node", "copies").join(counts, "node", "left").join(labels, "node", "left")
    known = known.select(F.concat("digest", F.lit(b"")).alias("class"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("linked"), F.coalesce("component", "node").alias("component"))
    found = table.select("id", "digest").join(known, F.col("digest") == F.col("class"), "left")
    component = F.coalesce("component", "id")
    return found.select(F.col("id").cast(vectors.schema[id_col].dataType).alias(id_col), F.coalesce("linked", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))


def op4_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
