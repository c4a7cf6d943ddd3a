"""Connected components of links, by alternating large-star and small-star steps on written tables.

Links are contracted within their partitions first, then within as few partitions of EACH as hold what is left. A step replaces
links by ones to smaller nodes, as minima that Spark aggregates before it shuffles; it ends when the links are stars around the
smallest node of each component, as they are at once where one partition held them all. What is known of components may be given
as links, so that only what is new takes steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidweave.session import written

#: Links that one task contracts: some 50 MB of its memory.
EACH = 200_000


def contiguous(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal integer keys, of batches that are sorted by them."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None or not len(held) else pa.concat_tables([held, table]).combine_chunks()
        marks = np.stack([held.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield held.slice(a, b - a)
        held = held.slice(cuts[-1])
    if held is not None and len(held):
        yield held


def roots(n: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The smallest of the numbers below n that each is connected to by the links (rows[i], columns[i])."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[rows], root[columns])
        new = root.copy()
        np.minimum.at(new, root[rows], least)
        np.minimum.at(new, root[columns], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _contracted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's links as stars around the smallest node of each of its own components."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    for part in parts:
        for a, b in zip(part["u"].tolist(), part["v"].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
                root.setdefault(min(a, b), min(a, b))
    nodes = [x for x in root if find(x) != x]
    for at in range(0, len(nodes), 50_000):
        some = nodes[at : at + 50_000]
        yield pd.DataFrame({"u": some, "v": [find(x) for x in some]})


def _apart(minima: DataFrame) -> DataFrame:
    """The same rows, keyed by an expression: a join then deals out both of its sides, and Spark can split a large key."""
    return minima.select((F.col("u") + F.lit(0)).alias("key"), "least")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node links to one smaller node at most, and none that does is linked to."""
    up = edges.select(F.col("u").alias("node"), F.col("v").alias("to"), F.lit(False).alias("linked"))
    down = edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("to"), F.lit(True).alias("linked"))
    ends = up.unionByName(down).groupBy("node").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.max("linked").alias("linked"))
    return ends.where("low < high OR (low IS NOT NULL AND linked)").agg(F.count("*")).first()[0] == 0


def components(links: DataFrame, a: str = "a", b: str = "b", *, most_rounds: int = 60, each: int = EACH) -> DataFrame:
    """(node, component) for every node of a link to another: component is the smallest node that links lead to.

    links: pairs of 64-bit integers, in any order, repeated or not; those with a null and those of a node with itself are
    ignored. No links give no rows. A task contracts `each` links about.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = written(edges.mapInPandas(_contracted, "u long, v long"), "links")
    parts = max(1, math.ceil(edges.count() / each))
    edges = written(edges.coalesce(parts).mapInPandas(_contracted, "u long, v long").distinct(), "links")
    for _ in range(most_rounds):
        if parts == 1 or _are_stars(edges):
            break
        # Large star: what is larger than a node and next to it links to the smallest node next to it.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _apart(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least")))
        large = written(both.where("v > u").join(least, F.col("u") == F.col("key")).select(F.col("v").alias("u"), F.col("least").alias("v")), "links")
        # Small star: a node and what is smaller and next to it link to the smallest of these.
        least = _apart(large.groupBy("u").agg(F.min("v").alias("least")))
        near = large.join(least, F.col("u") == F.col("key"))
        small = near.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select(F.col("key").alias("u"), F.col("least").alias("v")))
        edges = written(small.distinct(), "links")
    else:
        if not _are_stars(edges):
            raise RuntimeError(f"components are not connected after {most_rounds} rounds")
    edges = edges.coalesce(parts)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
