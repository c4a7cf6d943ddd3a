"""Hard negatives by a distributed nearest-neighbour join over Voronoi cells.

The greatest inner product is the least distance once every row has one component more, which lifts all rows to the largest
norm (an anchor's is 0). Rows and anchors are assigned to the nearest of some pivots. A round knows how near a row must be to
serve each anchor; the bounds of a cell's anchors against every pivot then say which cells a row might serve, and it is copied to
the anchors of those alone. There a local join compares anchors with rows in blocks, exactly, and keeps the best of each.

Rounds: rows of an anchor's own cell give its positives so far and with them a radius; the rows within that radius have the
positives; and the least score that a negative may have is the radius of the last round. Where bounds tell little, as among vectors of many
dimensions that are all far from each other, a row would go to most cells: cells are then merged into few groups, to which it goes once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidweave.llm.components import contiguous
from bidweave.session import written

#: Most pivots of vectors of one size, and anchors of one group: what the driver and a task hold of them is bounded at every size.
PIVOTS, GROUP = 64, 8192
#: Rows of the samples that pivots are chosen from and bounds are tried on; the fewest rows of a slice; and scores that a block has.
SAMPLE, SLICE, SCORES = 2048, 4096, 2_000_000
#: The share of cells that a row goes to from which cells are merged.
MOST_CELLS = 0.5
ROWS = "key int, slice int, kind int, id long, label long, vector binary, near binary"


def _packed(v: list | None, scale: float) -> bytes | None:
    """Whole parts of 1 / scale of the components, as 2 bytes each where that holds them, else 8; None for what takes no part."""
    if not v or any(x is None for x in v):
        return None
    a = np.array(v, np.float64)
    with np.errstate(all="ignore"):
        a = np.floor(a * scale)
        if not np.isfinite(a @ a):
            return None
    return (a.astype("<i2") if np.abs(a).max() < 32768 else a.astype("<f8")).tobytes()


def _unpacked(values: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """One row of doubles for each packed vector of so many components."""
    out = np.empty((len(values), size))
    for i, v in enumerate(values):
        raw = v.as_buffer()
        out[i] = np.frombuffer(raw, "<i2" if raw.size == 2 * size else "<f8")
    return out


@dataclass(frozen=True)
class Cells:
    """Pivots of the vectors of one size, in one dimension more; the squared largest norm; and each cell's anchors, first group and
    number of groups."""

    size: int
    pivots: np.ndarray
    top: float
    rows: int
    anchors: np.ndarray
    first: np.ndarray
    groups: np.ndarray

    def lifted(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        more = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.top - np.einsum("ij,ij->i", x, x), 0))
        return np.concatenate([x, more[:, None]], axis=1)

    def distances(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        """From each row to each pivot."""
        y = self.lifted(x, anchors)
        return np.sqrt(np.maximum(np.einsum("ij,ij->i", y, y)[:, None] + np.einsum("ij,ij->i", self.pivots, self.pivots)[None] - 2 * y @ self.pivots.T, 0))

    def slices(self) -> int:
        return max(1, -(-self.rows // max(SLICE, 8 * min(GROUP, self.rows // 100))))


def _apart(drawn: np.ndarray, most: int) -> np.ndarray:
    """At most so many of the rows, each the furthest from those before it."""
    chosen, far = [0], np.linalg.norm(drawn - drawn[0], axis=1)
    while len(chosen) < most and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(drawn - drawn[chosen[-1]], axis=1))
    return drawn[chosen]


def _cells(ready: DataFrame, pivots: int | None, group: int) -> list[Cells]:
    """Cells for each size of vectors that anchors have. What reaches the driver: a row a size, a sample of anchors, a count a cell."""
    sizes = ready.groupBy("size").agg(F.max("norm").alias("top"), F.count("*").alias("rows"), F.count_if("anchor").alias("anchors")).where("anchors > 0").orderBy("size").collect()
    out, first = [], 0
    for r in sizes:
        size, most = r["size"], pivots or max(1, min(PIVOTS, math.isqrt(r["anchors"])))
        sample = ready.where(F.col("anchor") & (F.col("size") == size)).select("vector").distinct().orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).toArrow()
        none = np.zeros(1, int)
        bare = Cells(size, np.zeros((1, size + 1)), r["top"], r["rows"], none, none, none)
        bare = Cells(size, _apart(bare.lifted(_unpacked(sample.column("vector"), size), True), most), r["top"], r["rows"], none, none, none)

        def nearest(batches: Iterator[pa.RecordBatch], cells: Cells = bare) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(cells.distances(_unpacked(batch.column(0), cells.size), True).argmin(axis=1))], names=["cell"])

        counts = np.zeros(len(bare.pivots), int)
        for c in ready.where(F.col("anchor") & (F.col("size") == size)).select("vector").mapInArrow(nearest, "cell long").groupBy("cell").count().collect():
            counts[c["cell"]] = c["count"]
        groups = -(-counts // group)
        out.append(Cells(size, bare.pivots, r["top"], r["rows"], counts, first + np.cumsum(groups) - groups, groups))
        first += int(groups.sum())
    return out


def _grouped(anchors: DataFrame, cells: list[Cells]) -> DataFrame:
    """Anchors with the key of their group: their cell's, dealt out by id where a cell has several."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.full(len(batch), -1)
            sizes, spread = batch.column("size").to_numpy(), batch.column("spread").to_numpy()
            for c in cells:
                mine = np.flatnonzero(sizes == c.size)
                if len(mine):
                    cell = c.distances(_unpacked(batch.column("vector").take(pa.array(mine)), c.size), True).argmin(axis=1)
                    at[mine] = c.first[cell] + spread[mine] % c.groups[cell]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("size"), batch.column("vector"), pa.array(at, pa.int32())], names=["id", "label", "size", "vector", "key"])

    rows = anchors.select("id", "label", "size", "vector", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("spread"))
    return rows.mapInArrow(assign, "id long, label long, size int, vector binary, key int")


def _bounds(known: DataFrame, cells: list[Cells]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each size: (cells, pivots) how far from a pivot a row may be, at least and at most, to serve some anchor of a cell.

    known: size, key, vector and least, the least score that serves the anchor; null if all do, infinite if none does. What reaches
    the driver is a number for every two pivots.
    """
    cell_of = {c.size: np.repeat(np.arange(len(c.pivots)), c.groups) for c in cells}

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = {c.size: np.full((len(c.pivots),) * 2, np.inf) for c in cells}
        high = {c.size: np.full((len(c.pivots),) * 2, -np.inf) for c in cells}
        for batch in batches:
            sizes, least = batch.column("size").to_numpy(), batch.column("least").to_numpy(zero_copy_only=False)
            for c in cells:
                mine = np.flatnonzero((sizes == c.size) & ~(least == np.inf))
                if not len(mine):
                    continue
                x = _unpacked(batch.column("vector").take(pa.array(mine)), c.size)
                far, score = c.distances(x, True), least[mine]
                radius = np.sqrt(np.maximum(np.einsum("ij,ij->i", x, x) + c.top - 2 * np.where(np.isnan(score), 0, score), 0))
                radius = np.where(np.isnan(score), np.inf, radius * (1 + 1e-9) + 1e-6 * math.sqrt(c.top + 1))[:, None]
                cell = cell_of[c.size][batch.column("key").to_numpy()[mine] - c.first[0]]
                np.minimum.at(low[c.size], cell, far - radius)
                np.maximum.at(high[c.size], cell, far + radius)
        for c in cells:
            cell, pivot = np.nonzero(high[c.size] > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), c.size, np.int32)), pa.array(cell), pa.array(pivot), pa.array(low[c.size][cell, pivot]), pa.array(high[c.size][cell, pivot])], names=["size", "cell", "pivot", "low", "high"])

    out = {c.size: (np.full((len(c.pivots),) * 2, np.inf), np.full((len(c.pivots),) * 2, -np.inf)) for c in cells}
    found = known.select("size", "key", "vector", "least").mapInArrow(limits, "size int, cell long, pivot long, low double, high double")
    for r in found.groupBy("size", "cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        low, high = out[r["size"]]
        low[r["cell"], r["pivot"]], high[r["cell"], r["pivot"]] = r["low"], r["high"]
    return out


def _served(far: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(rows, cells): whether a row may serve some anchor of a cell, by its distances to all pivots."""
    low, high = bounds
    return ((far[:, None] >= low[None]) & (far[:, None] <= high[None])).all(axis=2)


def _merged(ready: DataFrame, cells: list[Cells], bounds: dict, group: int) -> np.ndarray:
    """The group that each group's anchors join: itself, or with others one of `group` anchors at most, where rows of a sample would go to
    most of the cells. What reaches the driver is the sample."""
    to = np.arange(sum(int(c.groups.sum()) for c in cells))
    for c in cells:
        sample = ready.where(F.col("size") == c.size).select("id", "vector").orderBy(F.xxhash64("id"), "vector").limit(SAMPLE).toArrow()
        there = np.flatnonzero(c.groups)
        if _served(c.distances(_unpacked(sample.column("vector").combine_chunks(), c.size), False), bounds[c.size])[:, there].mean() < MOST_CELLS:
            continue
        into, held = -1, group
        for cell in there:
            if c.groups[cell] > 1:
                continue
            if held + c.anchors[cell] > group:
                into, held = c.first[cell], 0
            to[c.first[cell]] = into
            held += c.anchors[cell]
    return to


def _routed(ready: DataFrame, cells: list[Cells], bounds: dict | None, to: np.ndarray) -> DataFrame:
    """Rows once for every group that they might serve; without bounds, their own cell's alone. to: the group that a group has joined."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 256
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                sizes, spread = part.column("size").to_numpy(), part.column("spread").to_numpy()
                rows, keys, slices = [], [], []
                for c in cells:
                    mine = np.flatnonzero(sizes == c.size)
                    if not len(mine):
                        continue
                    far = c.distances(_unpacked(part.column("vector").take(pa.array(mine)), c.size), False)
                    serves = np.arange(len(c.pivots))[None] == far.argmin(axis=1)[:, None] if bounds is None else _served(far, bounds[c.size])
                    row, cell = np.nonzero(serves & (c.groups > 0)[None])
                    times = c.groups[cell]
                    row = np.repeat(row, times)
                    within = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    once = np.unique(row.astype(np.int64) << 32 | to[np.repeat(c.first[cell], times) + within])
                    rows.append(mine[once >> 32])
                    keys.append(once & 0xFFFFFFFF)
                    slices.append(spread[rows[-1]] % c.slices())
                if rows and sum(map(len, rows)):
                    take = part.take(pa.array(np.concatenate(rows)))
                    n = len(take)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys), pa.int32()), pa.array(np.concatenate(slices), pa.int32()), pa.array(np.ones(n, np.int32)), take.column("id"), take.column("label"), take.column("vector"), pa.nulls(n, pa.binary())],
                        names=["key", "slice", "kind", "id", "label", "vector", "near"],
                    )

    rows = ready.select("id", "label", "size", "vector", F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 30)).alias("spread"))
    return rows.mapInArrow(route, ROWS)


class _Best:
    """The best rows so far of each of n lists: by score, then by smaller id. Rows come by ascending ids."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.of = [np.zeros(0, t) for t in (np.int64, np.float64, np.int64)]

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(lists):
            return
        lists, scores, ids = (np.concatenate(x) for x in zip(self.of, (lists, scores, ids), strict=True))
        order = np.lexsort((ids, -scores, lists))
        lists, scores, ids = lists[order], scores[order], ids[order]
        start = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
        place = np.arange(len(lists)) - np.repeat(start, np.diff(np.r_[start, len(lists)]))
        last = place == self.k - 1
        self.least[lists[last]] = scores[last]
        keep = place < self.k
        self.of = [lists[keep], scores[keep], ids[keep]]


def _met(batches: Iterator[pa.RecordBatch], cells: list[Cells], k: int, low: int, high: int, negatives: bool) -> Iterator[pa.RecordBatch]:
    """The local join of groups' slices: a group's anchors come first, and its rows follow by id.

    Positives: (anchor, other, score) of the k best rows with the anchor's label. Negatives, for each positive in the anchor's `near`:
    (anchor, positive, other, score) of the k best rows of other labels within its range.
    """
    starts = [(int(c.first[0]), c.size) for c in cells]

    class Group:
        def __init__(self, table: pa.Table):
            key = table.column("key")[0].as_py()
            self.where = (key, table.column("slice")[0].as_py())
            self.size = next(size for first, size in reversed(starts) if first <= key)
            self.ids, self.labels = table.column("id").to_numpy(), table.column("label").to_numpy()
            self.x = _unpacked(table.column("vector").combine_chunks(), self.size)
            if negatives:
                near = [np.frombuffer(v.as_buffer(), [("id", "<i8"), ("score", "<f8")]) for v in table.column("near").combine_chunks()]
                most = max(map(len, near))
                self.positive, self.score = np.full((most, len(near)), -1, np.int64), np.full((most, len(near)), np.nan)
                for i, n in enumerate(near):
                    self.positive[: len(n), i], self.score[: len(n), i] = n["id"], n["score"]
                # Whole scores within the range: 100 * negative from low * positive to high * positive.
                self.floor, self.ceiling = np.ceil(self.score * low / 100), np.floor(self.score * high / 100)
                self.best = _Best(self.score.size, k)
            else:
                self.best = _Best(len(self.ids), k)

        def meet(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
            scores = self.x @ x.T
            same = self.labels[:, None] == labels[None]
            if negatives:
                n = len(self.ids)
                for j in range(len(self.score)):
                    # Lists that are full take better scores alone, as their ties have smaller ids.
                    least = self.best.least[j * n : (j + 1) * n]
                    fits = ~same & (scores <= self.ceiling[j][:, None]) & (scores >= self.floor[j][:, None]) & (scores > least[:, None])
                    rows, columns = np.nonzero(fits)
                    self.best.add(rows + j * n, scores[rows, columns], ids[columns])
            else:
                fits = same & (scores > self.best.least[:, None]) & (self.ids[:, None] != ids[None])
                rows, columns = np.nonzero(fits)
                self.best.add(rows, scores[rows, columns], ids[columns])

        def result(self) -> pa.RecordBatch:
            lists, scores, others = self.best.of
            anchor = self.ids[lists % len(self.ids)]
            positive = self.positive.ravel()[lists] if negatives else np.zeros(len(lists), np.int64)
            value = self.score.ravel()[lists] if negatives else np.zeros(len(lists))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (anchor, positive, value, others, scores)], names=["anchor", "positive", "positive_score", "other", "score"])

    group = None
    for table in contiguous(_small(batches), ["key", "slice", "kind"]):
        where = (table.column("key")[0].as_py(), table.column("slice")[0].as_py())
        if table.column("kind")[0].as_py() == 0:
            if group is not None:
                yield group.result()
            group = Group(table)
        elif group is not None and group.where == where:
            step = max(64, SCORES // len(group.ids))
            for at in range(0, len(table), step):
                part = table.slice(at, step)
                group.meet(part.column("id").to_numpy(), part.column("label").to_numpy(), _unpacked(part.column("vector").combine_chunks(), group.size))
    if group is not None:
        yield group.result()


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches without what they have no rows of."""
    yield from (b for b in batches if len(b))


def _joined(rows: DataFrame, anchors: DataFrame, cells: list[Cells], to: np.ndarray, *, k: int, low: int = 0, high: int = 0, negatives: bool = False) -> DataFrame:
    """Rows and anchors of each group and slice, met in one place. anchors: id, label, vector, key and near."""
    slices = max(c.slices() for c in cells)
    tasks = min(20_000, len(np.unique(to)) * slices)

    def joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(0, "key", pa.array(to[batch.column(0).to_numpy()], pa.int32()))

    # Each group's anchors go to each of its slices.
    moved = anchors.select("key", "id", "label", "vector", "near").mapInArrow(joining, "key int, id long, label long, vector binary, near binary")
    copies = moved.select("key", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), "id", "label", "vector", "near")
    both = copies.unionByName(rows).repartition(max(1, tasks), "key", "slice").sortWithinPartitions("key", "slice", "kind", "id")
    return both.mapInArrow(lambda b: _met(b, cells, k, low, high, negatives), "anchor long, positive long, positive_score double, other long, score double")


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of what groups and slices found, by score and then smaller id; place counts from 1."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "other"))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, *, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, pivots: int | None = None, group: int = GROUP, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that `anchor` marks.

    Scores are inner products of whole parts of 1 / scale, exact below 2 ** 53. An anchor's positives are its best other rows of the
    same label; each positive's negatives are the best rows of other labels with low * positive_score <= 100 * score <= high *
    positive_score, rank counting from 1. Higher scores come first, ties by smaller id. A positive without negatives has no row.
    Rows with a null id or label, a null or empty vector, a null or non-finite component, or one whose square no double holds, take
    no part; vectors of different sizes don't meet. Ids are unique 64-bit integers; a row that is repeated is a candidate as often as it
    is there, an anchor counts once, and never meets its own id. Without anchors there are no rows. Other
    columns are left out.

    The join is exact whatever the bounds exclude. Where they exclude little, every row is compared with every anchor, as many as a
    group at a time: the work then grows with rows times anchors, and a row is copied once in GROUP anchors.
    """
    spark = vectors.sparkSession

    def valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [_packed(v, scale) for v in batch.column("vector").to_pylist()]
            at = [i for i, p in enumerate(packed) if p is not None]
            sizes = pc.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)[at].astype(int).tolist()
            norms = [float(x @ x) for x in (np.frombuffer(packed[i], "<i2" if len(packed[i]) == 2 * n else "<f8").astype(np.float64) for i, n in zip(at, sizes, strict=True))]
            take = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([take.column("id"), take.column("label"), take.column("anchor"), pa.array(sizes, pa.int32()), pa.array(norms, pa.float64()), pa.array([packed[i] for i in at], pa.binary())], names=["id", "label", "anchor", "size", "norm", "vector"])

    # Labels are only told apart: those that aren't whole numbers go by their hashes.
    whole = vectors.schema[label_col].dataType.typeName() in ("byte", "short", "integer", "long")
    label = F.col(label_col).cast("long") if whole else F.when(F.col(label_col).isNotNull(), F.xxhash64(label_col))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("vector"))
    ready = written(rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").mapInArrow(valid, "id long, label long, anchor boolean, size int, norm double, vector binary"), "vectors")
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    cells = _cells(ready, pivots, group)
    if not cells:
        return spark.createDataFrame([], out)
    # A repeated anchor counts once.
    alone = ready.where("anchor").groupBy("id").agg(F.min(F.struct("label", "size", "vector")).alias("a")).select("id", "a.*")
    anchors = written(_grouped(alone, cells).withColumn("near", F.lit(None).cast("binary")), "anchors")

    alone_in = np.arange(sum(int(c.groups.sum()) for c in cells))
    home = _first(_joined(_routed(ready, cells, None, alone_in), anchors, cells, alone_in, k=positives), ["anchor"], positives)
    least = home.groupBy("anchor").agg(F.when(F.count("*") >= positives, F.min("score")).alias("least"))
    known = anchors.join(least, F.col("id") == F.col("anchor"), "left").withColumn("least", F.col("least").cast("double"))
    bounds = _bounds(known, cells)
    to = _merged(ready, cells, bounds, group)
    found = written(_first(_joined(_routed(ready, cells, bounds, to), anchors, cells, to, k=positives), ["anchor"], positives), "positives")

    def near(part: pa.Table) -> pa.Table:
        near_rows = np.empty(len(part), [("id", "<i8"), ("score", "<f8")])
        near_rows["id"], near_rows["score"] = part.column("other").to_numpy(), part.column("score").to_numpy()
        score = near_rows["score"].min()
        # The least score that some positive lets a negative have; none if all are below zero.
        fits = near_rows["score"][near_rows["score"] >= 0]
        score = math.ceil(fits.min() * low / 100) if len(fits) else math.inf
        return pa.table({"anchor": [part.column("anchor")[0].as_py()], "near": pa.array([np.sort(near_rows, order="id").tobytes()], pa.binary()), "least": pa.array([score], pa.float64())})

    lists = found.select("anchor", "other", "score").groupBy("anchor").applyInArrow(near, "anchor long, near binary, least double")
    served = written(anchors.drop("near").join(lists, F.col("id") == F.col("anchor")).drop("anchor"), "served")
    bounds = _bounds(served, cells)
    to = _merged(ready, cells, bounds, group)
    last = _joined(_routed(ready, cells, bounds, to), served, cells, to, k=negatives, low=low, high=high, negatives=True)
    last = _first(last, ["anchor", "positive"], negatives)
    return last.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("place").cast("int").alias("rank"), F.col("other").alias("negative_id"), F.col("positive_score").cast("long").alias("positive_score"), F.col("score").cast("long").alias("negative_score"))


def op11_voronoi_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


#: Ranks and ranges of integer inner products; floors and products are exact in doubles.
OP11_SQL = """
WITH ready AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM ready AS a JOIN ready AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), ranked AS (
  SELECT p.anchor_id, p.other AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) AS INTEGER) AS rank,
         n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives AS p JOIN scores AS n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
)
SELECT * FROM ranked WHERE rank <= 5"""
