"""MinHash near-duplicates with odd sketches.

Each document's set of word shingles has MinHash samples, in bands, and an odd sketch: a bitmap in which every sample flips
one bit, so that the bits in which two sketches differ estimate high similarities. Documents that share a band are
candidates, sketches select among them, and full sets confirm.

Documents with equal sets are one class, and only classes are compared. Candidates of a band are paired with its smallest
class first: each class with the likeliest of these, then with the others that it is still apart from. Such pairs tie classes
into clusters. Classes of a band that are in different clusters compare their sketches in blocks: where few are alike, those
pairs are confirmed one by one; where many are, they tie their clusters together. Where a cluster is still apart, those outside
its largest part are compared with all of it, in blocks whose full sets meet as a product of matrices; what leaves a block is
links enough to connect what is linked. So groups of near copies are never expanded into all their pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.llm.components import components, contiguous, roots
from bidweave.session import written

#: Bands and samples in each: at a similarity of 0.8 a pair shares no band with a probability of 5 in a million.
BANDS, ROWS = 40, 6
#: 64-bit words of an odd sketch.
SKETCH = 8
#: Estimates below are not confirmed by default: six standard deviations (0.030 each) under a similarity of 0.8, where none of
#: 20,000 simulated pairs had one below 0.64.
LEAST_ESTIMATE = 0.62
#: Classes of a cluster that one block holds, and shingles that blocks are multiplied by at a time.
BLOCK, COLUMNS = 128, 4096
#: Classes of a band whose sketches one block holds, and the most pairs for each of them that are confirmed one by one.
SKETCHES, EACH = 1024, 2
#: Tasks that a large cluster is dealt to.
SALTS = 32

_rng = np.random.default_rng(20)
_A = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_C = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_D = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def shingles(text: str, n: int) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct n-word shingles, A-Z lower-cased, words parted by ASCII white space.

    Fewer words are one shingle; no word is the empty set.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    m = max(1, len(words) - n + 1)
    k = min(n, len(words))
    out = np.full(m, k, np.uint64)
    for i in range(k):
        out = _mixed(out ^ h[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(out)


def samples(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, (x[at : at + 512, None] * _A + _B).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    bands = (least.reshape(BANDS, ROWS).astype(np.uint64) * _C).sum(axis=1, dtype=np.uint64)
    return _mixed(bands + np.arange(BANDS, dtype=np.uint64) * _M1).view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    bit = (_mixed(least.astype(np.uint64) * _D + np.arange(len(least), dtype=np.uint64)) >> np.uint64(40)) % np.uint64(64 * SKETCH)
    odd = np.bincount(bit.astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def estimate(a: Column, b: Column) -> Column:
    """The similarity under which two odd sketches would differ in about as many bits as they do."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    bits, k = 64 * SKETCH, BANDS * ROWS
    return 1 + bits / (4 * k) * F.log(F.greatest(1 - 2 * differ / bits, F.lit(1e-9)))


def _signatures(n: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                sets = [shingles(t.as_py() or "", n) for t in part.column(1)]
                least = [samples(s) if len(s) else None for s in sets]
                columns = [
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if x is None else band_keys(x).tolist() for x in least], pa.list_(pa.int64())),
                    pa.array([None if x is None else odd_sketch(x).tolist() for x in least], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are alike enough."""
    other = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(other, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = shingles(x.as_py() or "", n), shingles(y.as_py() or "", n)
                shared = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * shared >= percent * (len(s) + len(t) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def alike(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of a are alike enough to which of b, from the exact sizes of all intersections."""
    sizes = np.array([len(s) for s in (*a, *b)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, column, count = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    # Shingles of one set alone are in no intersection.
    both = count[column] > 1
    owner, column = owner[both], np.unique(column[both], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (first, first + COLUMNS))
        there = np.zeros((len(sizes), COLUMNS), np.float32)
        there[owner[lo:hi], column[lo:hi] - first] = 1
        shared += there[: len(a)] @ there[len(a) :].T
    return 100 * shared >= percent * (sizes[: len(a), None] + sizes[None, len(a) :] - shared)


def _linked(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links enough to connect what is linked between the two sides of each block, or within its only side."""
    for block in contiguous(batches, ["cluster", "i", "j"]):
        second = block.column("second").to_numpy().astype(bool)
        a, b = np.flatnonzero(~second), np.flatnonzero(second)
        sets = [shingles(t.as_py() or "", n) for t in block.column("text")]
        one = block.column("i")[0].as_py() == block.column("j")[0].as_py()
        if one:
            b = a
        if not len(a) or not len(b):
            continue
        rows, columns = np.nonzero(alike([sets[k] for k in a], [sets[k] for k in b], percent))
        root = roots(len(sets), a[rows], b[columns])
        nodes, tied = block.column("node").to_numpy(), np.flatnonzero(root != np.arange(len(sets)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[root[tied]])], names=["a", "b"])


def _clusters_linked(classed: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links that are missing within the clusters of classed (node, cluster, part), where part is what is connected so far.

    All of a cluster but its largest part is compared with that part and with itself. Blocks of the largest part are
    numbered from 0, those of the rest from below -1 on.
    """
    parts = classed.groupBy("cluster", "part").agg(F.count("*").alias("n"))
    several = parts.groupBy("cluster").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all")).where("all > most")
    # A cluster may be large: its classes meet its figures in several tasks.
    several = several.withColumn("part_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("part_of", F.col("cluster").alias("of"), "main", F.ceil(F.col("most") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("rests"))
    rows = classed.join(several, (F.col("cluster") == F.col("of")) & (F.pmod(F.xxhash64("node"), F.lit(SALTS)) == F.col("part_of")))
    in_main = F.col("part") == F.col("main")
    own = F.when(in_main, F.pmod(F.xxhash64("node"), "mains")).otherwise(-1 - F.pmod(F.xxhash64("node"), "rests")).cast("int")
    rests = F.transform(F.sequence(F.lit(1), F.col("rests")), lambda k: -k)
    others = F.when(in_main, rests).otherwise(F.concat(rests, F.sequence(F.lit(0), F.col("mains") - 1)))
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(others)).select("cluster", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("second"))
    tasks = int(classed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = dealt.join(texts, "node").repartition(tasks, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return full.select("cluster", "i", "j", "second", "node", "text").mapInArrow(lambda b: _linked(b, n, percent), "a long, b long")


def _alike_sketches(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Of each block of a band, pairs (a, b) of different clusters whose sketches are alike.

    tie: there are many, and what is given connects all that are. Else these are all of them, to be confirmed.
    """
    bits = 64 * SKETCH
    # The most bits in which sketches differ that are alike enough.
    most = int(bits / 2 * (1 - np.exp((least - 1) * 4 * BANDS * ROWS / bits)) + 1e-9) if least > 0 else bits
    for block in contiguous(batches, ["key", "i", "j"]):
        second = block.column("second").to_numpy().astype(bool)
        nodes, clusters = block.column("node").to_numpy(), block.column("of_node").to_numpy()
        one = block.column("i")[0].as_py() == block.column("j")[0].as_py()
        a = np.arange(len(nodes)) if one else np.flatnonzero(~second)
        b = a if one else np.flatnonzero(second)
        if not len(a) or not len(b):
            continue
        sketches = block.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, SKETCH).view(np.uint8)
        ones = np.unpackbits(sketches, axis=1).astype(np.float32)
        there = ones.sum(axis=1)
        # Bits in which two differ: those of one and those of the other, less twice the common ones.
        differ = there[a][:, None] + there[b][None, :] - 2 * (ones[a] @ ones[b].T)
        near = (differ <= most) & (clusters[a][:, None] != clusters[b][None, :])
        if one:
            near = np.triu(near, 1)
        x, y = np.nonzero(near)
        x, y = a[x], b[y]
        tie = len(x) > EACH * len(nodes)
        if tie:
            root = roots(len(nodes), x, y)
            x = np.flatnonzero(root != np.arange(len(nodes)))
            y = root[x]
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(nodes[x], nodes[y])), pa.array(np.maximum(nodes[x], nodes[y])), pa.array(np.full(len(x), tie))], names=["a", "b", "tie"])


def _bands_compared(banded: DataFrame, least: float) -> DataFrame:
    """(a, b, tie) of banded (key, node, of_node, sketch): the bands' classes are dealt out in blocks, every two of which meet."""
    tasks = int(banded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = banded.groupBy("key").agg(F.ceil(F.count("*") / SKETCHES).cast("int").alias("blocks")).select((F.col("key") + F.lit(0)).alias("band"), "blocks")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        banded.join(sizes, F.col("key") == F.col("band")).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "node", "of_node", "sketch", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("second"))
    )
    return dealt.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lambda rows: _alike_sketches(rows, least), "a long, b long, tie boolean")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, least_estimate: float | None = LEAST_ESTIMATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs.

    Documents are linked where 100 * shared >= percent * all, of the distinct `shingle`-word shingles of their whole texts.
    component_id is the smallest id that links lead to and kept marks the row whose id it is. Texts without words (null,
    empty, white space) have no shingles, are linked with nothing, and stay. Repeated rows are linked, and of one id all
    have the same result; ids are 64-bit integers and rows of one id have one text. An empty table gives no rows; other
    columns are left out. percent below 80 would need more bands than there are. Candidates whose sketches estimate less than
    `least_estimate` are left out; None confirms every two that share a band on their full sets.
    """
    if percent < 80:
        raise ValueError("the bands are made for similarities of 0.8 and more")
    least = 0.0 if least_estimate is None else least_estimate
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = written(rows.mapInArrow(_signatures(shingle, ["id", "n", "digest", "keys", "sketch"]), "id long, n long, digest binary, keys array<long>, sketch array<long>"), "signatures")

    # Classes of equal sets, named by their smallest id.
    classes = signed.where("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("node"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = written(classes, "classes")
    sketches = classes.select("node", "sketch")
    members = classes.select("node", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").select((F.col("key") + F.lit(0)).alias("band"), "first")
    shared = written(members.join(shared, F.col("key") == F.col("band")).select("key", "node", "first"), "bands")

    def likely(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b), those that their sketches don't rule out, with the estimate."""
        with_a = pairs.join(sketches.withColumnsRenamed({"node": "a", "sketch": "sketch_a"}), "a")
        with_b = with_a.join(sketches.withColumnsRenamed({"node": "b", "sketch": "sketch_b"}), "b")
        return with_b.select("a", "b", estimate(F.col("sketch_a"), F.col("sketch_b")).alias("estimate")).where((F.col("estimate") >= least) | F.lit(least <= 0))

    def labelled(pairs: DataFrame, labels: DataFrame, *ends: str) -> DataFrame:
        """With the component of each end: the node itself if it has no links."""
        for end in ends:
            pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
        return pairs

    first_pairs = written(likely(shared.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()), "pairs")
    # The texts of all classes of some shared band: no pair needs another.
    wanted = shared.select("node").distinct()
    texts = written(rows.join(wanted, F.col("id") == F.col("node"), "left_semi").select(F.col("id").alias("node"), "text").dropDuplicates(["node"]), "texts")

    best = first_pairs.groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a"))
    links = written(_confirmed(best, texts, shingle, percent), "links")
    labels = components(links)
    known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    apart = labelled(first_pairs.select("a", "b"), labels, "a", "b").where("of_a <> of_b").select("a", "b")
    links = written(known.unionByName(_confirmed(apart, texts, shingle, percent)), "links")

    clusters = written(components(first_pairs), "clusters")
    banded = written(labelled(shared.select("key", "node"), clusters, "node"), "bands")
    several = banded.groupBy("key").agg(F.min("of_node").alias("low"), F.max("of_node").alias("high")).where("low < high").select((F.col("key") + F.lit(0)).alias("band"))
    across = written(_bands_compared(banded.join(several, F.col("key") == F.col("band"), "left_semi").join(sketches, "node"), least), "pairs")
    rest = across.where("NOT tie").select("a", "b").distinct()
    links = written(links.unionByName(_confirmed(rest, texts, shingle, percent)), "links")
    known = clusters.select(F.col("node").alias("a"), F.col("component").alias("b"))
    clusters = written(components(known.unionByName(across.where("tie").select("a", "b"))), "clusters")

    labels = components(links)
    classed = written(labelled(clusters.select("node", F.col("component").alias("cluster")), labels, "node").withColumnRenamed("of_node", "part"), "clusters")
    known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    labels = components(known.unionByName(written(_clusters_linked(classed, texts, shingle, percent), "links")))

    of_class = labelled(classes.select("digest", "node"), labels, "node").select(F.concat("digest", F.lit(b"")).alias("class"), "of_node")
    found = signed.select("id", "n", "digest").join(of_class, F.col("digest") == F.col("class"), "left")
    component = F.coalesce("of_node", "id")
    return found.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("id")).alias("kept"))


def one_of_each(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all columns, without the near-duplicates of a document of a smaller id; one row of each id. Null ids stay."""
    kept = near_duplicates(docs, shingle=shingle, percent=percent, id_col=id_col, text_col=text_col).where("kept").select(id_col).distinct()
    return docs.join(kept, id_col, "left_semi").dropDuplicates([id_col]).unionByName(docs.where(F.col(id_col).isNull()))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)
