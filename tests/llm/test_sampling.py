"""Hard negatives, shards and resampling: against brute force and SQL, and on odd rows."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bidweave.llm import importance, negatives, sharding
from bidweave.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_voronoi_negatives", "op13_suffix_resampling"])
def test_queries_match_their_sql(spark, name):
    rows = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert rows.columns == want.columns
    assert sorted((tuple(r) for r in rows.collect()), key=key) == sorted(want.fetchall(), key=key)


def mined(rows, k=5, low=80, high=100):
    """rows: (id, label, vector). Every pair's product, in Python's whole numbers."""
    there = []
    for i, label, v in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            there.append((i, label, [math.floor(256 * x) for x in v]))
    out = []
    for i, label, v in {r[0]: r for r in there if r[0] % 10 == 0}.values():
        scores = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in there if len(w) == len(v) and j != i]
        for p, j, _ in sorted(s for s in scores if s[2] == label)[:k]:
            fits = sorted(s for s in scores if s[2] != label and low * -p <= 100 * -s[0] <= high * -p)[:k]
            out += [(i, j, n + 1, m, -p, -s) for n, (s, m, _) in enumerate(fits)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, label, v, "x", 1.0) for i, label, v in rows], "vec_id long, label int, embedding array<float>, anchor string, score double")


def groups_of_vectors():
    """Groups of near vectors of mixed labels, copies of one vector, and rows that take no part."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    x = np.concatenate([centres[i % 6] + rng.normal(size=12) * 0.2 for i in range(240)]).reshape(-1, 12).astype(np.float32)
    rows = [(i, int(rng.integers(3)), v.tolist()) for i, v in enumerate(x)] + [(300 + i, i % 3, x[0].tolist()) for i in range(60)]
    odd = [(400, None, [1.0] * 12), (410, 1, None), (420, 1, []), (430, 1, [float("nan")] * 12), (440, 1, [math.inf] * 12), (450, 1, [1.0, None] * 6), (None, 1, [1.0] * 12), (460, 1, [0.5, 0.25]), (461, 1, [0.5, 0.5]), (462, 2, [0.5, 0.25]), (470, 2, [0.0] * 12), (480, 0, [3000.0] * 12)]
    return rows + odd


@pytest.mark.parametrize("pivots, group", [(None, 8192), (1, 8192), (7, 3)])
def test_negatives_are_brute_force(spark, pivots, group):
    """However many cells and groups there are, with hot copies, ties and vectors of two sizes."""
    rows = groups_of_vectors()
    found = negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0, pivots=pivots, group=group)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in found.collect()) == mined(rows)


def test_bounds_leave_out_rows_of_far_cells(spark):
    """Groups far from each other: a row goes to fewer groups than there are, and results are whole."""
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, (np.eye(8)[i % 8] * 10 + rng.normal(size=8) * 0.02).tolist()) for i in range(400)]
    ready = vectors(spark, rows)
    found = negatives.hard_negatives(ready, F.col("vec_id") % 10 == 0, pivots=8)
    assert sorted(tuple(r) for r in found.collect()) == mined([(i, m, np.float32(v).tolist()) for i, m, v in rows])
    packed = ready.select(F.col("vec_id").alias("id"), F.col("label").cast("long"), (F.col("vec_id") % 10 == 0).alias("anchor"), F.lit(8).alias("size"), "embedding").toPandas()
    packed["vector"] = [negatives._packed(list(v), 256.0) for v in packed["embedding"]]
    packed["norm"] = [float((np.floor(np.float64(v) * 256) ** 2).sum()) for v in packed["embedding"]]
    table = spark.createDataFrame(packed.drop(columns="embedding")).withColumn("size", F.col("size").cast("int"))
    cells = negatives._cells(table, 8, 8192)
    anchors = negatives._grouped(table.where("anchor"), cells)
    bounds = negatives._bounds(anchors.withColumn("least", F.lit(256.0 * 256 * 90)), cells)
    to = negatives._merged(table, cells, bounds, 8192)
    assert len(set(to)) == len(to) > 2 and negatives._routed(table, cells, bounds, to).count() < 2 * len(rows)
    # Bounds that exclude nothing: cells are merged, as far as a group goes, and a row goes there once.
    wide = negatives._bounds(anchors.withColumn("least", F.lit(None).cast("double")), cells)
    into = negatives._merged(table, cells, wide, 8192)
    assert set(into) == {0} and negatives._routed(table, cells, wide, into).count() == len(rows)
    assert 1 < len(set(negatives._merged(table, cells, wide, 20))) < len(to)


def test_negatives_of_nothing(spark):
    rows = groups_of_vectors()
    assert negatives.hard_negatives(vectors(spark, rows).limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(vectors(spark, rows), F.lit(False)).count() == 0
    texts = vectors(spark, rows).withColumn("label", F.concat(F.lit("l"), "label"))
    assert sorted(tuple(r) for r in negatives.hard_negatives(texts, F.col("vec_id") % 10 == 0).collect()) == mined(rows)


def test_repeated_rows_count_each_and_repeated_anchors_once(spark):
    rows = groups_of_vectors()[:60]
    rows += [rows[3], rows[10]]
    found = negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0)
    by_pair = {}
    for r in found.collect():
        by_pair.setdefault((r["anchor_id"], r["positive_id"], r["rank"]), set()).add((r["negative_id"], r["negative_score"]))
    for anchor in range(0, 60, 10):
        want = [x for x in mined(rows) if x[0] == anchor]
        assert {(a, p, n) for a, p, n in by_pair if a == anchor} == {x[:3] for x in want}


def test_suffix_order_has_every_common_prefix():
    rng = np.random.default_rng(2)
    sizes = [7, 1, 40, 3]
    ids = rng.integers(0, 3, sum(sizes))
    ends = np.repeat(np.cumsum(sizes), sizes)
    for depth in (1, 2, 4):
        order, common = importance.suffix_order(ids, ends, depth)
        suffixes = [tuple(ids[p : min(ends[p], p + depth)]) for p in order]
        assert suffixes == sorted(suffixes) and sorted(order) == list(range(len(ids)))
        for a, b, n in zip(suffixes, suffixes[1:], common[1:]):
            assert n == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def sampled(docs, target, n, buckets, least=20, percent=10):
    def grams(text):
        words = WORD.findall((text or "").translate(LOWER))
        return len(words), [zlib.crc32(" ".join(words[p : p + k]).encode()) % buckets for k in range(1, n + 1) for p in range(len(words) - k + 1)]

    of, raw, wanted = [(i, *grams(t)) for i, t in docs], [0] * buckets, [0] * buckets
    for _, _, g in of:
        for b in g:
            raw[b] += 1
    for t in target:
        for b in grams(t)[1]:
            wanted[b] += 1
    gain = [math.floor(1000 * math.log((t + 1) * (sum(raw) + buckets) / ((s + 1) * (sum(wanted) + buckets)))) for s, t in zip(raw, wanted)]
    rows = []
    for i, words, g in of:
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in g)
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    enough = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0]))
    for place, r in enumerate(enough[: percent * len(enough) // 100]):
        r[4] = place + 1
    return sorted(tuple(r[:5]) for r in rows)


def texts():
    rng = np.random.default_rng(8)
    words = ["alpha", "Beta", "gamma", "ħost", "x1", "日本", "it's", "--", "end."]
    return {**dict(ODD), **{100 + i: " ".join(rng.choice(words, int(rng.integers(1, 80)))) for i in range(150)}}


@pytest.mark.parametrize("n, buckets", [(1, 10_000), (3, 97), (2, 100_000)])
def test_resampling_is_brute_force(spark, n, buckets):
    docs, target = texts(), ["alpha Beta gamma", "x1 日本 end", None, "", "gamma gamma"]
    table = spark.createDataFrame([(i, t, 1, "s", 0.5) for i, t in docs.items()], "doc_id long, text string, rank int, buckets string, score double")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    rows = importance.resampled(table, wanted, n=n, buckets=buckets, percent=30)
    assert sorted(tuple(r) for r in rows.collect()) == sampled(list(docs.items()), target, n, buckets, percent=30)


def test_resampling_of_odd_tables(spark, odd, none):
    empty = spark.createDataFrame([], "text string")
    assert importance.resampled(none, empty).count() == 0
    rows = importance.resampled(odd, empty, percent=100).collect()
    assert len(rows) == len(ODD) + 1
    drawn = sorted(r["rank"] for r in rows if r["rank"] is not None)
    assert drawn == list(range(1, len(drawn) + 1))
    no_id = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "c")], "doc_id long, text string")
    found = importance.resampled(no_id, empty, least_words=1, percent=100).collect()
    assert sorted(r["rank"] for r in found) == [1, 2, 3] and sum(r["doc_id"] is None for r in found) == 2


def test_ranks_go_on_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("score"), "id")
    found = importance.ranked(rows, [F.desc("score"), F.asc("id")], each=90)
    want = sorted(((i % 7, i) for i in range(1000)), key=lambda r: (-r[0], r[1]))
    assert [(r["score"], r["id"]) for r in found.orderBy("rank").collect()] == want
    assert sorted(r["rank"] for r in found.collect()) == list(range(1, 1001))


def test_shards_have_equal_bytes_and_no_gaps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = QUERIES["op12_virtual_slots"](spark, SF)
    assert rows.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert dict(rows.dtypes)["slot"] == "bigint" and dict(rows.dtypes)["shard"] == "int" and dict(rows.dtypes)["text_crc32"] == "bigint"
    found, want = rows.collect(), {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in found} == {i: (len(t) + 8, zlib.crc32(t)) for i, t in want.items()}
    loads, slots = [0] * 24, [[] for _ in range(24)]
    for r in found:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert (r["law"], r["grown_shard"]) == ("bytes", None)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(loads) - min(loads) < 0.05 * sum(loads) / 24
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_edits_keep_what_fits_and_growth_fills_only_the_new_shard(spark, tmp_path):
    sizes = spark.range(500).select(F.col("id").cast("int").alias("virtual_slot"), (100 + F.col("id") * 37 % 101 + F.when(F.col("id") == 7, 2000).otherwise(0)).cast("long").alias("bytes"), F.lit(1).cast("long").alias("rows"))
    store = sharding.MapStore(spark, f"{tmp_path}/map")
    current, version = sharding.balanced_map(store, sizes, 6, slots=500)
    assert (version, store.latest()) == (sharding.EDITS, sharding.EDITS)
    with pytest.raises(Exception):
        store.commit(current, version)
    of = lambda m: {r["virtual_slot"]: r["shard"] for r in m.collect()}
    byte = {r["virtual_slot"]: r["bytes"] for r in sizes.collect()}
    load = lambda m, k: [sum(byte[s] for s in m if m[s] == i) for i in range(k)]
    first, last = of(store.read(0)), of(current)
    assert max(load(last, 6)) - min(load(last, 6)) <= 101 < max(load(first, 6)) - min(load(first, 6))
    assert sum(first[s] != last[s] for s in first) < 100
    assert of(sharding.rebalanced(current, sizes, 6)) == last or max(load(of(sharding.rebalanced(current, sizes, 6)), 6)) <= max(load(last, 6)) + 101
    more = of(sharding.grown(current, sizes, 6))
    assert {more[s] for s in more if more[s] != last[s]} == {6}
    assert max(load(more, 7)) - min(load(more, 7)) < 8 * 201
    fewer = of(sharding.rebalanced(current, sizes, 5))
    assert set(fewer.values()) == set(range(5)) and max(load(fewer, 5)) - min(load(fewer, 5)) <= 201


def test_shards_of_odd_tables(spark, odd, none):
    assert sharding.shard_documents(none, 4).count() == 0
    rows = sharding.shard_documents(odd, 4).collect()
    assert len(rows) == len(ODD) + 1
    for shard in range(4):
        mine = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert mine == list(range(len(mine)))
    no_id = spark.createDataFrame([(None, f"text {i}") for i in range(40)] + [(None, None), (1, "x"), (1, "x")], "doc_id long, text string")
    found = sharding.shard_documents(no_id, 4).collect()
    assert len(found) == 43 and len({r["virtual_slot"] for r in found}) > 30 and len({r["shard"] for r in found if r["doc_id"] == 1}) == 1


def test_documents_get_their_shard(spark, tmp_path, odd):
    store = sharding.MapStore(spark, f"{tmp_path}/map")
    placed = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in sharding.shard_documents(odd, 3, store=store).collect()}
    docs = sharding.with_shards(odd, store.read(store.latest()))
    assert docs.columns == [*odd.columns, "shard"]
    assert {(r["doc_id"], zlib.crc32((r["text"] or "").encode())): r["shard"] for r in docs.collect()} == placed
