"""Near-duplicates, vectors, components and the language model against brute force."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidweave.llm import katz, minhash, pivots
from bidweave.llm.components import components
from tests.llm.conftest import ODD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def _set(text, n):
    w = _words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def _joined(nodes, links):
    root = {i: i for i in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def _near_copies(seed=5):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = {}
    for base in range(6):
        text = rng.choice(vocabulary, 120).tolist()
        for copy in range(12):
            t = list(text)
            for at in rng.choice(len(t), rng.integers(0, 9), replace=False):
                t[at] = "edit" + str(rng.integers(1000))
            docs[100 * base + copy + 50] = " ".join(t)
    for i in range(40):
        docs[1000 + i] = " ".join(rng.choice(vocabulary, rng.integers(1, 60)))
    return docs


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, n):
    docs = {**dict(ODD), **_near_copies()}
    rows = [(i, t, "x") for i, t in docs.items()] + [(5, docs[5], "again")]
    table = spark.createDataFrame(rows, "doc_id long, text string, node string")
    sets = {i: _set(t, n) for i, t in docs.items()}
    ids = sorted(docs)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = _joined(ids, links)
    found = minhash.near_duplicates(table, shingle=n).collect()
    assert len(found) == len(rows)
    for r in found:
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), want[i], want[i] == i), i
    assert minhash.near_duplicates(table.limit(0)).count() == 0
    kept = minhash.one_of_each(table, shingle=n)
    assert kept.columns == table.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_chain_without_a_common_leader_is_linked(spark):
    """a-b and b-c are near copies, a-c are not: all three are one component."""
    base = [f"w{i}" for i in range(100)]
    docs = [(1, " ".join(base)), (2, " ".join(base[4:] + [f"x{i}" for i in range(5)])), (3, " ".join(base[12:] + [f"x{i}" for i in range(12)]))]
    sets = [_set(t, 2) for _, t in docs]
    alike = [[100 * len(a & b) >= 80 * len(a | b) for b in sets] for a in sets]
    assert alike[0][1] and alike[1][2] and not alike[0][2]
    rows = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=2).collect()
    assert {r["component_id"] for r in rows} == {1}


def test_odd_sketches_estimate_high_similarities(spark):
    rng = np.random.default_rng(2)
    for share in (0.7, 0.8, 0.9):
        common, n = rng.integers(0, 1 << 63, 2000, dtype=np.uint64), int(2000 * (1 / share - 1) / 2)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, n, dtype=np.uint64)])) for _ in range(2))
        sketches = [minhash.odd_sketch(minhash.samples(s)).tolist() for s in (a, b)]
        got = spark.createDataFrame([tuple(sketches)], "a array<long>, b array<long>").select(minhash.estimate(F.col("a"), F.col("b"))).first()[0]
        assert abs(got - share) < 0.1


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    links = [tuple(map(int, x)) for x in rng.integers(0, 60, (45, 2))] + [(k, k + 1) for k in range(100, 140)] + [(7, 7)]
    nodes = {x for a, b in links if a != b for x in (a, b)}
    want = _joined(nodes, [x for x in links if x[0] != x[1]])
    table = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    for each in (1000, 10):
        rows = components(table, each=each).collect()
        assert {r["node"]: r["component"] for r in rows} == want and len(rows) == len(want)
    assert components(table.limit(0)).count() == 0


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 16)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(150, 16))
    near = [v + rng.normal(size=16) * 0.08 for v in vectors[:5] for _ in range(15)]
    rows = [(i, v.tolist()) for i, v in enumerate([*vectors, *near])]
    rows += [(400 + k, rows[3][1]) for k in range(6)] + [(500, [2 * x for x in rows[3][1]])]
    odd = [(600, None), (601, [0.0] * 16), (602, [math.nan] * 16), (603, [1.0] * 8), (604, [None] * 16), (605, []), (606, [math.inf] + [0.0] * 15)]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, node int")
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    alike = x @ x.T >= 0.9
    np.fill_diagonal(alike, False)
    ids = [i for i, _ in rows]
    want = _joined(ids, [(ids[a], ids[b]) for a, b in np.argwhere(np.triu(alike))])
    found = {r["vec_id"]: r for r in pivots.near_vectors(table, pivots=32).collect()}
    assert len(found) == len(rows) + len(odd)
    truth = dict(zip(ids, alike.sum(axis=1)))
    assert all(found[i]["n_links"] <= truth[i] for i in ids)
    assert sum(found[i]["n_links"] for i in ids) >= 0.9 * sum(truth.values())
    assert sum(found[i]["component_id"] == want[i] for i in ids) >= 0.97 * len(ids)
    assert all(found[400 + k]["component_id"] == 3 and not found[400 + k]["kept"] for k in range(6))
    assert all(tuple(found[i])[1:] == (0, i, True) for i, _ in odd)
    assert pivots.near_vectors(table.limit(0)).count() == 0


def test_pivot_links_inside_a_large_group(spark):
    rng = np.random.default_rng(11)

    def group(n, cosine):
        x = rng.normal(size=(n + 1, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        return np.sqrt(cosine) * x[0] + np.sqrt(1 - cosine) * x[1:]

    def recall(parts, **options):
        x = np.concatenate(parts).astype(np.float32)
        of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = rng.permutation(len(x))
        x, of = x[order], of[order]
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        found = {r["vec_id"]: r["n_links"] for r in pivots.near_vectors(table, **options).collect()}
        u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        truth = (u @ u.T >= 0.9).sum(axis=1) - 1
        assert all(found[i] <= truth[i] for i in range(len(x)))
        return [sum(found[i] for i in np.flatnonzero(of == g)) / max(1, truth[of == g].sum()) for g in range(len(parts))]

    alone = rng.normal(size=(1980, 64))
    for cosine in (0.95, 0.88):
        assert min(recall([alone, group(1000, cosine), group(20, 0.95)])[1:]) >= 0.95
    # Nothing but one group: one pivot, and all pairs meet.
    assert recall([group(300, 0.97)]) == [1.0]


@pytest.mark.parametrize("cosine", [0.901, 0.92])
def test_pivot_recall_near_the_threshold(spark, cosine):
    """Pairs of random directions just inside the threshold, among as many other vectors."""
    rng = np.random.default_rng(17)
    a = rng.normal(size=(1200, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n = rng.normal(size=a.shape)
    n -= (n * a).sum(axis=1, keepdims=True) * a
    b = cosine * a + math.sqrt(1 - cosine**2) * n / np.linalg.norm(n, axis=1, keepdims=True)
    rows = np.concatenate([a, b, rng.normal(size=(1200, 64))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    linked = pivots.near_vectors(table).where("n_links > 0").count()
    assert linked / 2400 >= 0.93


def test_vectors_of_every_size_are_linked(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(30)] + [(100, [1.0, 2.0]), (101, [2.0, 4.1]), (102, [-1.0, 0.5]), (200, [3.0]), (201, [5.0]), (202, [-3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivots.near_vectors(table).collect()}
    assert [found[i] for i in (100, 101, 102, 200, 201, 202)] == [(1, 100), (1, 100), (0, 102), (1, 200), (1, 200), (0, 202)]


@pytest.mark.parametrize("each", [0, 2])
def test_a_band_of_many_clusters_loses_no_link(spark, monkeypatch, each):
    """Half of all words are common to all documents, so bands hold many clusters, in blocks of few classes."""
    monkeypatch.setattr(minhash, "SKETCHES", 4)
    monkeypatch.setattr(minhash, "EACH", each)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = np.random.default_rng(8)
    common = [f"c{i}" for i in range(120)]
    docs = {}
    for k in range(36):
        own = [f"o{k // 3}x{i}" for i in range(40)]
        for at in rng.choice(40, k % 3 * 6, replace=False):
            own[at] = f"e{k}y{at}"
        docs[k] = " ".join(common + own)
    sets = {i: _set(t, 2) for i, t in docs.items()}
    links = [(a, b) for a in docs for b in docs if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = _joined(docs, links)
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert 1 < len(set(want.values())) < 36
    for least in (0.62, None):
        assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(table, shingle=2, least_estimate=least).collect()} == want


def _katz(docs, train):
    """Scores by definition, and the probability function."""
    tokens = {i: [*_words(t), "</s>"] for i, t in docs}
    count, pairs = Counter(w for i in train for w in tokens[i]), Counter()
    for i in train:
        pairs.update(zip(["<s>", *tokens[i]], tokens[i]))
    n = sum(count.values())

    def discounts(counts):
        with_count = np.array([0] + [sum(c == r for c in counts.values()) for r in range(1, katz.K + 2)])
        return katz.Discounts.of(with_count), with_count

    d1, with_count = discounts(count)
    words = katz.Words.of(n, len(count), with_count)
    d2, _ = discounts(pairs)
    after = defaultdict(dict)
    for (h, w), c in pairs.items():
        after[h][w] = c

    def single(w):
        return float(words.probability(np.array([count[w]]))[0])

    def probability(w, h):
        if not after.get(h):
            return single(w)
        total = sum(after[h].values())
        free = sum((1 - d2.factor[c]) * c for c in after[h].values() if c <= katz.K)
        flat = free <= 0
        if flat:
            free = d2.absolute * len(after[h])
        if c := after[h].get(w):
            return (c - d2.absolute if flat else float(d2.of_counts(np.array([c]))[0]) * c) / total
        return free / total / (1 - sum(single(x) for x in after[h])) * single(w)

    scores = {i: sum(math.log10(probability(w, h)) for h, w in zip(["<s>", *ws], ws)) for i, ws in tokens.items()}
    base = {i: sum(math.log10((count[w] + 0.5) / (n + 0.5 * (len(count) + 1))) for w in ws) for i, ws in tokens.items()}
    return scores, base, probability, count, after


def _sentences():
    rng = np.random.default_rng(9)
    nouns, verbs = ["cat", "dog", "bird", "fish", "cow"], ["sees", "likes", "eats"]
    return [(100 + i, f"the {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)} {'and' if i % 3 else 'but'} rare{i // 2}") for i in range(80)]


@pytest.mark.parametrize("block", [8_000_000, 300])
def test_katz_against_its_definition(spark, monkeypatch, block):
    monkeypatch.setattr(katz, "BLOCK", block)
    monkeypatch.setattr(katz, "TOKENS", 40 * block)
    docs = [*ODD, *_sentences()]
    train = [i for i, _ in docs if i % 4]
    table = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double")
    scores, base, _, count, _ = _katz(docs, train)
    rows = katz.katz_scores(table, use=F.col("doc_id") % 4 != 0).collect()
    assert len(rows) == len(docs)
    for r in rows:
        i = r["doc_id"]
        words = [*_words(dict(docs)[i]), "</s>"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(count[w] > 0 for w in words), sum(count.values()))
        assert r["base_score"] == pytest.approx(base[i], rel=1e-9) and r["score"] == pytest.approx(scores[i], rel=1e-9), i


def test_katz_probabilities_sum_to_one():
    docs = _sentences()
    _, _, probability, count, after = _katz(docs, [i for i, _ in docs])
    for h in ["<s>", "the", "cat", "and", "rare3", "never seen"]:
        assert sum(probability(w, h) for w in [*count, "unknown"]) == pytest.approx(1, abs=1e-9)


def test_katz_without_training_and_without_rows(spark):
    table = spark.createDataFrame([(1, "a b"), (None, "a"), (3, None)], "doc_id long, text string")
    rows = katz.katz_scores(table, use=F.lit(False)).collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in rows} == {(1, 3, 0, 0), (None, 2, 0, 0), (3, 1, 0, 0)}
    assert all(r["base_score"] == 0 and r["score"] == 0 for r in rows)
    assert katz.katz_scores(table.limit(0), use=F.lit(True)).count() == 0


def test_arrays_survive_packing():
    rng = np.random.default_rng(0)
    for a in (np.zeros(0, np.int64), rng.integers(-5, 1 << 62, 100), rng.integers(0, 255, 7).astype(np.uint8), rng.integers(0, 1 << 32, 50).astype(np.uint32)):
        assert (katz.unpack(katz.pack(a), a.dtype.type) == a).all()
    sizes = np.array([3, 1, 2])
    numbers = np.array([4, 9, 11, 2, 0, 7])
    assert (katz._ungapped(katz._gaps(numbers, sizes), sizes) == numbers).all()
