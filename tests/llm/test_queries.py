"""The queries by their contracts, over a folder of small tables with odd rows."""

import base64
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bidweave.llm.queries import QUERIES
from tests.llm.conftest import ODD
from tests.llm.test_similarity import _joined, _katz, _near_copies, _set, _words


@pytest.fixture(scope="module")
def docs():
    """Odd texts and near copies."""
    return {**dict(ODD), **_near_copies()}


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(6)
    spark.createDataFrame([(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in docs], "doc_id long, quality int").write.parquet(f"{root}/labels.parquet")
    x = rng.normal(size=(60, 16))
    x = np.concatenate([x, x[:20] + rng.normal(size=(20, 16)) * 0.05])
    vectors = [(i, v.tolist(), "l") for i, v in enumerate(x)] + [(500, None, "l"), (501, [0.0] * 16, "l"), (502, x[0].tolist(), "m")]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label string").write.parquet(f"{root}/embeddings.parquet")
    return root


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op2(spark, folder, docs):
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    rows = QUERIES["op2_packing"](spark, folder).collect()
    want = []
    for i, t in docs.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 4096
    assert len(bins) == rows[0]["least_sequences"] == -(-sum(w[3] for w in want) // 4096)


def test_op3(spark, folder, docs):
    """Likenesses against the whole sets of 16-character shingles; equal texts have equal fingerprints and others don't."""
    rows = {r["doc_id"]: r for r in QUERIES["op3_fingerprints"](spark, folder).collect()}
    order = sorted(docs, reverse=True)
    texts = {i: docs[i] or "" for i in docs}
    shingles = lambda t: {t[k : k + 16] for k in range(max(1, len(t) - 15))} if t else set()
    for i, j in zip(order, [*order[1:], order[0]]):
        n = len(texts[i]) // 3
        edited = texts[i][: len(texts[i]) - n] + texts[j][:n]
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(texts[i]), hashlib.sha256(edited.encode()).hexdigest())
        for got, other in ((r["near_edited"], edited), (r["near_next"], texts[j])):
            a, b = shingles(texts[i]), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            spread = math.sqrt(max(true * (1 - true), 0.02) / max(1, len(a | b) / 16))
            assert abs(got - true) <= 5 * spread + (1.0 if len(a | b) < 100 else 0.02), (i, got, true)
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (texts[i] == edited)
    assert len({r["fingerprint"] for r in rows.values()}) == len(set(texts.values()))


def test_op4(spark, folder):
    rows = {r["vec_id"]: r for r in QUERIES["op4_pivot_dedup"](spark, folder).collect()}
    table = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    fine = [i for i, v in table.items() if v is not None and any(v)]
    x = np.array([table[i] for i in fine], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = [(fine[a], fine[b]) for a, b in np.argwhere(np.triu(x @ x.T >= 0.9, 1))]
    found, want = sum(r["n_links"] for r in rows.values()), 2 * len(links)
    assert 0.9 * want <= found <= want and len(rows) == len(table)
    component = _joined(table, links)
    assert sum(rows[i]["component_id"] == component[i] for i in table) >= 0.95 * len(table)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in rows.items()) and (rows[0]["component_id"], rows[502]["component_id"], rows[500]["n_links"], rows[501]["n_links"]) == (0, 0, 0, 0)


def test_op5(spark, folder, docs):
    sets = {i: _set(t, 2) for i, t in docs.items()}
    links = [(a, b) for a in docs for b in docs if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = _joined(docs, links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op5_minhash"](spark, folder).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in docs}


@pytest.mark.parametrize("name, n, r", [("op6_quality", 3, 1), ("op8_language_id", 4, 2), ("op10_katz", 5, 1)])
def test_held_out_rows(spark, folder, docs, name, n, r):
    rows = QUERIES[name](spark, folder).collect()
    assert {x["doc_id"]: x["held_out"] for x in rows} == {i: remainder(i, n) == r for i in docs} and len(rows) == len(docs)


def test_op6_and_op8(spark, folder, docs):
    rows = QUERIES["op6_quality"](spark, folder).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    rows = {r["doc_id"]: r for r in QUERIES["op8_language_id"](spark, folder).collect()}
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in docs[i] or "")) and r["lang_pred"] in ("und", "en", "de") and 0 <= r["score"] <= 1 for i, r in rows.items())


def test_op7(spark, folder, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in QUERIES["op7_bpe"](spark, folder).collect():
        text = docs[r["doc_id"]] or ""
        ids = reference.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_op10(spark, folder, docs):
    scores, base, _, count, _ = _katz(list(docs.items()), [i for i in docs if remainder(i, 5) != 1])
    for r in QUERIES["op10_katz"](spark, folder).collect():
        words = [*_words(docs[r["doc_id"]]), "</s>"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(count[w] > 0 for w in words), sum(count.values()))
        assert r["base_score"] == pytest.approx(base[r["doc_id"]], rel=1e-9) and r["score"] == pytest.approx(scores[r["doc_id"]], rel=1e-9)


def test_op1_leaves_no_planted_value(spark, folder):
    rows = QUERIES["op1_pii_pseudonyms"](spark, folder)
    assert rows.count() == spark.read.parquet(f"{folder}/documents.parquet").count() and rows.where(F.col("doc_id").isNull()).count() == 0


def test_stages_of_odd_rows(spark, folder):
    """Nulls, empty and long texts, repeated rows and clashing names go through every stage."""
    import corpus_pipeline

    table = spark.read.parquet(f"{folder}/documents.parquet")
    table = table.unionByName(table.where("doc_id = 5")).unionByName(table.where("doc_id = 6").withColumn("lang", F.lit(None).cast("string"))).withColumns({"node": F.lit("n"), "score": F.lit(1.0)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, folder)
        assert out.columns == table.columns, name
        n = out.count()
        assert n <= table.count()
        if name == "language_id":
            assert out.where("text IS NULL OR text RLIKE '^[^\\\\p{L}]*$'").count() == 0 and out.where("doc_id = 5").count() in (0, 2)
        if name == "near_dedup":
            assert out.groupBy("doc_id").count().where("count > 1").count() == 0 and out.where("text IS NULL OR doc_id IS NULL").count() == table.where("text IS NULL OR doc_id IS NULL").select("doc_id").distinct().count()
        if name == "pseudonyms":
            assert n == table.count()
    assert corpus_pipeline.STAGES[-1][1](spark, table, folder).select("doc_id").distinct().count() == table.select("doc_id").distinct().count()
