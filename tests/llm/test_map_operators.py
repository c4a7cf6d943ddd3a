"""Operators that judge each document by itself, against brute force."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from bidweave.llm import bpe, fingerprints, language, packing, quality, subwords
from bidweave.llm.memory import Memory
from tests.llm.conftest import ODD


def test_bpe_is_tiktokens_and_decodes(spark, odd, none):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.decode(bpe.encode(odd, ranks=path, pattern=P.PATTERN), ranks=path).collect()
    assert len(rows) == len(ODD) + 1
    texts = dict(ODD)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == reference.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
    assert bpe.decode(bpe.encode(none, ranks=path, pattern=P.PATTERN), ranks=path).count() == 0


def test_bpe_of_another_pattern(spark, odd):
    """Words by white space and single digits: stretches between spaces aren't words of the published pattern's kind."""
    path, pattern = P.path("byte_bpe_50k.tiktoken"), r"[A-Za-z]+ [a-z]+|\d|\s+|[^\s\d]+"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.encode(odd, ranks=path, pattern=pattern).collect():
        assert r["ids"] == reference.encode_ordinary(dict(ODD)[r["doc_id"]] or "")


def test_merges_follow_ranks_where_a_later_merge_makes_a_lower_rank():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"ab": 301, b"cd": 290, b"abcd": 280, b"aa": 295, b"aaa": 296}
    replay = bpe.MergeReplay(ranks)
    words = [b"abcd", b"abc", b"aaaaa", b"aabcdab", b"x", b"aaaa" * 30]
    found = [np.frombuffer(x, "<i4").tolist() for x in replay.encode(words)]
    assert found == [replay.alone(w) for w in words]
    assert found[0] == [280]


class Local:
    """What bpe's operators ask of a frame; the function of its only task runs here, over these batches."""

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def __init__(self, batches):
        self.batches = batches

    def select(self, *columns):
        return self

    def mapInArrow(self, f, schema):  # noqa: N802
        return list(f(iter(self.batches)))


def test_bpe_replays_the_merges_once_for_all_batches_of_a_task(monkeypatch):
    """Another batch of new words costs its own merges, not one more round of all ranks."""
    path, rng = P.path("byte_bpe_50k.tiktoken"), np.random.default_rng(7)
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = [" ".join("".join(map(chr, rng.integers(97, 123, rng.integers(3, 9)))) for _ in range(600)) for _ in range(12)]
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t])], names=["doc_id", "text"]) for i, t in enumerate(texts)]
    asked, rank = [], bpe.MergeReplay.rank
    monkeypatch.setattr(bpe.MergeReplay, "rank", lambda self, a, b: asked.append(len(a)) or rank(self, a, b))
    rows = bpe.encode(Local([pa.Table.from_batches(batches).combine_chunks().to_batches()[0]]), ranks=path, pattern=P.PATTERN)
    once, asked[:] = len(asked), []
    apart = bpe.encode(Local(batches), ranks=path, pattern=P.PATTERN)
    assert len(asked) <= 1.5 * once
    found = [{i: x for b in some for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)} for some in (rows, apart)]
    assert found[0] == found[1] == {i: reference.encode_ordinary(t) for i, t in enumerate(texts)}


def test_bpe_cuts_words_as_the_pattern_does(monkeypatch):
    path, rng = P.path("byte_bpe_50k.tiktoken"), np.random.default_rng(8)
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    chars = list("ab Z'''sstmdrevl  \n\t\r19,.!-\u00e9\u00d7\u00f7\u65e5\u0436\u3000\u00a0\u0085\x1c\u200b\u00b2\u2167\U0001f600\u0301\u0661")
    texts = [None, "", *("".join(rng.choice(chars, rng.integers(0, 14))) for _ in range(4000)), "it's we'll'd 's '", ""]
    encoder = bpe.Encoder(bpe.MergeReplay(bpe.read_ranks(path)), P.PATTERN)
    for size in (bpe.CUT, 1000):
        monkeypatch.setattr(bpe, "CUT", size)
        assert encoder.encode(pa.array(texts)).to_pylist() == [reference.encode_ordinary(t or "") for t in texts]
    assert encoder.encode(pa.array([None, ""], pa.string())).to_pylist() == [[], []]
    assert encoder.encode(pa.array(["a", "b c", None]).slice(1)).to_pylist() == [reference.encode_ordinary("b c"), []]


def test_bpe_runs_and_parts_keep_every_row():
    texts = [None, "", "a" * 50, "b", *["c" * 7] * 9, "d" * 200]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b)), pa.array(texts[a:b], pa.string())], names=["doc_id", "text"]) for a, b in ((0, 3), (3, 3), (3, 14))]
    for most in (1, 40, 100, 10_000):
        runs = list(bpe.runs(iter(batches), most))
        assert [t for r in runs for t in r.column(1).to_pylist()] == texts and all(len(r) for r in runs)
        assert all(sum(len(t or "") + 16 for t in r.column(1).to_pylist()[:-1]) < most for r in runs)
    assert list(bpe.parts(np.array([0, 0, 5, 30, 31, 33, 33]), 6)) == [(0, 2), (2, 3), (3, 6)]


def test_bpe_decodes_null_lists_and_refuses_unknown_ids():
    path = P.path("byte_bpe_50k.tiktoken")
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    lists = [reference.encode_ordinary("the cat"), None, [], reference.encode_ordinary("\u65e5 sat")]

    def decoded(lists):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "ids"])
        return [x for b in bpe.decode(Local([batch]), ranks=path) for x in b.column(2).to_pylist()]

    assert decoded(lists) == [b"the cat", b"", b"", "\u65e5 sat".encode()] and decoded([None]) == [b""]
    for unknown in (10_000_000, -1, None):
        with pytest.raises((KeyError, IndexError, TypeError)):
            decoded([[5, unknown]])


def test_memory_keeps_what_comes_again():
    m = Memory(3)
    for block in ({"a", "b"}, {"a", "c"}, {"a", "d"}, {"a", "e"}):
        for k in m.missing(block):
            m[k] = k
    assert "a" in m and len(m) <= 4 and m.missing({"a", "e"}) == set()


def _lengths(counts):
    return sum(n for n in counts.values())


@pytest.mark.parametrize("seed", range(4))
def test_bin_completion_uses_all_and_meets_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 90, 60).tolist()
    counts = {int(x): lengths.count(x) for x in lengths}
    plan = packing.bin_completion(counts, 100)
    used = [x for content, n in plan for _ in range(n) for x in content]
    assert sorted(used) == sorted(lengths)
    assert all(sum(content) <= 100 for content, _ in plan)
    best = sum(n for _, n in packing.best_fit(counts, 100))
    assert -(-sum(lengths) // 100) <= sum(n for _, n in plan) <= best


def test_bin_completion_beats_best_fit():
    counts = {50: 1, 44: 1, 41: 1, 30: 2, 29: 1, 27: 1, 26: 1, 23: 1}
    assert sum(n for _, n in packing.bin_completion(counts, 100)) == 3
    assert packing.bin_completion({}, 10) == []
    assert packing.dominates((50,), (30, 20)) and not packing.dominates((30, 20), (50,))


def _fewest(lengths, capacity):
    """The fewest bins, by putting each length into every bin that it fits."""
    best = [len(lengths)]

    def put(at, bins):
        if len(bins) >= best[0]:
            return
        if at == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[at] <= capacity and bins[k] not in bins[:k]:
                put(at + 1, [*bins[:k], bins[k] + lengths[at], *bins[k + 1 :]])
        put(at + 1, [*bins, lengths[at]])

    put(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(8))
def test_a_search_of_all_fillings_is_optimal(seed):
    rng = np.random.default_rng(seed)
    lengths = sorted(rng.integers(8, 40, 11).tolist(), reverse=True)
    counts = {int(x): lengths.count(x) for x in lengths}
    found = packing.search(counts, 50, nodes=None, width=None)
    assert found.optimal and found.bins == sum(n for _, n in found.plan) == _fewest(lengths, 50) >= found.bound
    narrow = packing.search(counts, 50, width=1)
    assert narrow.bins >= found.bins and (not narrow.optimal or narrow.bins == found.bins)


def test_a_filling_may_be_used_less_often_than_it_could():
    """The fullest filling, used as often as it can be, leaves what takes a bin more."""
    counts = {6: 2, 5: 2, 4: 2, 3: 2, 2: 2}
    found = packing.search(counts, 10, nodes=None, width=None)
    assert found.optimal and found.bins == 4 and sorted(x for f, n in found.plan for _ in range(n) for x in f) == sorted([6, 5, 4, 3, 2] * 2)


def test_packing(spark, odd, none):
    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    placed = packing.pack_documents(odd, tokenizer=path)
    rows = placed.collect()
    want = []
    for i, t in [*ODD, ODD[4]]:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, p, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 4096))]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 4096
    assert len(bins) == -(-sum(w[3] for w in want) // 4096) == rows[0]["least_sequences"]
    assert packing.pack_documents(none, tokenizer=path).count() == 0


def test_sequences_hold_the_tokens(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "a dog and a cow"), (3, None)], "doc_id long, text string")
    path = P.path("word_bpe_49k.json")
    placed = packing.pack_documents(docs, tokenizer=path, capacity=6)
    found = {r["sequence_id"]: r["ids"] for r in packing.sequences(docs, placed, tokenizer=path, capacity=6).collect()}
    assert sorted(x for ids in found.values() for x in ids) == sorted(Tokenizer.from_file(path).encode("the cat a dog and a cow", add_special_tokens=False).ids + [1, 1, 1])
    assert all(len(ids) <= 6 for ids in found.values())


def test_edited_fingerprints(spark, odd, none):
    rows = fingerprints.edited_fingerprints(odd, parts=5).collect()
    docs = sorted([(i, t or "") for i, t in [*ODD, ODD[4]]], reverse=True)
    want = []
    for k, (i, t) in enumerate(docs):
        n, follow = len(t) // 3, docs[(k + 1) % len(docs)][1]
        want.append((i, len(t), hashlib.sha256((t[: len(t) - n] + follow[:n]).encode()).hexdigest()))
    assert sorted(tuple(r)[:3] for r in rows) == sorted(want)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[5]["fingerprint"] == by_id[6]["fingerprint"] and by_id[6]["near_next"] == 1.0
    assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"] != by_id[3]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprints.edited_fingerprints(none).count() == 0


def test_sketches_estimate_containment_and_merge():
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdefgh "), 40_000))
    whole, part = fingerprints.sketches([text, text[:4000]])
    assert fingerprints.containment(part, whole) == 1.0
    assert abs(fingerprints.containment(whole, part) - 0.1) < 0.03
    a, b = fingerprints.sketches([text[:20_015], text[20_000:]])
    assert (fingerprints.merged(a, b) == whole).all()
    assert (fingerprints.sketch_of(fingerprints.fingerprint(text, whole)) == whole).all()
    naive = {text[i : i + 16] for i in range(len(text) - 15)}
    assert abs(len(whole) - len(naive) / 16) < 5 * (len(naive) / 16) ** 0.5


def _corpus(spark, n=240):
    rng = np.random.default_rng(3)
    stems = {"en": "the and of with thing house", "de": "der und nicht strasse haus kind", "fr": "le les des maison rue avec", "es": "el los casa calle con nino"}
    rows, labels = [], []
    for i in range(n):
        lang = list(stems)[i % 4]
        good = i % 5 > 0
        words = [w + rng.choice(list("aeiou")) for w in rng.choice(stems[lang].split(), 40)]
        rows.append((i, " ".join(words if good else [w.upper() + "###" for w in words]), lang))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_learns_and_defines_odd_cases(spark, odd, none):
    docs, labels = _corpus(spark)
    held = quality.remainder("doc_id", 3) == 1
    model = quality.train(docs, labels, use=~held)
    rows = quality.score(docs.where(held), model).join(labels, "doc_id").collect()
    assert sum((r["score"] >= 0.5) == bool(r["quality"]) for r in rows) / len(rows) > 0.95
    scores = {r["doc_id"]: r["score"] for r in quality.score(odd, model).collect()}
    assert scores[1] == scores[2] == scores[3] and scores[5] == scores[6] and all(0 <= s <= 1 for s in scores.values())
    assert quality.score(none, quality.train(none, labels)).count() == 0
    assert quality.score(odd, quality.fit([], [])).first()["score"] == 0.5
    assert quality.keep_good(docs, model).columns == docs.columns


def test_samples_are_bounded_and_take_long_texts(spark):
    """A label or language that has long texts alone is learnt from them, and rows without a text take no place."""
    docs = spark.createDataFrame([(i, None if i < 5 else "bad ### " * (3000 if i % 2 else 1), "de" if i % 2 else "en") for i in range(40)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality, "fit", lambda texts, labels: seen.append(sorted(zip(map(len, texts), labels))))
        patch.setattr(language, "fit", lambda texts, langs: seen.append(sorted(zip(map(len, texts), langs))))
        quality.train(docs, labels, sample=30, chars=1000)
        language.train(docs, chars=1000)
        quality.train(docs, labels, sample=30)
    assert [c for _, c in seen[0]].count(1) == 1 and [c for _, c in seen[0]].count(0) > 5 and [c for _, c in seen[1]].count("de") == 1
    assert len(seen[2]) == 30


def _naive(texts, table, sizes, whole, lower):
    """Each text's mean row of the table, n-gram by n-gram."""
    out = []
    for text in texts:
        found = []
        for w in (text.lower() if lower else text).split():
            codes = [2, *map(ord, w), 3]
            for n in sizes:
                for k in range(len(codes) - n + 1):
                    h = 0
                    for c in codes[k : k + n]:
                        h = (h * int(subwords.BASE) + c) % (1 << 64)
                    h = (h ^ (h >> 31) ^ n) * int(subwords.MIX) % (1 << 64)
                    found.append(table[(h >> 33) % len(table)])
            if whole:
                found.append(table[zlib.crc32(w.encode(), 1) % len(table)])
        out.append(np.mean(found, axis=0) if found else np.zeros(table.shape[1]))
    return np.array(out)


def test_predictions_against_n_grams_one_by_one(spark, odd):
    """Scores and languages of the models, with features counted singly and machines asked one after the other."""
    docs, labels = _corpus(spark, 120)
    texts = [r["text"] or "" for r in odd.orderBy("doc_id").collect() if len(r["text"] or "") < 1000] + [r["text"] for r in docs.limit(20).collect()]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = quality.train(docs, labels)
    means = _naive(texts, model.words.table, quality.SIZES, True, False)[:, 0]
    got = {r["doc_id"]: r["score"] for r in quality.score(table, model).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx((1 / (1 + np.exp(-(means + model.bias)))).tolist(), abs=1e-9)
    model = language.train(docs)
    likely = 1 / (1 + np.exp(-(_naive(texts, model.words.table, language.SIZES, False, True) * language.SCALE + model.biases) * model.slopes))
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(table, model).collect()}
    for i, text in enumerate(texts):
        members = model.families[int(np.argmax(likely[i, : len(model.families)]))]
        votes = dict.fromkeys(members, 0)
        for c, (a, b) in enumerate(model.pairs):
            if a in members:
                votes[a if likely[i, len(model.families) + c] >= 0.5 else b] += 1
        best = max(members, key=lambda m: votes[m])
        assert got[i] == (model.languages[best] if any(ch.isalpha() for ch in text) else "und"), text


def test_language_learns_and_defines_odd_cases(spark, odd, none):
    docs, _ = _corpus(spark)
    held = quality.remainder("doc_id", 4) == 2
    model = language.train(docs, use=~held)
    assert model.pairs == ((0, 1), (2, 3)) or len(model.pairs) == 2
    rows = language.identify(docs.where(held), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.95
    found = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (1, 2, 3, 12)) and found[4]["lang_pred"] != "und"
    assert language.identify(none, language.train(none)).count() == 0
    assert language.identify(odd, language.fit(["one text"], ["en"])).where("doc_id = 5").first()["lang_pred"] == "en"
    assert language.keep_identified(odd, model).columns == odd.columns
