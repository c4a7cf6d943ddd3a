"""Language-model scores by Katz backoff over word bigrams.

Bigrams and words have Good-Turing discounted probabilities; what the discounts set free goes to what was not seen, through
backoff weights that make every history's probabilities sum to 1. Unseen words are one unknown type.

Documents are tokenised once, into blocks. A block asks for the counts of its distinct words, then for those of its distinct
word pairs; the words, and the pairs by history, are dealt out to partitions, each of which adds up what all blocks say of
its keys and answers each block. There are as many partitions as tokens ask for, so the tables of counts are never in one
place, and what moves is the distinct keys of a block in packed arrays. Pairs of a history too common for one partition are salted over several, whose sums are few.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.llm.bpe import blocks
from bidweave.llm.quality import remainder
from bidweave.session import written

#: The hash that stands for a document's end; words' hashes are larger.
END = 1
#: Counts above this are not discounted.
K = 5
#: A history with more than this part of a partition's share of tokens is salted.
PART = 8
#: Characters of a block, and tokens whose distinct words or pairs one partition adds up. Both hold at every size of a corpus, so
#: that it is the number of blocks and of partitions that grows.
BLOCK, TOKENS = 8_000_000, 2_000_000
#: The most tasks that blocks are dealt to.
TASKS = 50_000


def pack(a: np.ndarray) -> bytes:
    """An array's size of item, then its bytes of each significance together, compressed."""
    return bytes([a.itemsize]) + zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), 1)


def unpack(b: bytes, kind: type = np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b[1:]), np.uint8).reshape(b[0], -1).T).view(f"<u{b[0]}").ravel().astype(kind)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@dataclass(frozen=True)
class Discounts:
    """The factor of each count from 0 to K (that of 0 is unused), and what every count gives up where none is discounted."""

    factor: np.ndarray
    absolute: float

    @classmethod
    def of(cls, with_count: np.ndarray) -> Discounts:
        """with_count[r]: how many keys have count r, for r from 0 to K + 1.

        Katz's discounts of r > 0; where the keys are too few for one between 0 and 1, it is (r - absolute) / r.
        """
        n = with_count.astype(float)
        absolute = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        factor = np.array([1.0] + [(r - absolute) / r for r in range(1, K + 1)])
        common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
        for r in range(1, K + 1):
            if n[r] and common < 1:
                d = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
                if 0 < d < 1:
                    factor[r] = d
        return cls(factor, absolute)

    def of_counts(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > K, 1.0, self.factor[np.minimum(c, K)])


@dataclass(frozen=True)
class Words:
    """The unigram level: training tokens, distinct ones, discounts, and the probability of the unknown type."""

    tokens: int
    types: int
    discounts: Discounts
    unknown: float
    scale: float

    @classmethod
    def of(cls, tokens: int, types: int, with_count: np.ndarray) -> Words:
        d = Discounts.of(with_count)
        r = np.arange(1, K + 1)
        free = float(((1 - d.factor[1:]) * r * with_count[1 : K + 1]).sum() / tokens) if tokens else 1.0
        if free <= 0:
            # No count is discounted: the unknown type has the share of half a token.
            free = 0.5 / (tokens + 0.5)
            return cls(tokens, types, d, free, 1 - free)
        return cls(tokens, types, d, free, 1.0)

    def probability(self, c: np.ndarray) -> np.ndarray:
        """Of words of these counts; of the unknown type for 0."""
        return np.where(c > 0, self.scale * self.discounts.of_counts(c) * c / max(self.tokens, 1), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def backoff(seen: np.ndarray, kinds: np.ndarray, mass: np.ndarray, count: np.ndarray, d: Discounts) -> tuple[np.ndarray, np.ndarray]:
    """(weight, flat) of histories of these counts: seen[:, r - 1] of their successors have count r, `kinds` there are in
    all, with `mass` of the unigram probability. flat: no successor is discounted, so each gives up the absolute part."""
    r = np.arange(1, K + 1)
    free = (seen * (r * (1 - d.factor[1:]))).sum(axis=1)
    flat = free <= 0
    free = np.where(flat, kinds * d.absolute, free)
    return free / np.maximum(count, 1) / np.maximum(1 - mass, 1e-300), flat


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a block: its documents, its words by falling count, how often training documents have them, and its tokens."""
    context, number = TaskContext.get(), 0
    for batch in batches:
        for at, texts in blocks(batch.column(2), BLOCK):
            parts, ends = [], []
            for text in texts:
                words = text.encode("utf-8", "surrogatepass").lower().split()
                parts += (np.maximum(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), np.uint64(END + 1)), np.array([END], np.uint64))
                ends.append(len(words) + 1)
            words, place, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            tokens = rank[place]
            ids = batch.column(0).slice(at, len(texts))
            train = np.array(batch.column(1).slice(at, len(texts)).to_pylist(), bool)
            learnt = np.bincount(tokens[np.repeat(train, ends)], minlength=len(words))
            row = [
                [(context.partitionId() << 32) + number], [pack(np.array(ids.fill_null(0).to_pylist(), np.int64))], [pack(np.array(ids.is_null().to_pylist(), np.uint8))], [pack(train.astype(np.uint8))],
                [pack(np.array(ends, np.uint32))], [pack(words[order])], [pack(learnt.astype(np.uint32))], [pack(tokens)],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), *(pa.array(x, pa.binary()) for x in row[1:]), pa.array([len(tokens)], pa.int64())], names=["block", "ids", "nulls", "train", "ends", "words", "learnt", "tokens", "size"])
            number += 1


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places) for each part that occurs."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield int(part[order[a]]), order[a:b]


def _word_parts(words: np.ndarray, parts: int) -> np.ndarray:
    return (_mixed(words) % np.uint64(parts)).astype(np.int64)


class Pairs:
    """A block's distinct (history, word) pairs, and where they are dealt."""

    def __init__(self, row: pd.Series, answers: pd.DataFrame, words: Words, parts: int):
        self.ends = unpack(row["ends"])
        self.tokens, self.train = unpack(row["tokens"]), unpack(row["train"], bool)
        vocabulary = unpack(row["words"], np.uint64)
        self.count, self.number = np.zeros(len(vocabulary) + 1, np.int64), np.zeros(len(vocabulary) + 1, np.int64)
        places = dict(_by_part(_word_parts(vocabulary, parts)))
        for part, count, number in zip(answers["part"], answers["counts"], answers["numbers"], strict=True):
            self.count[places[part]], self.number[places[part]] = unpack(count), unpack(number)
        # The start of a document is one more history: it has the end's count, as that is the number of documents.
        start = len(vocabulary)
        self.count[start], self.number[start] = words_end(vocabulary, self.count), -1
        stops = np.cumsum(self.ends)
        history = np.concatenate([[start], self.tokens[:-1]])
        history[(stops - self.ends)] = start
        self.history = history
        # Pairs with an unknown word are none of the table's; but a known history that has no others asks for its weight by them.
        known = (self.count[history] > 0) & (self.count[self.tokens] > 0)
        asked = np.zeros(start + 1, bool)
        asked[history[known]] = True
        known |= (self.count[history] > 0) & ~asked[history]
        keys, place = np.unique(history[known] * (start + 1) + self.tokens[known], return_inverse=True)
        self.of = np.full(len(self.tokens), -1)
        self.of[known] = place
        self.learnt = np.bincount(place[np.repeat(self.train, self.ends)[known]], minlength=len(keys))
        self.first, self.second = keys // (start + 1), keys % (start + 1)
        self.salts = np.minimum(1 + self.count * (PART * parts) // max(words.tokens, 1), parts)
        salt = (_mixed(self.number[self.second]) >> np.uint64(20)) % self.salts[self.first].astype(np.uint64)
        self.part = ((_mixed(self.number[self.first] + 7) + salt) % np.uint64(parts)).astype(np.int64)

    def dealt(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, places of its pairs by history and number of the word, its histories, how many pairs each has)."""
        order = np.lexsort((self.number[self.second], self.first))
        for part, places in _by_part(self.part[order]):
            places = order[places]
            histories, sizes = np.unique(self.first[places], return_counts=True)
            yield part, places, histories, sizes


def words_end(vocabulary: np.ndarray, count: np.ndarray) -> int:
    at = np.flatnonzero(vocabulary == END)
    return int(count[at[0]]) if len(at) else 0


def _gaps(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ascending runs as first values and gaps."""
    gaps = np.diff(numbers, prepend=0)
    starts = np.cumsum(sizes) - sizes
    gaps[starts] = numbers[starts]
    return gaps


def _ungapped(gaps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    starts = np.cumsum(sizes) - sizes
    total = np.cumsum(gaps)
    return total - np.repeat(total[starts] - gaps[starts], sizes)


def katz_scores(docs: DataFrame, *, use: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    A whole text's tokens are its words (A-Z lower-cased, parted by ASCII white space) and one end. The model learns from the
    rows where `use` holds. n_known counts the tokens that training has; base_score is the log10 probability under its
    half-smoothed unigrams, score that under the model. Null and empty texts are an end alone. A null `use` counts as
    false. Repeated rows are learnt from and scored each; without training rows all is unknown, at probability 1; an
    empty table gives no rows; other columns are left out. ids are 64-bit integers.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(use, F.lit(False)).alias("use"), F.col(text_col).alias("text"))
    table = written(rows.mapInArrow(_tokenised, "block long, ids binary, nulls binary, train binary, ends binary, words binary, learnt binary, tokens binary, size long"), "blocks")
    size = table.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("tokens"), F.count("*").alias("blocks")).first()
    parts, tasks = 1 + size["tokens"] // TOKENS, min(TASKS, max(1, size["blocks"]))

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, learnt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, learnt = unpack(words, np.uint64), unpack(learnt, np.uint32)
                asked = [(part, block, pack(words[p]), pack(learnt[p])) for part, p in _by_part(_word_parts(words, parts))]
                yield pa.RecordBatch.from_pylist([dict(zip(("part", "block", "words", "learnt"), a, strict=True)) for a in asked], pa.schema([("part", pa.int64()), ("block", pa.int64()), ("words", pa.binary()), ("learnt", pa.binary())]))

    def count_words(asked: pd.DataFrame) -> pd.DataFrame:
        part, n = int(asked["part"].iloc[0]), len(asked)
        words = [unpack(w, np.uint64) for w in asked["words"]]
        distinct, place = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(place, np.concatenate([unpack(c) for c in asked["learnt"]]), len(distinct)).astype(np.int64)
        # Common words have small numbers.
        number = np.empty(len(total), np.int64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(total))
        number = number * parts + part
        cuts = np.cumsum([len(w) for w in words])[:-1]
        state = [int(total.sum()), int((total > 0).sum()), *np.bincount(np.minimum(total, K + 2), minlength=K + 3)[: K + 2].tolist()]
        out = pd.DataFrame({"block": asked["block"], "part": part, "counts": [pack(total[p].astype(np.uint32)) for p in np.split(place, cuts)], "numbers": [pack(number[p]) for p in np.split(place, cuts)], "state": [None] * n})
        return pd.concat([out, pd.DataFrame({"block": [-1], "part": [part], "counts": [None], "numbers": [None], "state": [state]})])

    asked = table.select("block", "words", "learnt").mapInArrow(ask_words, "part long, block long, words binary, learnt binary")
    counted = written(asked.repartition(parts, "part").groupBy("part").applyInPandas(count_words, "block long, part long, counts binary, numbers binary, state array<long>"), "words")
    states = [r["state"] for r in counted.where("block < 0").select("state").collect()]
    state = np.array(states).sum(axis=0) if states else np.zeros(K + 4, np.int64)
    words = Words.of(int(state[0]), int(state[1]), state[2:])
    words_answers = counted.where("block >= 0").select("block", "part", "counts", "numbers")
    answers = words_answers.repartition(tasks, "block")

    def ask_pairs(key: tuple, block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        pairs = Pairs(block.iloc[0], answers, words, parts)
        out = []
        for part, p, histories, sizes in pairs.dealt():
            out.append((
                part, key[0], pack(pairs.number[histories]), pack((pairs.salts[histories] > 1).astype(np.uint8)), pack(sizes.astype(np.uint32)),
                pack(_gaps(pairs.number[pairs.second[p]], sizes)), pack(pairs.learnt[p].astype(np.uint32)), pack(pairs.count[pairs.second[p]].astype(np.uint32)),
            ))
        return pd.DataFrame(out, columns=["part", "block", "histories", "salted", "sizes", "gaps", "learnt", "counts"])

    def count_pairs(asked: pd.DataFrame) -> pd.DataFrame:
        part = int(asked["part"].iloc[0])
        histories, sizes = [unpack(x) for x in asked["histories"]], [unpack(x) for x in asked["sizes"]]
        lengths = [int(s.sum()) for s in sizes]
        named, of_history = np.unique(np.concatenate(histories), return_inverse=True)
        first = np.repeat(of_history, np.concatenate(sizes))
        second, of_second = np.unique(np.concatenate([_ungapped(unpack(g), s) for g, s in zip(asked["gaps"], sizes, strict=True)]), return_inverse=True)
        keys, place = np.unique(first * len(second) + of_second, return_inverse=True)
        del of_second, second
        total = np.bincount(place, np.concatenate([unpack(x) for x in asked["learnt"]]), len(keys)).astype(np.int64)
        count = np.zeros(len(keys), np.int64)
        count[place] = np.concatenate([unpack(x) for x in asked["counts"]])
        history = _first_of(keys, place, first)
        seen = total > 0
        table = np.stack([np.bincount(history[total == r], minlength=len(named)) for r in range(1, K + 1)] + [np.bincount(history[seen], minlength=len(named))], axis=1)
        mass = np.bincount(history[seen], words.probability(count[seen]), len(named))
        out, a, b = [], 0, 0
        for block, h, n in zip(asked["block"], histories, lengths, strict=True):
            at = of_history[a : a + len(h)]
            out.append((block, part, pack(total[place[b : b + n]].astype(np.uint32)), pack(table[at].astype(np.uint32).T.ravel()), pack(mass[at].view(np.uint64)), None, None))
            a, b = a + len(h), b + n
        flags = np.zeros(len(named), bool)
        flags[of_history] = np.concatenate([unpack(x, bool) for x in asked["salted"]])
        for i in np.flatnonzero(flags):
            out.append((-2, part, None, None, None, [int(named[i]), *table[i].tolist()], float(mass[i])))
        out.append((-1, part, None, None, None, np.bincount(np.minimum(total, K + 2), minlength=K + 3)[: K + 2].tolist(), None))
        return pd.DataFrame(out, columns=["block", "part", "totals", "seen", "masses", "state", "mass"])

    blocked = table.select("block", "train", "ends", "words", "tokens").repartition(tasks, "block")
    asked = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(ask_pairs, "part long, block long, histories binary, salted binary, sizes binary, gaps binary, learnt binary, counts binary")
    counted = written(asked.repartition(parts, "part").groupBy("part").applyInPandas(count_pairs, "block long, part long, totals binary, seen binary, masses binary, state array<long>, mass double"), "pairs")
    found = counted.where("block < 0").select("block", "state", "mass").collect()
    discounts = Discounts.of(np.array([r["state"] for r in found if r["block"] == -1] or [[0] * (K + 2)]).sum(axis=0))
    # Salted histories: at most 2 * PART rows a partition. Their sums over the partitions, by number.
    salted = pd.DataFrame([[*r["state"], r["mass"]] for r in found if r["block"] == -2], columns=["number", *range(K + 1), "mass"]).groupby("number").sum().sort_index()
    salted_numbers, salted_seen, salted_mass = salted.index.to_numpy(np.int64), salted[list(range(K + 1))].to_numpy(np.int64), salted["mass"].to_numpy(float)

    def told(key: tuple, block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        of_pairs = answers[answers["totals"].notna()].set_index("part")
        pairs = Pairs(row, answers[answers["counts"].notna()], words, parts)
        n = len(pairs.count)
        total, seen, mass = np.zeros(len(pairs.first), np.int64), np.zeros((n, K + 1), np.int64), np.zeros(n)
        for part, p, histories, _ in pairs.dealt():
            answer = of_pairs.loc[part]
            total[p] = unpack(answer["totals"])
            seen[histories] = unpack(answer["seen"]).reshape(K + 1, -1).T
            mass[histories] = unpack(answer["masses"], np.uint64).view(np.float64)
        many = np.flatnonzero((pairs.salts > 1) & (pairs.count > 0))
        if len(many) and len(salted_numbers):
            at = np.minimum(np.searchsorted(salted_numbers, pairs.number[many]), len(salted_numbers) - 1)
            many, at = many[salted_numbers[at] == pairs.number[many]], at[salted_numbers[at] == pairs.number[many]]
            seen[many], mass[many] = salted_seen[at], salted_mass[at]
        weight, flat = backoff(seen[:, :K], seen[:, K], mass, pairs.count, discounts)
        single = np.log10(words.probability(pairs.count))
        # A token's level: its pair if training has it, else its word under the history's weight, or under none if the
        # history is unknown.
        history, token = pairs.history, pairs.tokens
        c = np.where(pairs.of >= 0, total[pairs.of], 0) if len(total) else np.zeros(len(token), np.int64)
        direct = np.where(flat[history], c - discounts.absolute, discounts.of_counts(c) * c) / np.maximum(pairs.count[history], 1)
        with np.errstate(divide="ignore"):
            value = np.where(c > 0, np.log10(np.maximum(direct, 1e-300)), single[token] + np.where(pairs.count[history] > 0, np.log10(np.maximum(weight[history], 1e-300)), 0.0))
        starts = np.cumsum(pairs.ends) - pairs.ends
        known = pairs.count[token] > 0
        ids = pd.array(unpack(row["ids"]), dtype="Int64")
        ids[unpack(row["nulls"], bool)] = pd.NA
        return pd.DataFrame({
            "id": ids, "n_tokens": pairs.ends, "n_known": np.add.reduceat(known.astype(np.int64), starts), "train_tokens": words.tokens,
            "base_score": np.add.reduceat(words.base(pairs.count[token]), starts), "score": np.add.reduceat(value, starts),
        })

    both = words_answers.unionByName(counted.where("block >= 0").select("block", "part", "totals", "seen", "masses"), allowMissingColumns=True).repartition(tasks, "block")
    out = table.select("block", "ids", "nulls", "train", "ends", "words", "tokens").repartition(tasks, "block").groupBy("block").cogroup(both.groupBy("block")).applyInPandas(told, "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _first_of(keys: np.ndarray, place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The history of each distinct key."""
    out = np.zeros(len(keys), np.int64)
    out[place] = first
    return out


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder("doc_id", 5) == 1, F.lit(False))
    scored = katz_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), use=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
