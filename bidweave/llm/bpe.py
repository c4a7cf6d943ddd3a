"""Byte-level BPE encoding and decoding by replaying the merges over a corpus of words.

Texts are cut into words by the tokenizer's pattern, and the different words of a block of documents are encoded together: an
inverted index from token pair (as the rank that the pair merges to) to positions gives every place of a merge at once, merges
apply in rank order, and each one touches its two neighbours alone. Blocks need nothing from each other.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text that are worked on at a time.
BLOCK = 4_000_000
#: Bytes of text whose words are encoded together; each merge of the ranks is replayed once for them.
TOGETHER = 16_000_000
#: Bytes of text that are cut at a time: a character takes some tens of bytes then.
CUT = 500_000
#: Ids in a batch of rows.
IDS = 300_000
#: Latin letters and ASCII marks after them, but the apostrophe: two words, or one, by the published pattern.
LETTERS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)")
#: The kinds of characters that the published pattern tells apart, and that of none.
MARK, LETTER, NUMBER, WHITE, NONE = range(5)


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: a base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encodes words (bytes) by the ranks of their tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # Every pair of tokens that together are a token, and that token's rank.
        made = sorted((ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        self.pairs = np.array([p for p, _ in made] or [-1], np.int64)
        self.made = np.array([r for _, r in made] or [-1], np.int32)
        self.size = max(ranks.values()) + 1
        self.bytes = {r: len(t) for t, r in ranks.items()}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the tokens that a and b merge to; -1 where there is none."""
        pairs = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.pairs, pairs)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == pairs, self.made[at], -1)

    def alone(self, word: bytes) -> list[int]:
        """The lowest-ranked, leftmost pair of the word merges first, until none does."""
        tokens = [bytes([b]) for b in word]
        while pairs := [(r, i) for i in range(len(tokens) - 1) if (r := self.ranks.get(tokens[i] + tokens[i + 1], -1)) >= 0]:
            i = min(pairs)[1]
            tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]
        return [self.ranks[t] for t in tokens]

    def merge(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words laid end to end (bytes, and where each word ends), and the number of ids up to each word's end."""
        ids = self.byte[data]
        starts = np.concatenate([[0], ends[:-1]])
        after, before = np.arange(1, len(ids) + 1, dtype=np.int32), np.arange(-1, len(ids) - 1, dtype=np.int32)
        after[ends - 1], before[starts] = -1, -1
        # The rank that the token at a place merges to with the one after it, and the inverted index: the places of each rank.
        merges = np.full(len(ids), -1, np.int32)
        inner = np.flatnonzero(after >= 0)
        merges[inner] = self.rank(ids[inner], ids[inner + 1])
        there = np.flatnonzero(merges >= 0).astype(np.int32)
        there = there[np.argsort(merges[there], kind="stable")]
        cuts = np.searchsorted(merges[there], np.arange(self.size + 1)).tolist()
        # Places that merges add to the index.
        index: dict[int, list[int]] = defaultdict(list)
        odd: list[np.ndarray] = []
        for r in range(self.size):
            p, added = there[cuts[r] : cuts[r + 1]], index.pop(r, None)
            if added:
                p = np.unique(np.concatenate([p, np.array(added, np.int32)]))
            # Places that an earlier merge has changed stay in the index; they count if they still merge to r.
            if not len(p) or not len(p := p[merges[p] == r]):
                continue
            q = after[p]
            if len(p) > 1 and (p[1:] == q[:-1]).any():
                taken, free = [], -1
                for x, y in zip(p.tolist(), q.tolist(), strict=True):
                    if x != free:
                        taken.append(x)
                        free = y
                p = np.array(taken, np.int32)
                q = after[p]
            k = after[q]
            ids[p], merges[q], after[p] = r, -1, k
            ids[q] = -1
            right = k >= 0
            before[k[right]] = p[right]
            left = before[p]
            left = left[left >= 0]
            merges[p] = -1
            touched = np.concatenate([left, p[right]])
            new = self.rank(ids[touched], ids[after[touched]])
            merges[touched] = new
            some = new >= 0
            # A lower rank than the one at work: that word's order is its own.
            if (low := some & (new < r)).any():
                odd.append(touched[low])
            for x, y in zip(new[some].tolist(), touched[some].tolist(), strict=True):
                index[x].append(y)
        for w in set(np.searchsorted(ends, np.concatenate(odd), "right").tolist()) if odd else ():
            a, b = int(starts[w]), int(ends[w])
            ids[a:b] = -1
            for token in self.alone(data[a:b].tobytes()):
                ids[a] = token
                a += self.bytes[token]
        alive = ids >= 0
        return ids[alive], np.cumsum(np.add.reduceat(alive, starts, dtype=np.int64))

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian 32-bit integers."""
        if not words:
            return []
        ids, stops = self.merge(np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words]))
        return [x.astype("<i4").tobytes() for x in np.split(ids, stops[:-1])]


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of each code point in the published pattern."""
    kinds, every = np.full(0x110000, MARK, np.uint8), np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    for kind, some in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
        for m in regex.finditer(some, every):
            kinds[m.start() : m.end()] = kind
    return kinds


def begins(data: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where the published pattern's matches begin in texts laid end to end (UTF-8 bytes, and where each begins; none is empty).

    A match is a run of one kind with the space before it, if any. Of white space before another character, the last is a match
    of its own, or goes with what follows if it is a space. An apostrophe that begins a match takes an English ending with it.
    """
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    heads = np.searchsorted(at, heads)
    kind = _kinds()[points]
    before, after = np.full_like(kind, NONE), np.full_like(kind, NONE)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    before[heads], after[heads[1:] - 1] = NONE, NONE
    spaced = np.zeros(len(kind), bool)
    spaced[1:] = points[:-1] == ord(" ")
    spaced[heads] = False
    found = np.where(kind == WHITE, (before != WHITE) | (after < WHITE), (kind != before) & ~spaced)
    q = np.flatnonzero((points == ord("'")) & found & (after == LETTER))
    x, y = points[q + 1], points.take(q + 2, mode="clip")
    two = (after[q + 1] == LETTER) & (np.isin(x, [ord("r"), ord("v")]) & (y == ord("e")) | (x == ord("l")) & (y == ord("l")))
    ending = two | np.isin(x, [ord(c) for c in "stmd"])
    stops = (q + 2 + two)[ending]
    found[q[ending] + 1] = False
    found[stops[stops < len(found)]] = True
    return at[found]


class Encoder:
    """Encodes texts: their words are found and numbered, and the different ones are encoded together."""

    def __init__(self, replay: MergeReplay, pattern: str):
        self.replay, self.published = replay, pattern == public_tokenizers.PATTERN
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The texts' words (binary), and the number of words before each text, and of all."""
        if not self.published:
            cut = [[w for w in self.find(t) if w] for t in texts.to_pylist()]
            return pa.array([w.encode() for words in cut for w in words], pa.binary()), np.cumsum([0, *map(len, cut)])
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        all_bytes = np.frombuffer(data or b"", np.uint8)
        heads, found = np.unique(ends[:-1][np.diff(ends) > 0]), []
        some = np.split(heads, np.flatnonzero(np.diff(heads // CUT)) + 1) if len(heads) else []
        for part, end in zip(some, [*(p[0] for p in some[1:]), ends[-1]], strict=False):
            found.append(part[0] + begins(all_bytes[part[0] : end], part - part[0]))
        starts = np.concatenate([*found, ends[-1:]]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), data])
        return words, np.searchsorted(starts, ends)

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text (null: empty)."""
        words, counts = self.words(pc.fill_null(texts, "").cast(pa.string()))
        coded = words.dictionary_encode()
        _, ends, data = coded.dictionary.buffers()
        if not len(words):
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.int32()))
        ends = np.frombuffer(ends, np.int32)[: len(coded.dictionary) + 1]
        ids, stops = self.replay.merge(np.frombuffer(data, np.uint8)[: ends[-1]], ends[1:])
        # An id is four bytes of a word's value, so the values are copied as they are.
        values = [None, pa.py_buffer(np.concatenate([[0], stops]) * 4), pa.py_buffer(ids.astype("<i4"))]
        _, ends, data = pa.Array.from_buffers(pa.large_binary(), len(stops), values).take(coded.indices).buffers()
        ends = np.frombuffer(ends, np.int64)[counts] // 4
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(data, "<i4")[: ends[-1]]))


@lru_cache(maxsize=1)
def _replay(path: str) -> MergeReplay:
    return MergeReplay(read_ranks(path))


@lru_cache(maxsize=1)
def _tokens(path: str) -> pa.Array:
    """Each id's token; null where an id has none."""
    token = {r: t for t, r in read_ranks(path).items()}
    return pa.array([token.get(r) for r in range(max(token) + 1)], pa.large_binary())


def blocks(texts: pa.Array, chars: int = BLOCK) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts (null: empty) of about so many characters, each with the place of its first."""
    at, size, run = 0, 0, []
    for i, text in enumerate(texts):
        run.append(text.as_py() or "")
        size += len(run[-1])
        if size >= chars:
            yield at, run
            at, size, run = i + 1, 0, []
    if run:
        yield at, run


def runs(batches: Iterator[pa.RecordBatch], most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of about so many bytes of text (the second column), across batches."""
    held, size = [], 0
    for batch in batches:
        # A row counts for some bytes, so empty texts end a run too.
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64) + 16)
        at = 0
        while at < len(batch):
            done = ends[at - 1] if at else 0
            to = min(len(batch), int(np.searchsorted(ends, done + most - size)) + 1)
            held.append(batch.slice(at, to - at))
            at, size = to, size + ends[to - 1] - done
            if size >= most:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def parts(ends: np.ndarray, most: int = IDS) -> Iterator[tuple[int, int]]:
    """From and to which list there are about so many ids, by the ends of lists (from 0); a list of more is alone."""
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, to
        at = to


def encode(docs: DataFrame, *, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row of docs: the whole text's tokens, each match of the pattern encoded separately.

    ranks: a tiktoken rank file that all executors have at this path. No special tokens: their strings are ordinary text.
    Null and empty texts have no ids; repeated rows are encoded alike; other columns are left out.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_replay(ranks), pattern)
        for run in runs(batches):
            ids = encoder.encode(run.column(1))
            for at, to in parts(ids.offsets.to_numpy()):
                yield pa.RecordBatch.from_arrays([run.column(0).slice(at, to - at), ids.slice(at, to - at)], names=[id_col, "ids"])

    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(id_col, text_col).mapInArrow(encoded, schema)


def decode(encoded: DataFrame, *, ranks: str, id_col: str = "doc_id") -> DataFrame:
    """encoded with the column `decoded` (binary): the bytes of its ids. A null list decodes to no bytes; unknown ids fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _tokens(ranks)
        for batch in batches:
            ids = batch.column(1)
            flat, ends = ids.flatten(), np.cumsum([0, *pc.fill_null(ids.value_lengths(), 0).to_numpy()])
            for at, to in parts(ends):
                found = token.take(flat.slice(ends[at], ends[to] - ends[at]))
                if found.null_count:
                    raise KeyError(f"an id without a token in {ranks}")
                # Tokens behind each other are the texts' bytes.
                _, stops, data = found.buffers()
                stops = np.frombuffer(stops, np.int64)[ends[at : to + 1] - ends[at]]
                texts = pa.Array.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(stops), data]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), ids.slice(at, to - at), texts], names=[id_col, "ids", "decoded"])

    schema = T.StructType([encoded.schema[id_col], encoded.schema["ids"], T.StructField("decoded", T.BinaryType())])
    return encoded.select(id_col, "ids").mapInArrow(run, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks=ranks, pattern=public_tokenizers.PATTERN)
    return decode(encoded, ranks=ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
