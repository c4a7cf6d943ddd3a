"""Best-fit packing of tokenised documents into sequences, by bin completion on the histogram of lengths.

Documents of one length are interchangeable, so the problem is its histogram: as many counts as the capacity, however many
documents there are. Branch and bound runs on that: it fills bins around the largest length left with undominated fillings, prunes by the
waste that a better solution may still have, and keeps best-fit solutions as incumbents. How widely it searches is the
caller's choice: all undominated fillings, or the fullest of them. Spark counts the lengths, numbers the pieces of each length, and hands out the places.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidweave.llm.bpe import LETTERS, blocks
from bidweave.llm.memory import Memory
from bidweave.session import written

#: Stretches of text that a task keeps; what it forgets it encodes anew, which changes no result.
KEPT = 300_000
#: A comma or full stop after another mark, with which it is one word to the tokenizer.
GROUPED = re.compile("[^A-Za-z0-9À-ÖØ-öø-ÿ ][.,] ").search

Plan = list[tuple[tuple[int, ...], int]]


def _tokenizer(path: str) -> tuple:
    """The tokenizer, and which of its ids end a word."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
    return tokenizer, ends


class WordTokens:
    """Ids of texts by a tokenizer that drops white space and ends each word's last token with </w>.

    Such a tokenizer's ids are those of the stretches between spaces and line ends. New stretches of Latin letters, with
    ASCII punctuation after them or not, are encoded many at a time and cut at the word ends.
    """

    def __init__(self, path: str):
        self.tokenizer, self.ends = _tokenizer(path)
        self.known = Memory(KEPT)

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def single(self, words: list[str]) -> list[bytes]:
        """Of words that are one word each to the tokenizer."""
        out = []
        for at in range(0, len(words), 5000):
            part = words[at : at + 5000]
            [run] = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(run.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                flat = ids.tobytes()
                out += [flat[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            else:
                out += self.plain(part)
        return out

    def learn(self, new: set[str]) -> None:
        """Words and marks are learnt by themselves, and words with marks after them are both together."""
        words, cut, rest = [], [], []
        for s in new:
            if s.isascii() and s.isalpha():
                words.append(s)
            elif m := LETTERS.fullmatch(s):
                cut.append((s, m[1], m[2])) if m[2] else words.append(s)
            else:
                rest.append(s)
        known = self.known
        parts = {x for _, w, p in cut for x in (w, p)} - known.keys() - new
        words += [x for x in parts if x[0].isalpha()]
        rest += [x for x in parts if not x[0].isalpha()]
        known.update(zip(words, self.single(words), strict=True))
        known.update(zip(rest, self.plain(rest), strict=True))
        known.update((s, known[w] + known[p]) for s, w, p in cut)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [parted(t) for t in texts]
        self.learn(self.known.missing(set().union(*split)))
        known = self.known.__getitem__
        return [b"".join(map(known, s)) for s in split]


def parted(text: str) -> list[str]:
    """Stretches with the ids of the text.

    In Latin-1 texts the case, which the tokenizer ignores, goes first, and commas and full stops are parted from the words
    they follow, so that there are fewer different stretches.
    """
    text = text.replace("\n", " ")
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.split(" ")
    text = text.lower()
    if not GROUPED(text):
        text = text.replace(", ", " , ").replace(". ", " . ")
    return text.split(" ")


def pieces(docs: DataFrame, *, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of each document's ids and end_id, cut every `capacity` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordTokens(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at, texts in blocks(batch.column(1), 2_000_000):
                rows, cut = [], []
                for k, ids in enumerate(encoder.encode(texts)):
                    ids += end
                    for piece, a in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[a : a + 4 * capacity]
                        rows.append((at + k, piece, a // 4, len(part) // 4, zlib.crc32(part)))
                        cut.append(part)
                where, *columns = zip(*rows, strict=True)
                out = [batch.column(0).take(pa.array(where)), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))]
                if with_ids:
                    ends = np.cumsum([0, *(len(x) // 4 for x in cut)]).astype("int32")
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(cut), "<i4"))))
                yield pa.RecordBatch.from_arrays(out, names=[id_col, "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on a histogram. Bins with equal contents are handled together."""
    spaces: list[int] = []
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(space: int, content: tuple[int, ...], n: int) -> None:
        if space not in bins:
            insort(spaces, space)
            bins[space] = []
        bins[space].append((content, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(spaces, length)
            if i == len(spaces):
                m = capacity // length
                if left >= m:
                    put(capacity - m * length, (length,) * m, left // m)
                if left % m:
                    put(capacity - left % m * length, (length,) * (left % m), 1)
                break
            space = spaces[i]
            content, n = bins[space].pop()
            if not bins[space]:
                del bins[space], spaces[i]
            used = min(left, n)
            if used < n:
                put(space, content, n - used)
            put(space - length, (*content, length), used)
            left -= used
    return [x for found in bins.values() for x in found]


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of b fit into the items of a taken as bins: then a filling by b is never better."""

    def fits(i: int, spaces: list[int]) -> bool:
        if i == len(b):
            return True
        for k, s in enumerate(spaces):
            if s >= b[i] and s not in spaces[:k] and fits(i + 1, [*spaces[:k], s - b[i], *spaces[k + 1 :]]):
                return True
        return False

    return sum(b) <= sum(a) and fits(0, list(a))


def fillings(counts: np.ndarray, space: int, width: int) -> list[tuple[int, ...]]:
    """Up to `width` undominated fillings of the space by lengths that counts has, the fullest first, of fewer items first.

    Single items and pairs are searched exhaustively; triples and more start from the few largest that fit.
    """
    there = np.flatnonzero(counts[: space + 1])
    there = there[there > 0]
    if not len(there):
        return [()]
    found: list[tuple[int, ...]] = [(int(there[-1]),)]
    # below[s]: the largest length of at most s.
    below = np.zeros(space + 1, np.int64)
    below[there] = there
    below = np.maximum.accumulate(below)

    def pairs(room: int, n: int) -> list[tuple[int, ...]]:
        first = there[there <= room]
        second = np.minimum(below[room - first], first)
        same = (second == first) & (counts[first] < 2)
        second[same] = below[first[same] - 1]
        order = np.lexsort((-first, -(first + second)))[:n]
        return [(int(a), int(b)) for a, b in zip(first[order], second[order], strict=True) if b]

    found += pairs(space, width)
    if max(map(sum, found)) < space:
        for a in there[::-1][:width].tolist():
            found += [(a, *p) for p in pairs(space - a, 2) if p[0] <= a and max(Counter((a, *p)).items(), key=lambda x: x[1] - counts[x[0]])[1] <= counts[a]]
    # Fill up what has room left.
    full = set()
    for f in found:
        items, room = list(f), space - sum(f)
        have = Counter(items)
        while room and (b := int(below[room])):
            while b and have[b] >= counts[b]:
                b = int(below[b - 1])
            if not b:
                break
            items.append(b)
            have[b] += 1
            room -= b
        if all(n <= counts[x] for x, n in have.items()):
            full.add(tuple(sorted(items, reverse=True)))
    kept: list[tuple[int, ...]] = []
    for f in sorted(full, key=lambda f: (-sum(f), len(f), tuple(-x for x in f))):
        if len(kept) < width and not any(len(f) < 9 and dominates(k, f) for k in kept):
            kept.append(f)
    return kept or [(int(there[-1]),)]


def every_filling(counts: np.ndarray, space: int) -> list[tuple[int, ...]]:
    """All undominated fillings of the space by lengths that counts has, the fullest first: exact, for short histograms."""
    there = [int(x) for x in np.flatnonzero(counts[: space + 1]) if x][::-1]
    full: list[tuple[int, ...]] = []

    def extend(at: int, items: tuple[int, ...], room: int) -> None:
        if at == len(there):
            # What still fits makes a filling that dominates this one.
            if not any(x <= room and items.count(x) < counts[x] for x in there):
                full.append(items)
            return
        x = there[at]
        for n in range(min(int(counts[x]), room // x), -1, -1):
            extend(at + 1, items + (x,) * n, room - n * x)

    extend(0, (), space)
    kept: list[tuple[int, ...]] = []
    for f in sorted(full, key=lambda f: (-sum(f), len(f), tuple(-x for x in f))):
        if not any(dominates(k, f) for k in kept):
            kept.append(f)
    return kept or [()]


class Search(NamedTuple):
    """Fillings and how often each is used, their number of bins, what no packing goes below, and whether none is better."""

    plan: Plan
    bins: int
    bound: int
    optimal: bool


def search(counts: dict[int, int], capacity: int, *, nodes: int | None = 6000, width: int | None = 8) -> Search:
    """Packs all of counts in as few bins as found.

    nodes bounds the branching (None: until all is searched). width bounds the fillings tried at a node; None tries all that
    are undominated, each as often as the counts allow and less often. With a width a filling is used as often as possible.
    So the result is optimal if it meets the bound, or if a search without a width ended by itself; `optimal` says whether.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    rest = int((left * np.arange(capacity + 1)).sum())
    bound = max(-(-rest // capacity), int(left[capacity // 2 + 1 :].sum()))
    best = best_fit(counts, capacity)
    size = sum(n for _, n in best)
    used: list[tuple[tuple[int, ...], int]] = []
    bins, ended = 0, False
    stack: list[Iterator[tuple[tuple[int, ...], int]]] = []

    def branches() -> Iterator[tuple[tuple[int, ...], int]]:
        """Fillings around the largest length left, with how often each is used."""
        large = int(np.flatnonzero(left)[-1])
        left[large] -= 1
        found = every_filling(left, capacity - large) if width is None else fillings(left, capacity - large, width)
        left[large] += 1
        some = [(large, *f) for f in found]
        most = [min(int(left[x]) // k for x, k in Counter(f).items()) for f in some]
        return iter([(f, n) for f, m in zip(some, most, strict=True) for n in range(m, 0 if width is None else m - 1, -1)])

    for _ in count() if nodes is None else range(nodes):
        if size == bound:
            break
        if not rest and bins < size:
            best, size = list(used), bins
        # A better solution may waste no more than this; what is left needs its total length at least.
        if rest and bins + -(-rest // capacity) < size:
            stack.append(branches())
            used.append(((), 0))
        while stack:
            content, n = used[-1]
            for x in content:
                left[x] += n
            rest, bins = rest + n * sum(content), bins - n
            if (branch := next(stack[-1], None)) is None:
                stack.pop()
                used.pop()
                continue
            content, n = branch
            for x in content:
                left[x] -= n
            rest, bins = rest - n * sum(content), bins + n
            used[-1] = (content, n)
            break
        else:
            ended = True
            break
        if len(stack) % 64 == 0 and rest:
            tail = best_fit({int(x): int(left[x]) for x in np.flatnonzero(left)}, capacity)
            if bins + sum(n for _, n in tail) < size:
                best, size = [*used, *tail], bins + sum(n for _, n in tail)
    return Search(best, size, bound, size == bound or ended and width is None)


def bin_completion(counts: dict[int, int], capacity: int, *, nodes: int | None = 6000, width: int | None = 8) -> Plan:
    """The plan that `search` finds."""
    return search(counts, capacity, nodes=nodes, width=width).plan


def pack(found: DataFrame, *, capacity: int, nodes: int | None = 6000, width: int | None = 8, id_col: str = "doc_id", slices: int = 256) -> DataFrame:
    """found with sequence_id, offset and least_sequences: pieces (with their length) in sequences of at most `capacity`.

    What reaches the driver is a count for each length: `capacity` rows, however many pieces there are. nodes and width are
    those of `search`; least_sequences is the number of sequences below which no packing goes, the same in all rows.
    """
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # For each length: the first rank, the first sequence and the offset of its runs of places.
    places: dict[int, list[list[int]]] = {length: [[], [], []] for length in histogram}
    taken: Counter[int] = Counter()
    sequence = 0
    result = search(histogram, capacity, nodes=nodes, width=width)
    for content, n in result.plan:
        at = 0
        for length in content:
            for column, value in zip(places[length], (taken[length], sequence, at), strict=True):
                column.append(value)
            taken[length] += n
            at += length
        sequence += n
    arrays = {length: tuple(map(np.array, p)) for length, p in places.items()}

    # Ranks within a length, in two steps: pieces of the commonest length are spread over the slices.
    sliced = found.withColumn("slice", F.pmod(F.xxhash64(id_col, "piece"), F.lit(slices)))
    before = sliced.groupBy("length", "slice").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("length", "slice").orderBy(id_col, "piece")) - 1).join(before.drop("n"), ["length", "slice"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0))).drop("slice", "before")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sequences, offsets = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            ranks = rows["rank"].to_numpy()
            for length, where in rows.groupby("length").indices.items():
                first, start, offset = arrays[length]
                k = np.searchsorted(first, ranks[where], "right") - 1
                sequences[where], offsets[where] = start[k] + ranks[where] - first[k], offset[k]
            yield rows.assign(sequence_id=sequences, offset=offsets)[[*kept, "sequence_id", "offset"]]

    kept = found.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"
    return ranked.mapInPandas(place, schema).withColumn("least_sequences", F.lit(result.bound).cast("long"))


def pack_documents(docs: DataFrame, *, tokenizer: str, end_id: int = 1, capacity: int = 4096, nodes: int | None = 6000, width: int | None = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset, least_sequences) for the pieces of every row of docs.

    A document's ids are the tokenizer's for its whole text (null: empty) and end_id. Up to `capacity` they are one piece;
    more are cut, with a shorter last piece. Pieces fill their sequences without gaps. Repeated rows, with the same id or
    not, are documents of their own; an empty table gives no rows; other columns are left out.
    """
    table = written(pieces(docs, tokenizer=tokenizer, end_id=end_id, capacity=capacity, id_col=id_col, text_col=text_col), "pieces")
    return pack(table, capacity=capacity, nodes=nodes, width=width, id_col=id_col)


def sequences(docs: DataFrame, placed: DataFrame, *, tokenizer: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, ids array<int>): the sequences themselves. Ids of docs must be unique."""
    cut = pieces(docs, tokenizer=tokenizer, end_id=end_id, capacity=capacity, with_ids=True, id_col=id_col, text_col=text_col)
    parts = cut.select(id_col, "piece", "ids").join(placed.select(id_col, "piece", "sequence_id", "offset"), [id_col, "piece"])
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda s: s["ids"])).alias("ids"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer=public_tokenizers.path("word_bpe_49k.json"))
