"""Hashed word and character n-gram features of whole texts, for models whose score is a sum over features."""

from __future__ import annotations

import zlib

import numpy as np

#: Words whose sums a task keeps; past it the memory starts anew, which changes no result.
KEPT = 150_000
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def grams(words: list[str], sizes: tuple[int, ...], buckets: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, bucket) for every character n-gram of each word between two marks, and for the word itself."""
    lengths = np.array([len(w) for w in words], np.int64) + 2
    marked = "\x02" + "\x03\x02".join(words) + "\x03"
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    owners, ids = [], []
    with np.errstate(over="ignore"):
        for n in sizes:
            m = len(codes) - n + 1
            if m <= 0:
                continue
            h = np.zeros(m, np.uint64)
            for k in range(n):
                h = h * BASE + codes[k : k + m]
            h = (h ^ (h >> np.uint64(31)) ^ np.uint64(n)) * MIX
            inside = owner[:m] == owner[n - 1 :]
            owners.append(owner[:m][inside])
            ids.append(((h >> np.uint64(33)) % np.uint64(buckets))[inside])
    if whole:
        owners.append(np.arange(len(words)))
        ids.append(np.array([zlib.crc32(w.encode("utf-8", "surrogatepass"), 1) % buckets for w in words], np.uint64))
    return np.concatenate(owners), np.concatenate(ids).astype(np.int64)


def bag(text: str, sizes: tuple[int, ...], buckets: int, whole: bool, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct buckets and their shares, which sum to 1; both are empty for a text without words."""
    words, counts = np.unique(np.array((text.lower() if lower else text).split() or [""], dtype=object).astype(str), return_counts=True)
    if not words[0] and len(words) == 1:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    owners, ids = grams(words.tolist(), sizes, buckets, whole)
    where, place = np.unique(ids, return_inverse=True)
    shares = np.bincount(place, weights=counts[owners])
    return where, (shares / shares.sum()).astype(np.float32)


class WordSums:
    """Sums of a table's rows over the features of texts; the sums of each word are kept."""

    def __init__(self, table: np.ndarray, sizes: tuple[int, ...], whole: bool, lower: bool):
        self.table, self.sizes, self.whole, self.lower = table, sizes, whole, lower
        self.memory = _Memory(table.shape[1])

    def __getstate__(self) -> dict:
        """Tasks start with nothing remembered."""
        return {**self.__dict__, "memory": _Memory(self.table.shape[1])}

    def means(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the mean row over its features (zeros if it has none), and the number of features."""
        if len(self.memory.place) > KEPT:
            self.memory = _Memory(self.table.shape[1])
        memory = self.memory
        split = [(t.lower() if self.lower else t).split() for t in texts]
        memory.learn(self, set().union(*split) - memory.place.keys() if split else set())
        place = memory.place.__getitem__
        lengths = np.array([len(s) for s in split], np.int64)
        flat = np.fromiter((place(w) for s in split for w in s), np.int64, int(lengths.sum()))
        k = self.table.shape[1]
        sums, counts = np.zeros((len(texts), k)), np.zeros(len(texts))
        some = np.flatnonzero(lengths)
        if len(some):
            at = (np.cumsum(lengths) - lengths)[some]
            for c in range(k):
                sums[some, c] = np.add.reduceat(memory.sums[c][flat], at)
            counts[some] = np.add.reduceat(memory.counts[flat], at)
        return sums / np.maximum(counts, 1)[:, None], counts


class _Memory:
    def __init__(self, columns: int):
        self.place: dict[str, int] = {}
        self.sums = [np.zeros(0)] * columns
        self.counts = np.zeros(0)

    def learn(self, model: WordSums, new: set[str]) -> None:
        if not new:
            return
        words = list(new)
        owners, ids = grams(words, model.sizes, model.table.shape[0], model.whole)
        self.sums = [np.concatenate([s, np.bincount(owners, weights=model.table[ids, c], minlength=len(words))]) for c, s in enumerate(self.sums)]
        self.counts = np.concatenate([self.counts, np.bincount(owners, minlength=len(words))])
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
