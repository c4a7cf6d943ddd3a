"""Language identification in two levels: the family first, then one-versus-one linear support vector machines within it.

All levels are linear in a document's mean character n-gram features, so a text's margins are means of a few numbers a word.
The machines are fitted on the driver by numpy, on a bounded sample that is drawn evenly over the languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidweave.llm.bpe import blocks
from bidweave.llm.quality import remainder, within
from bidweave.llm.subwords import WordSums, bag

SIZES, BUCKETS, SCALE = (1, 2, 3), 1 << 15, 30.0
#: About as many documents of a language a fit takes, and the characters of text that all may have together.
SAMPLE, CHARS = 600, 24_000_000
#: Families by ISO 639-1 code. A language not named here is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "dravidian": ["kn", "ml", "ta", "te"],
    "semitic": ["ar", "he", "mt"],
    "malayic": ["id", "ms"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
UNKNOWN = "und"
_letter = regex.compile(r"\p{L}").search


@dataclass(frozen=True)
class LanguageModel:
    """Margins are columns of the mean row: first one a family (one against the rest), then one a pair of languages."""

    languages: tuple[str, ...]
    families: tuple[tuple[int, ...], ...]
    pairs: tuple[tuple[int, int], ...]
    words: WordSums
    #: Bias of each column, and the slope that turns its margin into a log-odds.
    biases: np.ndarray
    slopes: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        odds = (self.words.means(texts)[0] * SCALE + self.biases) * self.slopes
        likely = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        n = len(self.families)
        family = likely[:, :n] / likely[:, :n].sum(axis=1, keepdims=True)
        first = family.argmax(axis=1)
        scores, chosen = family[np.arange(len(texts)), first], np.zeros(len(texts), np.int64)
        for f, members in enumerate(self.families):
            rows = np.flatnonzero(first == f)
            votes = np.zeros((len(rows), len(self.languages)))
            sure = np.full((len(rows), len(self.languages)), 0.0)
            for c, (a, b) in enumerate(self.pairs):
                if a in members:
                    p = likely[rows, n + c]
                    votes[:, a] += p >= 0.5
                    votes[:, b] += p < 0.5
                    sure[:, a] += p
                    sure[:, b] += 1 - p
            # Most votes, then the greatest sum of likelihoods.
            rank = votes + sure / (len(self.languages) + 1)
            rank[:, [x for x in range(len(self.languages)) if x not in members]] = -1
            chosen[rows] = rank.argmax(axis=1)
            if len(members) > 1:
                scores[rows] *= sure[np.arange(len(rows)), chosen[rows]] / (len(members) - 1)
        lettered = [_letter(t) is not None for t in texts]
        return [self.languages[k] if there else UNKNOWN for k, there in zip(chosen, lettered, strict=True)], np.where(lettered, scores, 0.0)


def _machine(bags: list, signs: np.ndarray, rng: np.random.Generator, epochs: int, strength: float) -> tuple[np.ndarray, float, float]:
    """Weights, bias and slope of a linear support vector machine: hinge loss, stochastic steps, averaged over the last half."""
    w, seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-3)
    b, total, total_b, n = 0.0, np.zeros(BUCKETS), 0.0, 0
    # Both sides weigh the same.
    weight = np.where(signs > 0, 0.5 / max((signs > 0).mean(), 1e-9), 0.5 / max((signs < 0).mean(), 1e-9))
    for epoch in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, x = bags[i]
            if signs[i] * (w[ids] @ x + b) < 1:
                g = signs[i] * weight[i] * x
                seen[ids] += g * g
                w[ids] += (g - strength * w[ids]) / np.sqrt(seen[ids])
                b += 0.05 * signs[i] * weight[i]
        if 2 * epoch >= epochs:
            total, total_b, n = total + w, total_b + b, n + 1
    w, b = total / max(n, 1), total_b / max(n, 1)
    margins = np.array([w[ids] @ x + b for ids, x in bags]) * signs
    # The slope under which the sample's signs are likeliest, among a few.
    slope = min((0.5, 1.0, 2.0, 4.0), key=lambda s: np.logaddexp(0, -s * np.clip(margins, -60, 60)).mean() + 0.001 * s) if len(margins) else 1.0
    return w, b, slope


def fit(texts: list[str], langs: list[str], *, epochs: int = 6, strength: float = 1e-4, seed: int = 11) -> LanguageModel:
    """Without texts every text is `und`; with a single language all texts with a letter are of that."""
    rng = np.random.default_rng(seed)
    languages = tuple(sorted(set(langs)))
    bags = [(ids, x.astype(float) * SCALE) for ids, x in (bag(t, SIZES, BUCKETS, False, True) for t in texts)]
    of = np.array([languages.index(x) for x in langs])
    names = sorted({FAMILY_OF.get(x, x) for x in languages})
    families = tuple(tuple(i for i, x in enumerate(languages) if FAMILY_OF.get(x, x) == f) for f in names)
    pairs = tuple(p for members in families for p in combinations(members, 2))
    columns = [_machine(bags, np.where(np.isin(of, members), 1.0, -1.0), rng, epochs, strength) for members in families] if len(families) > 1 else [(np.zeros(BUCKETS), 1.0, 1.0)]
    for a, b in pairs:
        rows = np.flatnonzero((of == a) | (of == b))
        columns.append(_machine([bags[i] for i in rows], np.where(of[rows] == a, 1.0, -1.0), rng, epochs, strength))
    table = np.stack([c[0] for c in columns], axis=1)
    return LanguageModel(languages, families, pairs, WordSums(table, SIZES, False, True), np.array([c[1] for c in columns]), np.array([c[2] for c in columns]))


def train(docs: DataFrame, *, use: Column | None = None, sample: int = SAMPLE, chars: int = CHARS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fits on about `sample` whole documents a language, of those with a language and a text where `use` holds.

    They are drawn by a hash of the id, at a rate for each language that follows its count, with up to `chars` characters in
    all, evenly over the languages; a language's first document is taken whatever its length. Of rows of one language with one
    id (or none) one is learnt from.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.lit(True) if use is None else use))
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], [])
    rate = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, sample / n))])
    place = F.xxhash64(F.col("id"), F.lit("language"))
    drawn = known.where(F.pmod(place, F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20))
    found = drawn.groupBy("lang", "id").agg(F.max(F.length("text")).alias("length"), F.first(place).alias("place")).collect()
    ids = within([((r["lang"], r["id"]), r["lang"], r["length"]) for r in sorted(found, key=lambda r: (r["place"], str(r["id"]), r["lang"]))], chars)
    # About `sample` rows a language.
    chosen = F.broadcast(docs.sparkSession.createDataFrame([tuple(x) for x in ids], T.StructType([T.StructField("l", known.schema["lang"].dataType), T.StructField("i", known.schema["id"].dataType)])))
    rows = drawn.join(chosen, (F.col("lang") == F.col("l")) & F.col("id").eqNullSafe(F.col("i"))).groupBy("lang", "id").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["lang"], str(r["id"])))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row of docs by its whole text alone.

    Texts that are null or have no letter are `und` with score 0. Otherwise the score, from 0 to 1, is the family's share of
    the likelihoods times the mean likelihood over the language's machines. Repeated rows are judged alike; other columns
    are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in blocks(batch.column(1), 1_000_000):
                langs, scores = model.predict(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(langs, pa.string()), pa.array(scores)], names=[id_col, "lang_pred", "score"])

    schema = T.StructType([docs.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: LanguageModel, *, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose language is known with at least that score, each by its whole text alone.

    Texts that are null or have no letter go. Repeated rows stay or go together; an empty table stays empty; other columns may
    have any names.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in blocks(batch.column(place), 1_000_000):
                langs, scores = model.predict(texts)
                yield batch.slice(at, len(texts)).filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, use=remainder("doc_id", 4) != 2)
    return identify(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
