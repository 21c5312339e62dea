"""Reading level of documents: interpolated n-gram models and isotonic regression.

One interpolated trigram model per known level is trained on the labelled samples. Of a document, the distribution of
surprisal over stretches of words is taken under every level's model and described by its quantiles; what each level's
quantiles say, by their means' softmax, is the document's expected level. Isotonic regression (pool adjacent violators)
maps that score monotonically to graded difficulty.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.words import words

#: The scale, easiest first.
LEVELS = ("basic", "intermediate", "advanced")
MIN_WORDS = 60
STRETCH = 12
#: Quantiles that describe a distribution of surprisal, and how many bits a word of difference count as e-fold odds.
QUANTILES, BITS = (0.1, 0.25, 0.5, 0.75, 0.9), 0.5
#: Weights of the trigram, bigram and unigram estimates and of the uniform one.
WEIGHTS = (0.35, 0.35, 0.25, 0.05)
#: Bound of the labelled rows that are fitted on.
MAX_SAMPLES = 20_000


class Trigrams:
    """Interpolated trigram models of several levels over one vocabulary; ids from 1, 0 is any other word."""

    def __init__(self, texts: Sequence[tuple[int, list[str]]], n_levels: int):
        vocabulary = sorted({w for _, t in texts for w in t if not w.isdigit()})
        self.ids = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.size = v = len(vocabulary) + 1
        self.uni = np.zeros((n_levels, v))
        bi: list[dict] = [{} for _ in range(n_levels)]
        tri: list[dict] = [{} for _ in range(n_levels)]
        for level, t in texts:
            ids = self.encode(t)
            np.add.at(self.uni[level], ids, 1)
            for key, n in zip(*np.unique(ids[:-1] * v + ids[1:], return_counts=True), strict=True):
                bi[level][int(key)] = bi[level].get(int(key), 0) + int(n)
            for key, n in zip(*np.unique((ids[:-2] * v + ids[1:-1]) * v + ids[2:], return_counts=True), strict=True):
                tri[level][int(key)] = tri[level].get(int(key), 0) + int(n)
        totals = self.uni.sum(axis=1, keepdims=True)
        self.p1 = WEIGHTS[2] * self.uni / np.maximum(totals, 1) + WEIGHTS[3] / v
        # sparse bigrams and trigrams of all levels: sorted keys, one column of probabilities per level
        self.k2 = np.array(sorted(set().union(*bi)), dtype=np.int64)
        self.k3 = np.array(sorted(set().union(*tri)), dtype=np.int64)
        self.p2 = np.zeros((n_levels, len(self.k2) + 1))
        self.p3 = np.zeros((n_levels, len(self.k3) + 1))
        for level in range(n_levels):
            c2 = np.array([bi[level].get(int(k), 0) for k in self.k2], dtype=float)
            c3 = np.array([tri[level].get(int(k), 0) for k in self.k3], dtype=float)
            if len(c2):
                self.p2[level, :-1] = WEIGHTS[1] * c2 / np.maximum(self.uni[level][self.k2 // v], 1)
            if len(c3):
                before = np.array([bi[level].get(int(k // v), 0) for k in self.k3], dtype=float)
                self.p3[level, :-1] = WEIGHTS[0] * c3 / np.maximum(before, 1)

    def encode(self, t: list[str]) -> np.ndarray:
        get = self.ids.get
        return np.fromiter((get(w, 0) for w in t), dtype=np.int64, count=len(t))

    def surprisal(self, ids: np.ndarray, levels: Sequence[int]) -> np.ndarray:
        """Bits of every word (from the third one) under the models of the given levels."""
        v = self.size
        k2 = ids[1:-1] * v + ids[2:]
        at2 = np.searchsorted(self.k2, k2)
        at2[(at2 >= len(self.k2)) | (self.k2[np.minimum(at2, len(self.k2) - 1)] != k2)] = len(self.k2)
        at3 = np.full(len(k2), len(self.k3), dtype=np.int64)
        known = np.flatnonzero(at2 < len(self.k2))  # a trigram is known only where its last two words are
        k3 = ids[:-2][known] * v * v + k2[known]
        i3 = np.searchsorted(self.k3, k3)
        good = (i3 < len(self.k3)) & (self.k3[np.minimum(i3, len(self.k3) - 1)] == k3)
        at3[known[good]] = i3[good]
        return np.stack([-np.log2(self.p1[n][ids[2:]] + self.p2[n][at2] + self.p3[n][at3]) for n in levels])


def pool_adjacent_violators(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic (non-decreasing) least-squares fit: knots and values for interpolation."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, least x, greatest x
    for xi, yi in zip(x[order], y[order], strict=True):
        blocks.append([yi, 1, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    knots = [k for b in blocks for k in (b[2], b[3])]
    values = [b[0] / b[1] for b in blocks for _ in (0, 1)]
    return np.array(knots), np.array(values)


class LevelModel:
    """Fitted on (text, level index) pairs of known level."""

    def __init__(self, samples: Sequence[tuple[str, int]], n_levels: int = len(LEVELS), stretch: int = STRETCH):
        self.stretch, self.n_levels = stretch, n_levels
        coded = [(level, words(text)) for text, level in samples]
        self.grams = Trigrams(coded, n_levels)
        # scores of the samples by models that have not seen them, half against half
        halves = [Trigrams(coded[k::2], n_levels) for k in (0, 1)]
        scores = np.array([self._score(halves[1 - i % 2], t) for i, (_, t) in enumerate(coded)])
        self.knots, self.values = pool_adjacent_violators(scores, np.array([float(level) for level, _ in coded]))

    def _score(self, grams: Trigrams, t: list[str]) -> float:
        ids = grams.encode(t)
        if len(ids) < 3:
            return 0.0
        bits = grams.surprisal(ids, range(self.n_levels))
        n = max(1, bits.shape[1] // self.stretch)
        starts = np.arange(n) * self.stretch
        means = np.add.reduceat(bits, starts, axis=1) / np.diff([*starts, bits.shape[1]])
        level = np.quantile(means, QUANTILES, axis=1).mean(axis=0)
        odds = np.exp((level.min() - level) / BITS)
        return float(odds @ np.arange(self.n_levels) / odds.sum())

    def difficulty(self, t: list[str]) -> float:
        return float(np.interp(self._score(self.grams, t), self.knots, self.values))


def fit_levels(samples: DataFrame, levels: Sequence[str] = LEVELS, most: int = MAX_SAMPLES) -> LevelModel:
    """Fit on the labelled rows (``sample_text, reading_level``); beyond ``most`` of them, on those of least hash."""
    level = F.lower(F.trim("reading_level"))
    rows = samples.select("sample_text", level.alias("level")).where(level.isin(*levels) & F.col("sample_text").isNotNull()).distinct()
    rows = rows.orderBy(F.xxhash64("sample_text"), "sample_text", "level").limit(most).collect()
    if len({r[1] for r in rows}) < len(levels):
        raise ValueError("samples of every level are needed")
    return LevelModel([(r[0], list(levels).index(r[1])) for r in rows], len(levels))


def reading_levels(documents: DataFrame, samples: DataFrame, levels: Sequence[str] = LEVELS, min_words: int = MIN_WORDS) -> DataFrame:
    """Level of every English document of at least ``min_words`` words.

    Rows of null id, null or short text, or another or no language give no rows; extra columns are ignored;
    repeated rows give one row, of texts that share an id the hardest one counts. Result: ``doc_id, reading_level, difficulty`` (0 for the first level upwards).
    """
    sent = documents.sparkSession.sparkContext.broadcast(fit_levels(samples, levels))
    names = list(levels)

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            ids, grades = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = words(text)
                if len(t) >= min_words:
                    ids.append(doc)
                    grades.append(model.difficulty(t))
            near = [names[min(len(names) - 1, int(g + 0.5))] for g in grades]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(near, pa.string()), pa.array(grades, pa.float64())], names=["doc_id", "reading_level", "difficulty"])

    english = F.lower(F.trim(F.col("lang"))).startswith("en") & F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    docs = documents.where(english).select("doc_id", "text")
    graded = docs.mapInArrow(grade, "doc_id long, reading_level string, difficulty double")
    return graded.groupBy("doc_id").agg(F.max(F.struct("difficulty", "reading_level")).alias("g")).select("doc_id", "g.reading_level", "g.difficulty")


def level_profile(graded: DataFrame) -> DataFrame:
    """Documents and mean difficulty per level."""
    return graded.groupBy("reading_level").agg(F.count("*").alias("n_docs"), F.round(F.avg("difficulty"), 4).alias("mean_difficulty"))
