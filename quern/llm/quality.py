"""Quality classifier: a generalised additive model with pairwise interactions, learned by cyclic boosting.

Each document becomes about twenty numbers that describe its text alone. Every feature is cut into bins at quantiles of
the training sample. Boosting goes round the features: in each round every feature gets one shallow tree (a few cuts of
its bins, found on the residuals of a logistic loss), shrunk and added to that feature's lookup table. Then the pairs
whose product grids explain most of what is left get tables too, boosted in the same way by shallow trees of two levels
(a cut of one feature, then a cut of the other on each side). A score is a sum of table entries, looked up for whole
batches, through the logistic function.

Training data: labelled documents outside the held-out quarter (crc32 of the id as text, modulo 4, is 2), at most
``max_rows`` of them, the first by a hash of the id (documented bound: 20,000 rows of about twenty numbers reach the
driver, one for each id). Labels, language, source and id are never inputs of a score.

Defined cases. A null or empty text has all features 0 and gets the score of that point. Labels that are null or belong
to no document are ignored; of several labels for one id the smallest counts, and of several texts of one id the smallest
row of features. Repeated documents are scored row by row, and all repeats are kept or go. Without any labels the model
is a constant 0.5 (nothing is accepted at 0.7). Other columns of the caller, whatever their names, are not read;
``keep_quality`` returns them as they are. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import col, map_text, numbered, place

FEATURES = (
    "log_chars", "log_words", "mean_word", "long_words", "short_words", "upper", "digits", "marks", "odd_marks", "spaces",
    "distinct_words", "top_word", "repeats_next", "distinct_pairs", "line_chars", "repeated_lines", "ends_in_stop", "bars", "exclaims", "capital_words",
)
ODD = re.compile(r"[#$%&*@^~=<>{}\[\]\\|+_]")
MARKS = re.compile(r"[^\w\s]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
DIGIT = re.compile(r"[0-9]")


def features(text: str) -> list[float]:
    """What ``FEATURES`` names, of a whole text."""
    words = text.split()
    n, k = len(text), len(words)
    if not k:
        return [0.0] * len(FEATURES)
    lines = [s for s in text.split("\n") if s.strip()]
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, k - 1)
    sizes = np.fromiter(map(len, words), np.int64, k)
    same = sum(map(str.__eq__, words, words[1:])) / k
    return [
        float(np.log1p(n)), float(np.log1p(k)), float(sizes.mean()), float((sizes > 12).mean()), float((sizes < 3).mean()),
        len(UPPER.findall(text)) / n, len(DIGIT.findall(text)) / n, len(MARKS.findall(text)) / n, len(ODD.findall(text)) / n, 1 - int(sizes.sum()) / n,
        len(counts) / k, counts.most_common(1)[0][1] / k, same, pairs, float(np.log1p(n / len(lines))),
        1 - len(set(lines)) / len(lines), sum(s.rstrip().endswith((".", "!", "?")) for s in lines) / len(lines), text.count("|") / k, text.count("!") / k, sum(map(str.isupper, words)) / k,
    ]


def feature_rows(texts: list[str]) -> dict:
    return {"x": [features(t) for t in texts]}


def held_out(of: Column) -> Column:
    return F.pmod(F.crc32(of.cast("string").cast("binary")), F.lit(4)) == 2


@dataclass
class Gam:
    """Bin edges per feature, a table per feature, and a table per pair."""

    edges: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def logit(self, b: np.ndarray) -> np.ndarray:
        z = np.full(len(b), self.base)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for (i, j), t in self.pairs.items():
            z += t[b[:, i] // COARSE, b[:, j] // COARSE]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(self.bins(x))))


#: Bins of a feature; neighbouring bins that a pair's table joins.
BINS, COARSE = 32, 4


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """A shallow tree on one feature's bins: values of the bins after the best few cuts, found greedily."""
    value, parts = np.zeros(len(g)), [(0, len(g))]
    G, H = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    worth = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + l2)
    while len(parts) < leaves:
        best = max(((worth(a, c) + worth(c, b) - worth(a, b), i, c) for i, (a, b) in enumerate(parts) for c in range(a + 1, b)), default=(0, 0, 0))
        if best[0] <= 1e-9:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    for a, b in parts:
        value[a:b] = (G[b] - G[a]) / (H[b] - H[a] + l2)
    return value


def _pair_tree(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """A shallow tree on a pair's grid: the best cut along one axis, then the best cut along the other on each side (four leaves)."""
    G, H = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h))

    def box(a: int, b: int, c: int, d: int) -> tuple[float, float]:
        return tuple(v[b, d] - v[a, d] - v[b, c] + v[a, c] for v in (G, H))

    def worth(*at: int) -> float:
        sums = box(*at)
        return sums[0] ** 2 / (sums[1] + l2)

    n, m = g.shape
    best: tuple[float, list] = (-1.0, [])
    for i in range(1, n):  # rows first
        sides = [max((worth(a, b, 0, j) + worth(a, b, j, m), j) for j in range(1, m)) for a, b in ((0, i), (i, n))]
        best = max(best, (sides[0][0] + sides[1][0], [(a, b, c, d) for (a, b), (_, j) in zip(((0, i), (i, n)), sides, strict=True) for c, d in ((0, j), (j, m))]))
    for j in range(1, m):  # columns first
        sides = [max((worth(0, i, c, d) + worth(i, n, c, d), i) for i in range(1, n)) for c, d in ((0, j), (j, m))]
        best = max(best, (sides[0][0] + sides[1][0], [(a, b, c, d) for (c, d), (_, i) in zip(((0, j), (j, m)), sides, strict=True) for a, b in ((0, i), (i, n))]))
    value = np.zeros_like(g)
    for at in best[1]:
        sums = box(*at)
        value[at[0] : at[1], at[2] : at[3]] = sums[0] / (sums[1] + l2)
    return value


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, pair_rounds: int = 20, n_pairs: int = 6, rate: float = 0.15, leaves: int = 3, l2: float = 2.0) -> Gam:
    """Cyclic boosting of shallow trees into tables; deterministic for the same rows in the same order."""
    if not len(y) or y.min() == y.max():
        return Gam([np.zeros(0)] * len(FEATURES), 0.0 if not len(y) else float(np.where(y[0] > 0, 4.0, -4.0)))
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    gam = Gam([np.unique(np.quantile(x[:, j], quantiles)) for j in range(x.shape[1])], float(np.log(y.mean() / (1 - y.mean()))))
    b = gam.bins(x)
    gam.tables = [np.zeros(len(e) + 1) for e in gam.edges]
    z = np.full(len(y), gam.base)
    for _ in range(rounds):
        for j, t in enumerate(gam.tables):
            p = 1 / (1 + np.exp(-z))
            step = rate * _tree(np.bincount(b[:, j], y - p, len(t)), np.bincount(b[:, j], p * (1 - p), len(t)), leaves, l2)
            t += step
            z += step[b[:, j]]
    p = 1 / (1 + np.exp(-z))
    side = BINS // COARSE
    c = b // COARSE
    grid = lambda i, j, v: np.bincount(c[:, i] * side + c[:, j], v, side * side)
    gain = {(i, j): float((grid(i, j, y - p) ** 2 / (grid(i, j, p * (1 - p)) + l2)).sum()) for i, j in combinations(range(x.shape[1]), 2)}
    chosen = sorted(gain, key=lambda k: (-gain[k], k))[:n_pairs]
    gam.pairs = {k: np.zeros((side, side)) for k in chosen}
    for _ in range(pair_rounds):
        for i, j in chosen:
            p = 1 / (1 + np.exp(-z))
            step = rate * _pair_tree(grid(i, j, y - p).reshape(side, side), grid(i, j, p * (1 - p)).reshape(side, side), l2)
            gam.pairs[i, j] += step
            z += step[c[:, i], c[:, j]]
    return gam


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Gam:
    """Fit on labelled documents outside the held-out quarter, ``max_rows`` of them at most."""
    known = labels.select(col(id_col).alias("__id"), col(label_col).cast("int").alias("__y")).filter("__id IS NOT NULL AND __y IN (0, 1)").filter(~held_out(F.col("__id"))).groupBy("__id").agg(F.min("__y").alias("__y"))
    some = F.broadcast(known.orderBy(F.xxhash64("__id"), "__id").limit(max_rows))  # max_rows rows of two numbers; the documents aren't shuffled
    rows = docs.select(col(id_col).alias("__id"), col(text_col).alias("__text")).join(some, "__id")
    found = map_text(rows, "__text", ["__id", "__y"], feature_rows, "x array<double>")
    got = found.groupBy("__id").agg(F.min("__y").alias("y"), F.min("x").alias("x")).toPandas()  # an id is one row, however often it occurs
    got = got.sort_values("__id", kind="stable")
    x = np.array(got.x.tolist(), float).reshape(len(got), len(FEATURES))
    return fit(x, got.y.to_numpy(float))


class Scorer:
    def __init__(self, gam: Gam, name: str = "score"):
        self.gam, self.name = gam, name

    def __call__(self, texts: list[str]) -> dict:
        x = np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))
        return {self.name: self.gam.score(x)}


def score_quality(docs: DataFrame, gam: Gam, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out, score, predicted."""
    scored = map_text(docs, text_col, [id_col], Scorer(gam), "score double")
    i = col(id_col)
    return scored.select(i, F.coalesce(held_out(i), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, gam: Gam, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    rows = numbered(docs)
    scored = map_text(rows, place(docs, text_col), rows.columns, Scorer(gam), "score double")
    return scored.filter(F.col("score") >= threshold).drop("score").toDF(*docs.columns)
