"""Linear probes: logistic regressions at many strengths of regularisation by one solver that shares its passes over the data."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.rank import materialise

#: 45 strengths of regularisation, evenly spaced in the exponent.
STRENGTHS = tuple(10 ** (-6 + 11 * i / 44) for i in range(45))
#: Pairs of steps and gradients that a fit remembers, passes over the data at most, and the gradient at which a fit is done.
MEMORY, PASSES, TOLERANCE = 20, 1500, 3e-6


class Descent:
    """One strength's limited-memory quasi-Newton descent, fed with losses and gradients from outside.

    ``curvature`` bounds the Hessian from above (for the penalised weights of any class), so the first step always descends.
    """

    def __init__(self, shape: tuple[int, int], curvature: np.ndarray):
        self.at, self.bound = np.zeros(shape), np.linalg.inv(curvature)
        self.loss = self.gradient = self.way = None
        self.step, self.done, self.pairs = 0.0, False, deque(maxlen=MEMORY)

    def trial(self) -> np.ndarray:
        return self.at if self.way is None else self.at + self.step * self.way

    def tell(self, loss: float, gradient: np.ndarray) -> None:
        """What the trial point gave."""
        if self.way is not None:
            slope = float((self.gradient * self.way).sum())
            if not loss <= self.loss + 1e-4 * self.step * slope + 1e-15 * abs(self.loss):
                self.step /= 2
                self.done = self.step < 1e-12
                return
            s, y = self.step * self.way, gradient - self.gradient
            if (curve := float((s * y).sum())) > 1e-300:
                self.pairs.append((s, y, 1 / curve))
            self.at = self.at + s
        self.loss, self.gradient = loss, gradient
        self.done = bool(np.abs(gradient).max() <= TOLERANCE)
        self.way, self.step = -self._scaled(gradient), 1.0

    def _scaled(self, v: np.ndarray) -> np.ndarray:
        """The inverse Hessian's estimate times v: two loops over the remembered pairs around the bound's inverse."""
        v, shares = v.copy(), []
        for s, y, r in reversed(self.pairs):
            shares.append(a := r * float((s * v).sum()))
            v = v - a * y
        scale = 1.0
        if self.pairs:
            s, y, r = self.pairs[-1]
            scale = 1 / (r * float((y * (y @ self.bound)).sum()))
        v = scale * (v @ self.bound)
        for (s, y, r), a in zip(self.pairs, reversed(shares), strict=True):
            v = v + s * (a - r * float((y * v).sum()))
        return v


def _pack(k: int, several: bool, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of rows (vector, label): flat (vectors with a one after each) and hot (one flag per class)."""
    for batch in batches:
        if len(batch):
            x = np.stack(batch.iloc[:, 0].to_numpy()).astype(np.float64)
            hot = np.zeros((len(x), k), np.uint8)
            if several:
                for row, labels in zip(hot, batch.iloc[:, 1], strict=True):
                    row[[c for c in labels if 0 <= c < k]] = 1
            else:
                y = batch.iloc[:, 1].to_numpy()
                inside = np.flatnonzero((y >= 0) & (y < k))
                hot[inside, y[inside]] = 1
            yield pd.DataFrame({"flat": [np.concatenate([x, np.ones((len(x), 1))], 1).tobytes()], "hot": [hot.tobytes()]})


def _unpack(block, k: int) -> tuple[np.ndarray, np.ndarray]:
    hot = np.frombuffer(block.hot, np.uint8).reshape(-1, k)
    return np.frombuffer(block.flat, np.float64).reshape(len(hot), -1), hot


def _slots(total: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"slot": np.arange(total.size, dtype=np.int32), "amount": total.ravel()})


def _gram(k: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for batch in batches:
        for block in batch.itertuples():
            x, _ = _unpack(block, k)
            total = x.T @ x + (0 if total is None else total)
    if total is not None:
        yield _slots(total)


def _chances(z: np.ndarray, several: bool) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of z (rows, strengths, classes), and the part of the loss that doesn't need the labels."""
    if several:
        return 0.5 * (1 + np.tanh(z / 2)), np.logaddexp(0, z).sum((0, 2))
    top = z.max(2, keepdims=True)
    e = np.exp(z - top)
    sums = e.sum(2, keepdims=True)
    return e / sums, (top + np.log(sums)).sum((0, 2))


def _losses(weights: np.ndarray, several: bool, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Summed losses and gradients of all strengths (weights: strengths, classes, components and intercept)."""
    n, k, p = weights.shape
    loss, gradient = np.zeros(n), np.zeros((n * k, p))
    for batch in batches:
        for block in batch.itertuples():
            whole, hot_ = _unpack(block, k)
            for i in range(0, len(whole), 2048):
                x, hot = whole[i : i + 2048], hot_[i : i + 2048]
                z = (x @ weights.reshape(n * k, p).T).reshape(len(x), n, k)
                chance, free = _chances(z, several)
                loss += free - np.einsum("isk,ik->s", z, hot)
                gradient += (chance - hot[:, None, :]).reshape(len(x), n * k).T @ x
    yield _slots(np.concatenate([loss, gradient.ravel()]))


def _summed(rows: DataFrame, run, size: int) -> np.ndarray:
    """Per-slot sums of what the tasks yield; only ``size`` numbers reach the driver."""
    out = np.zeros(size)
    got = rows.mapInPandas(run, "slot int, amount double").groupBy("slot").agg(F.sum("amount").alias("amount")).toPandas()
    out[got["slot"]] = got["amount"]
    return out


def fit_logistic(rows: DataFrame, n: int, k: int, cs: Sequence[float], several: bool = False) -> np.ndarray:
    """Weights (strengths, classes, components and intercept) of L2 logistic regressions: mean loss and |w|^2 / (2 c n), intercepts free.

    ``rows`` are packed blocks. All strengths descend together: a pass evaluates the next point of each that isn't done, and one
    job adds up their losses and gradients.
    """
    gram = _summed(rows, partial(_gram, k), int(rows.select(F.max((F.length("flat") / 8) / (F.length("hot") / k))).first()[0]) ** 2)
    p = int(round(gram.size**0.5))
    gram = gram.reshape(p, p) / n
    ridge = np.diag(np.append(np.ones(p - 1), 0.0))
    fits = [Descent((k, p), (0.25 if several else 0.5) * gram + ridge / (c * n) + 1e-12 * np.eye(p)) for c in cs]
    for _ in range(PASSES):
        live = [i for i, f in enumerate(fits) if not f.done]
        if not live:
            break
        weights = np.stack([fits[i].trial() for i in live])
        sums = _summed(rows, partial(_losses, weights, several), len(live) * (1 + k * p)) / n
        gradients = sums[len(live) :].reshape(weights.shape)
        for j, i in enumerate(live):
            w = weights[j] @ ridge
            fits[i].tell(sums[j] + (w * w).sum() / (2 * cs[i] * n), gradients[j] + w / (cs[i] * n))
    return np.stack([f.at for f in fits])


def _right(weights: np.ndarray, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows whose first best class is theirs, per strength."""
    n, k, p = weights.shape
    total = np.zeros(n)
    for batch in batches:
        for block in batch.itertuples():
            x, hot = _unpack(block, k)
            for i in range(0, len(x), 2048):
                best = (x[i : i + 2048] @ weights.reshape(n * k, p).T).reshape(-1, n, k).argmax(2)
                total += np.take_along_axis(hot[i : i + 2048], best, 1).sum(0)
    yield _slots(total)


def _said(weights: np.ndarray, several: bool, at: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The prediction of one strength beside the caller's columns: a class, or the classes' probabilities."""
    for batch in batches:
        if len(batch):
            x = np.stack(batch.iloc[:, at].to_numpy()).astype(np.float64)
            z = x @ weights[:, :-1].T + weights[:, -1]
            yield batch.assign(prediction=list(0.5 * (1 + np.tanh(z / 2))) if several else z.argmax(1).astype(np.int32))


def probe_logreg(train: DataFrame, val: DataFrame, test: DataFrame, cs: Sequence[float] = STRENGTHS, refit: bool = True, n_classes: int | None = None, vector: str = "embedding", label: str = "label") -> DataFrame:
    """L2 logistic regressions over C, the best on ``val`` (first of ties), refitted on train and val, and what it says of
    ``test``, whose rows no fit has seen: the test rows with prediction, val_score, c.

    With ``n_classes`` the label is an array of classes: one regression for each class against the rest, chosen by macro
    average precision, and the prediction is an array of the classes' probabilities. Rows of train and val without a vector or
    label are left out, test rows without a vector too.
    """
    from quern.operators.classification import agg_avg_precision

    several = n_classes is not None
    known = [x.filter(F.col(vector).isNotNull() & F.col(label).isNotNull()) for x in (train, val)]
    k = n_classes if several else int(known[0].agg(F.max(label)).first()[0]) + 1
    said = lambda of, weights: of.filter(F.col(vector).isNotNull()).mapInPandas(partial(_said, weights, several, of.columns.index(vector)), ", ".join(f"`{c}` {t}" for c, t in of.dtypes) + (", prediction array<double>" if several else ", prediction int"))
    packed, sizes = [], []
    for part in known:
        rows = part.select(vector, label)
        packed.append(materialise(rows.mapInPandas(partial(_pack, k, several), "flat binary, hot binary"), "probe").persist())
        sizes.append(rows.count())
    try:
        weights = fit_logistic(packed[0], sizes[0], k, cs, several)
        if several:
            scores = [agg_avg_precision(said(known[1], w), "prediction", label).first()[0] or 0.0 for w in weights]
        else:
            scores = (_summed(packed[1], partial(_right, weights), len(cs)) / max(sizes[1], 1)).tolist()
        best = max(range(len(cs)), key=lambda i: (scores[i], -i))
        final = fit_logistic(packed[0].unionByName(packed[1]), sum(sizes), k, [cs[best]], several)[0] if refit else weights[best]
    finally:
        for part in packed:
            part.unpersist()
    return said(test, final).withColumn("val_score", F.lit(float(scores[best]))).withColumn("c", F.lit(float(cs[best])))
