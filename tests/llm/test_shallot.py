"""Shallot search against plain k-means on integers."""

import hashlib

import numpy as np
import pytest

from quern.llm import shallot
from quern.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect

from .conftest import CLASHES


def plain(rows, k, rounds, dims, scale=256, salt="2:"):
    """Every vector against every centroid with Python's integers."""
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return sorted(((i, j, d) for (i, v) in kept for d, j in [nearest(v)]), key=str), centres


def test_query_sql(spark, sf):
    compare(QUERIES["op12_clustering"](spark, sf), connect(sf), ORACLES["op12_clustering"])


@pytest.mark.parametrize(("dims", "spread", "n", "k"), [(2, 3, 300, 7), (3, 40, 400, 12), (1, 2, 60, 5), (4, 200, 50, 60), (2, 5, 30, 1)])
def test_ties_repeats_and_few_vectors(spark, dims, spread, n, k):
    rng = np.random.default_rng(dims * n)
    rows = [(int(i) if i % 17 else None, [float(x) / 4 for x in rng.integers(-spread, spread, dims)]) for i in range(n)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found, centres = shallot.cluster_vectors(df, k, 4, dims, 4)
    want, at = plain(rows, k, 4, dims, 4)
    assert centres == at
    assert sorted((tuple(r) for r in found.collect()), key=str) == want


def test_odd_vectors(spark):
    good = [0.5, -0.25, 1.0]
    rows = [(1, good), (2, None), (3, []), (4, [1.0, 2.0]), (5, [1.0, None, 2.0]), (6, [1.0, float("nan"), 2.0]), (7, [float("inf"), 0.0, 0.0]), (None, [0.0, 0.0, 0.0]), (8, good), (8, [*good, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", *(f"1 AS `{c}`" for c in CLASHES))
    got = shallot.clusters(df, 2, 3, 3).collect()
    assert sorted((r.vec_id for r in got), key=str) == [1, 8, None]
    assert all(r.inertia == sum(x.distance for x in got) and r.cluster_inertia == sum(x.distance for x in got if x.cluster == r.cluster) for r in got)
    assert shallot.clusters(df.limit(0), 2, 3, 3).count() == 0
    assert shallot.clusters(df.filter("vec_id IN (2, 3)"), 2, 3, 3).count() == 0
    with pytest.raises(Exception, match="too large"):
        shallot.clusters(spark.createDataFrame([(1, [1e30, 0.0, 0.0])], "vec_id long, embedding array<double>"), 1, 1, 3)


def test_search_keeps_exact_neighbours_and_skips_most_distances():
    rng = np.random.default_rng(5)
    centre = rng.integers(-5000, 5000, (50, 8))
    x = np.concatenate([c + rng.integers(-90, 90, (60, 8)) for c in centre])
    at, before, b = x[rng.choice(len(x), 50, replace=False)], None, shallot.Bounds.none(len(x))
    looked = []
    for _ in range(8):
        c = shallot.Centroids.of(at, before)
        counted, real = [0], shallot.squared

        def count(p, q, counted=counted, real=real):
            counted[0] += len(p)
            return real(p, q)

        shallot.squared = count
        try:
            b = shallot.search(x, c, shallot.Bounds.unpack(b.pack()))
        finally:
            shallot.squared = real
        looked.append(counted[0] / len(x))
        all_ = ((x[:, None, :] - at[None]) ** 2).sum(2)
        assert (b.own == all_.argmin(1)).all()
        others = np.where(np.arange(len(at)) == b.own[:, None], np.iinfo(np.int64).max, all_)
        assert (b.lower <= np.sqrt(others.min(1))).all() and (b.upper >= np.sqrt(all_.min(1))).all()
        s = shallot.sums_of(x, b.own, len(at))
        before, at = at, np.where(s[:, -1:] > 0, s[:, :-1] // np.maximum(s[:, -1:], 1), at)
    assert looked[-1] < 3 < 50
