"""Hand-computed cases, invariants and edge cases of the operators."""

import io
import itertools
import math
import random
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.expr import clip, fn_interp, fn_uri_rewrite, grid_lookup, strata
from quern.functions.rank import global_rank, group_quantiles, materialise, running_minima, shared_path
from quern.operators import classification, density, joins, metrics, neighbours, probes, reweight, sampling, trials, vectors
from quern.plans.fixtures import view
from quern.sources import files, readers, sinks
from quern.streaming import live


@pytest.fixture(scope="module")
def scored(spark, sf):
    return view(spark, sf, "scored").cache()


@pytest.fixture(scope="module")
def pmf(spark, sf):
    return view(spark, sf, "target_pmf")


def predictions(spark, pred, label, grp):
    return spark.createDataFrame([(i, float(p), float(y), g) for i, (p, y, g) in enumerate(zip(pred, label, grp, strict=True))], "sample_id long, pred double, label double, grp int")


def test_perfect_predictions_score_zero(spark):
    df = predictions(spark, (0.1, 0.2, 0.3, 0.4), (0.1, 0.2, 0.3, 0.4), (0, 1, 0, 1))
    r = metrics.agg_fair_score(df).first()
    assert r.score < 1e-8 and r.abs_gap < 1e-8 and r.r2 == 1
    assert metrics.agg_is_score(df.withColumn("w", F.lit(1.0)), "w").first().score == r.score


def test_disparity_raises_the_first_group(spark):
    r = metrics.agg_fair_score(predictions(spark, (0.5, 0.5, 0, 0), (0, 0, 0, 0), (0, 0, 1, 1))).first()
    assert r.err_f > r.err_m and math.isclose(r.score, (r.err_f + r.err_m) / 2 + r.abs_gap) and r.r2 == 0


def test_penalty_of_the_hand_computed_case(spark):
    df = predictions(spark, (1, 1, 0, 0), (0, 0, 0, 0), (0, 0, 1, 1)).withColumn("one", F.lit(1.0))
    r = metrics.agg_tilted_penalty(df, 2.0, 0.0, "one").first()
    assert (r.loss, r.abs_gap) == (2.5, 1.0)
    alone = metrics.agg_tilted_penalty(df.filter("grp = 0"), 2.0, 0.0, "one").first()
    assert (alone.loss, alone.abs_gap) == (1.0, 0.0)


def test_metrics_without_rows_or_groups(spark):
    none = predictions(spark, (), (), ())
    assert metrics.agg_fair_score(none).first().score == 0
    r = metrics.agg_fair_score(predictions(spark, (1.0,), (0.0,), (None,))).first()
    assert (r.score, r.n, r.n_no_group) == (0, 1, 1)
    assert metrics.agg_bin_group_report(none).count() == 10


def test_weight_bounds_and_floor(spark, pmf):
    labels = spark.range(100).selectExpr("id AS sample_id", "id / 200.0D AS label", "CAST(id % 2 AS INT) AS grp")
    extra = labels.unionByName(spark.createDataFrame([(1000, 0.6, 0), (1001, 0.9, 1)], "sample_id long, label double, grp int"))
    for target in ("hc", "joint"):
        got = {r.sample_id: r.weight for r in reweight.rw_weight(extra, labels, pmf, target).collect()}
        assert all(0.05 <= w <= 5 for w in got.values()) and got[1000] == got[1001] == 1
        assert all(w >= 1 for k, w in got.items() if 102 < 5 * k < 500)


def test_quantile_map_moves_to_the_target(spark, scored, pmf):
    mapped = reweight.cal_quantile_map(scored, pmf).withColumn("x", F.col("calibrated") - 1e-9)
    before = density.agg_w1(density.binned_mass(scored, "pred", 200), pmf, 1 / 200).first().w1
    after = density.agg_w1(density.binned_mass(mapped, "x", 200), pmf, 1 / 200).first().w1
    assert after < before / 10
    same = reweight.cal_quantile_map(scored, pmf, strength=0.0)
    assert same.filter(F.abs(F.col("calibrated") - F.col("pred")) > 1e-12).count() == 0


def test_isotonic_equals_pooled_adjacent_violators(spark):
    rng = random.Random(1)
    rows = [(i, round(rng.random(), 2), rng.random(), 0) for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id long, pred double, label double, grp int")
    got = {r.sample_id: r.calibrated for r in reweight.cal_isotonic(df, df).collect()}
    blocks = []
    for x, group in itertools.groupby(sorted((p, y) for _, p, y, _ in rows), key=lambda t: t[0]):
        ys = [y for _, y in group]
        ws = [1 / 30 + y for y in ys]
        blocks.append([sum(w * y for w, y in zip(ws, ys, strict=True)) / sum(ws), sum(ws), [x]])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    want = {x: v for v, _, xs in blocks for x in xs}
    assert all(abs(got[i] - want[p]) < 1e-9 for i, p, _, _ in rows)


def test_equal_scores_make_the_weighted_ensemble_a_mean(spark, sf):
    preds = view(spark, sf, "preds")
    equal = preds.select("model").distinct().withColumn("score", F.lit(0.2))
    both = reweight.ens_mean(preds).join(reweight.ens_weighted(preds, equal).withColumnRenamed("pred", "w"), "sample_id")
    assert both.filter(F.abs(F.col("pred") - F.col("w")) > 1e-12).count() == 0


def test_samples_keep_their_promises(spark, scored):
    n = scored.count()
    folds = sampling.smp_kfold(scored, 5)
    assert metrics.agg_fold_tiling_check(folds, scored).first().tiles
    sizes = [r["count"] for r in folds.groupBy("stratum", "fold").count().collect()]
    assert sum(sizes) == n
    assert sampling.smp_proportional(scored, 300).count() == 300
    assert sampling.smp_random_holdout(scored.limit(3)).count() == 1
    shards = sampling.smp_epoch_shards(scored, 7).groupBy("shard").count().collect()
    assert {r["count"] for r in shards} == {-(-n // 7)}
    cropped = sampling.smp_epoch_shards(scored, 7, pad=False)
    assert cropped.count() == n - n % 7 and cropped.select("sample_id").distinct().count() == n - n % 7
    batches = sampling.smp_balanced_batches(scored, 32)
    per = batches.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("grp") == 0).alias("f")).collect()
    assert {r.n for r in per} == {32} and len({r.f for r in per}) == 1
    one_group = sampling.smp_balanced_batches(scored.filter("grp = 0"), 32).groupBy("batch_id").count()
    assert {r["count"] for r in one_group.collect()} == {32}


def test_samples_don_t_depend_on_partitioning(scored):
    a = sampling.smp_random_holdout(scored.repartition(1)).select("sample_id")
    assert a.exceptAll(sampling.smp_random_holdout(scored.repartition(13)).select("sample_id")).count() == 0


def test_global_rank_is_a_permutation_in_order(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS v")
    got = [(r.v, r.id) for r in global_rank(df, [F.col("v"), F.col("id")]).orderBy("rank").collect()]
    assert got == sorted(got) and len(got) == 1000
    assert global_rank(df.limit(0), ["v"]).count() == 0


def test_interpolation(spark):
    xs, ys = F.array(*map(F.lit, (0.0, 1.0, 3.0))), F.array(*map(F.lit, (0.0, 10.0, 20.0)))
    df = spark.createDataFrame([(-1.0,), (0.0,), (0.5,), (1.0,), (2.0,), (9.0,), (None,)], "x double")
    assert [r[0] for r in df.select(fn_interp("x", xs, ys)).collect()] == [0, 0, 5, 10, 15, 20, None]
    grid = F.array(*map(F.lit, (0.0, 1.0, 4.0)))
    assert [r[0] for r in df.select(grid_lookup("x", grid, 0.0, 0.5)).collect()][:5] == [0, 0, 1, 4, 4]
    assert [r[0] for r in df.select(clip("x", 0, 1)).collect()] == [0, 0, 0.5, 1, 1, 1, None]


def test_uri_rewrite_and_strata(spark):
    df = spark.createDataFrame([("file:///a/mlruns/b/mlruns/1/x",), ("/q/mlruns",), ("s3://b/c",), (None,)], "u string")
    assert [r[0] for r in df.select(fn_uri_rewrite("u", "mlruns", "/n/")).collect()] == ["file:///n/mlruns/1/x", "/n/mlruns", "s3://b/c", None]
    df = spark.createDataFrame([(0.0, 0), (0.399, 1), (0.4, 0), (1.0, 1)], "label double, grp int")
    assert [r[0] for r in df.select(strata()).collect()] == [0, 40, 20, 41]


def test_leakage_looks_at_every_source(spark):
    aug = spark.createDataFrame([(1, 10, 20, 99), (2, 11, 99, 0), (3, 99, 12, 0), (4, None, 13, 0)], "aug_id long, source_a long, source_b long, source_blend long")
    val = spark.createDataFrame([(99,)], "sample_id long")
    assert {r.aug_id for r in joins.join_leakage_anti(aug, val).collect()} == {1, 4}


def test_clusters_of_chains_and_stars(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)], "a long, b long")
    got = {r.node: r.cluster_id for r in vectors.dup_clusters(edges).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in range(100, 140))


def test_stars_give_the_components_of_any_graph(spark):
    rng = random.Random(12)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 620)] + [(900 + i % 7, 900) for i in range(9)] + [(700, 700)]
    edges = spark.createDataFrame(pairs + pairs[:30], "a long, b long")
    root = {n: n for p in pairs for n in p}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {n: find(n) for n in root}
    got = {r.node: r for r in vectors.dup_clusters(edges).collect()}
    assert {n: r.cluster_id for n, r in got.items()} == want
    assert all(r.cluster_size == sum(c == r.cluster_id for c in want.values()) for r in got.values())
    assert vectors.dup_clusters(edges.limit(0)).count() == 0


def test_the_edges_of_a_hub_are_dealt_to_many_tasks(spark):
    hub = spark.range(1, 20_001).select(F.lit(0).cast("long").alias("v"), F.col("id").alias("u"))
    both = hub.unionByName(hub.select(F.col("u").alias("v"), F.col("v").alias("u")))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        met = vectors._with_least(both).filter("u = 0").groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["count"] for r in met) == 20_000 and max(r["count"] for r in met) < 5_000


def test_lowest_similarity_looks_at_few_pairs_of_a_hot_cluster(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.ones((1, 6)) + rng.normal(size=(1200, 6)) * 0.01, np.ones((1, 6)) + rng.normal(size=(40, 6)), rng.normal(size=(25, 6)), rng.normal(size=(1, 6))])
    group = [7] * 1240 + [8] * 25 + [9]
    df = spark.createDataFrame([(i, g, [float(v) for v in r]) for i, (g, r) in enumerate(zip(group, x, strict=True))], "vec_id long, cluster_id long, embedding array<double>")
    looked = []
    real = vectors.materialise
    monkeypatch.setattr(vectors, "materialise", lambda d, name, *a: looked.append((name, d)) or real(d, name, *a))
    got = {r.cluster_id: r.low for r in vectors.lowest_similarity(df, "vec_id", "embedding", 40).collect()}
    for g in (7, 8):
        s = x[np.array(group) == g] @ x[np.array(group) == g].T
        assert abs(got[g] - s[np.triu_indices(len(s), 1)].min()) < 1e-9
    assert 9 not in got
    blocks = -(-1240 // 40)
    assert blocks * (blocks + 1) / 2 == 496
    heads = [d for name, d in looked if name == "blocks"][0].count()
    assert heads == blocks + 2
    met = [d for name, d in looked if name == "lowest"][0]
    assert met.count() < 100  # rows are pairs of blocks


def test_cross_pairs_treat_unknown_entities_as_different(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0]), (3, None, [1.0, 0.0]), (4, None, [1.0, 0.01]), (5, "b", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, entity_id string, embedding array<double>")
    for block in (2, 100):
        assert {(r.a, r.b) for r in vectors.join_pairs_cross(df, 0.9, block=block).collect()} == {(1, 3), (1, 4), (2, 3), (2, 4), (3, 4)}
    assert {(r.a, r.b) for r in vectors.join_pairs_within(df, 0.9).collect()} == {(1, 2)}
    near = vectors.join_pairs_cross(df.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double"))), 0.9, approx=True)
    assert {(r.a, r.b) for r in near.collect()} == {(1, 3), (1, 4), (2, 3), (2, 4), (3, 4)}


def test_recall_of_approximate_cross_pairs(spark):
    """Of the exact pairs at a similarity of 0.9 or more, projections find at least nine in ten, and none that isn't one."""
    rng = np.random.default_rng(21)
    x = np.concatenate([c + rng.normal(size=(6, 16)) * 0.05 for c in rng.normal(size=(80, 16))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, i % 7, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, entity_id long, embedding array<double>")
    exact, near = ({(r.a, r.b) for r in vectors.join_pairs_cross(df, 0.9, approx=a).collect()} for a in (False, True))
    assert len(exact) > 300 and near <= exact and len(near) >= 0.9 * len(exact)


def test_nearest_neighbours_equal_brute_force_over_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 6))
    df = spark.createDataFrame([(i, [float(v) for v in r], int(i % 3)) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {}
    for r in neighbours.join_knn_topk(df.filter("vec_id < 15"), df.filter("vec_id >= 15"), 4, block=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.train_id)
    s = x[:15] @ x[15:].T
    assert got == {i: [int(j) + 15 for j in np.argsort(-s[i], kind="stable")[:4]] for i in range(15)}


@pytest.mark.parametrize("cells", [1, 9, 60])
def test_index_is_exact_with_ties_hot_cells_and_few_rows(spark, cells, monkeypatch):
    """Small integers give many ties; a third of the rows are one vector; two queries ask for more than there is in their cells."""
    monkeypatch.setattr(neighbours, "TILE", 16)
    rng = np.random.default_rng(cells)
    x = np.concatenate([rng.integers(-3, 4, (160, 3)), np.full((80, 3), 2)]).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(i % 5)) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(5)
    asked = df.filter("vec_id % 20 = 0")
    s = x @ x.T
    for k in (1, 7, 300):
        got = {}
        found = neighbours.join_knn_topk(asked, df, k, label="label", block=20, cells=cells, probes=2)
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.train_id, r.similarity, r.label))
        assert got == {i: [(int(j), s[i, j], int(j % 5)) for j in np.argsort(-s[i], kind="stable")[:k]] for i in range(0, 240, 20)}
    nothing = neighbours.join_knn_topk(asked, df.limit(0), 3)
    assert nothing.count() == 0 and neighbours.join_knn_topk(asked.limit(0), df, 3).count() == 0


def test_search_hands_on_a_bounded_number_of_rows_for_each_query(spark, monkeypatch):
    """Queries that meet 40 blocks get k rows from each of four spans at most, and from all of them the k best; some labels are unknown."""
    written, plain = [], neighbours.materialise

    def counted(df, name, *rest):
        out = plain(df, name, *rest)
        if name == "nearest":
            written.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "materialise", counted)
    x = np.random.default_rng(13).normal(size=(2000, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r], i % 7 or None) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int")
    asked = df.filter("vec_id % 20 = 0")
    found = neighbours.join_knn_topk(asked, df, 5, label="label", block=50, cells=40, probes=2)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.train_id, r.label))
    s = np.round(x[::20].astype(float) @ x.T.astype(float), 12)
    assert got == {20 * i: [(int(j), int(j % 7) or None) for j in np.argsort(-s[i], kind="stable")[:5]] for i in range(100)}
    assert len(written) == 2 and max(written) <= 4 * 5 * 100


def test_probes_reach_the_recall_they_were_chosen_for_and_bounds_spare_cells(spark):
    rng = np.random.default_rng(11)
    middle = rng.normal(size=(40, 8)) * 4
    x = np.concatenate([c + rng.normal(size=(50, 8)) * 0.3 for c in middle])
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 20 = 0")
    index = neighbours.index_vectors(df, cells=40)
    curve = {r.probes: r.recall for r in neighbours.recall_of_probes(asked, df, index, 10).collect()}
    assert max(curve.values()) == 1.0 and sorted(curve.values()) == [curve[p] for p in sorted(curve)]
    enough = min(p for p, r in curve.items() if r >= 0.9)
    assert enough < 10
    s = x[::20] @ x.T
    want = {(20 * i, int(j)) for i in range(len(s)) for j in np.argsort(-np.round(s[i], 12), kind="stable")[:10]}
    near = {(r.query_id, r.train_id) for r in neighbours.join_knn_topk(asked, df, 10, cells=40, recall=0.9).collect()}
    assert len(near & want) >= 0.9 * len(want)
    assert {(r.query_id, r.train_id) for r in neighbours.search_index(asked, index, 10, probes=2).collect()} == want
    floor = np.sort(s, 1)[:, -10]
    about = index.centres, index.radii, index.groups
    more = neighbours._wanted(x[::20], floor, 2, about).sum(1)
    assert more.mean() < 10  # of 38 other cells
    plan = neighbours.search_index(asked, index, 10)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_blocks_of_several_tiles_give_the_same(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(vectors, "TILE", 7)
    rng = np.random.default_rng(8)
    x, y = rng.integers(-3, 4, (30, 3)).astype(float), rng.integers(-3, 4, (40, 3)).astype(float)
    rows = [(0, i, j, [*range(100 * i, 100 * i + len(a))], a.ravel(), [*range(100 * j, 100 * j + len(b))], b.ravel(), ["e"] * len(a), ["f"] * len(b)) for i, j, a, b in ((0, 0, x, x), (0, 1, x, y))]
    frame = pd.DataFrame(rows, columns=["by", "i", "j", "ids", "flat", "ids2", "flat2", "e", "e2"])
    every = np.concatenate([x, y])
    names = [*range(30), *range(100, 140)]
    got = pd.concat(vectors._pairs_from(9.0, None)(iter([frame])))
    s = every @ every.T
    assert {(r.a, r.b) for r in got.itertuples()} == {(names[p], names[q]) for p in range(30) for q in range(p + 1, 70) if s[p, q] >= 9} and len(got) == len(got.drop_duplicates())
    low = pd.concat(vectors._lowest(iter([frame])))
    assert low.low.min() == s[:30][np.triu(np.ones((30, 70), bool), 1)].min()


def test_balanced_assignment_shares_prototypes_alike(spark):
    rng = np.random.default_rng(2)
    long = spark.createDataFrame([(i, j, float(rng.normal())) for i in range(40) for j in range(4)], "sample int, prototype int, logit double")
    q = vectors.agg_balanced_assign(long, 0.5, 50)
    assert all(abs(r.s - 1) < 1e-6 for r in q.groupBy("sample").agg(F.sum("q").alias("s")).collect())
    assert all(abs(r.s - 10) < 1e-3 for r in q.groupBy("prototype").agg(F.sum("q").alias("s")).collect())


def newton(x, hot, c, several=False):
    """Logistic regression by full Newton steps with the whole Hessian, halved until they descend: weights with intercept, per class."""
    n, k = hot.shape
    x = np.concatenate([x, np.ones((n, 1))], 1)
    p = x.shape[1]
    w, ridge = np.zeros((k, p)), np.append(np.ones(p - 1), 0) / (c * n)

    def loss(w):
        z = x @ w.T
        free = np.logaddexp(0, z).sum() if several else np.logaddexp.reduce(z, 1).sum()
        return (free - (z * hot).sum()) / n + (ridge * w * w).sum() / 2

    for _ in range(200):
        z = x @ w.T
        q = 1 / (1 + np.exp(-z)) if several else np.exp(z - np.logaddexp.reduce(z, 1)[:, None])
        g = (q - hot).T @ x / n + ridge * w
        if np.abs(g).max() < 1e-13:
            break
        h = np.zeros((k, p, k, p))
        for a in range(k):
            for b in range(k):
                share = q[:, a] * ((a == b) - (0 if several and a == b else q[:, b])) if not several else (q[:, a] * (1 - q[:, a]) if a == b else np.zeros(n))
                h[a, :, b] = (x * share[:, None]).T @ x / n + (np.diag(ridge) if a == b else 0)
        way = np.linalg.lstsq(h.reshape(k * p, k * p), g.ravel(), rcond=1e-13)[0].reshape(k, p)
        step = 1.0
        while loss(w - step * way) > loss(w) and step > 1e-9:
            step /= 2
        w = w - step * way
    assert np.isfinite(w).all()
    return w


def test_probe_equals_plain_newton_at_every_strength_and_reports_on_unseen_rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 3))
    y = np.argmax(x @ np.array([[1.5, -1, 0], [0, 1, -1], [0.3, 0, 1]]) + rng.normal(size=(150, 3)) * 0.7, 1)
    labels = [[int(c), (int(c) + 1) % 3] if i % 2 else [int(c)] for i, c in enumerate(y)]
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c), m) for i, (r, c, m) in enumerate(zip(x, y, labels, strict=True))], "vec_id long, embedding array<double>, label int, labels array<int>")
    parts = [df.filter("vec_id < 80"), df.filter("vec_id BETWEEN 80 AND 114"), df.filter("vec_id > 114")]
    hot = np.eye(3)[y]
    several = np.array([[c in m for c in range(3)] for m in labels], float)
    plain = [newton(x[:80], hot[:80], c) for c in probes.STRENGTHS]
    for target, column, is_several, want in ((hot, "label", False, plain), (several, "labels", True, None)):
        rows = parts[0].select("embedding", column).repartition(3).mapInPandas(lambda b, s=is_several: probes._pack(3, s, b), "flat binary, hot binary")
        got = probes.fit_logistic(materialise(rows, "probe"), 80, 3, probes.STRENGTHS, is_several)
        assert np.isfinite(got).all()
        for c, w, v in zip(probes.STRENGTHS, got, want or [newton(x[:80], target[:80], c, True) for c in probes.STRENGTHS], strict=True):
            z = x[80:] @ w[:, :-1].T + w[:, -1], x[80:] @ v[:, :-1].T + v[:, -1]
            chance = [1 / (1 + np.exp(-u)) if is_several else np.exp(u - np.logaddexp.reduce(u, 1)[:, None]) for u in z]
            assert np.abs(chance[0] - chance[1]).max() < 2e-3, c
            assert (z[0].argmax(1) == z[1].argmax(1)).all() or is_several
    scores = [((x[80:115] @ w[:, :-1].T + w[:, -1]).argmax(1) == y[80:115]).mean() for w in plain]
    best = int(np.argmax(scores))
    found = probes.probe_logreg(*parts).collect()
    assert {r.c for r in found} == {probes.STRENGTHS[best]} and abs(found[0].val_score - max(scores)) < 1e-9
    w = newton(x[:115], hot[:115], probes.STRENGTHS[best])
    assert {r.vec_id: r.prediction for r in found} == {i: int((x[i] @ w[:, :-1].T + w[:, -1]).argmax()) for i in range(115, 150)}
    many = probes.probe_logreg(*parts, (0.3, 10.0), n_classes=3, label="labels").collect()
    assert len(many) == 35 and all(len(r.prediction) == 3 and all(0 < p < 1 for p in r.prediction) for r in many)
    assert np.mean([int(np.argmax(r.prediction)) in r.labels for r in many]) > 0.8


def test_group_quantiles_and_running_minima_of_hot_groups(spark):
    rng = random.Random(3)
    rows = [(k % 3 if k % 5 else 0, float(rng.randrange(50)) if rng.random() > 0.05 else None, k) for k in range(700)]
    df = spark.createDataFrame(rows, "g int, v double, k int")
    for r in group_quantiles(df, ["g"], "v", {"lo": 0.0, "q": 0.25, "m": 0.5, "hi": 1.0}).collect():
        have = [v for g, v, _ in rows if g == r.g and v is not None]
        assert np.allclose([r.lo, r.q, r.m, r.hi], np.quantile(have, [0, 0.25, 0.5, 1]))
    got = {r.k: r.low for r in running_minima(df, ["g"], [F.col("k")], F.col("v"), "low").collect()}
    for g in range(3):
        low = None
        for _, v, k in sorted((r for r in rows if r[0] == g), key=lambda r: r[2]):
            low = v if low is None else low if v is None else min(low, v)
            assert got[k] == low


@pytest.mark.parametrize("few", [0, 100_000])
def test_isotonic_by_group_interpolates_and_takes_any_number_of_groups(spark, few):
    rng = random.Random(2)
    rows = [(i, rng.random(), rng.random(), i % 150) for i in range(3000)]
    fit = spark.createDataFrame(rows, "sample_id long, pred double, label double, grp int")
    asked = spark.createDataFrame([(i, p, y, g) for i, p, y, g in rows[:400]] + [(9000, -1.0, 0.0, 3), (9001, 2.0, 0.0, 3), (9002, 0.4, 0.0, 999), (9003, None, 0.0, 3), (9004, 0.7, 0.0, None)], "sample_id long, pred double, label double, grp int")
    got = {r.sample_id: r.calibrated for r in reweight.cal_isotonic(asked, fit, by="grp", few=few).collect()}
    assert len(got) == 405 and got[9002] == 0.4 and got[9004] == 0.7 and got[9003] is None
    for g in range(150):
        cells = sorted((p, y) for _, p, y, k in rows if k == g)
        blocks = []
        for p, y in cells:
            blocks.append([(1 / 30 + y) * y, 1 / 30 + y, [p]])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
                b, a = blocks.pop(), blocks.pop()
                blocks.append([a[0] + b[0], a[1] + b[1], a[2] + b[2]])
        xs, ys = [x for b in blocks for x in b[2]], [min(1, max(0, b[0] / b[1])) for b in blocks for _ in b[2]]
        for i, p, _, k in rows[:400]:
            if k == g:
                assert abs(got[i] - np.interp(p, xs, ys)) < 1e-9
        if g == 3:
            assert abs(got[9000] - ys[0]) < 1e-12 and abs(got[9001] - ys[-1]) < 1e-12


@pytest.mark.parametrize("kind", ["rising", "falling", "noise", "late drop", "ties"])
def test_isotonic_lists_merge_over_many_partitions(spark, kind):
    """Short lists and small runs, so that pooling crosses many of them; the same blocks as pooling row by row, to the last bit of order."""
    rng = random.Random(5)
    y = {"rising": lambda i: i / 600, "falling": lambda i: 1 - i / 600, "noise": lambda i: rng.random(), "late drop": lambda i: i / 600 if i < 590 else 0.0, "ties": lambda i: float(i // 50 % 2)}[kind]
    rows = [(i, (i // 3 if kind == "ties" else i) / 600, y(i), "x" if i % 4 else None) for i in range(600)]
    fit = spark.createDataFrame(rows, "sample_id long, pred double, label double, grp string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        lists = reweight.isotonic_lists(fit, False, chunk=9, fan=4)
        got = [(lo, hi, wy / w) for r in lists.orderBy("seq").collect() for lo, hi, w, wy in zip(r.lo, r.hi, r.w, r.wy, strict=True)]
        assert all(len(r.lo) <= 9 for r in lists.collect())
        near = {r.sample_id: r.calibrated for r in reweight.cal_isotonic(fit, fit, False, few=0).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    blocks = []
    for x, group in itertools.groupby(sorted((p, v) for _, p, v, _ in rows), key=lambda t: t[0]):
        values = [v for _, v in group]
        blocks.append([x, x, len(values), sum(values)])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] > blocks[-1][3] * blocks[-2][2]:
            _, hi, n, s = blocks.pop()
            blocks[-1] = [blocks[-1][0], hi, blocks[-1][2] + n, blocks[-1][3] + s]
    assert [(lo, hi) for lo, hi, _ in got] == [(lo, hi) for lo, hi, _, _ in blocks]
    assert np.allclose([v for _, _, v in got], [s / n for *_, n, s in blocks])
    assert all(abs(near[i] - next(s / n for lo, hi, n, s in blocks if lo <= p <= hi)) < 1e-12 for i, p, _, _ in rows)


def test_flags_never_take_all_but_one(spark):
    rows = [(i, 1, "intra", float(y), 0.95) for i, y in enumerate((0.1, 0.1, 0.5))] + [(10 + i, 2, "intra", y, 0.95) for i, y in enumerate((0.0, 0.4, 0.8))]
    df = spark.createDataFrame(rows, "vec_id long, cluster_id long, scope string, y double, cohesion double")
    assert {r.vec_id for r in vectors.dup_flag_cluster(df).filter("outlier").collect()} == {2}


def test_long_runs_are_split_and_give_what_one_range_gives(spark):
    """One run with nearly all rows over many ranges, some shorter than the window; missing values take their places."""
    rng = random.Random(9)
    rows = [("a", s, None if rng.random() < 0.05 else float(rng.randrange(-40, 40)) + s / 50) for s in range(300)] + [("b", s, float(-s)) for s in range(7)] + [("c", 1, None)]
    df = spark.createDataFrame(rows, "run_id string, step long, value double").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "37"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {(r.run_id, r.step): r for r in trials.win_smoothed(df, 20, ["run_id"]).collect()}
            epochs = {p: {r.run_id: r for r in trials.agg_best_epoch(df, p).collect()} for p in (1, 8, 60, 500)}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert len(got) == len(rows)
        for run in "abc":
            values = [v for r, _, v in sorted(rows, key=lambda r: r[:2]) if r == run]
            steps = sorted(s for r, s, _ in rows if r == run)
            for i, s in enumerate(steps):
                near, all_ = (sorted(v for v in part if v is not None) for part in (values[max(0, i - 19) : i + 1], values[: i + 1]))
                r = got[run, s]
                if near:
                    assert r.median == near[(len(near) - 1) // 2] and abs(r.avg - sum(near) / len(near)) < 1e-9 and r.max == near[-1]
                    assert abs(r.global_avg - sum(all_) / len(all_)) < 1e-9
                else:
                    assert r.median is r.avg is r.max is None
            for patience, found in epochs.items():
                low, at, idle, stopped = None, steps[0], 0, steps[-1]
                for i, (s, v) in enumerate(zip(steps, values, strict=True)):
                    if i == 0 or low is None or (v is not None and v < low):
                        low, at, idle = (v, s, 0) if v is not None or low is None else (low, at, idle)
                    else:
                        idle += 1
                        if idle >= patience:
                            stopped = s
                            break
                assert found[run].stopped_at == stopped
                if low is not None:
                    assert (found[run].best_epoch, found[run].best_value) == (at, low)


def test_best_epoch_and_patience(spark):
    values = [5.0, 4.0, 4.0, 6.0, 3.0, 1.0]
    df = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(values)], "run_id int, step int, value double")
    assert tuple(trials.agg_best_epoch(df, 2).first())[1:] == (2, 4.0, 4)
    assert tuple(trials.agg_best_epoch(df, 3).first())[1:] == (6, 1.0, 6)
    assert tuple(trials.agg_best_epoch(df, 3, full_data=True).first())[1:] == (6, 1.0, 6)


def test_ties_in_classification(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.1], 1, [1]), ([0.2, 0.2, 0.2], 0, []), ([0.9, 0.0, 0.0], 0, [0, 2])], "scores array<double>, target int, targets array<int>")
    assert classification.agg_topk_accuracy(df, ks=(1, 2)).first().asDict() == {"acc_1": 2 / 3, "acc_2": 1.0}
    assert abs(classification.agg_macro_mrr(df, 3).first()[0] - ((1 / 3 + 1) / (2 + 1e-6) + (1 / 2) / (1 + 1e-6)) / 3) < 1e-12
    assert classification.agg_any_match(df, k=1).first().asDict() == {"any_match": 0.5, "n": 2}


def test_samples_csv_and_multi(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sample_id,label,grp\nx,0.5,1\n,0.1,0\ny,nan,\n")
    rows = readers.src_samples_csv(spark, f"file://{tmp_path}/a.csv", "sample_id string, label double, grp int").collect()
    assert sorted((r.sample_id, r.label, r.grp) for r in rows) == [("x", 0.5, 1), ("y", None, None)]
    assert readers.src_multi_csv(spark, [f"file://{tmp_path}/a.csv", f"file://{tmp_path}/no.csv"], "sample_id string, label double, grp int").count() == 2
    assert readers.src_multi_csv(spark, [f"file://{tmp_path}/no.csv"], "sample_id string, label double, grp int").count() == 0


def test_captions_files_shards_and_readability(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"images": [{"id": 1, "file_name": "a.jpg"}, {"id": 2, "file_name": "b.jpg"}],\n "annotations": [{"id": 5, "image_id": 1, "caption": "z"}, {"id": 6, "image_id": 1, "caption": "y"}]}')
    got = {r.id: (r.image, r.captions) for r in readers.src_captions_json(spark, f"file://{tmp_path}/c.json", "d").collect()}
    assert got == {1: ("d/a.jpg", ["y", "z"]), 2: ("d/b.jpg", [])}
    (tmp_path / "img" / "s").mkdir(parents=True)
    for name, data in (("a.JPG", b"ok"), ("s/a.JPG", b"second"), ("b.png", b""), ("c.png", b"bad"), ("d.txt", b"x")):
        (tmp_path / "img" / name).write_bytes(data)
    root = f"file://{tmp_path}/img"
    inventory = readers.src_file_inventory(spark, root)
    assert sorted((r.basename, r.length) for r in inventory.collect()) == [("a.JPG", 2), ("b.png", 0), ("c.png", 3)]
    wanted = spark.createDataFrame([(n,) for n in ("a.JPG", "b.png", "c.png", "none.png")], "filename string")
    bad = readers.src_readability_check(wanted, inventory, probe=lambda b: b != b"bad")
    assert {(r.filename, r.problem) for r in bad.collect()} == {("b.png", "empty"), ("c.png", "unreadable"), ("none.png", "missing")}
    with tarfile.open(tmp_path / "t.tar", "w") as tar:
        info = tarfile.TarInfo("m.txt")
        info.size = 3
        tar.addfile(info, io.BytesIO(b"abc"))
    assert [(r.name, bytes(r.content)) for r in readers.src_tar_shards(spark, f"file://{tmp_path}/*.tar").collect()] == [("m.txt", b"abc")]


def test_listings_take_files_folders_and_wildcards(spark, tmp_path):
    for name in ("a/1.tar", "a/b/2.tar", "a/b/c.d/3.tar", "x[1]/4.tar", "5.tar", "a+b/6.tar"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * int(name[-5]))

    def names(roots):
        return sorted(r.length for r in files.list_files(spark, roots).collect())

    top = f"file://{tmp_path}"
    assert names(top) == names(str(tmp_path) + "/") == [1, 2, 3, 4, 5, 6]
    assert names(f"{top}/*.tar") == [5] and names(f"{top}/a/*") == [1, 2, 3] and names(f"{top}/a/?.tar") == [1]
    assert names([f"{top}/a+b", f"{top}/5.tar", f"{top}/5.tar"]) == [5, 6] and names([f"{top}/a/b", f"{top}/a"]) == [1, 2, 3]
    assert names(f"{top}/*/[!a]*/*.tar") == [2] and names(f"{top}/none") == names(f"{top}/none/*.tar") == []


def test_each_folder_is_made_by_one_task_and_one_root_is_not_shuffled(spark):
    from quern.plans.experiments import put_files

    rows = spark.range(300).selectExpr("concat('s', id % 3, '/d', id % 2, '/f', id, '.txt') AS name", "repeat('x', id % 4) AS content")
    name = f"dealt-{random.SystemRandom().getrandbits(64)}"
    root = put_files(spark, rows.repartition(5), name)
    made = spark.read.parquet(root.rsplit("/", 1)[0] + f"/{name}-written-*").agg(F.sum("n"), F.sum("folders")).first()
    assert tuple(made) == (300, 6)
    found = files.list_files(spark, root)
    assert sorted((r.path.removeprefix(root), r.length) for r in found.collect()) == sorted((f"/s{i % 3}/d{i % 2}/f{i}.txt", i % 4) for i in range(300))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "RLIKE" not in plan


def test_one_shard_of_many_members_is_read_by_several_tasks(spark, tmp_path):
    """Long names, folders, links, empty and large members; each member comes whole and once, in any cut."""
    rng = random.Random(6)
    want = {}
    with tarfile.open(tmp_path / "t.tar", "w", format=tarfile.PAX_FORMAT) as tar:
        for i in range(120):
            info = tarfile.TarInfo(f"d/{'long' * (i % 40)}-é{i}.bin")
            data = rng.randbytes(rng.choice([0, 1, 511, 512, 513, 9000]))
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
            want[info.name] = data
            if i % 10 == 0:
                link = tarfile.TarInfo(f"link{i}")
                link.type, link.linkname = tarfile.SYMTYPE, info.name
                tar.addfile(link)
    for cut in (700, 20_000, 1 << 30):
        rows = readers.src_tar_shards(spark, f"file://{tmp_path}/t.tar", cut).withColumn("task", F.spark_partition_id()).collect()
        assert {r.name: bytes(r.content) for r in rows} == want and len(rows) == len(want)
        assert (len({r.task for r in rows}) > 1) == (cut < 1 << 30)


def test_lists_and_archive_logs(spark):
    lines = spark.createDataFrame([("/b/2.jpg  d/2.png/ 9",), ("a/1.jpg d/1.png 9",), ("",)], "value string")
    assert [tuple(r) for r in readers.pair_list(lines).collect()] == [("a/1.jpg", "d/1.png"), ("b/2.jpg", "d/2.png")]
    assert [tuple(r) for r in readers.pair_list(spark.createDataFrame([("x.jpg",)], "value string"), "derive").collect()] == [("x.jpg", "x.png")]
    logs = spark.createDataFrame([("n2", "block 0: a.jpg"), ("n2", "block 3: b.jpg"), ("n2", "block 9: ** Block of NULs **"), ("n1", "block 0: c.jpg"), ("n1", "block 5: ** Block of NULs **"), ("n1", "noise")], "class_id string, value string")
    got = sorted(tuple(r) for r in readers.archive_index(logs, ["b.jpg"]).collect())
    assert got == [(0, "n1", 0, 2560, "c.jpg"), (1, "n2", 0, 1536, "a.jpg")]


def test_result_tables(spark):
    table = sinks.stack_results(sinks.result_rows(spark, {"a": 1, "b": True}), sinks.result_rows(spark, {"a": [2, 3], "c": [0.5, 1.5]}))
    assert dict(table.dtypes) == {"a": "bigint", "b": "string", "c": "double"} and table.count() == 3
    with pytest.raises(TypeError, match="other types"):
        sinks.result_types(spark.createDataFrame([([1],)], "x array<int>"))
    path = shared_path(spark, "log")
    for _ in range(2):
        sinks.snk_metric_log(spark.createDataFrame([("m", 1.0)], "metric string, value double"), path)
    assert [r.value for r in spark.read.text(path).collect()] == ['{"m":1.0}'] * 2


def test_early_stop_waits_for_steps_that_come_late(spark):
    path = shared_path(spark, "late")
    values = {1: 5.0, 2: 4.0, 3: 4.5, 4: 4.6, 5: 1.0}
    for steps in ((1, 4), (3, 5), (2,)):
        spark.createDataFrame([(7, s, values[s]) for s in steps], "run_id long, step long, value double").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("run_id long, step long, value double").option("maxFilesPerTrigger", 1).parquet(path)
    rows = live.run_available(live.str_early_stop(stream, 2), shared_path(spark, "late-view")).collect()
    last = max(rows, key=lambda r: r.batch)
    assert (last.best_step, last.best_value, last.stopped_at) == (2, 4.0, 4)


def test_a_gap_ends_by_timer_in_a_stream_that_goes_on(spark):
    import time

    path, view_path = shared_path(spark, "gap"), shared_path(spark, "gap-view")
    put = lambda rows: spark.createDataFrame(rows, "run_id long, step long, value double").coalesce(1).write.mode("append").parquet(path)
    put([(7, 1, 5.0), (7, 3, 6.0), (7, 4, 7.0), (7, 5, 1.0), (8, 1, 2.0), (8, 2, 1.0)])
    stream = spark.readStream.schema("run_id long, step long, value double").parquet(path)
    seen = {}

    def keep(rows, batch):
        seen.update({r.run_id: (r.best_step, r.best_value, r.stopped_at) for r in rows.collect()})

    query = live.str_early_stop(stream, 2, wait_ms=3000).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", view_path).trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 90
        first = None
        while time.time() < end and seen.get(7, (0, 0, None))[2] is None:
            first = first or seen.get(7)
            time.sleep(0.2)
        assert first == (1, 5.0, None) and seen[7] == (1, 5.0, 4) and seen[8] == (2, 1.0, None)
        put([(7, 2, 0.0), (8, 3, 0.5)])  # too late, and in time
        while time.time() < end and seen[8][0] < 3:
            time.sleep(0.2)
        assert seen[7] == (1, 5.0, 4) and seen[8] == (3, 0.5, None)
    finally:
        query.stop()


def test_early_stop_keeps_a_state_for_a_part_and_not_for_each_run(spark):
    path = shared_path(spark, "many-runs")
    spark.range(6000).selectExpr("id AS run_id", "1L AS step", "id + 0.5D AS value").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("run_id long, step long, value double").parquet(path)
    seen = []
    query = live.str_early_stop(stream, 2).writeStream.foreachBatch(lambda rows, _: seen.append(rows.filter("best_step = 1 AND best_value = run_id + 0.5D AND stopped_at IS NULL").count())).outputMode("update").option("checkpointLocation", shared_path(spark, "many-view")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(seen) == 6000 and 0 < query.lastProgress.stateOperators[0].numRowsTotal <= live.PARTS


def test_early_stop_with_steps_put_away_in_any_order(monkeypatch):
    """Runs of one part against a plain pass over their steps; more steps wait than stay beside the state, and gaps end by timer."""
    monkeypatch.setattr(live, "CHUNK", 4)

    class Handle(dict):
        timers: set = set()

        def getValueState(self, *_):
            return self

        getMapState = getValueState

        def get(self):
            return dict.get(self, None)

        def update(self, value):
            self[None] = value

        getValue, updateValue, removeKey = dict.__getitem__, dict.__setitem__, dict.__delitem__
        registerTimer = lambda self, t: Handle.timers.add(t)
        deleteTimer = lambda self, t: Handle.timers.remove(t)

    class Clock:
        now = 0

        def getCurrentProcessingTimeInMs(self):
            return self.now

        getExpiryTimeInMs = getCurrentProcessingTimeInMs

    rng = random.Random(4)
    for trial in range(60):
        patience, wait, clock, handle = rng.choice([2, 5, 99]), rng.choice([None, 10]), Clock(), Handle()
        stop = live.Stop(("run_id",), patience, wait)
        stop.init(handle)
        stop.part, stop.far, Handle.timers = Handle(), Handle(), set()
        values = {(run, step): rng.random() for run in range(3) for step in range(1, 40) if wait is None or rng.random() < 0.8}
        todo, last = rng.sample(sorted(values), len(values)), {}
        while todo:
            batch, todo = todo[:7], todo[7:]
            last |= {r.run_id: (r.best_step, r.best_value, r.stopped_at) for r in stop.handleInputRows((0,), iter([(0, *k, values[k]) for k in batch]), clock)}
        stuck = {run for (run,), r in stop._start()[1].items() if r[5] or r[6]}
        assert bool(Handle.timers) == bool(stuck and wait)
        if Handle.timers:
            clock.now = Handle.timers.pop()
            out = {r.run_id: (r.best_step, r.best_value, r.stopped_at) for r in stop.handleExpiredTimer((0,), clock, clock)}
            assert set(out) == stuck and not Handle.timers
            last |= out
        for run in range(3):
            best, idle, stopped = (-1, float("inf")), 0, None
            for step in sorted(s for r, s in values if r == run):
                best, idle = ((step, values[run, step]), 0) if values[run, step] < best[1] else (best, idle + 1)
                if idle >= patience:
                    stopped = step
                    break
            assert last[run] == (*best, stopped)
        assert not stop.far


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_package(tmp_path):
    """The driver deletes the corpus package and pipeline; everything else must still import."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "quern"), tmp_path / "quern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_range_labels_keep_the_sign_of_zero(spark, sf, tmp_path):
    import duckdb

    from quern.plans import catalog
    from tests.compare import compare

    spark.createDataFrame([(1, -0.0), (2, 0.0), (3, -0.01), (4, -1000.0), (5, 2999.99), (6, None), (7, 3e18)], "c_custkey long, c_acctbal double").selectExpr("c_custkey", "'c' AS c_name", "1 AS c_nationkey", "c_acctbal", "'m' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    compare(catalog.QUERIES["fn_range_label"](spark, str(tmp_path)), con, catalog.ORACLES["fn_range_label"])


@pytest.mark.parametrize("topk", [1, 3])
def test_spread_of_neighbours_over_blocks_equals_brute_force(spark, topk):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(70, 5)), np.ones((3, 5)), np.zeros((1, 5))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    u = x[:-1] / np.linalg.norm(x[:-1], axis=1)[:, None]
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -np.inf)
    want = -np.log(np.sqrt(np.maximum(2 - 2 * np.sort(s, 1)[:, -topk:], 0)) + 1e-8).mean()
    for block in (9, 1000):
        got = neighbours.agg_nn_spread(df, topk, block=block).first()
        assert abs(got.spread - want) < 1e-6 and got.n == 73


def test_links_have_the_components_of_all_pairs(spark, monkeypatch):
    """Two dense bundles, a chain between entities and single rows; tiles, blocks and held links are small."""
    monkeypatch.setattr(vectors, "TILE", 16)
    rng = np.random.default_rng(5)
    x = np.concatenate([np.eye(6)[[0] * 60] + rng.normal(size=(60, 6)) * 0.05, np.eye(6)[[1] * 40] + rng.normal(size=(40, 6)) * 0.05, rng.normal(size=(50, 6))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, None if i == 3 else i % 4, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, entity_id long, embedding array<float>")
    for pairs, links in ((vectors.join_pairs_within, vectors.join_links_within), (vectors.join_pairs_cross, vectors.join_links_cross)):
        want, few = pairs(df, 0.9, block=20), links(df, 0.9, block=20)
        of = lambda edges: {tuple(r) for r in vectors.dup_clusters(edges).collect()}
        assert of(few) == of(want) and few.count() < want.count() / 3
    u, v = vectors._stars(np.array([5, 7, 9, 2]), np.array([7, 9, 11, 3]))
    assert sorted(zip(u.tolist(), v.tolist(), strict=True)) == [(2, 3), (5, 7), (5, 9), (5, 11)]


def test_a_large_cluster_or_group_has_sixteen_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 4)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(320, 4))
    df = spark.createDataFrame([(i, 1, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, cluster_id long, embedding array<double>")
    assert vectors.outward_blocks(df, "vec_id", "embedding", None).count() == 16
    assert vectors._blocks(df, "vec_id", "embedding", 4, "cluster_id").count() == 16
    s = x @ x.T
    assert abs(vectors.lowest_similarity(df, "vec_id", "embedding").first().low - s[np.triu_indices(320, 1)].min()) < 1e-9


def test_groups_below_a_share_of_all_rows_are_shuffled_once_for_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 4)
    rng = np.random.default_rng(10)
    x, group = rng.normal(size=(400, 4)), np.array([*range(20)] * 8 + [20] * 240)
    df = spark.createDataFrame([(i, int(g), [float(v) for v in r]) for i, (g, r) in enumerate(zip(group, x, strict=True))], "vec_id long, cluster_id long, embedding array<double>")
    packed = vectors._blocks(df, "vec_id", "embedding", 4, "cluster_id", of_all=True)
    assert {r.by: r.parts for r in packed.collect()} == {g: 1 if g < 20 else 10 for g in range(21)}
    pairs = vectors._block_pairs(packed).selectExpr("by", "i", "j", "ids2 IS NULL AS alone").collect()
    n = {r.by: 0 for r in pairs}
    for r in pairs:
        n[r.by] += 1
        assert r.alone == (r.i == r.j)
    k = packed.filter("by = 20").count()
    assert n == {g: 1 if g < 20 else k * (k + 1) // 2 for g in range(21)}
    got = {r.cluster_id: r.low for r in vectors.lowest_similarity(df, "vec_id", "embedding").collect()}
    assert len(got) == 21
    for g in range(21):
        s = x[group == g] @ x[group == g].T
        assert abs(got[g] - s[np.triu_indices(len(s), 1)].min()) < 1e-9
    monkeypatch.setattr(vectors, "TILE", 7)
    own = packed.filter("by = 0").selectExpr("by", "0 AS i", "0 AS j", "ids", "flat").toPandas()
    assert [tuple(r) for r in next(vectors._lowest(iter([own]))).round(9).itertuples(index=False)] == [(0, round(got[0], 9))]  # of several tiles too
    found = vectors.join_pairs_within(df, 0.5, entity="cluster_id", block=4).collect()
    s = x @ x.T
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if group[i] == group[j] and s[i, j] >= 0.5}
    assert len(found) == len(want) and {(r.a, r.b) for r in found} == want


def test_templates_take_time_in_proportion_to_the_vector(spark):
    import time

    from quern.functions.expr import vec_template

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 300))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(300, None), (301, []), (302, [2.0, 2.0])]
    df = materialise(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "long-vectors")
    start = time.time()
    got = {r.vec_id: r.t for r in df.select("vec_id", vec_template("embedding").alias("t")).collect()}
    assert time.time() - start < 20  # it was cubic: 8 billion steps
    c = x - x.mean(1)[:, None]
    assert np.allclose([got[i] for i in range(300)], c / np.linalg.norm(c, axis=1)[:, None]) and [got[i] for i in (300, 301, 302)] == [None] * 3


def test_folders_and_archives_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    """Names are few bytes, which Spark would put together in one task."""
    for i in range(40):
        (tmp_path / f"s{i}" / "d").mkdir(parents=True)
        (tmp_path / f"s{i}" / "d" / f"{i}.png").write_bytes(b"x" * i)
        with tarfile.open(tmp_path / f"s{i}" / f"{i}.tar", "w") as tar:
            tar.addfile(tarfile.TarInfo(f"m{i}"))
    seen = []
    real = files.materialise
    monkeypatch.setattr(files, "materialise", lambda d, name, *a: seen.append((name, real(d, name, *a))) or seen[-1][1])
    got = {r.path.rsplit("/", 1)[1]: r.length for r in files.list_files(spark, f"file://{tmp_path}/*/d").collect()}
    assert got == {f"{i}.png": i for i in range(40)}
    assert len(seen[1][1].inputFiles()) > 1 and len(files.tar_members(spark, f"file://{tmp_path}/*/*.tar").inputFiles()) > 1


def test_archive_logs_of_many_names(spark):
    from quern.plans.experiments import put_files

    names = ["n1.log", "a.b.log", "x"]
    rows = spark.createDataFrame([(n, f"block {i}: {n}{i}\n") for n in names for i in range(9)], "name string, content string")
    got = {(r.class_id, r.filename) for r in readers.src_archive_index(spark, put_files(spark, rows, "logs")).collect()}
    assert got == {(c, f"{n}{i}") for c, n in (("n1", "n1.log"), ("a.b", "a.b.log"), ("x", "x")) for i in range(8)}


def test_runs_of_a_part_share_a_state(spark, monkeypatch):
    """Three batches, points out of order, two parts for 30 runs; each batch gives the runs that it touched."""
    monkeypatch.setattr(live, "PARTS", 2)
    rng = random.Random(4)
    points = [(r, "m", s, float(rng.randrange(9))) for r in range(30) for s in range(1, 8)]
    rng.shuffle(points)
    path, schema = shared_path(spark, "points"), "run_id long, metric string, step long, value double"
    for i in range(3):
        spark.createDataFrame(points[70 * i : 70 * i + 70], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    rows = live.run_available(live.str_smoothed(stream, 4), shared_path(spark, "points-view")).collect()
    assert len(rows) == sum(len({p[0] for p in points[70 * i : 70 * i + 70]}) for i in range(3))
    for r in {r.run_id: r for r in sorted(rows, key=lambda r: r.batch)}.values():
        every = [p[3] for p in sorted(p for p in points if p[0] == r.run_id)]
        last = every[-4:]
        assert (r.n, r.median, r.last) == (7, sorted(last)[1], last[-1]) and abs(r.avg - sum(last) / 4) + abs(r.global_avg - sum(every) / 7) < 1e-12
