"""Similarity joins, clusters of near-duplicates, outlier flags and learned probes on vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.expr import dot
from quern.functions.rank import group_quantiles, group_rank, materialise

#: Rows of a block that is compared with others: BLOCK at least, and where a group has many rows a 16th of them (PARTS), up to
#: MOST bytes. What is shuffled is the table times the blocks of a group, so it grows as the table does until blocks have MOST
#: bytes. What is made of many groups alike (entities, clusters) takes a 16th of all rows for that, so that a group with less is one
#: block, which is not shuffled again for pairs, at any size. TILE rows of a block are multiplied with TILE others at once; AT_ONCE block pairs reach a task together, and a task
#: holds LINKS links or pairs before it hands them on.
BLOCK, PARTS, MOST, TILE, AT_ONCE, LINKS = 1024, 16, 32 << 20, 2048, 2, 1 << 20
#: Parts into which the edges or members of one node are dealt.
SALTS = 32


def _blocks(vecs: DataFrame, key: str, vector: str, block: int, by: str | None = None, extra: Sequence[str] = (), of_all: bool = False, more: int = 0) -> DataFrame:
    """Vectors packed into rows of about ``block`` or more: by, block, ids, flat (their vectors one after another), the number of
    parts of the group and extra columns as arrays. Large blocks are a 16th of a group or (``of_all``) of all rows. A task holds
    ``more`` values for a row beside its vector."""
    group = F.col(by) if by else F.lit(0)
    rows = vecs.filter(F.col(vector).isNotNull()).withColumn("__by", group)
    kind = _kind(vecs, vector)
    sizes = materialise(rows.groupBy("__by").agg(F.count(F.lit(1)).alias("__n"), _most(kind, F.max(F.size(vector)) + more).alias("__most")), "parts")
    share = F.lit(_total(sizes)) if of_all else F.col("__n")
    parts = sizes.select("__by", F.ceil(F.col("__n") / F.greatest(F.lit(block), F.least(share / PARTS, "__most"))).cast("int").alias("__parts"))
    dealt = rows.join(parts, "__by").withColumn("block", F.pmod(F.xxhash64(key), F.col("__parts")).cast("int"))
    packed = dealt.groupBy("__by", "block").agg(F.max("__parts").alias("parts"), F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), *extra, F.col(vector).cast(kind).alias("v")))).alias("l"))
    return materialise(packed.select(F.col("__by").alias("by"), "block", "parts", F.transform("l", lambda x: x["k"]).alias("ids"), F.flatten(F.transform("l", lambda x: x["v"])).alias("flat"), *(_each("l", c) for c in extra)), "blocks")


def _total(sizes: DataFrame) -> int:
    """All rows of groups with ``__n`` each."""
    return sizes.agg(F.sum("__n")).first()[0] or 0


def _kind(vecs: DataFrame, vector: str) -> str:
    """Floats stay floats on their way to the tasks, which multiply them as doubles."""
    return "array<float>" if dict(vecs.dtypes)[vector] == "array<float>" else "array<double>"


def _most(kind: str, size: Column) -> Column:
    """Rows of MOST bytes."""
    return MOST / (4 if kind == "array<float>" else 8) / F.greatest(size, F.lit(1))


def _each(structs: str, field: str) -> Column:
    return F.transform(structs, lambda x: x[field]).alias(field)


def _matrix(ids, flat) -> np.ndarray:
    flat = np.asarray(flat)
    return (flat if flat.dtype == np.float32 else flat.astype(np.float64, copy=False)).reshape(len(ids), -1)


def _tiles(a: np.ndarray, b: np.ndarray, once: bool = False) -> Iterator[tuple[int, int, np.ndarray]]:
    """Products of all rows of two blocks, tile by tile: first row, first column, products. Of a block with itself ``once`` leaves out the tiles below the diagonal."""
    for i in range(0, len(a), TILE):
        for j in range(i if once else 0, len(b), TILE):
            yield i, j, a[i : i + TILE].astype(np.float64, copy=False) @ b[j : j + TILE].astype(np.float64, copy=False).T


def _block_pairs(packed: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Each block of a group with itself (which comes without ids2 and flat2) and with every later one of the group."""
    right = packed.filter("block > 0").select("by", F.col("block").alias("j"), F.col("ids").alias("ids2"), F.col("flat").alias("flat2"), *(F.col(c).alias(f"{c}2") for c in extra))
    left = packed.withColumnRenamed("block", "i").withColumn("j", F.explode(F.sequence(F.col("i"), F.col("parts") - 1))).drop("parts")
    return _dealt(left, right.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j") - 1))))


def _dealt(left: DataFrame, right: DataFrame) -> DataFrame:
    """Blocks that meet, dealt by the pair (by, i, j): a group of any size meets many tasks, and all of them get about as much. A block that meets itself comes alone."""
    parts, pair = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["by", "i", "j"]
    return left.repartition(parts, *pair).join(right.repartition(parts, *pair), pair, "left").filter("i = j OR ids2 IS NOT NULL")


def _other(r) -> np.ndarray:
    """Vectors of the second block of a pair."""
    return _matrix(r.ids, r.flat) if r.i == r.j else _matrix(r.ids2, r.flat2)


def _near(r, thr: float, extra: str | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the first and of the second block whose similarity is ``thr`` or more, and the similarity, tile by tile; a block's pairs with itself come once."""
    if extra:
        codes = pd.factorize(np.concatenate([np.asarray(getattr(r, c), object) for c in (extra, extra if r.i == r.j else extra + "2")]))[0]
        left, right = codes[: len(r.ids)], codes[len(r.ids) :]  # unknown ones are -1
    for i, j, s in _tiles(_matrix(r.ids, r.flat), _other(r), r.i == r.j):
        p, q = np.nonzero(s >= thr)
        near = s[p, q]
        p, q = p + i, q + j
        keep = p < q if r.i == r.j else np.ones(len(p), bool)
        if extra:
            keep &= (left[p] < 0) | (left[p] != right[q])
        yield p[keep], q[keep], near[keep]


def _pairs_from(thr: float, extra: str | None):
    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = pd.DataFrame({"a": [], "b": [], "by": [], "similarity": []})
        for batch in batches:
            found, n = [], 0
            for r in batch.itertuples(index=False):
                ids, ids2 = np.asarray(r.ids), np.asarray(r.ids if r.i == r.j else r.ids2)
                for p, q, near in _near(r, thr, extra):
                    a, b = ids[p], ids2[q]
                    found.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "by": r.by, "similarity": near}))
                    n += len(near)
                    if n >= LINKS:
                        yield pd.concat(found)
                        found, n = [], 0
            yield pd.concat(found) if found else none

    return meet


def _tied(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component after the edges (u, v) were added to components given alike."""
    while True:
        a, b = root[u], root[v]
        open_ = a != b
        if not open_.any():
            return root
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the same components, one less than each has nodes: every node with the smallest of its component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = _tied(np.arange(len(ids)), at[: len(a)], at[len(a) :])
    more = np.flatnonzero(root != np.arange(len(ids)))
    return ids[root[more]], ids[more]


def _links_from(thr: float, extra: str | None):
    """Of the pairs that a task finds, links that leave the same components."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [np.zeros((2, 0), np.int64)], 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids, shift = np.asarray(r.ids), 0 if r.i == r.j else len(r.ids)
                ids = ids if r.i == r.j else np.concatenate([ids, np.asarray(r.ids2)])
                root = np.arange(len(ids))
                for p, q, _ in _near(r, thr, extra):
                    root = _tied(root, p, q + shift)
                tied = np.flatnonzero(root != np.arange(len(ids)))
                held.append(np.stack([ids[root[tied]], ids[tied]]))
                n += len(tied)
                if n >= LINKS:
                    held = [np.stack(_stars(*np.concatenate(held, 1)))]
                    n = held[0].shape[1]
                    if n >= LINKS // 2:
                        yield pd.DataFrame({"a": held[0][0], "b": held[0][1]})
                        held, n = [np.zeros((2, 0), np.int64)], 0
        a, b = _stars(*np.concatenate(held, 1))
        yield pd.DataFrame({"a": a, "b": b})

    return meet


def join_links_within(vecs: DataFrame, thr: float = 0.93, key: str = "vec_id", vector: str = "embedding", entity: str = "entity_id", block: int = BLOCK) -> DataFrame:
    """Links (a, b) with the same nodes and components as ``join_pairs_within``: of each task's pairs at most one less than it has rows, so dense groups give no quadratic table."""
    packed = _blocks(vecs.filter(F.col(entity).isNotNull()), key, vector, block, entity, of_all=True)
    return materialise(_block_pairs(packed).mapInPandas(_links_from(thr, None), "a long, b long"), "links", AT_ONCE)


def join_links_cross(vecs: DataFrame, thr: float = 0.985, key: str = "vec_id", vector: str = "embedding", entity: str = "entity_id", block: int = BLOCK) -> DataFrame:
    """Links (a, b) with the same nodes and components as ``join_pairs_cross``."""
    packed = _blocks(vecs.withColumn("e", F.col(entity).cast("string")), key, vector, block, None, ["e"])
    return materialise(_block_pairs(packed, ["e"]).mapInPandas(_links_from(thr, "e"), "a long, b long"), "links", AT_ONCE)


def join_pairs_within(vecs: DataFrame, thr: float = 0.93, key: str = "vec_id", vector: str = "embedding", entity: str = "entity_id", block: int = BLOCK) -> DataFrame:
    """Pairs a < b of one entity with similarity from ``thr`` on; rows without an entity are left out. Only such pairs leave a task, however large an entity is."""
    packed = _blocks(vecs.filter(F.col(entity).isNotNull()), key, vector, block, entity, of_all=True)
    kind = dict(vecs.dtypes)[entity]
    found = _block_pairs(packed).mapInPandas(_pairs_from(thr, None), f"a long, b long, by {kind}, similarity double")
    return materialise(found, "pairs", AT_ONCE).withColumnRenamed("by", "entity")


def join_pairs_cross(vecs: DataFrame, thr: float = 0.985, approx: bool = False, key: str = "vec_id", vector: str = "embedding", entity: str = "entity_id", block: int = BLOCK) -> DataFrame:
    """Pairs a < b of different entities (or with one or both unknown) with similarity from ``thr`` on.

    Exact by default: blocks of vectors meet block by block and a matrix product finds the pairs, so only pairs that
    reach the threshold leave a task. ``approx`` takes candidates from random projections first (at 1,000 times the data).
    """
    if approx:
        from pyspark.ml.feature import BucketedRandomProjectionLSH
        from pyspark.ml.functions import array_to_vector

        rows = vecs.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(entity).alias("e"), F.col(vector).alias("v"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
        model = BucketedRandomProjectionLSH(inputCol="features", outputCol="h", bucketLength=0.5, numHashTables=8, seed=7).fit(rows)
        near = model.approxSimilarityJoin(rows, rows, float(np.sqrt(2 - 2 * thr)) + 1e-6).select(F.col("datasetA.id").alias("a"), F.col("datasetB.id").alias("b"), F.col("datasetA.e").alias("ea"), F.col("datasetB.e").alias("eb"), dot(F.col("datasetA.v"), F.col("datasetB.v")).alias("similarity"))
        return near.filter("a < b AND NOT (ea <=> eb AND ea IS NOT NULL)").filter(F.col("similarity") >= thr).select("a", "b", "similarity").distinct()
    packed = _blocks(vecs.withColumn("e", F.col(entity).cast("string")), key, vector, block, None, ["e"])
    found = _block_pairs(packed, ["e"]).mapInPandas(_pairs_from(thr, "e"), "a long, b long, by int, similarity double")
    return materialise(found, "pairs", AT_ONCE).drop("by")


def agg_balanced_assign(logits_long: DataFrame, temperature: float, iters: int = 3) -> DataFrame:
    """Balanced soft assignment of (sample, prototype, logit): columns and rows made to share alike in turn, ``iters`` times.

    Sums run by aggregation and join, so a prototype with many samples is no task's alone.
    """
    top = logits_long.groupBy().agg(F.max("logit").alias("__top"))
    q = logits_long.join(F.broadcast(top)).select("sample", "prototype", F.exp((F.col("logit") - F.col("__top")) / temperature).alias("q"))
    sizes = q.agg(F.countDistinct("sample").alias("__b"), F.countDistinct("prototype").alias("__k"))
    q = q.join(F.broadcast(sizes))
    for _ in range(iters):
        by_prototype = q.groupBy("prototype").agg(F.sum("q").alias("__s"))
        q = q.join(by_prototype, "prototype").withColumn("q", F.col("q") / F.col("__s") / F.col("__k")).drop("__s")
        by_sample = q.groupBy("sample").agg(F.sum("q").alias("__s"))
        q = materialise(q.join(by_sample, "sample").withColumn("q", F.col("q") / F.col("__s") / F.col("__b")).drop("__s"), "assign")
    return q.select("sample", "prototype", (F.col("q") * F.col("__b")).alias("q"))


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the smallest neighbour of u, itself included: column m.

    Minima are taken per (u, salt) and go back to edges by (u, salt), so a hub with any number of edges meets many tasks.
    """
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = materialise(dealt.groupBy("u", "salt").agg(F.min("v").alias("m")), "minima")
    least = parts.groupBy("u").agg(F.min("m").alias("m")).select("u", F.least("u", "m").alias("m"))
    return dealt.join(parts.select("u", "salt").join(least, "u"), ["u", "salt"]).drop("salt")


def dup_clusters(edges: DataFrame, scope: str = "intra") -> DataFrame:
    """Connected components of pairs (a, b): node, cluster_id (its smallest node), scope, cluster_size.

    Alternating stars: every node ties its larger neighbours to the smallest node that it knows (large star), then itself and its
    smaller neighbours (small star), until each component is one star around its smallest node. Each round is written; rounds
    grow with the logarithm of the number of nodes.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    pairs = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialise(_with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        near = _with_least(large)  # of each node to smaller ones only
        small = near.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v")
        pairs = materialise(small.distinct(), "small-star")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    labels = materialise(nodes.join(pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("label")), "labels")
    sizes = labels.groupBy("label", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.join(sizes.groupBy("label").agg(F.sum("n").alias("cluster_size")), "label").drop("n")
    sized = labels.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(sizes, ["label", "salt"])
    return sized.select("node", F.col("label").alias("cluster_id"), F.lit(scope).alias("scope"), "cluster_size")


def agg_cluster_stats(members: DataFrame, vecs: DataFrame, key: str = "vec_id", vector: str = "embedding", entity: str = "entity_id", label: str = "y", block: int | None = None) -> DataFrame:
    """Per cluster: size, distinct entities, label spread and median, cohesion (smallest similarity of its pairs), four places."""
    rows = members.select(F.col("node").alias(key), "cluster_id", "scope").join(vecs.select(key, vector, entity, label), key)
    stats = rows.groupBy("cluster_id", "scope").agg(F.count(F.lit(1)).alias("cluster_size"), F.countDistinct(entity).alias("n_entities"), F.round(F.max(label) - F.min(label), 4).alias("label_spread"))
    middle = group_quantiles(rows, ["cluster_id"], label, {"cluster_median": 0.5}).select("cluster_id", F.round("cluster_median", 4).alias("cluster_median"))
    stats = stats.join(middle, "cluster_id", "left")
    return stats.join(lowest_similarity(rows, key, vector, block).select("cluster_id", F.round("low", 4).alias("cohesion")), "cluster_id", "left")


def outward_blocks(rows: DataFrame, key: str, vector: str, block: int | None) -> DataFrame:
    """The rows of each cluster in blocks of ``block`` (BLOCK, or a 16th of all rows) by falling distance r from the cluster's mean
    c: by, block, ids, flat, and what bounds the similarities of its rows: low (smallest c.x - c.c / 2) and reach (largest r)."""
    kind = _kind(rows, vector)
    rows = rows.filter(F.col(vector).isNotNull()).select("cluster_id", F.col(key).alias("k"), F.col(vector).cast(kind).alias("v"))
    means = rows.select("cluster_id", F.posexplode("v").alias("i", "x")).groupBy("cluster_id", "i").agg(F.avg("x").alias("x"))
    means = means.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    near, total = rows.join(means, "cluster_id"), rows.count()
    gap = F.zip_with("v", "c", lambda x, y: x - y)
    placed = group_rank(materialise(near.select("cluster_id", "k", "v", (dot("c", "v") - dot("c", "c") / 2).alias("p"), F.sqrt(dot(gap, gap)).alias("r")), "radii"), ["cluster_id"], [F.desc("r"), F.col("k")], "place", "__n")
    size = F.lit(block) if block else F.ceil(F.greatest(F.lit(BLOCK), F.least(F.lit(total / PARTS), _most(kind, F.size("v")))))
    dealt = placed.withColumn("block", F.floor((F.col("place") - 1) / size).cast("int"))
    packed = dealt.groupBy(F.col("cluster_id").alias("by"), "block").agg(F.collect_list(F.struct("k", "v")).alias("l"), F.min("p").alias("low"), F.max("r").alias("reach"))
    return materialise(packed.select("by", "block", F.transform("l", lambda x: x["k"]).alias("ids"), F.flatten(F.transform("l", lambda x: x["v"])).alias("flat"), "low", "reach"), "blocks")


def lowest_similarity(rows: DataFrame, key: str, vector: str, block: int | None = None) -> DataFrame:
    """Per cluster_id the smallest similarity of two of its rows: low. Clusters of one row have none.

    A cluster that fits in one block (of BLOCK rows, or a 16th of all) is one task's; the others, and with ``block`` all, meet block by block.
    """
    rows = materialise(rows.filter(F.col(vector).isNotNull()).select("cluster_id", key, vector), "members")
    if block:
        return _lowest_of_blocks(rows, key, vector, block)
    kind, parts = _kind(rows, vector), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = materialise(rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("__n"), _most(kind, F.max(F.size(vector))).alias("__most")), "sizes")
    fits = F.col("__n") <= F.greatest(F.lit(BLOCK), F.least(F.lit(_total(sizes) / PARTS), "__most"))
    whole = rows.join(sizes.filter(fits).select("cluster_id"), "cluster_id", "left_semi").repartition(parts, "cluster_id")
    packed = whole.groupBy("cluster_id").agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(vector).cast(kind).alias("v"))).alias("l"))
    packed = packed.select(F.col("cluster_id").alias("by"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.transform("l", lambda x: x["k"]).alias("ids"), F.flatten(F.transform("l", lambda x: x["v"])).alias("flat"))
    low = materialise(packed.mapInPandas(_lowest, "by long, low double"), "whole", AT_ONCE).withColumnRenamed("by", "cluster_id")
    large = sizes.filter(~fits).select("cluster_id")
    return low if large.isEmpty() else low.unionByName(_lowest_of_blocks(rows.join(large, "cluster_id", "left_semi"), key, vector, block))


def _lowest_of_blocks(rows: DataFrame, key: str, vector: str, block: int | None) -> DataFrame:
    """The same for clusters of any size.

    For any x, y and the cluster's mean c: x.y >= (c.x - c.c / 2) + (c.y - c.c / 2) - |x - c| |y - c|. The rows that lie furthest out
    meet each other first; then only those blocks meet that can hold a lower pair than was found so.
    """
    blocks, parts = outward_blocks(rows, key, vector, block), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (blocks.select("by", F.col("block").alias(n), *(F.col(c).alias(c + e) for c in ("ids", "flat"))) for n, e in (("i", ""), ("j", "2")))
    first = left.filter("i = 0").withColumn("j", F.lit(0)).repartition(parts, "by")
    outer = materialise(first.mapInPandas(_lowest, "by long, low double"), "outermost", AT_ONCE)
    heads = blocks.select("by", "block", "low", "reach")
    pairs = heads.select("by", F.col("block").alias("i"), "low", "reach").join(heads.select("by", F.col("block").alias("j"), F.col("low").alias("low2"), F.col("reach").alias("reach2")), "by").filter("i <= j AND j > 0")
    open_ = pairs.join(outer.select("by", F.col("low").alias("found")), "by", "left").filter(F.col("found").isNull() | (F.col("low") + F.col("low2") - F.col("reach") * F.col("reach2") - 1e-9 < F.col("found")))
    open_ = materialise(open_.select("by", "i", "j"), "open")
    more = materialise(_dealt(open_.join(left, ["by", "i"]), open_.filter("i < j").join(right, ["by", "j"])).mapInPandas(_lowest, "by long, low double"), "lowest", AT_ONCE)
    return outer.unionByName(more).groupBy(F.col("by").alias("cluster_id")).agg(F.min("low").alias("low"))


def _lowest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Smallest similarity of different rows of each pair of blocks, a row a pair."""
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            low = []
            for i, j, s in _tiles(_matrix(r.ids, r.flat), _other(r), r.i == r.j):
                if r.i == r.j:
                    s = s[np.arange(len(s))[:, None] + i < np.arange(s.shape[1]) + j]
                if s.size:
                    low.append(float(s.min()))
            if low:
                out.append((r.by, min(low)))
        yield pd.DataFrame(out, columns=["by", "low"])


def dup_flag_cluster(members: DataFrame, dev: float = 0.10, min_cluster: int = 3, label: str = "y") -> DataFrame:
    """Members of clusters from ``min_cluster`` on that are further than ``dev`` from its median; nothing where all but one or more would be flagged."""
    stats = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size")).join(group_quantiles(members, ["cluster_id"], label, {"cluster_median": 0.5}), "cluster_id", "left")
    far = members.drop("cluster_size", "cluster_median").join(stats, "cluster_id").withColumn("far", F.round(F.abs(F.col(label) - F.col("cluster_median")), 9) > dev)
    n = far.groupBy("cluster_id").agg(F.count_if("far").alias("n_far"))
    return far.join(n, "cluster_id").withColumn("outlier", F.col("far") & (F.col("scope") == "intra") & (F.col("cluster_size") >= min_cluster) & (F.col("n_far") < F.col("cluster_size") - 1)).drop("far", "n_far")


def dup_flag_consensus(members: DataFrame, entity_stats: DataFrame, dev: float = 0.10, min_cluster: int = 3, min_entity: int = 4, min_cohesion: float = 0.90, label: str = "y", entity: str = "entity_id", key: str = "vec_id") -> DataFrame:
    """Proposed removals from coherent intra clusters: against the cluster's median from three members on, against the entity's median for pairs of which exactly one deviates."""
    good = members.filter((F.col("scope") == "intra") & (F.col("cohesion") >= min_cohesion))
    big = dup_flag_cluster(good.filter(F.col("cluster_size") >= min_cluster), dev, min_cluster, label).filter("outlier").select(key, entity, label, F.col("cluster_median").alias("consensus"), F.lit("cluster").alias("source"), "cohesion", "cluster_id")
    pairs = good.filter("cluster_size = 2").drop("entity_median", "entity_n").join(entity_stats.select(entity, "entity_median", F.col("n").alias("entity_n")), entity).filter(F.col("entity_n") >= min_entity)
    far = pairs.withColumn("far", F.round(F.abs(F.col(label) - F.col("entity_median")), 9) > dev)
    one = far.groupBy("cluster_id").agg(F.count_if("far").alias("n_far")).filter("n_far = 1").select("cluster_id")
    small = far.join(one, "cluster_id", "left_semi").filter("far").select(key, entity, label, F.col("entity_median").alias("consensus"), F.lit("entity").alias("source"), "cohesion", "cluster_id")
    return big.unionByName(small).withColumn("deviation", F.round(F.abs(F.col(label) - F.col("consensus")), 6)).orderBy(F.desc("deviation"), key)


def dup_conflict_report(clusters: DataFrame, flagged: DataFrame, conflict: float = 0.10) -> DataFrame:
    """Clusters by scope, those with conflicting labels, and flagged rows by source: item, n."""
    by_scope = clusters.groupBy(F.concat(F.lit("clusters_"), F.col("scope")).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    conflicts = clusters.filter(F.col("label_spread") >= conflict).groupBy(F.concat(F.lit("conflicts_"), F.col("scope")).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    rows = flagged.groupBy(F.concat(F.lit("flagged_"), F.col("source")).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return by_scope.unionByName(conflicts).unionByName(rows)


def top_spread_clusters(clusters: DataFrame, n: int = 300, conflict: float = 0.10) -> DataFrame:
    """The n clusters with the widest labels, conflicts first (a report)."""
    return clusters.orderBy(F.desc(F.col("label_spread") >= conflict), F.desc("label_spread"), "cluster_id").limit(n)


# ---- probes and scores


def probe_linear_select(val_scores: DataFrame, test_scores: DataFrame) -> DataFrame:
    """The probe with the best validation top-1 (the first of ties) and its results on each test set."""
    best = val_scores.agg(F.min_by("probe", F.struct((-F.col("top1")).alias("s"), "probe")).alias("probe"))
    return test_scores.join(F.broadcast(best), "probe")


def score_batch(df: DataFrame, predict_fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A caller's model over the table in Arrow batches: ``predict_fn`` gets and returns data frames of the same rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield predict_fn(batch)

    return df.mapInPandas(run, schema)


def score_dedupe_index(df: DataFrame, idx: str = "index") -> DataFrame:
    """Sharded results back together: padding (negative index) and repeats go."""
    return df.filter(F.col(idx) >= 0).dropDuplicates([idx])
