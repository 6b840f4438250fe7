"""Nearest neighbours through an inverted-file index, exact by bounds or with a measured recall, and what votes by them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.rank import materialise
from quern.operators.vectors import AT_ONCE, BLOCK, PARTS, TILE, _block_pairs, _blocks, _kind, _matrix, _other, _tiles

#: Centres of an index and groups of neighbouring centres at most, and rows of the bounded sample that centres are fitted on.
CENTRES, GROUPS, SAMPLE = 4096, 64, 32_768
#: Spans into which the blocks of an index are dealt. A task leads a block of queries past all blocks of a span that it asks for and hands on
#: the k best once, so what is written are at most SPANS * k rows a query, at any size.
SPANS = 4
#: Bounds are loosened by this share, which is more than sums of doubles lose.
SLACK = 1e-9


class VectorIndex(NamedTuple):
    """Every row listed under its nearest centre.

    ``blocks`` holds the rows by group of neighbouring centres, in blocks of bounded size: by (group), j, ids2, flat2, cell2 and
    label2. ``radii`` is how far from its centre a cell reaches, so that ``centres`` and ``radii`` bound what any row of a
    cell can score. ``homes`` are larger groups of cells, by which queries that ask for the same cells come together. All four have
    as many rows as there are centres.
    """

    centres: np.ndarray
    radii: np.ndarray
    groups: np.ndarray
    homes: np.ndarray
    blocks: DataFrame


def _fitted(x: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """k-means centres of a bounded sample."""
    centres = x[np.random.default_rng(7).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = _own(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _own(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Nearest centre of each row."""
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + TILE] @ centres.T - half, 1) for i in range(0, len(x), TILE)]) if len(x) else np.zeros(0, np.int64)


def _listed(centres: np.ndarray, groups: np.ndarray, at: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = batch.iloc[:, at]
            own = _own(np.stack(vectors.to_numpy()).astype(np.float64), centres) if len(batch) else np.zeros(0, np.int64)
            yield batch.assign(cell=own.astype(np.int32), grp=groups[own].astype(np.int32))

    return run


def _reach(centres: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                cell = np.asarray(r.cell2)
                gap = np.sqrt(((_matrix(r.ids2, r.flat2) - centres[cell]) ** 2).sum(1))
                out.append(pd.DataFrame({"cell": cell, "gap": gap}).groupby("cell", as_index=False).gap.max())
            yield pd.concat(out) if out else pd.DataFrame({"cell": [], "gap": []})

    return run


def index_vectors(train: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = None, cells: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> VectorIndex:
    """An inverted-file index of all rows with a vector.

    Centres are fitted on at most ``sample`` rows (those with the smallest hashes of their keys); there are ``cells`` of them, or
    one for every ``block`` rows up to ``CENTRES``. Rows of one cell, however many, lie in blocks of bounded size.
    """
    kind = _kind(train, vector)
    rows = train.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast(kind).alias("v"), *([F.col(label).alias("label2")] if label else []))
    n = rows.count()
    x = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()], np.float64)
    k = max(1, min(cells or -(-n // block), CENTRES, len(x)))
    centres = _fitted(x, k) if len(x) else np.zeros((1, 1))
    groups, homes = (_own(centres, _fitted(centres, min(most, max(1, k // 4)))) for most in (GROUPS, PARTS))
    made = rows.mapInPandas(_listed(centres, groups, 1), f"id long, v {kind}" + (", label2 int" if label else "") + ", cell int, grp int")
    blocks = _blocks(made, "id", "v", block, "grp", ["cell", *(["label2"] if label else [])], of_all=True)
    blocks = blocks.select("by", F.col("block").alias("j"), F.col("ids").alias("ids2"), F.col("flat").alias("flat2"), F.col("cell").alias("cell2"), *(["label2"] if label else []))
    radii = np.full(len(centres), -np.inf)
    reached = materialise(blocks.mapInPandas(_reach(centres), "cell int, gap double"), "reach", AT_ONCE)
    for r in reached.groupBy("cell").agg(F.max("gap").alias("gap")).collect():  # a row per centre
        radii[r.cell] = r.gap
    return VectorIndex(centres, radii, groups, homes, blocks)


def _scores(q: np.ndarray, index: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Each query's similarity to every centre, and the most that a row of the cell can have."""
    centres, radii, _ = index
    s = q @ centres.T
    size = np.sqrt((q * q).sum(1))[:, None]
    reach = np.sqrt((centres * centres).sum(1))[None] + np.maximum(radii, 0)[None]
    return s, np.where(np.isfinite(radii)[None], s + size * np.maximum(radii, 0)[None] + SLACK * (1 + size * reach), -np.inf)


def _wanted(q: np.ndarray, floor: np.ndarray | None, probes: int, index: tuple) -> np.ndarray:
    """Cells of each query: the ``probes`` closest ones, or (with a floor) all that can hold a row from the floor on."""
    s, most = _scores(q, index)
    if floor is not None:
        return (most >= floor[:, None]) & np.isfinite(most)
    s = np.where(np.isfinite(most), s, -np.inf)  # empty cells come last
    near = np.zeros(s.shape, bool)
    np.put_along_axis(near, np.argsort(-s, axis=1, kind="stable")[:, :probes], True, 1)
    return near & np.isfinite(most)


def _asked(index: tuple, probes: int, later: bool):
    """The groups of cells that a block of queries asks for: by, block, grp."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                q, floor, want = _matrix(r.ids, r.flat), np.asarray(r.floor, float), np.zeros(len(index[0]), bool)
                for i in range(0, len(q), TILE):
                    want |= _wanted(q[i : i + TILE].astype(np.float64), floor[i : i + TILE] if later else None, probes, index).any(0)
                grp = np.unique(index[2][want]).astype(np.int32)
                yield pd.DataFrame({"by": np.full(len(grp), r.by, np.int32), "block": np.full(len(grp), r.block, np.int32), "grp": grp})

    return run


def _best(k: int, query: np.ndarray, train: np.ndarray, s: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """The k best rows of each query, ties by train id."""
    order = np.lexsort((train, -s, query))
    query = query[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    order = order[place < k]
    return [query[place < k], train[order], s[order], *(a[order] for a in more)]


class _Nearest:
    """The k best rows so far of at most TILE queries, and the similarity that a row needs to become one of them.

    Without floors a query looks at its ``probes`` closest cells only.
    """

    def __init__(self, k: int, ids: np.ndarray, q: np.ndarray, floor: np.ndarray | None, probes: int, index: tuple) -> None:
        self.k, self.ids, self.q, self.index, self.found, self.n = k, ids, q, index, [], 0
        if floor is None:
            self.near, self.least = _wanted(q, None, probes, index), np.full(len(q), -np.inf)
        else:  # floors were summed up in another order, so they are loosened as bounds are
            centres, radii = (a[np.isfinite(index[1])] for a in index[:2])
            reach = (np.sqrt((centres * centres).sum(1)) + radii).max()
            self.near, self.least = None, floor - SLACK * (1 + np.sqrt((q * q).sum(1)) * reach)

    def wants(self, cells: np.ndarray) -> np.ndarray:
        return _wanted(self.q, self.least, 0, (self.index[0][cells], self.index[1][cells], None)) if self.near is None else self.near[:, cells]

    def meet(self, who: np.ndarray, ids: np.ndarray, rows: np.ndarray, names: np.ndarray) -> None:
        """Rows of one cell come to those queries that want it."""
        s, least = self.q[who] @ rows.T, self.least[who]
        hit = s >= (least - _edge(least))[:, None]
        if np.count_nonzero(hit) > self.k * len(s):  # then there are more than k rows
            known = np.where(np.isnan(s), -np.inf, s)
            least = np.maximum(least, np.round(np.partition(known, known.shape[1] - self.k, 1)[:, known.shape[1] - self.k], 12))
            hit = s >= (least - _edge(least))[:, None]
        p, t = np.nonzero(hit)
        s = np.round(s[p, t], 12)
        keep = s >= least[p]
        p, t = p[keep], t[keep]
        self.found.append((who[p], ids[t], s[keep], names[t]))
        self.n += len(p)
        if self.n >= 2 * self.k * len(self.q):
            self.trim()

    def trim(self) -> None:
        best = _best(self.k, *(np.concatenate(x) for x in zip(*self.found, strict=True)))
        last = np.cumsum(n := np.bincount(best[0], minlength=len(self.q))) - 1
        full = n == self.k
        self.least[full] = np.maximum(self.least[full], best[2][last[full]])
        self.found, self.n = [best], len(best[0])

    def best(self, label: bool) -> pd.DataFrame:
        self.trim()
        query, train, s, names = self.found[0]
        return pd.DataFrame({"query_id": self.ids[query], "train_id": train, "similarity": s} | ({"label": names} if label else {}))


def _edge(least: np.ndarray) -> np.ndarray:
    """How far below a rounded similarity one can lie that is rounded to it."""
    return 1e-12 + 1e-14 * np.abs(least)


def _meet(k: int, probes: int, later: bool, label: bool, index: tuple):
    """The k best of a block of queries among the rows of the blocks that follow it (up to the next block of queries) and lie in cells they want."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids, x = np.asarray(r.ids), _matrix(r.ids, r.flat)
                if r.j < 0:
                    yield from (h.best(label) for h in held if h.found)
                    floor = np.asarray(r.floor, float)
                    held = [_Nearest(k, ids[i : i + TILE], x[i : i + TILE].astype(np.float64), floor[i : i + TILE] if later else None, probes, index) for i in range(0, len(ids), TILE)]
                    continue
                names = np.asarray(r.label2) if label else np.zeros(len(ids), np.int32)
                own = np.asarray(r.cell2)
                order = np.argsort(own, kind="stable")
                bounds = np.flatnonzero(np.diff(own[order], prepend=-1, append=-1))
                wants = [h.wants(own[order[bounds[:-1]]]) for h in held]
                for c, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    for at in (order[i : min(i + TILE // 4, b)] for i in range(a, b, TILE // 4)):
                        rows = x[at].astype(np.float64)
                        for h, want in zip(held, wants, strict=True):
                            if len(who := np.flatnonzero(want[:, c])):
                                h.meet(who, ids[at], rows, names[at])
        yield from (h.best(label) for h in held if h.found)

    return run


def search_index(query: DataFrame, index: VectorIndex, k: int, probes: int = 8, exact: bool = True, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """The k most similar listed rows of each query row: query_id, train_id, similarity, (label,) rank (ties by train id).

    A query meets its ``probes`` closest cells. Its k-th similarity there is a floor: ``exact`` then sends it to every cell that
    can hold a row from the floor on, by the cell's centre and radius, so nothing is missed (where there are few cells, to all at
    once). Queries lie in blocks by home; a block is followed by the blocks of the groups of cells that it asks for, span by span,
    so what is shuffled is the index for each block of queries (about PARTS of them, until a block and its k best have MOST bytes).
    Keys of queries are distinct.
    """
    about = index.centres, index.radii, index.groups
    label = "label2" in index.blocks.columns
    kinds = "query_id long, train_id long, similarity double" + (", label int" if label else "")
    if not np.isfinite(index.radii).any():
        return query.sparkSession.createDataFrame([], kinds + ", rank int")
    kind, parts = _kind(query, vector), int(query.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = query.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast(kind).alias("v"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "train_id")

    def met(asked: DataFrame, later: bool) -> DataFrame:
        dealt = asked.mapInPandas(_listed(index.centres, index.homes, 1), f"id long, v {kind}, floor double, cell int, grp int")
        packed = _blocks(dealt, "id", "v", block, "grp", ["floor"], of_all=True, more=5 * k).drop("parts")
        asks = materialise(packed.mapInPandas(_asked(about, probes, later), "by int, block int, grp int"), "asks", AT_ONCE)
        lead = packed.select("by", "block", F.explode(F.sequence(F.lit(0), F.lit(SPANS - 1))).alias("span"), F.lit(-1).alias("j"), "ids", "flat", "floor")
        follow = asks.join(index.blocks.withColumnRenamed("by", "grp"), "grp").withColumn("span", F.pmod(F.col("grp") + F.col("j"), F.lit(SPANS)))
        follow = follow.withColumnsRenamed({"ids2": "ids", "flat2": "flat"}).drop("grp")
        led = lead.unionByName(follow, allowMissingColumns=True).repartition(parts, "by", "block", "span").sortWithinPartitions("by", "block", "span", "j")
        return materialise(led.mapInPandas(_meet(k, probes, later, label, about), kinds), "nearest", AT_ONCE)

    few = int(np.isfinite(index.radii).sum()) <= 2 * probes
    some = met(rows.withColumn("floor", F.lit(float("-inf"))), exact and few)
    if exact and not few:
        kth = some.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("similarity").alias("floor"))
        some = met(rows.join(kth, "id", "left").select("id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")), True)
    return some.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def recall_of_probes(query: DataFrame, train: DataFrame, index: VectorIndex, k: int, sample: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Recall that each number of probes reaches: probes, recall.

    Measured against the exact search of at most ``sample`` queries (smallest hashes of their keys): an exact neighbour is found
    by so many probes if its cell is among the query's so many closest. At most sample * k rows are looked at.
    """
    some = materialise(query.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample), "recall-queries")
    true = search_index(some, index, k, key=key, vector=vector).select("query_id", "train_id")
    true = true.join(some.select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("q")), "query_id").join(train.select(F.col(key).alias("train_id"), F.col(vector).cast("array<double>").alias("t")), "train_id")
    about = index.centres, index.radii, index.groups

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                s, most = _scores(np.stack(batch.q.to_numpy()), about)
                s = np.where(np.isfinite(most), s, -np.inf)
                rank = np.argsort(np.argsort(-s, axis=1, kind="stable"), axis=1)
                yield pd.DataFrame({"place": rank[np.arange(len(batch)), _own(np.stack(batch.t.to_numpy()), about[0])] + 1})

    found = true.mapInPandas(places, "place int").groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    whole = found.agg(F.sum("n").alias("total"))
    so_far = F.sum("n").over(Window.orderBy("place"))  # over probes, at most as many as centres
    return found.join(F.broadcast(whole)).select(F.col("place").alias("probes"), (so_far / F.col("total")).alias("recall"))


def join_knn_topk(query: DataFrame, train: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", label: str | None = None, block: int = BLOCK, cells: int | None = None, probes: int = 8, recall: float | None = None) -> DataFrame:
    """The k most similar train rows of each query row: query_id, train_id, similarity, rank (ties by train id).

    Exact by default. With ``recall`` each query meets as many cells as reached that recall on a bounded sample of the queries.
    """
    index = index_vectors(train, key, vector, label, cells, block=block)
    if recall is None:
        return search_index(query, index, k, probes, True, key, vector, block)
    enough = recall_of_probes(query, train, index, k, key=key, vector=vector).filter(F.col("recall") >= recall).agg(F.min("probes")).first()[0]
    return search_index(query, index, k, enough or probes, False, key, vector, block)


def knn_vote(query: DataFrame, train: DataFrame, ks: Sequence[int] = (10, 20, 100, 200), T: float = 0.07, skip_first: bool = False, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per k the share of query rows whose class is the first, or among the first five, by votes of their k nearest.

    Votes are a softmax over all max(ks) neighbours; a class's probability at k sums the first k. ``skip_first`` leaves
    out the nearest (a query that is in the train set finds itself).
    """
    n_train = train.count()
    most = min(max(ks), n_train - skip_first)
    near = join_knn_topk(query, train, most + skip_first, key, vector, label).filter(F.col("rank") > int(skip_first)).withColumn("rank", F.col("rank") - int(skip_first))
    top = F.max("similarity").over(Window.partitionBy("query_id"))
    e = near.withColumn("e", F.exp((F.col("similarity") - top) / T))
    p = e.withColumn("p", F.col("e") / F.sum("e").over(Window.partitionBy("query_id")))
    capped = sorted({min(k, n_train) for k in ks})
    votes = p.withColumn("k", F.explode(F.array(*(F.lit(k) for k in capped)))).filter("rank <= k").groupBy("k", "query_id", F.col("label").alias("class")).agg(F.round(F.sum("p"), 12).alias("p"))
    ranked = votes.withColumn("place", F.row_number().over(Window.partitionBy("k", "query_id").orderBy(F.desc("p"), "class")))
    truth = query.select(F.col(key).alias("query_id"), F.col(label).alias("class"))
    hit = ranked.join(truth, ["query_id", "class"]).select("k", "query_id", "place")
    total = query.agg(F.count(F.lit(1)).alias("n"))
    return hit.groupBy("k").agg(F.count_if(F.col("place") == 1).alias("h1"), F.count_if(F.col("place") <= 5).alias("h5")).join(F.broadcast(total)).select("k", (F.col("h1") / F.col("n")).alias("top1"), (F.col("h5") / F.col("n")).alias("top5"), "n")


def _highest(k: int):
    """The k highest similarities of each row of two blocks to rows of the other one: id, similarity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids, ids2 = np.asarray(r.ids), np.asarray(r.ids if r.i == r.j else r.ids2)
                best, best2 = (np.full((len(x), k), -np.inf) for x in (ids, ids2))
                for i, j, s in _tiles(_units(_matrix(r.ids, r.flat)), _units(_other(r))):
                    a, b = slice(i, i + TILE), slice(j, j + TILE)
                    s[np.isnan(s)] = -np.inf
                    if r.i == r.j:
                        s[ids[a][:, None] == ids2[b][None]] = -np.inf  # the block of a key holds all its rows
                    else:
                        best2[b] = _top(best2[b], s.T)
                    best[a] = _top(best[a], s)
                for x, top in ((ids, best), (ids2, best2)):
                    found = np.isfinite(top)
                    yield pd.DataFrame({"id": np.repeat(x, k)[found.ravel()], "similarity": np.round(top[found], 12)})

    return run


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; those without a length have no direction (NaN)."""
    x = x.astype(np.float64, copy=False)
    with np.errstate(invalid="ignore"):
        return x / np.sqrt((x * x).sum(1))[:, None]


def _top(best: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The highest values of each row of both, as many as ``best`` has."""
    k = best.shape[1]
    if k == 1:
        return np.maximum(best, s.max(1)[:, None])
    both = np.concatenate([best, s], 1)
    return np.partition(both, both.shape[1] - k, 1)[:, -k:]


def agg_nn_spread(vecs: DataFrame, topk: int = 1, eps: float = 1e-8, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """-mean(log(distance to the nearest others + eps)) of vectors brought to unit length; vectors without a length are left out.

    All rows ask, so blocks meet block by block, each pair once for both sides, and only the highest similarities leave a task.
    """
    packed = _blocks(vecs, key, vector, block)
    met = materialise(_block_pairs(packed).mapInPandas(_highest(topk), "id long, similarity double"), "highest", AT_ONCE)
    near = met.groupBy("id").agg(F.slice(F.sort_array(F.collect_list("similarity"), False), 1, topk).alias("near")) if topk > 1 else met.groupBy("id").agg(F.array(F.max("similarity")).alias("near"))
    others = near.select("id", F.explode("near").alias("similarity"))
    distance = F.sqrt(F.greatest(2 - 2 * F.col("similarity"), F.lit(0.0)))
    return others.agg((-F.avg(F.log(distance + eps))).alias("spread"), F.countDistinct("id").alias("n"))
