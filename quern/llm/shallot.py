"""Exact k-means of integer vectors by Shallot search.

Every vector keeps, from round to round, its centroid, its second-nearest centroid, an upper bound of its distance to the
first and a lower bound of its distance to all others. After the centroids have moved, the bounds are loosened by how far;
while the upper one is below the lower one, or below half the way to the nearest other centroid, nothing is computed.
Otherwise the distance to the own centroid is computed, then that to the remembered second; the search starts from the
closer of the two and goes through its neighbours in order of their distance to it, as long as that distance is within the
start's distance plus the second-best distance so far. That ball shrinks whenever a second-best is found. Whatever lies in
it is compared by exact integer distances; bounds are rounded outwards and comparisons of bounds strict, so ties always
come to the integer comparison, where the smaller number wins.

On Spark: vectors are packed once into blocks of at most 1,000, in a table bucketed by block. A round reads it beside the
last round's bounds, bucketed alike (so nothing is shuffled), and writes new bounds and one row of sums per task. Only the
sums (centroids x (dimensions + 1) numbers after aggregation) and the centroids pass the driver.

Defined cases. Vectors that are null, have another number of components, or null, infinite or NaN components are left out.
A null id is kept and comes last where ids' hashes choose the first centroids. Rows that repeat an id are vectors of their
own; of equal hashes the smaller vector comes first. With fewer vectors than centroids there are as many centroids as vectors.
Components that are not within 2**27 once they are integers raise an error: squared distances would not fit 64 bits. Other
columns of the caller, whatever their names, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bound_batches, col, materialise, scratch

#: Blocks that a Python task holds at once.
AT_ONCE = 16
#: Integer components beyond this would give squared distances of more than 64 bits.
LARGEST = 1 << 27
#: Bounds are rounded outwards by this share, which is more than what square roots and sums lose.
SLACK = 1e-12


def up(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 + SLACK)


def down(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 - SLACK)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer matrices."""
    gap = x - y
    return np.einsum("ij,ij->i", gap, gap)


class Centroids(NamedTuple):
    """Centroids with what the search needs of them: each one's others in order of distance, and how far they moved."""

    at: np.ndarray  # integers, one row each
    near: np.ndarray  # the others of each, nearest first
    far: np.ndarray  # their distances, rounded down
    half: np.ndarray  # half the distance to the nearest other
    moved: np.ndarray  # since the round before, rounded up
    others: np.ndarray  # the most that any other one moved

    @staticmethod
    def of(at: np.ndarray, before: np.ndarray | None = None) -> Centroids:
        k = len(at)
        squares = np.stack([squared(np.broadcast_to(c, at.shape), at) for c in at])
        np.fill_diagonal(squares, -1)  # itself comes first and is left out
        near = np.argsort(squares, axis=1, kind="stable")[:, 1:]
        far = down(np.take_along_axis(squares, near, 1))
        moved = np.zeros(k) if before is None else up(squared(at, before))
        others = np.array([np.delete(moved, i).max(initial=0) for i in range(k)])
        return Centroids(at, near, far, far[:, 0] / 2 if k > 1 else np.full(k, np.inf), moved, others)


class Bounds(NamedTuple):
    own: np.ndarray
    second: np.ndarray
    upper: np.ndarray
    lower: np.ndarray

    @staticmethod
    def none(n: int) -> Bounds:
        return Bounds(np.zeros(n, np.int64), np.ones(n, np.int64), np.full(n, np.inf), np.zeros(n))

    def pack(self) -> bytes:
        return b"".join((self.own.astype("<u2").tobytes(), self.second.astype("<u2").tobytes(), self.upper.astype("<f8").tobytes(), self.lower.astype("<f8").tobytes()))

    @staticmethod
    def unpack(data: bytes) -> Bounds:
        n = len(data) // 20
        ids = np.frombuffer(data, "<u2", 2 * n).astype(np.int64)
        rest = np.frombuffer(data, "<f8", 2 * n, 4 * n)
        return Bounds(ids[:n], ids[n:], rest[:n].copy(), rest[n:].copy())


def search(x: np.ndarray, c: Centroids, b: Bounds) -> Bounds:
    """Each vector's nearest and second-nearest centroid, with bounds, from the bounds of the round before."""
    if len(c.at) < 2:
        return Bounds(np.zeros(len(x), np.int64), b.second, b.upper, b.lower)
    own, second = b.own.copy(), b.second.copy()
    upper, lower = b.upper + c.moved[own], b.lower - c.others[own]
    todo = np.flatnonzero(upper >= np.maximum(lower, c.half[own]))
    d1 = squared(x[todo], c.at[own[todo]])
    upper[todo] = up(d1)
    open_ = upper[todo] >= np.maximum(lower[todo], c.half[own[todo]])
    todo, d1 = todo[open_], d1[open_]
    if not len(todo):
        return Bounds(own, second, upper, lower)
    p, q = own[todo], second[todo]
    d2 = squared(x[todo], c.at[q])
    swap = (d2 < d1) | ((d2 == d1) & (q < p))
    p, q, d1, d2 = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, d2, d1), np.where(swap, d1, d2)
    start, met = p.copy(), q.copy()  # both are known already
    radius = up(d1)
    reach = radius + up(d2)
    live = np.arange(len(todo))
    for t in range(len(c.at) - 1):
        live = live[c.far[start[live], t] <= reach[live]]
        if not len(live):
            break
        j = c.near[start[live], t]
        new = j != met[live]
        at, j = live[new], j[new]
        d = squared(x[todo[at]], c.at[j])
        first = (d < d1[at]) | ((d == d1[at]) & (j < p[at]))
        i = at[first]
        d2[i], q[i], d1[i], p[i] = d1[i], p[i], d[first], j[first]
        next_ = ~first & (d < d2[at])
        s = at[next_]
        d2[s], q[s] = d[next_], j[next_]
        reach[at] = radius[at] + up(d2[at])
    own[todo], second[todo], upper[todo], lower[todo] = p, q, up(d1), down(d2)
    return Bounds(own, second, upper, lower)


def sums_of(x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Per centroid the componentwise sum and, last, the number of its vectors."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    if len(x):
        order = np.argsort(own, kind="stable")
        found, first = np.unique(own[order], return_index=True)
        out[found, :-1] = np.add.reduceat(x[order], first, axis=0)
        out[:, -1] = np.bincount(own, minlength=k)
    return out


def _blocks(dims: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per batch: block, ids, width, flat."""
    part = TaskContext.get().partitionId()
    for n, batch in enumerate(b for b in batches if b.num_rows):
        x = batch.column(1).flatten().to_numpy().reshape(-1, dims)
        width = 2 if np.abs(x).max() < 1 << 15 else 4
        ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([part << 33 | n]), ids, pa.array([width], pa.int32()), pa.array([x.astype(f"<i{width}").tobytes()])], names=["block", "ids", "width", "flat"])


def _matrix(flat: bytes, width: int, dims: int) -> np.ndarray:
    return np.frombuffer(flat, f"<i{width}").reshape(-1, dims).astype(np.int64)


def _round(c: Centroids, known: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block its new bounds, and one row of sums for all blocks of the task."""
    k, dims = c.at.shape
    total, block = np.zeros((k, dims + 1), np.int64), None
    schema = pa.schema([("block", pa.int64()), ("bounds", pa.binary()), ("sums", pa.binary())])
    for batch in batches:
        blocks, out = batch.column(0).to_pylist(), []
        for i, block in enumerate(blocks):
            x = _matrix(batch.column(2)[i].as_py(), batch.column(1)[i].as_py(), dims)
            b = search(x, c, Bounds.unpack(batch.column(3)[i].as_py()) if known else Bounds.none(len(x)))
            total += sums_of(x, b.own, k)
            out.append(b.pack())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.nulls(len(out), pa.binary())], schema=schema)
    if block is not None:
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], schema=schema)


def _last(c: Centroids, known: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per vector its id, centroid and exact squared distance."""
    for batch in batches:
        for i in range(batch.num_rows):
            x = _matrix(batch.column(2)[i].as_py(), batch.column(1)[i].as_py(), c.at.shape[1])
            b = search(x, c, Bounds.unpack(batch.column(3)[i].as_py()) if known else Bounds.none(len(x)))
            yield pa.RecordBatch.from_arrays([batch.column(4)[i].values, pa.array(b.own.astype(np.int32)), pa.array(squared(x, c.at[b.own]))], names=["id", "cluster", "distance"])


def _added(shape: tuple[int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the task's rows: slot (centroid x component, in order), amount."""
    total = np.zeros(shape, np.int64)
    for batch in batches:
        for data in batch.column(0).to_pylist():
            total += np.frombuffer(data, np.int64).reshape(shape)
    slots = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(total.ravel()[slots])], names=["slot", "amount"])


@contextmanager
def _few_blocks(spark: SparkSession):
    """Blocks, not rows, pass between the JVM and Python meanwhile."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, str(AT_ONCE))
    try:
        yield
    finally:
        spark.conf.set(size, before)


class Bucketed:
    """Tables in the shared folder, bucketed by block, known to the catalog until ``close``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names, self.buckets = spark, [], int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.names.append(f"shallot_{name}_{uuid.uuid4().hex}")
        df.write.format("parquet").bucketBy(self.buckets, "block").option("path", scratch(self.spark, f"shallot-{name}")).saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1])

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def integers(vecs: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """id and components (floor(scale * component), integers) of the vectors that are kept."""
    v = F.col("v")
    whole = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = vecs.select(col(id_col).cast("long").alias("id"), col(vector_col).alias("v")).filter(v.isNotNull() & whole)
    fits = F.forall("v", lambda x: F.abs(x.cast("double") * scale) <= float(LARGEST))
    made = F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return kept.select("id", F.when(fits, made).otherwise(F.raise_error(F.lit("a component is too large for exact squared distances"))).alias("v"))


def cluster_vectors(vecs: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """Per kept vector: id, cluster, distance (squared), written; and the centroids.

    Centroids start as the k vectors whose ids have the smallest hashes, in that order. ``rounds`` times vectors are assigned
    and centroids replaced by the floors of their vectors' means; then vectors are assigned once more.
    """
    if k >= 1 << 16:
        raise ValueError("at most 65,535 centroids")
    spark = vecs.sparkSession
    bound_batches(spark)
    rows = integers(vecs, id_col, vector_col, dims, scale)
    mark = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    chosen = rows.orderBy(mark.asc_nulls_last(), "v").limit(k).collect()
    if not chosen:
        return spark.createDataFrame([], f"`{id_col}` long, cluster int, distance long"), []
    tables = Bucketed(spark)
    try:
        made = rows.mapInArrow(partial(_blocks, dims), "block long, ids array<long>, width int, flat binary")
        blocks = tables.write(made.repartition(tables.buckets, "block"), "vectors")
        at, before, bounds = np.array([r.v for r in chosen], np.int64), None, None
        with _few_blocks(spark):
            for _ in range(rounds + 1):
                c, last, done = Centroids.of(at, before), _ == rounds, bounds is not None
                beside = blocks.join(bounds.filter("bounds IS NOT NULL").select("block", "bounds").hint("shuffle_hash"), "block") if done else blocks.withColumn("bounds", F.lit(None).cast("binary"))
                beside = beside.select("block", "width", "flat", "bounds", *(["ids"] if last else []))
                if last:
                    found = materialise(beside.mapInArrow(partial(_last, c, done), "id long, cluster int, distance long"), "assigned")
                    break
                bounds = tables.write(beside.mapInArrow(partial(_round, c, done), "block long, bounds binary, sums binary"), "bounds")
                shape = len(at), dims + 1
                parts = bounds.filter("sums IS NOT NULL").select("sums").mapInArrow(partial(_added, shape), "slot int, amount long")
                sums = np.zeros(shape[0] * shape[1], object)
                for r in parts.groupBy("slot").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount")).collect():  # centroids x (dims + 1)
                    sums[r.slot] = int(r.amount)
                sums = sums.reshape(shape)
                before, at = at, np.array([[s // n for s in row] if n else list(old) for *row, n, old in ((*row, old) for row, old in zip(sums, at, strict=True))], np.int64)
    finally:
        tables.close()
    return found.withColumnRenamed("id", id_col), at.tolist()


def clusters(vecs: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per kept vector: id, cluster, distance, cluster_inertia, inertia (distances summed over its cluster, over all), centroid_sha256."""
    found, centroids = cluster_vectors(vecs, k, rounds, dims, scale, salt, id_col, vector_col)
    spark = vecs.sparkSession
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    about = materialise(sums.join(F.broadcast(named), "cluster").join(F.broadcast(total)), "clusters")  # k rows
    return found.join(F.broadcast(about), "cluster").select(col(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
