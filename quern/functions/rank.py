"""Ranks over a whole table without a single-task window."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; where that is unset, a temporary one of this machine, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-quern-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, rows_per_batch: int | None = None) -> DataFrame:
    """Written to the shared folder and read back, so that lineage ends there and lost executors cost nothing.

    ``rows_per_batch`` bounds the rows that a Python function of ``df`` gets at once, where a row is a block of many.
    """
    spark, path, size = df.sparkSession, shared_path(df.sparkSession, name), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        if rows_per_batch:
            spark.conf.set(size, str(rows_per_batch))
        df.write.parquet(path)
    finally:
        spark.conf.set(size, before)
    return spark.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, order: list[Column | str], name: str = "rank", parts: int | None = None) -> DataFrame:
    """1, 2, ... over the whole table in the given order.

    Range-partition on the order, sort and number the rows inside partitions, and add the rows of the partitions before:
    one shuffle. Only one count per partition meets in one place. The numbered table is written, so that both passes see
    the same partitions.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = materialise(placed, "ranged")
    part = F.shiftright("__at", 33)  # the partition's number; the lower bits count its rows from 0
    counts = dealt.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over partitions
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    numbered = dealt.withColumn("__part", part).join(F.broadcast(starts), "__part")  # one row a partition
    return numbered.withColumn(name, F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__part", "__start", "__at")


def group_rank(df: DataFrame, by: list[str], order: list[Column | str], name: str = "rank", size: str | None = None) -> DataFrame:
    """1, 2, ... within the groups of ``by``, for groups that are few and large: the whole table's rank less the rows of earlier groups.

    ``size`` also names a column with the rows of the group.
    """
    ranked = global_rank(df, [*(F.col(b) for b in by), *order], "__g")
    keys = [f"__k{i}" for i in range(len(by))]
    first = ranked.groupBy(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True))).agg(F.min("__g").alias("__f"), F.count(F.lit(1)).alias(size or "__size"))
    same = F.lit(True)
    for b, k in zip(by, keys, strict=True):
        same &= F.col(b).eqNullSafe(F.col(k))
    return ranked.join(first, same).select(*df.columns, (F.col("__g") - F.col("__f") + 1).alias(name), *([size] if size else []))


def ranged(df: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """The rows range-partitioned by group and order, with their partition's number in ``__part``; written, so that all passes see the same."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(parts, *(F.col(b) for b in by), *order).withColumn("__part", F.spark_partition_id()), "ranged")


def here(by: list[str], order: list[Column | str]) -> Window:
    """A group's rows of one partition, in order."""
    return Window.partitionBy("__part", *by).orderBy(*order)


def carried(ends: DataFrame, by: list[str], columns: dict[str, Column], back: int | None = None) -> DataFrame:
    """What earlier partitions (``back`` of them, or all) of a group bring to each: ``columns`` are aggregates over rows of ``ends``, one per partition and group."""
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding if back is None else -back, -1)
    return ends.select("__part", *by, *(c.over(before).alias(n) for n, c in columns.items()))


def running_sums(df: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, str]) -> DataFrame:
    """Running sums (``sums``: new column -> summed column) within ``by`` in an order, however many rows a group has.

    Range-partition on group and order, sum inside partitions, and add the groups' sums of earlier partitions.
    """
    dealt, rows = ranged(df, by, order), here(by, order).rowsBetween(Window.unboundedPreceding, 0)
    totals = dealt.groupBy("__part", *by).agg(*(F.sum(c).alias(f"__t_{n}") for n, c in sums.items()))
    starts = carried(totals, by, {f"__s_{n}": F.sum(f"__t_{n}") for n in sums})
    inside = dealt.select(*dealt.columns, *(F.sum(c).over(rows).alias(n) for n, c in sums.items()))
    return inside.join(starts, ["__part", *by]).select(*df.columns, *((F.col(n) + F.coalesce(F.col(f"__s_{n}"), F.lit(0))).alias(n) for n in sums))


def running_minima(df: DataFrame, by: list[str], order: list[Column | str], col: Column, name: str) -> DataFrame:
    """Running minimum within ``by`` in an order, however many rows a group has: like ``running_sums``, with minima carried from earlier partitions."""
    dealt, rows = ranged(df.withColumn("__v", col), by, order), here(by, order).rowsBetween(Window.unboundedPreceding, 0)
    least = dealt.groupBy("__part", *by).agg(F.min("__v").alias("__m"))
    inside = dealt.withColumn("__h", F.min("__v").over(rows))
    return inside.join(carried(least, by, {"__s": F.min("__m")}), ["__part", *by]).select(*df.columns, F.least("__h", "__s").alias(name))


def group_quantiles(df: DataFrame, by: list[str], col: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear between neighbours) of a column per group, as columns, by rank: no task holds a group's values."""
    rows = group_rank(df.filter(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("__v")), by, [F.col("__v")], "__r", "__n")
    out = []
    for name, q in quantiles.items():
        at = (F.col("__n") - 1) * F.lit(float(q)) + 1  # place of the quantile
        low = F.max(F.when(F.col("__r") == F.floor(at), F.col("__v")))
        high = F.max(F.when(F.col("__r") == F.ceil(at), F.col("__v")))
        share = F.max(at - F.floor(at))
        out.append(F.when(low == high, low).otherwise(low + (high - low) * share).alias(name))
    return rows.groupBy(*by).agg(*out)


def exact_median(df: DataFrame, col: str, name: str = "median") -> DataFrame:
    """Median of a column as one row, by rank: no task holds the column's values."""
    rows = global_rank(df.select(F.col(col).alias("__v")).filter("__v IS NOT NULL"), [F.col("__v")], "__r")
    total = rows.groupBy().agg(F.count(F.lit(1)).alias("__n"))
    middle = rows.join(F.broadcast(total)).filter((F.col("__r") == F.floor((F.col("__n") + 1) / 2)) | (F.col("__r") == F.floor((F.col("__n") + 2) / 2)))
    return middle.groupBy().agg(F.avg("__v").alias(name))
