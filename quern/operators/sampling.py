"""Splits and samples, reproducible by hash: the same rows in any engine, whatever the partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.expr import clip, order_hash, strata, uniform
from quern.functions.metric_spec import sampler
from quern.functions.rank import global_rank, group_rank


def _ordered(df: DataFrame, key: str, *salt) -> DataFrame:
    """Rows with their place in the hash order, ties by key."""
    return global_rank(df.withColumn("__h", order_hash(key, *salt)), [F.col("__h"), F.col(key)], "__r").drop("__h")


@sampler("random")
def smp_random_holdout(df: DataFrame, ratio: float = 0.15, seed: int = 42, key: str = "sample_id") -> DataFrame:
    """max(floor(N * ratio), 1) rows without replacement."""
    total = df.groupBy().agg(F.greatest(F.floor(F.count(F.lit(1)) * ratio), F.lit(1)).alias("__n"))
    return _ordered(df, key, seed).join(F.broadcast(total)).filter("__r <= __n").select(*df.columns)


def smp_strata(df: DataFrame) -> DataFrame:
    """``df`` with its stratum (group times label bin, 42 values)."""
    return df.withColumn("stratum", strata())


def _rank_in(df: DataFrame, by: Sequence[str], key: str, *salt) -> DataFrame:
    """__r: place within ``by`` in hash order; __size: rows of the group. Strata are few and large."""
    return group_rank(df.withColumn("__h", order_hash(key, *salt)), list(by), [F.col("__h"), F.col(key)], "__r", "__size").drop("__h")


@sampler("stratified")
def smp_proportional(df: DataFrame, n: int, seed: int = 42, key: str = "sample_id") -> DataFrame:
    """About ``n`` rows in proportion to the strata: floors first, then one more for the largest remainders; no stratum gives more than it has."""
    rows = _rank_in(df.filter("grp IS NOT NULL AND label IS NOT NULL").withColumn("stratum", strata()), ["stratum"], key, seed)
    sizes = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("size"))
    whole = Window.partitionBy(F.lit(1))  # over at most 42 strata
    share = sizes.withColumn("q", F.round(F.col("size") * n / F.sum("size").over(whole), 9)).withColumn("base", F.floor("q"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(F.col("q") - F.col("base"), 9)), "stratum")
    take = share.withColumn("extra", (F.row_number().over(order) <= n - F.sum("base").over(whole)).cast("int")).select("stratum", F.least(F.col("base") + F.col("extra"), F.col("size")).alias("__take"))
    return rows.join(F.broadcast(take), "stratum").filter("__r <= __take").select(*df.columns, "stratum")


@sampler("kfold")
def smp_kfold(df: DataFrame, k: int = 5, seed: int = 42, key: str = "sample_id") -> DataFrame:
    """Stratified folds: within each stratum rows go round the folds in hash order. One partition per seed."""
    rows = _rank_in(df.withColumn("stratum", F.coalesce(strata(), F.lit(-1))), ["stratum"], key, seed)
    return rows.select(*(c for c in df.columns if c != "fold"), "stratum", ((F.col("__r") - 1) % k).cast("int").alias("fold"))


@sampler("monitor")
def smp_full_data(df: DataFrame, n: int = 2000, seed: int = 42, key: str = "sample_id") -> DataFrame:
    """Every row trains; ``monitor`` marks the ``n`` rows (by hash order) that are also watched."""
    return _ordered(df, key, seed).select(*df.columns, (F.col("__r") <= n).alias("monitor"))


def smp_importance(df: DataFrame, weight: str = "weight", rho: float = 1.0, seed: int = 42, epoch: int = 0, key: str = "sample_id") -> DataFrame:
    """Rows kept with p = min(1, w**rho), those from 0.999 always; what is left of the weight, and an augmentation strength in [.25, 1]."""
    p = F.least(F.lit(1.0), F.pow(F.col(weight), F.lit(rho)))
    kept = df.withColumn("p", p).filter((F.col("p") >= 0.999) | (uniform(key, seed, epoch) < F.col("p")))
    return kept.select(*df.columns, "p", (F.col(weight) / F.col("p")).alias("residual"), clip(weight, 0.25, 1.0).alias("strength"))


def smp_epoch_shards(df: DataFrame, n_shards: int, seed: int = 42, epoch: int = 0, pad: bool = True, key: str = "sample_id") -> DataFrame:
    """A permutation per epoch dealt to shards of equal length; short shards repeat rows from the start (or the tail is cropped)."""
    rows = _ordered(df, key, seed, epoch).withColumn("__p", F.col("__r") - 1)
    total = rows.groupBy().agg(F.count(F.lit(1)).alias("__t"))
    rows = rows.join(F.broadcast(total))
    if pad:
        need = (n_shards - F.col("__t") % n_shards) % n_shards
        rows = rows.unionByName(rows.filter(F.col("__p") < need).withColumn("__p", F.col("__t") + F.col("__p")))
    else:
        rows = rows.filter(F.col("__p") < F.col("__t") - F.col("__t") % n_shards)
    return rows.select(*df.columns, (F.col("__p") % n_shards).cast("int").alias("shard"), F.floor(F.col("__p") / n_shards).alias("pos"))


def smp_balanced_batches(df: DataFrame, batch_size: int, seed: int = 42, epoch: int = 0, key: str = "sample_id") -> DataFrame:
    """Batches that hold both groups in their natural ratio, no row twice; plain batches where a group is absent."""
    known = df.filter("grp IN (0, 1)")
    rows = _rank_in(known, ["grp"], key, seed, epoch)
    c = rows.groupBy().agg(F.count_if(F.col("grp") == 0).alias("__f"), F.count_if(F.col("grp") == 1).alias("__m"))
    f, m = F.col("__f"), F.col("__m")
    n_f = F.least(F.greatest(F.floor(batch_size * f / (f + m) + 0.5), F.lit(1)), F.lit(batch_size - 1))
    c = c.withColumn("__nf", n_f).withColumn("__both", (f > 0) & (m > 0)).withColumn("__nm", batch_size - F.col("__nf"))
    c = c.withColumn("__b", F.when(F.col("__both"), F.least(F.floor(f / F.col("__nf")), F.floor(m / F.col("__nm")))).otherwise(F.floor((f + m) / batch_size)))
    size = F.when(F.col("__both"), F.when(F.col("grp") == 0, F.col("__nf")).otherwise(F.col("__nm"))).otherwise(F.lit(batch_size))
    return rows.join(F.broadcast(c)).withColumn("batch_id", F.floor((F.col("__r") - 1) / size)).filter("batch_id < __b").select(*df.columns, "batch_id")


def smp_few_shot(df: DataFrame, k_or_percent: float, tries: int = 1, label: str = "label", key: str = "id") -> DataFrame:
    """k rows of each class, or max(floor(p * n), 1) where k < 1, in independent tries."""
    shots = df.withColumn("try", F.explode(F.array(*(F.lit(t) for t in range(tries))))).filter(F.col(label).isNotNull())
    rows = _rank_in(shots.withColumn("__k", F.concat_ws(":", F.col(key), F.col("try"))), [label, "try"], "__k")
    take = F.greatest(F.floor(F.col("__size") * k_or_percent), F.lit(1)) if k_or_percent < 1 else F.lit(int(k_or_percent))
    return rows.filter(F.col("__r") <= take).select(*df.columns, "try")


def smp_few_shot_multilabel(df: DataFrame, percent: float, tries: int = 1, labels: str = "labels", key: str = "id") -> DataFrame:
    """A share of the rows whose label occurrences sum to that share of all occurrences: a first cut by rows, rescaled once by labels."""
    rows = df.withColumn("try", F.explode(F.array(*(F.lit(t) for t in range(tries)))))
    rows = _rank_in(rows.withColumn("__k", F.concat_ws(":", F.col(key), F.col("try"))), ["try"], "__k")
    first = F.greatest(F.floor(F.col("__size") * percent), F.lit(1))
    sums = rows.groupBy("try").agg(F.sum(F.size(labels)).alias("__all"), F.sum(F.when(F.col("__r") <= first, F.size(labels))).alias("__got"), F.first(first).alias("__first"))
    take = sums.select("try", F.greatest(F.floor(F.col("__first") * (F.col("__all") * percent) / F.col("__got") + 0.5), F.lit(1)).alias("__take"))
    return rows.join(F.broadcast(take), "try").filter("__r <= __take").select(*df.columns, "try")


def smp_class_split(df: DataFrame, percent: float = 0.1, seed: int = 0, label: str = "label", key: str = "id") -> DataFrame:
    """max(1, floor(p * n)) rows of each class validate; a class of one row trains."""
    rows = _rank_in(df, [label], key, seed)
    val = (F.col("__size") > 1) & (F.col("__r") <= F.greatest(F.floor(F.col("__size") * percent), F.lit(1)))
    return rows.select(*df.columns, F.when(val, "val").otherwise("train").alias("split"))


def smp_mixture(sources: dict[str, DataFrame], ratios: dict[str, float], batch_size: int, seed: int = 42, key: str = "id") -> DataFrame:
    """Whole batches drawn from sources by ratio until the first source is exhausted: slot, source, key.

    Each slot of a batch sequence is given to a source by a hash draw; a source's m-th slot takes its m-th batch.
    """
    names = sorted(sources)
    whole = sum(ratios[n] for n in names)
    ranked = [_ordered(sources[n].select(F.col(key).cast("string").alias(key)), key, seed, n).select(F.lit(n).alias("source"), key, F.floor((F.col("__r") - 1) / batch_size).alias("batch")) for n in names]
    rows = ranked[0]
    for r in ranked[1:]:
        rows = rows.unionByName(r)
    full = rows.groupBy("source", "batch").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == batch_size).groupBy("source").agg(F.count(F.lit(1)).alias("have"))
    slots = rows.sparkSession.range(full.agg(F.sum("have")).first()[0] or 0).withColumnRenamed("id", "slot")  # one number comes to the driver
    bounds, low = [], 0.0
    for n in names:
        bounds.append((n, low, low + ratios[n] / whole))
        low += ratios[n] / whole
    draw: Column = F.lit(names[-1])
    for n, _, high in reversed(bounds[:-1]):
        draw = F.when(uniform("slot", seed) < high, n).otherwise(draw)
    drawn = global_rank(slots.withColumn("source", draw), [F.col("source"), F.col("slot")], "__g")
    first = drawn.groupBy("source").agg(F.min("__g").alias("__f"))
    drawn = drawn.join(F.broadcast(first), "source").withColumn("batch", F.col("__g") - F.col("__f")).drop("__g", "__f")
    # the first slot whose source has no batch left ends the mixture
    ended = drawn.join(F.broadcast(full), "source", "left").filter(F.col("batch") >= F.coalesce("have", F.lit(0))).agg(F.min("slot").alias("__end"))
    used = drawn.join(F.broadcast(ended)).filter(F.col("__end").isNull() | (F.col("slot") < F.col("__end")))
    return used.join(rows, ["source", "batch"]).select("slot", "source", key)
