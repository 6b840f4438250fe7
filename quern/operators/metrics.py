"""Group-fair errors, bin reports, split reports, summaries and fold reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.expr import fair_weight
from quern.functions.rank import exact_median, group_quantiles


def _group_error(weight: Column, g: int) -> Column:
    here = F.col("grp") == g
    error = F.col("pred") - F.col("label")
    return F.coalesce(F.try_divide(F.sum(F.when(here, weight * error * error)), F.sum(F.when(here, weight))), F.lit(0.0))


def agg_fair_score(df: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Mean of the two groups' weighted errors plus their absolute gap; MAE in percent and R2. One scan, one shuffle.

    An empty group has error 0. R2 is 0 where the labels don't vary. Rows without a group count in neither error.
    """
    w = fair_weight("label") * (F.col(weight) if weight else F.lit(1.0))
    error = F.col("pred") - F.col("label")
    ss = F.sum(F.col("label") * F.col("label")) - F.sum("label") * F.sum("label") / F.count("label")
    out = df.groupBy(*by).agg(
        _group_error(w, 0).alias("err_f"), _group_error(w, 1).alias("err_m"), (F.avg(F.abs(error)) * 100).alias("mae_pct"),
        F.when(F.count(F.when(F.col("label").isNotNull(), 1)) > 0, F.when(F.max("label") > F.min("label"), 1 - F.sum(error * error) / ss).otherwise(0.0)).alias("r2"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("grp").isNull()).alias("n_no_group"),
    )
    gap = F.col("err_f") - F.col("err_m")
    return out.select(*by, ((F.col("err_f") + F.col("err_m")) / 2 + F.abs(gap)).alias("score"), "err_f", "err_m", F.abs(gap).alias("abs_gap"), gap.alias("gap"), "mae_pct", "r2", "n", "n_no_group")


def agg_is_score(df: DataFrame, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """``agg_fair_score`` with each row's weight multiplied by an importance weight (self-normalised); without R2."""
    return agg_fair_score(df, by, weight).drop("r2")


def agg_tilted_penalty(df: DataFrame, lam: float = 1.0, tilt: float = 0.0, weight: str | None = None) -> DataFrame:
    """Mean group error plus a tilted penalty on the gap; the plain weighted error where a group is absent.

    ``next_tilt`` is 3.5 (M - F) / (|M| + |F|) held in [-0.85, 0.85].
    """
    w = F.col(weight) if weight else fair_weight("label")
    error = F.col("pred") - F.col("label")
    out = df.agg(
        _group_error(w, 0).alias("err_f"), _group_error(w, 1).alias("err_m"), F.count_if(F.col("grp") == 0).alias("nf"), F.count_if(F.col("grp") == 1).alias("nm"),
        F.try_divide(F.sum(w * error * error), F.sum(w)).alias("plain"),
    )
    f, m = F.col("err_f"), F.col("err_m")
    penalty = (1 + tilt) * F.greatest(m - f, F.lit(0.0)) + (1 - tilt) * F.greatest(f - m, F.lit(0.0))
    both = (F.col("nf") > 0) & (F.col("nm") > 0)
    turn = F.coalesce(F.try_divide(3.5 * (m - f), F.abs(m) + F.abs(f)), F.lit(0.0))
    return out.select(
        F.when(both, (f + m) / 2 + lam * penalty).otherwise(F.col("plain")).alias("loss"),
        F.when(both, F.abs(f - m)).otherwise(0.0).alias("abs_gap"),
        F.least(F.greatest(turn, F.lit(-0.85)), F.lit(0.85)).alias("next_tilt"),
    )


def bucket(x: str, edges: Sequence[float]) -> Column:
    """Number of the half-open range [edges[i], edges[i+1]) that holds x; null outside."""
    out = None
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        here = (F.col(x) >= a) & (F.col(x) < b)
        out = F.when(here, i) if out is None else out.when(here, i)
    return out


def agg_bin_group_report(df: DataFrame, edges: Sequence[float] = (0.0, 0.1, 0.2, 0.3, 0.4, 1.01)) -> DataFrame:
    """Weighted error and count of each label bin and group; every cell is there."""
    w, error = fair_weight("label"), F.col("pred") - F.col("label")
    found = df.withColumn("bin", bucket("label", edges)).filter("bin IS NOT NULL AND grp IS NOT NULL").groupBy("bin", "grp").agg(F.try_divide(F.sum(w * error * error), F.sum(w)).alias("err"), F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(len(edges) - 1).selectExpr("CAST(id AS INT) AS bin", "explode(array(0, 1)) AS grp")
    return grid.join(found, ["bin", "grp"], "left").select("bin", "grp", F.coalesce("err", F.lit(0.0)).alias("err"), F.coalesce("n", F.lit(0)).alias("n"))


def agg_bin_diagnostics(df: DataFrame, n_bins: int = 200, weight: str | None = None) -> DataFrame:
    """Per fine bin and group: MAE, share of the group's weighted error, count."""
    w, error = F.col(weight) if weight else fair_weight("label"), F.col("pred") - F.col("label")
    cells = df.filter("grp IS NOT NULL AND label IS NOT NULL").withColumn("bin", F.least(F.floor(F.col("label") * n_bins), F.lit(n_bins - 1)).cast("int")).groupBy("bin", "grp").agg(F.avg(F.abs(error)).alias("mae"), F.sum(w * error * error).alias("e"), F.sum(w).alias("w"), F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy("grp")
    return cells.select("bin", "grp", "mae", (F.col("e") / F.sum("w").over(total)).alias("contribution"), "n")


def agg_split_report(df: DataFrame, split: str = "split", edges: Sequence[float] = (0.0, 0.1, 0.2, 0.3, 0.4, 1.0)) -> DataFrame:
    """Per split and label range (the last is closed) the rows of each group, totals per split (range null) and mean label."""
    last = len(edges) - 2
    ranges = F.coalesce(bucket("label", edges), F.when(F.col("label") == edges[-1], last))
    return df.withColumn("range", ranges).filter("range IS NOT NULL").groupBy(F.col(split), "range").agg(*_split_aggs()).unionByName(df.groupBy(F.col(split)).agg(*_split_aggs()).withColumn("range", F.lit(None).cast("int")))


def _split_aggs() -> list[Column]:
    return [F.count_if(F.col("grp") == 0).alias("n_f"), F.count_if(F.col("grp") == 1).alias("n_m"), F.count(F.lit(1)).alias("n"), F.avg("label").alias("mean_label")]


def agg_delta_mae(df: DataFrame, methods: Sequence[str], raw: str = "pred", n_bins: int = 15, hi: float = 0.5) -> DataFrame:
    """Per label bin over [0, hi], group and method: MAE of the method minus MAE of the raw prediction."""
    cells = df.filter((F.col("label") >= 0) & (F.col("label") <= hi)).withColumn("bin", F.least(F.floor(F.col("label") / (hi / n_bins)), F.lit(n_bins - 1)).cast("int"))
    long = cells.select("bin", "grp", "label", F.col(raw).alias("__raw"), F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("value")) for m in methods))).alias("x"))
    return long.groupBy("bin", "grp", "x.method").agg((F.avg(F.abs(F.col("x.value") - F.col("label"))) - F.avg(F.abs(F.col("__raw") - F.col("label")))).alias("delta_mae"), F.count(F.lit(1)).alias("n"))


def agg_pred_summary(df: DataFrame, pred: str = "pred", hi: float = 0.3, lo: float = 0.01) -> DataFrame:
    """Mean, population standard deviation, median and the shares above ``hi`` and below ``lo``."""
    p = F.col(pred)
    return df.agg(F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"), F.avg((p > hi).cast("double")).alias("share_hi"), F.avg((p < lo).cast("double")).alias("share_lo")).join(F.broadcast(exact_median(df, pred)))  # one row


def agg_fold_report(df: DataFrame, weight_a: str, weight_b: str, fold: str = "fold") -> DataFrame:
    """Per fold n, score and gap; then their mean and population deviation, and the pooled score under two weightings."""
    folds = agg_fair_score(df, [fold]).select(F.col(fold).cast("string").alias("part"), "n", "score", "gap")
    stats = folds.agg(F.sum("n").alias("n"), F.avg("score").alias("m"), F.stddev_pop("score").alias("s"), F.avg("gap").alias("gm"), F.stddev_pop("gap").alias("gs"))
    spread = stats.select(F.explode(F.array(F.struct(F.lit("mean").alias("part"), "n", F.col("m").alias("score"), F.col("gm").alias("gap")), F.struct(F.lit("std").alias("part"), "n", F.col("s").alias("score"), F.col("gs").alias("gap")))).alias("x")).select("x.*")
    pooled = [agg_fair_score(df, (), w).select(F.lit(f"pooled_{n}").alias("part"), "n", "score", "gap") for n, w in (("a", weight_a), ("b", weight_b))]
    return folds.unionByName(spread).unionByName(pooled[0]).unionByName(pooled[1])


def agg_fold_tiling_check(df: DataFrame, all_keys: DataFrame, key: str = "sample_id") -> DataFrame:
    """Whether folds are disjoint and cover every key once: counts of repeated, missing and unknown keys."""
    seen = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    both = seen.join(all_keys.select(key).distinct().withColumn("__known", F.lit(1)), key, "full")
    return both.agg(
        F.count_if(F.col("__n") > 1).alias("n_repeated"), F.count_if(F.col("__n").isNull()).alias("n_missing"), F.count_if(F.col("__known").isNull()).alias("n_unknown"),
        F.coalesce(F.bool_and((F.col("__n") == 1).eqNullSafe(True) & F.col("__known").isNotNull()), F.lit(True)).alias("tiles"),
    )


def agg_run_mean_std(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of each metric over repeated tries."""
    return df.groupBy(*by).agg(*(f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))))


def agg_entity_stats(df: DataFrame, entity: str = "entity_id", key: str = "sample_id") -> DataFrame:
    """Per entity median label (by rank, so that a hot entity is no task's alone), rows, and the key of its largest label (largest key of ties)."""
    rows = df.filter(F.col(entity).isNotNull())
    stats = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.max_by(key, F.struct("label", key)).alias("top_key"))
    return stats.join(group_quantiles(rows, [entity], "label", {"entity_median": 0.5}), entity, "left").select(entity, "entity_median", "n", "top_key")
