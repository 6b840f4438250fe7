"""Experiment analytics: trials, metric histories, windows, top-k tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.expr import fair_weight, no_nan
from quern.functions.rank import carried, global_rank, group_quantiles, here, materialise, ranged, running_minima


def agg_axis_breakdown(long: DataFrame, cat: Sequence[str], cont: Sequence[str], q: int = 4) -> DataFrame:
    """Per axis and value of (run_id, axis, value, score): n, best (smallest), mean and median score.

    Continuous axes are cut at quantiles (repeated edges dropped, ranges closed on the right and the first on the left
    too); axes with fewer than four numbers are left out.
    """
    by_value = long.filter(F.col("axis").isin(*cat) & F.col("value").isNotNull()).select("axis", F.col("value").alias("part"), "score")
    numbers = long.filter(F.col("axis").isin(*cont)).select("axis", F.expr("try_cast(value AS DOUBLE)").alias("x"), "score").filter("x IS NOT NULL AND NOT isnan(x)")
    cuts = group_quantiles(numbers, ["axis"], "x", {f"e{i}": i / q for i in range(q + 1)})
    enough = numbers.groupBy("axis").agg(F.count(F.lit(1)).alias("n")).filter("n >= 4")
    edges = cuts.join(enough, "axis", "left_semi").select("axis", F.array_distinct(F.array(*(f"e{i}" for i in range(q + 1)))).alias("e"))
    # the number of edges below a value is its range; the smallest value belongs to the first
    binned = numbers.join(edges, "axis").withColumn("b", F.greatest(F.size(F.filter("e", lambda v: v < F.col("x"))), F.lit(1)))
    ranges = binned.select("axis", F.concat(F.lit("q"), F.col("b").cast("string")).alias("part"), "score")
    rows = by_value.unionByName(ranges)
    stats = rows.groupBy("axis", "part").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("best"), F.avg("score").alias("avg"))
    return stats.join(group_quantiles(rows, ["axis", "part"], "score", {"median": 0.5}), ["axis", "part"], "left")


def agg_axis_coverage(long: DataFrame) -> DataFrame:
    """Per axis of (axis, value): n, distinct values, min, max and sample deviation of the numbers, first six values in order."""
    x = F.expr("try_cast(value AS DOUBLE)")
    # distinct values are many at scale: they are counted once per value first, and only six are gathered per task and axis
    per = long.filter("value IS NOT NULL").groupBy("axis", "value").agg(F.count(F.lit(1)).alias("c"))
    first = per.withColumn("r", F.row_number().over(Window.partitionBy("axis").orderBy("value"))).filter("r <= 6").groupBy("axis").agg(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda s: s["value"])).alias("first_values"))
    stats = long.filter("value IS NOT NULL").groupBy("axis").agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.stddev_samp(x).alias("std"))
    return stats.join(per.groupBy("axis").agg(F.count(F.lit(1)).alias("n_distinct")), "axis").join(first, "axis")


def agg_best_trials(runs: DataFrame, k: int, score: str = "score", status: str = "status", key: str = "run_id") -> DataFrame:
    """The k best completed trials with a finite score, ascending."""
    finite = no_nan(score).isNotNull() & (F.abs(F.col(score)) < float("inf"))
    return runs.filter((F.col(status) == "FINISHED") & finite).orderBy(score, key).limit(k)


def agg_best_epoch(history: DataFrame, patience: int, run: str | Sequence[str] = "run_id", step: str = "step", value: str = "value", full_data: bool = False) -> DataFrame:
    """Per run the first epoch of the smallest value seen before ``patience`` epochs pass without a strict improvement.

    Trained on all data, the last epoch is the best by rule. A run may have any number of epochs: the smallest value, the number of
    epochs and the last improvement are carried from one range of a run to the next.
    """
    by = [run] if isinstance(run, str) else list(run)
    if full_data:
        return history.groupBy(*by).agg(F.max(step).alias("best_epoch"), F.max_by(value, step).alias("best_value"), F.max(step).alias("stopped_at"))
    dealt, rows = ranged(history.select(*by, step, value), by, [step]), here(by, [step])
    so_far = rows.rowsBetween(Window.unboundedPreceding, 0)
    ends = dealt.groupBy("__part", *by).agg(F.min(value).alias("__m"), F.count(F.lit(1)).alias("__c"))
    known = dealt.join(carried(ends, by, {"__low": F.min("__m"), "__n0": F.sum("__c")}), ["__part", *by])
    before = F.least(F.min(value).over(rows.rowsBetween(Window.unboundedPreceding, -1)), "__low")
    n = F.row_number().over(rows) + F.coalesce("__n0", F.lit(0))
    marked = known.select("__part", *by, step, value, n.alias("__n"), F.when(before.isNull() | (F.col(value) < before), n).alias("__b"))
    marked = materialise(marked, "epochs")
    last = carried(marked.groupBy("__part", *by).agg(F.max("__b").alias("__b")), by, {"__b0": F.max("__b")})
    idle = F.col("__n") - F.greatest(F.max("__b").over(so_far), "__b0")
    stops = marked.join(last, ["__part", *by]).select(*by, F.when(idle >= patience, F.col("__n")).alias("__s")).groupBy(*by).agg(F.min("__s").alias("__s"))
    live = marked.join(stops, by).filter(F.col("__s").isNull() | (F.col("__n") <= F.col("__s")))
    first = F.min_by(step, F.when(F.col(value).isNotNull(), F.struct(value, step)))  # an epoch without a value is never the best of a run with one
    return live.groupBy(*by).agg(F.coalesce(first, F.min(step)).alias("best_epoch"), F.min(value).alias("best_value"), F.max(step).alias("stopped_at"))


def win_best_so_far(runs: DataFrame, score: str = "score", order: Sequence[str] = ("start_time", "run_id"), by: Sequence[str] = ("experiment_id",), skip_bad: bool = True) -> DataFrame:
    """Running minimum of the score in order, per experiment; missing and infinite scores are skipped."""
    s = F.when(F.abs(no_nan(score)) < float("inf"), F.col(score)) if skip_bad else F.col(score)
    return running_minima(runs, list(by), list(order), s, "best_so_far")


def win_top_n_per_group(df: DataFrame, n: int, by: Sequence[str], order: str, key: str = "run_id", desc: bool = False) -> DataFrame:
    """The n first rows of each group by a column, missing values last."""
    o = F.col(order).desc_nulls_last() if desc else F.col(order).asc_nulls_last()
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(o, key))).filter(F.col("rank") <= n)


def win_last_value(history: DataFrame, fallback: DataFrame | None = None, by: Sequence[str] = ("run_id", "metric"), step: str = "step", value: str = "value") -> DataFrame:
    """Last logged value of each run and metric, else the run's summary value."""
    last = history.groupBy(*by).agg(F.max_by(value, step).alias("last_value"))
    if fallback is None:
        return last
    return last.join(fallback.select(*by, F.col(value).alias("__f")), list(by), "full").select(*by, F.coalesce("last_value", "__f").alias("last_value"))


def win_progress(history: DataFrame, run: str = "run_id", step: str = "step") -> DataFrame:
    """Step as a percentage of the run's last step."""
    last = history.groupBy(run).agg(F.max(step).alias("__last"))
    return history.join(last, run).withColumn("progress", 100.0 * F.col(step) / F.col("__last")).drop("__last")


def win_smoothed(history: DataFrame, window: int = 20, by: Sequence[str] = ("run_id", "metric"), step: str = "step", value: str = "value") -> DataFrame:
    """Median (lower middle) and mean of the last ``window`` points, running mean, maximum and last value.

    A run is split into ranges of steps: each starts with the last points of the ranges before (as many as the window needs) and
    with their sum and number, so however long it is, it is no task's alone. Missing values take a place and count for nothing.
    """
    by, point = list(by), F.struct(F.col(value).alias("v"))
    dealt, rows = ranged(history.select(*by, step, value), by, [step]), here(by, [step])
    tails = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("__part", *by).orderBy(F.desc(step)))).groupBy("__part", *by)
    ends = tails.agg(F.sum(value).alias("__s"), F.count(value).alias("__c"), F.collect_list(F.when(F.col("__r") < window, F.struct(F.col("__r"), F.col(value).alias("v")))).alias("__t"))
    ends = ends.withColumn("__t", F.transform(F.sort_array("__t", False), lambda x: F.struct(x["v"].alias("v"))))
    halo = carried(ends, by, {"__halo": F.collect_list("__t")}, window - 1)
    sums = carried(ends, by, {"__s0": F.sum("__s"), "__c0": F.sum("__c")})
    inside = dealt.select("*", F.collect_list(point).over(rows.rowsBetween(-(window - 1), 0)).alias("__own"), F.sum(value).over(rows.rowsBetween(Window.unboundedPreceding, 0)).alias("__s1"), F.count(value).over(rows.rowsBetween(Window.unboundedPreceding, 0)).alias("__c1"))
    near = F.concat(F.flatten("__halo"), "__own")
    near = F.slice(near, F.greatest(F.size(near) - window + 1, F.lit(1)), window)
    values = F.array_sort(F.filter(F.transform(near, lambda x: x["v"].cast("double")), lambda x: x.isNotNull()))  # at most ``window``
    met = inside.join(halo, ["__part", *by]).join(sums, ["__part", *by]).withColumn("__w", values)
    n, total = F.col("__c1") + F.coalesce("__c0", F.lit(0)), F.coalesce("__s1", F.lit(0.0)) + F.coalesce("__s0", F.lit(0.0))
    return met.select(
        *by, step, value, F.get("__w", F.floor((F.size("__w") - 1) / 2).cast("int")).alias("median"), F.try_divide(F.aggregate("__w", F.lit(0.0), lambda a, x: a + x), F.size("__w")).alias("avg"),
        F.try_divide(total, n).alias("global_avg"), F.array_max("__w").alias("max"),
    )


def top_worst_best_k(df: DataFrame, k: int, weight: str | None = None, key: str = "sample_id") -> DataFrame:
    """The k rows with the largest and the k with the smallest weighted squared error, ranked (a report)."""
    w = F.col(weight) if weight else fair_weight("label")
    rows = df.withColumn("werr", F.round(w * (F.col("pred") - F.col("label")) * (F.col("pred") - F.col("label")), 12))
    out = None
    for side, order in (("worst", [F.desc("werr"), F.col(key)]), ("best", [F.asc("werr"), F.col(key)])):
        top = rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("side", F.lit(side))  # over k rows
        out = top if out is None else out.unionByName(top)
    return out.select("side", "rank", key, "label", "pred", "grp", F.abs(F.col("pred") - F.col("label")).alias("abs_err"), "werr")


def top_label_tail(df: DataFrame, cut: float = 0.5, key: str = "sample_id") -> DataFrame:
    return df.filter(F.col("label") > cut).orderBy(F.desc("label"), key)


def srt_trial_order(runs: DataFrame, mode: str = "best", score: str = "score", start: str = "start_time", key: str = "run_id") -> DataFrame:
    """All runs with their position: best first or worst first with missing scores last, or newest first."""
    order = {"best": F.col(score).asc_nulls_last(), "worst": F.col(score).desc_nulls_last(), "recent": F.col(start).desc_nulls_last()}[mode]
    return global_rank(runs, [order, F.col(key)], "position").orderBy("position")


def flt_params(runs: DataFrame, text: str | None = None, params: str = "params", key: str = "run_id") -> DataFrame:
    """Per run the parameters whose key or value holds a text, in any case (all without a text): the run's key, param, value."""
    rows = runs.select(key, F.explode(params).alias("param", "value"))
    if not text:
        return rows
    holds = lambda c: F.contains(F.lower(c), F.lower(F.lit(text)))
    return rows.filter(holds("param") | F.coalesce(holds(F.col("value").cast("string")), F.lit(False)))


def trial_number(name: str = "run_name") -> Column:
    """Number after "trial" in a run's name; null without one."""
    return F.nullif(F.regexp_extract(name, r"trial[_-]?(\d+)", 1), F.lit("")).cast("long")
