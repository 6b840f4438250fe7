"""Distribution-shift weights, calibration and ensembling."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.expr import clip, fair_weight, fn_interp, grid_lookup, no_nan
from quern.functions.rank import global_rank, group_rank, materialise
from quern.operators.density import agg_kde
from quern.operators.metrics import agg_fair_score

# ---- weights


def rw_target_density(target_pmf: DataFrame, grid: int = 1001, n_bins: int = 200) -> DataFrame:
    """The target's mass as a continuous density on the grid: linear between bin centres, 0 past the last non-empty bin's centre, never negative."""
    curve = target_pmf.groupBy().agg(
        F.transform(F.array_sort(F.collect_list(F.struct("bin", "mass"))), lambda s: s["mass"] * n_bins).alias("d"),
        F.transform(F.array_sort(F.collect_list("bin")), lambda b: (b + 0.5) / n_bins).alias("c"), F.max(F.when(F.col("mass") > 0, F.col("bin"))).alias("last"),
    )
    points = target_pmf.sparkSession.range(grid).select(F.col("id").cast("int").alias("i"), (F.col("id") / float(grid - 1)).alias("x"))
    inside = F.greatest(fn_interp("x", F.col("c"), F.col("d")), F.lit(0.0))
    return points.join(F.broadcast(curve)).select("i", "x", F.when(F.col("x") > (F.col("last") + 0.5) / n_bins, 0.0).otherwise(inside).alias("density"))


def as_row(curve: DataFrame, name: str) -> DataFrame:
    """A density grid (one row per point) as one row with one array."""
    return curve.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "density"))), lambda s: s["density"]).alias(name))


def rw_weight(df: DataFrame, train: DataFrame, target_pmf: DataFrame, target: str = "hc", alpha: float = 1.0, lam: float = 0.10, grid: int = 1001, n_bins: int = 200) -> DataFrame:
    """``df`` with weight: clip(P_t / (P_r + lam), .05, 5), blended with 1 by ``alpha``, and at least 1 above label 0.102 (the floor last).

    ``hc`` compares with the training density of all rows; ``joint`` halves the target and compares with the density of
    the row's group times the group's share. The densities are grids of fixed size, looked up in constant time per row.
    """
    goal = as_row(rw_target_density(target_pmf, grid, n_bins), "goal")
    step = 1 / (grid - 1)
    if target == "joint":
        known = train.filter("grp IN (0, 1)")
        share = known.groupBy().agg(F.avg((F.col("grp") == 0).cast("double")).alias("s0"), F.avg((F.col("grp") == 1).cast("double")).alias("s1"))
        curves = agg_kde(known, by=["grp"], grid=grid)
        both = [as_row(curves.filter(F.col("grp") == g), f"d{g}") for g in (0, 1)]
        rows = df.join(F.broadcast(goal)).join(F.broadcast(both[0])).join(F.broadcast(both[1])).join(F.broadcast(share))
        have = F.when(F.col("grp") == 1, grid_lookup("label", F.col("d1"), 0.0, step) * F.col("s1")).otherwise(grid_lookup("label", F.col("d0"), 0.0, step) * F.col("s0"))
        want = grid_lookup("label", F.col("goal"), 0.0, step) / 2
    else:
        rows = df.join(F.broadcast(goal)).join(F.broadcast(as_row(agg_kde(train, grid=grid), "d0")))
        have, want = grid_lookup("label", F.col("d0"), 0.0, step), grid_lookup("label", F.col("goal"), 0.0, step)
    return rows.select(*df.columns, weight_of(want, have, F.col("label"), alpha, lam).alias("weight"))


def weight_of(want: Column, have: Column, label: Column, alpha: float = 1.0, lam: float = 0.10) -> Column:
    w = clip(want / (have + lam), 0.05, 5.0)
    w = (1 - alpha) + alpha * w if alpha < 1 else w
    return F.when(label > 0.102, F.greatest(w, F.lit(1.0))).otherwise(w)


def rw_binned_ratio(df: DataFrame, target_pmf: DataFrame, alpha: float = 1.0, n_bins: int = 200) -> DataFrame:
    """Older form: ((1 - alpha) P_train + alpha P_target) / P_train per bin, clipped to [.1, 10], with mean 1 over the rows."""
    rows = df.withColumn("bin", F.least(F.floor(F.col("label") * n_bins), F.lit(n_bins - 1)).cast("int"))
    cells = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over bins
    ratio = cells.join(target_pmf, "bin", "left").withColumn("p", F.col("n") / total).select("bin", "n", clip(((1 - alpha) * F.col("p") + alpha * F.coalesce("mass", F.lit(0.0))) / F.col("p"), 0.1, 10.0).alias("r"))
    whole = Window.partitionBy(F.lit(1))
    ratio = ratio.select("bin", (F.col("r") * F.sum("n").over(whole) / F.sum(F.col("r") * F.col("n")).over(whole)).alias("weight"))
    return rows.join(F.broadcast(ratio), "bin").select(*df.columns, "weight")  # n_bins rows


def rw_ratio_curve(train: DataFrame, target_pmf: DataFrame, lam: float = 0.10, grid: int = 1001, n_bins: int = 200) -> DataFrame:
    """Per scope (all, 0, 1) and grid point the raw and the regularised ratio and whether the target is short or in surplus there."""
    goal = rw_target_density(target_pmf, grid, n_bins).select("i", F.col("density").alias("t"))
    curves = agg_kde(train, grid=grid).withColumn("scope", F.lit("all")).select("scope", "i", "x", "density").unionByName(agg_kde(train.filter("grp IS NOT NULL"), by=["grp"], grid=grid).select(F.col("grp").cast("string").alias("scope"), "i", "x", "density"))
    return curves.join(goal, "i").select("scope", "i", "x", "density", F.try_divide("t", "density").alias("raw"), (F.col("t") / (F.col("density") + lam)).alias("ratio"), F.when(F.col("t") > F.col("density"), "shortage").otherwise("surplus").alias("region"))


# ---- calibration


def win_midrank(df: DataFrame, col: str, tie: str = "sample_id", by: Sequence[str] = ()) -> DataFrame:
    """u = (rank - 0.5) / n in the order of the value and the key, within ``by`` or over the whole table, by partial ranks."""
    if by:
        ranked = group_rank(df, list(by), [F.col(col), F.col(tie)], "__r", "__t")
        return ranked.withColumn("u", (F.col("__r") - 0.5) / F.col("__t")).drop("__r", "__t")
    ranked = global_rank(df, [F.col(col), F.col(tie)], "__r")
    total = ranked.groupBy().agg(F.count(F.lit(1)).alias("__t"))
    return ranked.join(F.broadcast(total)).withColumn("u", (F.col("__r") - 0.5) / F.col("__t")).drop("__r", "__t")


def _inverse(target: DataFrame, by: Sequence[str], n_bins: int) -> DataFrame:
    """Segments of the inverse distribution: (__lo, __hi] of the cdf and the edges __e0, __e1 there; of repeated cdf values the first stays."""
    keys = list(by) or [F.lit(1)]
    run, whole = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    cdf = target.select(*by, ((F.col("bin") + 1) / n_bins).alias("edge"), F.round(F.sum("mass").over(run) / F.sum("mass").over(whole), 12).alias("cdf"))
    knots = cdf.groupBy(*by, "cdf").agg(F.min("edge").alias("edge")).filter("cdf > 0")
    before = Window.partitionBy(*keys).orderBy("cdf")
    return knots.select(*by, F.coalesce(F.lag("cdf").over(before), F.lit(0.0)).alias("__lo"), F.col("cdf").alias("__hi"), F.coalesce(F.lag("edge").over(before), F.lit(0.0)).alias("__e0"), F.col("edge").alias("__e1"))


def _mapped(ranked: DataFrame, segments: DataFrame, columns: Sequence[str], by: Sequence[str], strength: float, pred: str) -> DataFrame:
    """u through the inverse: each row meets the one segment that holds it. Without groups the segments are n_bins rows at
    most and are broadcast; with groups Spark joins by group, broadcast or not by their size."""
    s = segments.select(*(F.col(b).alias(f"__{b}") for b in by), "__lo", "__hi", "__e0", "__e1")
    here = (F.col("u") > F.col("__lo")) & (F.col("u") <= F.col("__hi"))
    for b in by:
        here &= F.col(b) == F.col(f"__{b}")
    value = F.col("__e0") + (F.col("__e1") - F.col("__e0")) * (F.col("u") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
    return ranked.join(s if by else F.broadcast(s), here).select(*columns, clip(strength * value + (1 - strength) * F.col(pred), 0, 1).alias("calibrated"))


def cal_quantile_map(df: DataFrame, target_pmf: DataFrame, strength: float = 1.0, pred: str = "pred", key: str = "sample_id", n_bins: int = 200) -> DataFrame:
    """Predictions mapped to the target's distribution by rank, blended with the raw ones, in [0, 1]: column calibrated."""
    return _mapped(win_midrank(df, pred, key), _inverse(target_pmf, (), n_bins), df.columns, (), strength, pred)


def cal_quantile_map_group(df: DataFrame, group_pmf: DataFrame, strength: float = 1.0, pred: str = "pred", key: str = "sample_id", n_bins: int = 200) -> DataFrame:
    """The same within each group, to the group's own target (grp, bin, mass).

    A group is large at scale, so ranks within it come from the whole table's rank.
    """
    real = df.filter("grp IS NOT NULL AND CAST(grp AS STRING) NOT IN ('x', 'nan')")
    return _mapped(win_midrank(real, pred, key, ["grp"]), _inverse(group_pmf, ["grp"], n_bins), df.columns, ["grp"], strength, pred)


#: Blocks of an isotonic fit that lie in one row, and such rows that one task merges.
CHUNK, FAN = 65_536, 16
BLOCKS = "g string, seq long, lo array<double>, hi array<double>, w array<double>, wy array<double>"


def _chunks(group: str, seqs: Iterator[int], blocks: np.ndarray, size: int) -> Iterator[tuple]:
    """Rows of at most ``size`` blocks (lo, hi, w, wy), numbered by ``seqs``."""
    for at in range(0, len(blocks), size):
        part = blocks[at : at + size]
        yield (group, next(seqs), *(part[:, i] for i in range(4)))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["g", "seq", "lo", "hi", "w", "wy"])


def _pooled(chunk: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pool adjacent violators of cells (g, lo, w, wy) in ascending order of group and place: the partition's blocks."""
    stack: list[list[float]] = []  # of one group
    group, seqs = None, itertools.count(TaskContext.get().partitionId() << 32)
    for batch in batches:
        for g, x, w, wy in batch[["g", "lo", "w", "wy"]].itertuples(index=False, name=None):
            if g != group and stack:
                yield _frame([*_chunks(group, seqs, np.array(stack), chunk)])
                stack.clear()
            group = g
            stack.append([x, x, w, wy])
            while len(stack) > 1 and stack[-2][3] * stack[-1][2] > stack[-1][3] * stack[-2][2]:
                _, hi, w2, wy2 = stack.pop()
                stack[-1] = [stack[-1][0], hi, stack[-1][2] + w2, stack[-1][3] + wy2]
    if stack:
        yield _frame([*_chunks(group, seqs, np.array(stack), chunk)])


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Two lists of ascending blocks, the second after the first, as one: what they violate is pooled from their border outwards."""
    e, s = len(left), 0
    if not e or left[-1, 3] * right[0, 2] <= right[0, 3] * left[-1, 2]:
        return np.concatenate([left, right])
    lo, _, w, wy = left[-1]
    hi = lo
    e -= 1
    while True:
        if s < len(right) and wy * right[s, 2] > right[s, 3] * w:
            hi, w, wy, s = right[s, 1], w + right[s, 2], wy + right[s, 3], s + 1
        elif e and left[e - 1, 3] * w > wy * left[e - 1, 2]:
            e -= 1
            lo, w, wy = left[e, 0], w + left[e, 2], wy + left[e, 3]
        else:
            return np.concatenate([left[:e], [[lo, hi, w, wy]], right[s:]])


def _merged(chunk: int, rows: pd.DataFrame) -> pd.DataFrame:
    """Consecutive rows of blocks of a group, merged; what is left keeps the first rows' numbers."""
    rows = rows.sort_values("seq")
    lists = [np.stack([r.lo, r.hi, r.w, r.wy], 1) for r in rows.itertuples()]
    while len(lists) > 1:  # pairwise, up a tree
        lists = [_joined(a, b) for a, b in zip(lists[::2], lists[1::2], strict=False)] + lists[len(lists) & ~1 :]
    return _frame([*_chunks(rows.g.iloc[0], iter(rows.seq.tolist()), lists[0], chunk)])


def isotonic_lists(fit_df: DataFrame, weighted: bool = True, by: str | None = None, pred: str = "pred", label: str = "label", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """The blocks of the weighted isotonic regression in lists: g (group as text), seq (their order), and arrays lo, hi
    (predictions from, to), w, wy (weight, weighted labels). Written.

    Distinct predictions are summed and range-partitioned, and each partition pools its own: a list of ascending blocks. Lists
    merge: only blocks at a border can violate the order, and pooling them, and outwards while needed, gives the same blocks as
    pooling all rows. Each round merges runs of up to ``fan`` lists in which a border violates, in turn aligned to two places, until
    no border does. A list has at most ``chunk`` blocks, so no task holds a group, and one row per list is all that is ordered.
    """
    w = fair_weight(label) if weighted else F.lit(1.0)
    group = F.lit("") if by is None else F.col(by).cast("string")
    rows = fit_df.filter(no_nan(pred).isNotNull() & no_nan(label).isNotNull() & group.isNotNull())
    cells = rows.groupBy(group.alias("g"), F.col(pred).cast("double").alias("lo")).agg(F.sum(w).alias("w"), F.sum(w * F.col(label)).alias("wy"))
    state = materialise(cells.repartitionByRange("g", "lo").sortWithinPartitions("g", "lo").mapInPandas(partial(_pooled, chunk), BLOCKS), "isotonic")
    shift, order = 0, Window.partitionBy("g").orderBy("seq")
    while True:
        ends = state.select("g", "seq", *(F.element_at(c, at).alias(f"{c}{at}") for c in ("w", "wy") for at in (1, -1))).toDF("g", "seq", "w1", "w9", "y1", "y9")
        place = F.row_number().over(order) - 1 + shift
        heads = ends.select("g", "seq", F.floor(place / fan).alias("run"), (place % fan > 0).alias("inside"), (F.lag("y9").over(order) * F.col("w1") > F.col("y1") * F.lag("w9").over(order)).alias("bad"))
        heads = materialise(heads, "isotonic-heads")
        if heads.filter("bad").isEmpty():
            return state
        shift = fan // 2 - shift
        if not heads.filter("bad AND inside").isEmpty():
            runs = heads.join(heads.filter("bad AND inside").select("g", "run").distinct(), ["g", "run"], "left_semi").select("g", "seq", "run")
            merged = state.join(runs, ["g", "seq"]).groupBy("g", "run").applyInPandas(lambda rows: _merged(chunk, rows), BLOCKS)
            state = materialise(state.join(runs, ["g", "seq"], "left_anti").unionByName(merged), "isotonic")


def isotonic_blocks(fit_df: DataFrame, weighted: bool = True, by: str | None = None, pred: str = "pred", label: str = "label") -> DataFrame:
    """The blocks of the weighted isotonic regression: g (group as text), lo, hi (predictions from, to), value."""
    blocks = isotonic_lists(fit_df, weighted, by, pred, label).select("g", F.explode(F.arrays_zip("lo", "hi", "w", "wy")).alias("b"))
    return blocks.select("g", "b.lo", "b.hi", (F.col("b.wy") / F.col("b.w")).alias("value"))


def _on_curve(x: Column, at: Column, after: Column) -> Column:
    """The value at x between the block from ``at`` on and the next one: flat within blocks, linear between them, held at the ends."""
    slope = (after["value"] - at["value"]) / (after["lo"] - at["hi"])
    return F.when(at.isNull(), after["value"]).when(after.isNull() | (x <= at["hi"]), at["value"]).otherwise(at["value"] + slope * (x - at["hi"]))


def _ranged(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (g, x, row) with the blocks around x: columns at and after.

    Rows and blocks are range-partitioned together (a prediction that many rows share is split), each row takes the last block
    before and the first one after it from its partition, and where there is none, from the nearest partition that has one.
    """
    points = blocks.select("g", F.col("lo").alias("x"), F.lit(0).alias("kind"), F.struct("lo", "hi", "value").alias("b"))
    asked = rows.withColumn("kind", F.lit(1)).withColumn("salt", F.monotonically_increasing_id())
    both = asked.unionByName(points.withColumn("salt", F.lit(0).cast("long")), allowMissingColumns=True)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(both.repartitionByRange(parts, "g", "x", "kind", "salt").withColumn("part", F.spark_partition_id()), "ranged")
    up, down = (Window.partitionBy("part", "g").orderBy(*o) for o in ((F.col("x"), F.col("kind")), (F.desc("x"), F.desc("kind"))))
    near = dealt.select("*", F.last("b", True).over(up).alias("at"), F.last("b", True).over(down).alias("after")).filter("kind = 1")
    ends = dealt.groupBy("part", "g").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    before, later = (Window.partitionBy("g").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("part"), F.desc("part")))  # over partitions
    carried = ends.select("part", "g", F.last("high", True).over(before).alias("far_at"), F.last("low", True).over(later).alias("far_after"))
    return near.join(carried, ["part", "g"]).select("x", "row", F.coalesce("at", "far_at").alias("at"), F.coalesce("after", "far_after").alias("after"))


def cal_isotonic(df: DataFrame, fit_df: DataFrame, weighted: bool = True, by: str | None = None, pred: str = "pred", label: str = "label", few: int = 100_000) -> DataFrame:
    """Weighted isotonic regression of label on prediction, linear between blocks, held at the ends and in [0, 1]: column
    calibrated. One fit, or one per value of ``by``; groups that the fit has not (and rows without a group) keep their
    prediction, and rows without a prediction get none.

    Up to ``few`` blocks (5 MB) go to all tasks as one table; more meet the rows by range.
    """
    blocks = materialise(isotonic_blocks(fit_df, weighted, by, pred, label), "isotonic-blocks")
    group, x = F.lit("") if by is None else F.col(by).cast("string"), no_nan(pred).cast("double")
    if blocks.count() <= few:
        return _looked_up(df, blocks, group, x)
    rows = df.select(group.alias("g"), x.alias("x"), F.struct(*(F.col(c) for c in df.columns)).alias("row"))
    found = _ranged(rows.filter("g IS NOT NULL AND x IS NOT NULL"), blocks)
    found = found.select("row.*", clip(F.coalesce(_on_curve(F.col("x"), F.col("at"), F.col("after")), F.col("x")), 0, 1).alias("calibrated"))
    return found.unionByName(rows.filter("g IS NULL OR x IS NULL").select("row.*", clip(F.col("x"), 0, 1).alias("calibrated")))


def _looked_up(df: DataFrame, blocks: DataFrame, group: Column, x: Column) -> DataFrame:
    """The calibrated rows of ``df`` by few blocks, which all tasks hold."""
    curves = {}
    for g, part in blocks.toPandas().sort_values(["g", "lo"]).groupby("g"):
        curves[g] = part[["lo", "hi"]].to_numpy().ravel(), np.repeat(part.value.to_numpy(), 2)
    held = df.sparkSession.sparkContext.broadcast(curves)
    at = len(df.columns)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, raw = batch.column(at).to_pandas(), batch.column(at + 1).to_numpy(zero_copy_only=False).astype(float)
            out = np.clip(raw, 0, 1)
            for g, where in groups.groupby(groups).indices.items():
                if g in held.value:
                    out[where] = np.clip(np.interp(raw[where], *held.value[g]), 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.float64(), from_pandas=True)], names=[*batch.schema.names[:at], "calibrated"])

    rows = df.select("*", group.alias("__g"), x.alias("__x"))
    return rows.mapInArrow(apply, T.StructType([*df.schema.fields, T.StructField("calibrated", T.DoubleType())]))


def weighted_errors(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Weighted mean squared error of each column (before and after a calibration), per group or over all rows."""
    w = fair_weight(label)
    return df.groupBy(*by).agg(*((F.sum(w * (F.col(c) - F.col(label)) * (F.col(c) - F.col(label))) / F.sum(w)).alias(f"err_{c}") for c in columns))


def cal_linear(df: DataFrame, fit_df: DataFrame, by: Sequence[str] = ("grp",), pred: str = "pred", label: str = "label") -> DataFrame:
    """Weighted least-squares line of label on prediction per group, in [0, 1]."""
    w, x, y = fair_weight(label), F.col(pred), F.col(label)
    m = fit_df.groupBy(*by).agg(F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"))
    slope = F.coalesce(F.try_divide(F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")), F.lit(0.0))
    lines = m.select(*by, slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("sw")).alias("base"))
    return df.join(lines, list(by), "left").select(*df.columns, clip(F.col("base") + F.col("slope") * x, 0, 1).alias("calibrated"))


def cal_group_mixture(densities: DataFrame, priors: DataFrame) -> DataFrame:
    """Density of unlabelled rows: the groups' densities (grp, bin, density) mixed by their priors (grp, prior)."""
    return densities.join(priors, "grp").groupBy("bin").agg(F.sum(F.col("density") * F.col("prior")).alias("density"))


def cal_alpha_sweep(df: DataFrame, methods: Sequence[str], alphas: Sequence[float] = tuple(i / 10 for i in range(16)), pred: str = "pred") -> DataFrame:
    """Score of alpha * calibrated + (1 - alpha) * raw for each calibrator and alpha; ``best`` marks each calibrator's best."""
    choice = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.lit(float(a)).alias("alpha"), F.col(m).alias("value")) for m in methods for a in alphas))).alias("c")
    rows = df.select("label", "grp", F.col(pred).alias("__raw"), choice).select("label", "grp", "c.method", "c.alpha", (F.col("c.alpha") * F.col("c.value") + (1 - F.col("c.alpha")) * F.col("__raw")).alias("pred"))
    scores = agg_fair_score(rows, ["method", "alpha"]).select("method", "alpha", F.round("score", 9).alias("score"))
    first = F.row_number().over(Window.partitionBy("method").orderBy("score", "alpha"))
    return scores.withColumn("best", first == 1)


def cal_report(df: DataFrame, methods: Sequence[str], pred: str = "pred") -> DataFrame:
    """Raw and each calibrator: score, change, change in percent, group gap; best first."""
    choice = F.explode(F.array(*(F.struct(F.lit(n).alias("method"), F.col(c).alias("value")) for n, c in [("raw", pred), *((m, m) for m in methods)]))).alias("c")
    scores = agg_fair_score(df.select("label", "grp", choice).select("label", "grp", "c.method", F.col("c.value").alias("pred")), ["method"])
    raw = scores.filter("method = 'raw'").select(F.col("score").alias("__raw"))
    return scores.join(F.broadcast(raw)).select("method", "score", (F.col("score") - F.col("__raw")).alias("delta"), (100 * (F.col("score") - F.col("__raw")) / F.col("__raw")).alias("delta_pct"), "gap").orderBy("score")


# ---- ensembles


def ens_mean(preds_long: DataFrame, key: str = "sample_id") -> DataFrame:
    """Mean of the models' predictions, in [0, 1]."""
    return preds_long.groupBy(key).agg(clip(F.avg("pred"), 0, 1).alias("pred"))


def ens_weighted(preds_long: DataFrame, scores: DataFrame, key: str = "sample_id", model: str = "model") -> DataFrame:
    """Mean weighted by 1 / score (lower is better) of the models that have a prediction, in [0, 1]."""
    rows = preds_long.filter("pred IS NOT NULL").join(scores.select(model, (1 / F.col("score")).alias("__w")), model)
    return rows.groupBy(key).agg(clip(F.sum(F.col("__w") * F.col("pred")) / F.sum("__w"), 0, 1).alias("pred"))


