"""Histograms, kernel densities, cumulative distributions and distances between them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def agg_histogram(df: DataFrame, col: str, n_bins: int, lo: float = 0.0, hi: float = 1.0, by: Sequence[str] = (), outside: str = "clip") -> DataFrame:
    """Counts and density of even bins over [lo, hi]; values outside go to the end bins or are dropped. Empty bins are there."""
    x = F.col(col)
    rows = df.filter(x.isNotNull() & ~F.isnan(x.cast("double")))
    if outside == "drop":
        rows = rows.filter((x >= lo) & (x <= hi))
    found = rows.withColumn("bin", F.least(F.greatest(F.floor((x - lo) * n_bins / (hi - lo)), F.lit(0)), F.lit(n_bins - 1)).cast("int")).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(n_bins).selectExpr("CAST(id AS INT) AS bin")
    if by:
        grid = found.select(*by).distinct().join(F.broadcast(grid))  # the grid is n_bins rows by definition
    full = grid.join(found, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))  # over bins, not rows
    return full.select(*by, "bin", "n", F.coalesce(F.try_divide(F.col("n") * n_bins, total * (hi - lo)), F.lit(0.0)).alias("density"))


def agg_kde(df: DataFrame, col: str = "label", bw: float = 0.018, grid: int = 1001, reflect: bool = True, by: Sequence[str] = (), prebin: float | None = 1e-4) -> DataFrame:
    """Gaussian kernel density on an even grid over [0, 1], reflected at 0.

    Values are first counted in cells of width ``prebin`` (10,001 at most), so the kernel sum costs cells x grid however
    many rows there are; the error is of the order (prebin/bw)**2. ``prebin=None`` sums over distinct values, which
    costs distinct values x grid and is for small tables.
    """
    y = F.col(col).cast("double")
    value = (F.round(y / prebin) * prebin if prebin else y).alias("y")
    cells = df.filter(y.isNotNull() & ~F.isnan(y)).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    points = df.sparkSession.range(grid).select(F.col("id").cast("int").alias("i"), (F.col("id") / float(grid - 1)).alias("x"))
    phi = lambda z: F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    kernel = phi((F.col("x") - F.col("y")) / bw) + (phi((F.col("x") + F.col("y")) / bw) if reflect else F.lit(0.0))
    total = cells.groupBy(*by).agg(F.sum("n").alias("total")) if by else cells.agg(F.sum("n").alias("total"))
    summed = cells.join(F.broadcast(points)).groupBy(*by, "i", "x").agg(F.sum(F.col("n") * kernel).alias("s"))  # the grid's size is fixed
    joined = summed.join(total, list(by)) if by else summed.join(F.broadcast(total))
    return joined.select(*by, "i", "x", (F.col("s") / (F.col("total") * bw)).alias("density"))


def agg_smoothed_density(df: DataFrame, col: str = "label", bw: float = 0.02, n_bins: int = 200) -> DataFrame:
    """Histogram density convolved with a truncated Gaussian of four bandwidths (kernel normalised, zero outside)."""
    hist = agg_histogram(df, col, n_bins)
    half = int(4 * bw * n_bins)
    weights = [math.exp(-0.5 * (k / n_bins / bw) ** 2) for k in range(-half, half + 1)]
    kernel = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w / sum(weights)).alias("w")) for k, w in zip(range(-half, half + 1), weights, strict=True))))
    moved = hist.select("bin", "density", kernel.alias("c")).select((F.col("bin") + F.col("c.k")).alias("bin"), (F.col("density") * F.col("c.w")).alias("d"))
    return moved.filter((F.col("bin") >= 0) & (F.col("bin") < n_bins)).groupBy("bin").agg(F.sum("d").alias("density"))


def win_cdf(dist: DataFrame, bin_: str = "bin", mass: str = "mass", by: Sequence[str] = ()) -> DataFrame:
    """Cumulative share of the mass, by bin. The input is a binned table, so its window is over bins."""
    run = Window.partitionBy(*by or [F.lit(1)]).orderBy(bin_).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by or [F.lit(1)])
    return dist.withColumn("cdf", F.sum(mass).over(run) / F.sum(mass).over(whole))


def agg_w1(dist_a: DataFrame, dist_b: DataFrame, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Wasserstein-1 distance of two binned distributions on the same bins: the area between their cumulative shares."""
    both = dist_a.select(*by, "bin", F.col("mass").alias("a")).join(dist_b.select(*by, "bin", F.col("mass").alias("b")), [*by, "bin"], "full").na.fill(0.0, ["a", "b"])
    keys = list(by) or [F.lit(1)]
    run, whole = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    gap = both.select(*by, F.abs(F.sum("a").over(run) / F.sum("a").over(whole) - F.sum("b").over(run) / F.sum("b").over(whole)).alias("d"))
    return gap.groupBy(*by).agg((F.sum("d") * width).alias("w1"))


def binned_mass(df: DataFrame, value: str, n_bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts of [0, 1] values per bin, as mass."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by, F.least(F.greatest(F.floor(F.col(value) * n_bins), F.lit(0)), F.lit(n_bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("mass"))


def agg_w1_by_group(df: DataFrame, target: DataFrame, methods: Sequence[str], n_bins: int = 200, grp: str = "grp") -> DataFrame:
    """W1 of each method's predictions to the group's target (grp, bin, mass), per group and method."""
    long = df.filter(F.col(grp).isNotNull()).select(grp, F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("value")) for m in methods))).alias("x")).select(grp, "x.*")
    mass = binned_mass(long, "value", n_bins, [grp, "method"])
    goal = target.join(F.broadcast(df.sparkSession.createDataFrame([(m,) for m in methods], "method string")))
    return agg_w1(mass, goal, 1 / n_bins, [grp, "method"])


def agg_group_pmf(df: DataFrame, target_pmf: DataFrame, n_bins: int = 200) -> DataFrame:
    """P(bin | group) proportional to P_train(group | bin) times the target's mass; the target itself for a group without mass.

    ``target_pmf`` is (bin, mass); bins without training rows give no group any mass.
    """
    cells = df.filter("grp IS NOT NULL").withColumn("bin", F.least(F.floor(F.col("label") * n_bins), F.lit(n_bins - 1)).cast("int")).groupBy("bin").agg(F.count_if(F.col("grp") == 0).alias("n0"), F.count_if(F.col("grp") == 1).alias("n1"))
    joined = target_pmf.join(cells, "bin", "left").select("bin", "mass", F.explode(F.array(F.struct(F.lit(0).alias("grp"), F.col("n0").alias("k")), F.struct(F.lit(1).alias("grp"), F.col("n1").alias("k")))).alias("x"), (F.col("n0") + F.col("n1")).alias("total"))
    raw = joined.select("bin", "x.grp", "mass", F.coalesce(F.try_divide(F.col("x.k") * F.col("mass"), F.col("total")), F.lit(0.0)).alias("u"))
    whole = F.sum("u").over(Window.partitionBy("grp"))
    return raw.select("bin", "grp", F.when(whole > 0, F.col("u") / whole).otherwise(F.col("mass")).alias("mass"), F.col("u").alias("joint_mass"))


def agg_marginal_check(df: DataFrame, target_pmf: DataFrame, observed: DataFrame, n_bins: int = 200) -> DataFrame:
    """Expected share of group 1 under the target against the observed share, in points, and the target mass covered."""
    joint = agg_group_pmf(df, target_pmf, n_bins).groupBy().agg(F.sum(F.when(F.col("grp") == 1, F.col("joint_mass"))).alias("u1"), F.sum("joint_mass").alias("u"))
    seen = observed.filter("grp IS NOT NULL").agg(F.avg(F.col("grp").cast("double")).alias("observed"))
    return joint.join(F.broadcast(seen)).select((F.col("u1") / F.col("u")).alias("expected"), "observed", ((F.col("observed") - F.col("u1") / F.col("u")) * 100).alias("delta_points"), F.col("u").alias("coverage"))


