"""Queries of the metric, density, weight, calibration and ensemble operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.metric_spec import MetricSpec, evaluate
from quern.operators import classification as C
from quern.operators import dense as X
from quern.operators import density as D
from quern.operators import metrics as M
from quern.operators import reweight as R
from quern.plans.fixtures import view
from quern.plans.registry import registry, rounded

QUERIES, ORACLES, query = registry()

W = "(1/30e0 + label)"
E2 = "(pred - label) * (pred - label)"


def err(g: int, w: str = W, extra: str = "") -> str:
    return f"coalesce(sum(CASE WHEN grp = {g}{extra} THEN {w} * {E2} END) / nullif(sum(CASE WHEN grp = {g}{extra} THEN {w} END), 0), 0)"


FAIR = f"SELECT {{by}} {err(0)} AS f, {err(1)} AS m, avg(abs(pred - label)) * 100 AS mae, 1 - sum({E2}) / nullif(sum(label * label) - sum(label) * sum(label) / count(label), 0) AS r2, count(*) AS n FROM {{source}} {{group}}"


def fair(source: str = "scored", by: str = "") -> str:
    return FAIR.format(by=by + "," if by else "", source=source, group=f"GROUP BY {by}" if by else "")


@query(f"SELECT round((f + m) / 2 + abs(f - m), 9) AS score, round(f, 9) AS err_f, round(m, 9) AS err_m, round(abs(f - m), 9) AS abs_gap, round(f - m, 9) AS gap, round(mae, 9) AS mae_pct, round(r2, 9) AS r2, n, CAST(0 AS BIGINT) AS n_no_group FROM ({fair()})")
def agg_fair_score(spark, sf):
    return rounded(M.agg_fair_score(view(spark, sf, "scored")), 9)


@query(f"SELECT fold, round((f + m) / 2 + abs(f - m), 9) AS score, round(f, 9) AS err_f, round(m, 9) AS err_m, round(abs(f - m), 9) AS abs_gap, round(f - m, 9) AS gap, round(mae, 9) AS mae_pct, n, CAST(0 AS BIGINT) AS n_no_group FROM (SELECT fold, {err(0, W + ' * iw')} AS f, {err(1, W + ' * iw')} AS m, avg(abs(pred - label)) * 100 AS mae, count(*) AS n FROM (SELECT *, 5e-1 + label AS iw FROM scored) GROUP BY fold)")
def agg_is_score(spark, sf):
    return rounded(M.agg_is_score(view(spark, sf, "scored").withColumn("iw", F.lit(0.5) + F.col("label")), "iw", ["fold"]), 9)


@query(f"SELECT round((f + m) / 2 + 2 * (13e-1 * greatest(m - f, 0) + 7e-1 * greatest(f - m, 0)), 9) AS loss, round(abs(f - m), 9) AS abs_gap, round(least(greatest(35e-1 * (m - f) / (abs(m) + abs(f)), -85e-2), 85e-2), 9) AS next_tilt FROM ({fair()})")
def agg_tilted_penalty(spark, sf):
    return rounded(M.agg_tilted_penalty(view(spark, sf, "scored"), 2.0, 0.3), 9)


BIN5 = "CASE WHEN label >= 0 AND label < 1e-1 THEN 0 WHEN label >= 1e-1 AND label < 2e-1 THEN 1 WHEN label >= 2e-1 AND label < 3e-1 THEN 2 WHEN label >= 3e-1 AND label < 4e-1 THEN 3 WHEN label >= 4e-1 AND label < {hi} THEN 4 END"


@query(f"""
    SELECT g.bin, g.grp, round(coalesce(e, 0e0), 9) AS err, coalesce(n, 0) AS n
    FROM (SELECT CAST(b AS INT) AS bin, CAST(x AS INT) AS grp FROM range(5) t(b), range(2) u(x)) g
    LEFT JOIN (SELECT {BIN5.format(hi='101e-2')} AS bin, grp, sum({W} * {E2}) / sum({W}) AS e, count(*) AS n FROM scored GROUP BY 1, 2) f USING (bin, grp)""")
def agg_bin_group_report(spark, sf):
    return rounded(M.agg_bin_group_report(view(spark, sf, "scored")), 9)


@query(f"""
    WITH cells AS (SELECT CAST(least(floor(label * 200), 199) AS INT) AS bin, grp, avg(abs(pred - label)) AS mae, sum({W} * {E2}) AS e, sum({W}) AS w, count(*) AS n FROM scored GROUP BY 1, 2)
    SELECT bin, grp, round(mae, 9) AS mae, round(e / sum(w) OVER (PARTITION BY grp), 9) AS contribution, n FROM cells""")
def agg_bin_diagnostics(spark, sf):
    return rounded(M.agg_bin_diagnostics(view(spark, sf, "scored")), 9)


@query(f"""
    WITH s AS (SELECT *, CASE WHEN fold = 0 THEN 'val' ELSE 'train' END AS split, CASE WHEN label = 1 THEN 4 ELSE {BIN5.format(hi='1e0')} END AS range FROM scored)
    SELECT split, CAST(range AS VARCHAR) AS range, count(*) FILTER (grp = 0) AS n_f, count(*) FILTER (grp = 1) AS n_m, count(*) AS n, round(avg(label), 9) AS mean_label FROM s WHERE range IS NOT NULL GROUP BY split, range
    UNION ALL SELECT split, 'all', count(*) FILTER (grp = 0), count(*) FILTER (grp = 1), count(*), round(avg(label), 9) FROM s GROUP BY split""")
def agg_split_report(spark, sf):
    return rounded(M.agg_split_report(view(spark, sf, "scored").withColumn("split", F.when(F.col("fold") == 0, "val").otherwise("train"))).withColumn("range", F.coalesce(F.col("range").cast("string"), F.lit("all"))), 9)


METHODS = {"cal_a": "pred * 9e-1 + 1e-2", "cal_b": "pred * 8e-1 + 2e-2"}


def calibrated(spark, sf):
    return view(spark, sf, "scored").withColumns({n: F.expr(e) for n, e in METHODS.items()})


CAL = "(SELECT *, pred * 9e-1 + 1e-2 AS cal_a, pred * 8e-1 + 2e-2 AS cal_b FROM scored)"
LONG = f"(SELECT sample_id, label, grp, pred AS raw, 'cal_a' AS method, cal_a AS value FROM {CAL} UNION ALL SELECT sample_id, label, grp, pred, 'cal_b', cal_b FROM {CAL})"


@query(f"SELECT CAST(least(floor(label / (5e-1 / 15)), 14) AS INT) AS bin, grp, method, round(avg(abs(value - label)) - avg(abs(raw - label)), 9) AS delta_mae, count(*) AS n FROM {LONG} WHERE label >= 0 AND label <= 5e-1 GROUP BY 1, 2, 3")
def agg_delta_mae(spark, sf):
    return rounded(M.agg_delta_mae(calibrated(spark, sf), list(METHODS)), 9)


@query("SELECT round(avg(pred), 9) AS mean, round(stddev_pop(pred), 9) AS std, round(median(pred), 9) AS median, round(avg(CAST(pred > 3e-1 AS DOUBLE)), 9) AS share_hi, round(avg(CAST(pred < 1e-2 AS DOUBLE)), 9) AS share_lo FROM scored")
def agg_pred_summary(spark, sf):
    return rounded(M.agg_pred_summary(view(spark, sf, "scored")), 9)


POOLED = "SELECT '{n}' AS part, count(*) AS n, {a} AS f, {b} AS m FROM (SELECT *, 5e-1 + label AS iw FROM scored)"


@query(f"""
    WITH folds AS (SELECT CAST(fold AS VARCHAR) AS part, n, (f + m) / 2 + abs(f - m) AS score, f - m AS gap FROM ({fair(by='fold')})),
    pooled AS ({POOLED.format(n='pooled_a', a=err(0), b=err(1))} UNION ALL {POOLED.format(n='pooled_b', a=err(0, W + ' * iw'), b=err(1, W + ' * iw'))})
    SELECT part, n, round(score, 9) AS score, round(gap, 9) AS gap FROM folds
    UNION ALL SELECT 'mean', CAST(sum(n) AS BIGINT), round(avg(score), 9), round(avg(gap), 9) FROM folds
    UNION ALL SELECT 'std', CAST(sum(n) AS BIGINT), round(stddev_pop(score), 9), round(stddev_pop(gap), 9) FROM folds
    UNION ALL SELECT part, n, round((f + m) / 2 + abs(f - m), 9), round(f - m, 9) FROM pooled""")
def agg_fold_report(spark, sf):
    return rounded(M.agg_fold_report(view(spark, sf, "scored").withColumns({"one": F.lit(1.0), "iw": F.lit(0.5) + F.col("label")}), "one", "iw"), 9)


@query("""
    WITH f AS (SELECT sample_id FROM scored WHERE fold <> 4 UNION ALL SELECT sample_id FROM scored WHERE fold = 1 AND grp = 0), s AS (SELECT sample_id, count(*) AS k FROM f GROUP BY 1),
    b AS (SELECT k, a.sample_id AS known FROM s FULL JOIN (SELECT sample_id FROM scored) a USING (sample_id))
    SELECT count(*) FILTER (k > 1) AS n_repeated, count(*) FILTER (k IS NULL) AS n_missing, count(*) FILTER (known IS NULL) AS n_unknown, bool_and(coalesce(k = 1, false) AND known IS NOT NULL) AS tiles FROM b""")
def agg_fold_tiling_check(spark, sf):
    s = view(spark, sf, "scored")
    folds = s.filter("fold <> 4").select("sample_id").unionByName(s.filter("fold = 1 AND grp = 0").select("sample_id"))
    return M.agg_fold_tiling_check(folds, s)


@query("SELECT metric, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std FROM history GROUP BY metric")
def agg_run_mean_std(spark, sf):
    return rounded(M.agg_run_mean_std(view(spark, sf, "history"), ["metric"], ["value"]))


@query("SELECT entity_id, round(median(label), 9) AS entity_median, count(*) AS n, arg_max(sample_id, struct_pack(l := label, s := sample_id)) AS top_key FROM scored GROUP BY entity_id")
def agg_entity_stats(spark, sf):
    return rounded(M.agg_entity_stats(view(spark, sf, "scored")), 9)


ERROR = lambda: F.abs(F.col("pred") - F.col("label"))
SPECS = [
    MetricSpec("mae", {"s": lambda: F.sum("mae__e"), "n": lambda: F.count("mae__e")}, lambda a: a("s") / a("n"), {"e": ERROR}),
    MetricSpec("rmse", {"s": lambda: F.sum(ERROR() * ERROR()), "n": lambda: F.count("pred")}, lambda a: F.sqrt(a("s") / a("n"))),
    MetricSpec("worst", {"m": lambda: F.max(ERROR())}, lambda a: a("m")),
]


@query("SELECT grp, round(avg(abs(pred - label)), 9) AS mae, round(sqrt(avg((pred - label) * (pred - label))), 9) AS rmse, round(max(abs(pred - label)), 9) AS worst FROM scored GROUP BY grp")
def udf_metric_spec(spark, sf):
    return rounded(evaluate(view(spark, sf, "scored"), SPECS, ["grp"]), 9)


# ---- densities


@query("""
    SELECT g.grp, g.bin, coalesce(n, 0) AS n, round(coalesce(n, 0) * 50 / sum(coalesce(n, 0)) OVER (PARTITION BY g.grp), 9) AS density
    FROM (SELECT grp, CAST(b AS INT) AS bin FROM (SELECT DISTINCT grp FROM scored), range(50) t(b)) g
    LEFT JOIN (SELECT grp, CAST(least(greatest(floor(label * 50), 0), 49) AS INT) AS bin, count(*) AS n FROM scored GROUP BY 1, 2) USING (grp, bin)""")
def agg_histogram(spark, sf):
    return rounded(D.agg_histogram(view(spark, sf, "scored"), "label", 50, by=["grp"]), 9)


def kde_sql(source: str = "scored", by: str = "") -> str:
    b = f"{by}, " if by else ""
    on = f"USING ({by})" if by else "ON true"
    phi = "exp(-5e-1 * power(({}) / 18e-3, 2)) / sqrt(2 * pi())"
    return f"""SELECT {b}i, x, sum(n * ({phi.format('x - y')} + {phi.format('x + y')})) / (any_value(total) * 18e-3) AS density
        FROM (SELECT {b}round(label / 1e-4) * 1e-4 AS y, count(*) AS n FROM {source} GROUP BY ALL) c
        JOIN (SELECT {b}count(*) AS total FROM {source} {'GROUP BY ' + by if by else ''}) t {on},
        (SELECT CAST(k AS INT) AS i, k / 1000e0 AS x FROM range(1001) r(k)) g GROUP BY {b}i, x"""


@query(f"SELECT i, round(x, 6) AS x, round(density, 6) AS density FROM ({kde_sql()})")
def agg_kde(spark, sf):
    return rounded(D.agg_kde(view(spark, sf, "scored")))


@query("""
    WITH h AS (SELECT CAST(b AS INT) AS bin, coalesce(n, 0) * 200e0 / sum(coalesce(n, 0)) OVER () AS density FROM range(200) t(b)
               LEFT JOIN (SELECT CAST(least(greatest(floor(label * 200), 0), 199) AS INT) AS b, count(*) AS n FROM scored GROUP BY 1) USING (b)),
    k AS (SELECT k, exp(-5e-1 * power(k / 200e0 / 2e-2, 2)) / sum(exp(-5e-1 * power(k / 200e0 / 2e-2, 2))) OVER () AS w FROM range(-16, 17) t(k))
    SELECT CAST(bin + k AS INT) AS bin, round(sum(density * w), 9) AS density FROM h, k WHERE bin + k BETWEEN 0 AND 199 GROUP BY 1""")
def agg_smoothed_density(spark, sf):
    return rounded(D.agg_smoothed_density(view(spark, sf, "scored")), 9)


MASS = "SELECT {b} CAST(least(greatest(floor({v} * 200), 0), 199) AS INT) AS bin, CAST(count(*) AS DOUBLE) AS mass FROM {s} GROUP BY ALL"


@query(f"SELECT bin, mass, round(sum(mass) OVER (ORDER BY bin) / sum(mass) OVER (), 9) AS cdf FROM ({MASS.format(b='', v='label', s='scored')})")
def win_cdf(spark, sf):
    return rounded(D.win_cdf(D.binned_mass(view(spark, sf, "scored"), "label", 200)), 9)


def w1_sql(a: str, b: str, by: str = "") -> str:
    c = f"{by}, " if by else ""
    p = f"PARTITION BY {by}" if by else ""
    return f"""SELECT {c}round(sum(d) / 200e0, 9) AS w1 FROM (
        SELECT {c}abs(sum(a) OVER ({p} ORDER BY bin) / sum(a) OVER ({p}) - sum(b) OVER ({p} ORDER BY bin) / sum(b) OVER ({p})) AS d
        FROM (SELECT {c}bin, coalesce(x.mass, 0) AS a, coalesce(y.mass, 0) AS b FROM ({a}) x FULL JOIN ({b}) y USING ({c}bin))) {'GROUP BY ' + by if by else ''}"""


@query(w1_sql(MASS.format(b="", v="pred", s="scored"), "SELECT bin, mass FROM target_pmf"))
def agg_w1(spark, sf):
    return rounded(D.agg_w1(D.binned_mass(view(spark, sf, "scored"), "pred", 200), view(spark, sf, "target_pmf"), 1 / 200), 9)


PMF = """
    SELECT bin, grp, CASE WHEN sum(u) OVER (PARTITION BY grp) > 0 THEN u / sum(u) OVER (PARTITION BY grp) ELSE mass END AS mass, u AS joint_mass FROM (
      SELECT t.bin, g.grp, t.mass, coalesce(CASE WHEN g.grp = 0 THEN n0 ELSE n1 END * t.mass / (n0 + n1), 0) AS u
      FROM target_pmf t CROSS JOIN (SELECT 0 AS grp UNION ALL SELECT 1) g
      LEFT JOIN (SELECT CAST(least(floor(label * 200), 199) AS INT) AS bin, count(*) FILTER (grp = 0) AS n0, count(*) FILTER (grp = 1) AS n1 FROM scored GROUP BY 1) c ON c.bin = t.bin)"""


@query(f"SELECT bin, grp, round(mass, 9) AS mass, round(joint_mass, 9) AS joint_mass FROM ({PMF})")
def agg_group_pmf(spark, sf):
    return rounded(D.agg_group_pmf(view(spark, sf, "scored"), view(spark, sf, "target_pmf")), 9)


@query(f"SELECT round(e, 9) AS expected, round(o, 9) AS observed, round((o - e) * 100, 9) AS delta_points, round(c, 9) AS coverage FROM (SELECT sum(joint_mass) FILTER (grp = 1) / sum(joint_mass) AS e, sum(joint_mass) AS c FROM ({PMF})), (SELECT avg(CAST(grp AS DOUBLE)) AS o FROM scored WHERE fold = 0)")
def agg_marginal_check(spark, sf):
    s = view(spark, sf, "scored")
    return rounded(D.agg_marginal_check(s, view(spark, sf, "target_pmf"), s.filter("fold = 0")), 9)


@query(w1_sql(MASS.format(b="grp, method,", v="value", s=LONG), f"SELECT grp, method, bin, mass FROM ({PMF}), (SELECT 'cal_a' AS method UNION ALL SELECT 'cal_b')", "grp, method"))
def agg_w1_by_group(spark, sf):
    s = calibrated(spark, sf)
    return rounded(D.agg_w1_by_group(s, D.agg_group_pmf(s, view(spark, sf, "target_pmf")).select("grp", "bin", "mass"), list(METHODS)), 9)


# ---- weights

#: Density of the target on the grid: bins 0-99 have mass, so it ends at 99.5/200.
GOAL = """(SELECT i, x, CASE WHEN x > 995e-1 / 200 THEN 0e0 ELSE greatest(200 * (CASE WHEN x <= 5e-1 / 200 THEN (SELECT mass FROM target_pmf WHERE bin = 0)
        ELSE a.mass + (coalesce(b.mass, a.mass) - a.mass) * ((x * 200 - 5e-1) - a.bin) END), 0) END AS density
    FROM (SELECT CAST(k AS INT) AS i, k / 1000e0 AS x FROM range(1001) r(k)) g
    LEFT JOIN target_pmf a ON a.bin = CAST(least(floor(greatest(x * 200 - 5e-1, 0)), 99) AS INT) LEFT JOIN target_pmf b ON b.bin = a.bin + 1)"""


@query(f"SELECT i, round(x, 6) AS x, round(density, 6) AS density FROM {GOAL}")
def rw_target_density(spark, sf):
    return rounded(R.rw_target_density(view(spark, sf, "target_pmf")))


def at(curve: str, extra: str = "") -> str:
    """Value of a grid curve at the label."""
    i = "CAST(least(floor(least(greatest(label * 1000, 0), 1000)), 999) AS INT)"
    t = "least(greatest(label * 1000, 0), 1000)"
    return f"(SELECT p.density + (q.density - p.density) * ({t} - p.i) FROM {curve} p JOIN {curve} q ON q.i = p.i + 1{extra} WHERE p.i = {i})"


WEIGHT = """WITH goal AS MATERIALIZED (SELECT i, density FROM {goal}), kde AS MATERIALIZED ({kde}),
    s AS (SELECT *, least(greatest(label * 1000, 0), 1000) AS t, CAST(least(floor(least(greatest(label * 1000, 0), 1000)), 999) AS INT) AS i FROM scored),
    r AS (SELECT s.*, g.density + (g2.density - g.density) * (t - s.i) AS want, k.density + (k2.density - k.density) * (t - s.i) AS have
          FROM s JOIN goal g ON g.i = s.i JOIN goal g2 ON g2.i = s.i + 1 JOIN kde k ON k.i = s.i {on} JOIN kde k2 ON k2.i = s.i + 1 {on2}),
    w AS (SELECT *, least(greatest({want} / ({have} + 1e-1), 5e-2), 5) AS w FROM r {prior})"""


@query(WEIGHT.format(goal=GOAL, kde=f"SELECT i, density FROM ({kde_sql()})", on="", on2="", want="want", have="have", prior="") + " SELECT sample_id, round(CASE WHEN label > 102e-3 THEN greatest(w, 1) ELSE w END, 5) AS weight FROM w")
def rw_weight(spark, sf):
    s = view(spark, sf, "scored")
    return rounded(R.rw_weight(s, s, view(spark, sf, "target_pmf")).select("sample_id", "weight"), 5)


@query(
    WEIGHT.format(goal=GOAL, kde=f"SELECT grp, i, density FROM ({kde_sql(by='grp')})", on="AND k.grp = s.grp", on2="AND k2.grp = s.grp", want="want / 2", have="have * share", prior="JOIN (SELECT grp, count(*) * 1e0 / (SELECT count(*) FROM scored) AS share FROM scored GROUP BY grp) USING (grp)")
    + " SELECT sample_id, round(CASE WHEN label > 102e-3 THEN greatest(5e-1 + 5e-1 * w, 1) ELSE 5e-1 + 5e-1 * w END, 5) AS weight FROM w"
)
def rw_weight_joint(spark, sf):
    s = view(spark, sf, "scored")
    return rounded(R.rw_weight(s, s, view(spark, sf, "target_pmf"), "joint", 0.5).select("sample_id", "weight"), 5)


@query("""
    WITH c AS (SELECT CAST(least(floor(label * 200), 199) AS INT) AS bin, count(*) AS n FROM scored GROUP BY 1),
    p AS (SELECT bin, n, n * 1e0 / sum(n) OVER () AS p FROM c),
    r AS (SELECT p.bin, n, least(greatest((2e-1 * p + 8e-1 * coalesce(mass, 0)) / p, 1e-1), 10) AS r FROM p LEFT JOIN target_pmf t ON t.bin = p.bin),
    w AS (SELECT bin, r * sum(n) OVER () / sum(r * n) OVER () AS weight FROM r)
    SELECT sample_id, round(weight, 8) AS weight FROM scored JOIN w ON w.bin = CAST(least(floor(label * 200), 199) AS INT)""")
def rw_binned_ratio(spark, sf):
    return rounded(R.rw_binned_ratio(view(spark, sf, "scored"), view(spark, sf, "target_pmf"), 0.8).select("sample_id", "weight"), 8)


@query(f"""
    WITH t AS MATERIALIZED (SELECT i, density AS t FROM {GOAL}), c AS (SELECT 'all' AS scope, i, x, density FROM ({kde_sql()}) UNION ALL SELECT CAST(grp AS VARCHAR), i, x, density FROM ({kde_sql(by='grp')}))
    SELECT scope, i, round(x, 6) AS x, CASE WHEN density > 1e-6 THEN round(t / density, 5) END AS raw, round(t / (density + 1e-1), 5) AS ratio, CASE WHEN t > density THEN 'shortage' ELSE 'surplus' END AS region FROM c JOIN t USING (i)""")
def rw_ratio_curve(spark, sf):
    # a ratio to a density that is nearly 0 is noise: it is left out of the comparison
    curve = R.rw_ratio_curve(view(spark, sf, "scored"), view(spark, sf, "target_pmf"))
    return curve.select("scope", "i", F.round("x", 6).alias("x"), F.when(F.col("density") > 1e-6, F.round("raw", 5)).alias("raw"), F.round("ratio", 5).alias("ratio"), "region")


# ---- calibration

MIDRANK = "(row_number() OVER ({p} ORDER BY {o}) - 5e-1) / count(*) OVER ({p})"


@query(f"SELECT sample_id, round({MIDRANK.format(p='', o='pred, sample_id')}, 9) AS u FROM scored")
def win_midrank(spark, sf):
    return rounded(R.win_midrank(view(spark, sf, "scored"), "pred").select("sample_id", "u"), 9)


def quantile_sql(target: str, by: str = "") -> str:
    b, p = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    return f"""WITH u AS (SELECT sample_id, {b}pred, {MIDRANK.format(p=p, o='pred, sample_id')} AS u FROM scored),
        c AS (SELECT {b}(bin + 1) / 200e0 AS edge, round(sum(mass) OVER ({p} ORDER BY bin) / sum(mass) OVER ({p}), 12) AS cdf FROM ({target})),
        k AS (SELECT {b}cdf, min(edge) AS edge FROM c WHERE cdf > 0 GROUP BY {b}cdf UNION ALL SELECT {'DISTINCT ' + by + ',' if by else ''} 0e0, 0e0 {'FROM (' + target + ')' if by else ''}),
        s AS (SELECT {b}cdf AS lo, edge AS e0, lead(cdf) OVER ({p} ORDER BY cdf) AS hi, lead(edge) OVER ({p} ORDER BY cdf) AS e1 FROM k)
        SELECT sample_id, round(least(greatest(7e-1 * (e0 + (e1 - e0) * (u - lo) / (hi - lo)) + 3e-1 * pred, 0), 1), 6) AS calibrated FROM u JOIN s ON u > lo AND u <= hi {'AND u.' + by + ' = s.' + by if by else ''}"""


@query(quantile_sql("SELECT bin, mass FROM target_pmf"))
def cal_quantile_map(spark, sf):
    return rounded(R.cal_quantile_map(view(spark, sf, "scored"), view(spark, sf, "target_pmf"), 0.7).select("sample_id", "calibrated"))


@query(quantile_sql(f"SELECT grp, bin, mass FROM ({PMF})", "grp"))
def cal_quantile_map_group(spark, sf):
    s = view(spark, sf, "scored")
    return rounded(R.cal_quantile_map_group(s, D.agg_group_pmf(s, view(spark, sf, "target_pmf")), 0.7).select("sample_id", "calibrated"))


#: Isotonic regression by its min-max formula: the largest, over starts up to a cell, of the smallest mean from there to an end
#: from it on. First within runs of 128 cells; pooling what that leaves gives the same as pooling all cells.
MIN_MAX = """n{s} AS MATERIALIZED (SELECT *, row_number() OVER o AS i, sum(w) OVER o AS cw, sum(wy) OVER o AS cy FROM c{s} WINDOW o AS (PARTITION BY grp ORDER BY lo)),
    p{s} AS (SELECT a.grp, a.i AS j, b.i AS k, (b.cy - a.cy + a.wy) / (b.cw - a.cw + a.w) AS m FROM n{s} a JOIN n{s} b ON a.grp = b.grp AND b.i >= a.i{within}),
    l{s} AS (SELECT grp, k, min(m) OVER (PARTITION BY grp, j ORDER BY k DESC) AS m FROM p{s}),
    i{s} AS MATERIALIZED (SELECT n.*, y FROM n{s} n JOIN (SELECT grp, k AS i, max(m) AS y FROM l{s} GROUP BY 1, 2) USING (grp, i))"""
ISOTONIC = f"""WITH c1 AS (SELECT grp, pred AS lo, pred AS hi, sum(1/30e0 + label) AS w, sum((1/30e0 + label) * label) AS wy FROM scored GROUP BY grp, pred), {MIN_MAX.format(s=1, within=" AND b.i // 128 = a.i // 128")},
    c2 AS (SELECT grp, min(lo) AS lo, max(hi) AS hi, sum(w) AS w, sum(wy) AS wy FROM i1 GROUP BY grp, i // 128, y), {MIN_MAX.format(s=2, within="")},
    cal AS (SELECT s.*, least(greatest(y, 0), 1) AS calibrated FROM scored s JOIN i2 ON i2.grp = s.grp AND s.pred BETWEEN i2.lo AND i2.hi)"""


@query(f"{ISOTONIC} SELECT sample_id, round(calibrated, 6) AS calibrated FROM cal")
def cal_isotonic(spark, sf):
    s = view(spark, sf, "scored")
    return rounded(R.cal_isotonic(s, s, by="grp").select("sample_id", "calibrated"))


@query(f"{ISOTONIC} SELECT grp, round(sum({W} * {E2}) / sum({W}), 6) AS err_pred, round(sum({W} * {E2.replace('pred', 'calibrated')}) / sum({W}), 6) AS err_calibrated FROM cal GROUP BY grp")
def cal_isotonic_error(spark, sf):
    s = view(spark, sf, "scored")
    return rounded(R.weighted_errors(R.cal_isotonic(s, s, by="grp"), ["pred", "calibrated"], ["grp"]))


@query("""
    WITH m AS (SELECT grp, sum(w) AS sw, sum(w * pred) AS sx, sum(w * label) AS sy, sum(w * pred * pred) AS sxx, sum(w * pred * label) AS sxy FROM (SELECT *, 1/30e0 + label AS w FROM scored WHERE fold <> 0) GROUP BY grp),
    l AS (SELECT grp, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS s, sw, sx, sy FROM m)
    SELECT sample_id, round(least(greatest((sy - s * sx) / sw + s * pred, 0), 1), 6) AS calibrated FROM scored JOIN l USING (grp)""")
def cal_linear(spark, sf):
    s = view(spark, sf, "scored")
    return rounded(R.cal_linear(s, s.filter("fold <> 0")).select("sample_id", "calibrated"))


@query(f"""
    WITH d AS (SELECT grp, bin, mass / sum(mass) OVER (PARTITION BY grp) AS density FROM ({MASS.format(b='grp,', v='pred', s='scored')})), p AS (SELECT grp, count(*) * 1e0 / (SELECT count(*) FROM scored WHERE fold = 0) AS prior FROM scored WHERE fold = 0 GROUP BY grp)
    SELECT bin, round(sum(density * prior), 9) AS density FROM d JOIN p USING (grp) GROUP BY bin""")
def cal_group_mixture(spark, sf):
    s = view(spark, sf, "scored")
    d = D.win_cdf(D.binned_mass(s, "pred", 200, ["grp"]), by=["grp"])
    total = d.groupBy("grp").agg(F.sum("mass").alias("t"))
    held = s.filter("fold = 0")
    priors = held.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).crossJoin(held.agg(F.count(F.lit(1)).alias("t"))).select("grp", (F.col("n") / F.col("t")).alias("prior"))
    return rounded(R.cal_group_mixture(d.join(total, "grp").select("grp", "bin", (F.col("mass") / F.col("t")).alias("density")), priors), 9)


@query(f"""
    WITH r AS (SELECT method, k / 10e0 AS alpha, label, grp, k / 10e0 * value + (1 - k / 10e0) * raw AS pred FROM {LONG}, range(16) t(k)),
    s AS (SELECT method, alpha, round((f + m) / 2 + abs(f - m), 9) AS score FROM (SELECT method, alpha, {err(0)} AS f, {err(1)} AS m FROM r GROUP BY method, alpha))
    SELECT method, alpha, score, row_number() OVER (PARTITION BY method ORDER BY score, alpha) = 1 AS best FROM s""")
def cal_alpha_sweep(spark, sf):
    return R.cal_alpha_sweep(calibrated(spark, sf), list(METHODS))


@query(f"""
    WITH r AS (SELECT method, label, grp, value AS pred FROM {LONG} UNION ALL SELECT 'raw', label, grp, pred FROM scored),
    s AS (SELECT method, (f + m) / 2 + abs(f - m) AS score, f - m AS gap FROM (SELECT method, {err(0)} AS f, {err(1)} AS m FROM r GROUP BY method))
    SELECT method, round(score, 9) AS score, round(score - (SELECT score FROM s WHERE method = 'raw'), 9) AS delta, round(100 * (score / (SELECT score FROM s WHERE method = 'raw') - 1), 6) AS delta_pct, round(gap, 9) AS gap FROM s""")
def cal_report(spark, sf):
    out = R.cal_report(calibrated(spark, sf), list(METHODS))
    return out.select("method", F.round("score", 9).alias("score"), F.round("delta", 9).alias("delta"), F.round("delta_pct", 6).alias("delta_pct"), F.round("gap", 9).alias("gap"))


@query("SELECT sample_id, round(least(greatest(avg(pred), 0), 1), 9) AS pred FROM preds GROUP BY sample_id")
def ens_mean(spark, sf):
    return rounded(R.ens_mean(view(spark, sf, "preds")), 9)


@query(f"""
    WITH s AS (SELECT model, (f + m) / 2 + abs(f - m) AS score FROM (SELECT model, {err(0)} AS f, {err(1)} AS m FROM preds GROUP BY model))
    SELECT sample_id, round(least(greatest(sum(pred / score) / sum(1 / score), 0), 1), 8) AS pred FROM preds JOIN s USING (model) GROUP BY sample_id""")
def ens_weighted(spark, sf):
    p = view(spark, sf, "preds")
    return rounded(R.ens_weighted(p, M.agg_fair_score(p, ["model"]).select("model", "score")), 8)


# ---- classification


@query("SELECT max(target) + 1 AS n_classes FROM class_scores")
def agg_num_classes(spark, sf):
    return C.agg_num_classes(view(spark, sf, "class_scores"), "target")


PLACE = "(1 + len(list_filter(range(1, 11), lambda i: scores[i] > scores[target + 1] OR (scores[i] = scores[target + 1] AND i < target + 1))))"
TOP = "list_transform(list_sort(list_transform(range(0, 10), lambda i: struct_pack(s := -scores[i + 1], i := i)))[1:{k}], lambda p: p.i)"


@query(f"WITH r AS (SELECT target, {PLACE} AS p FROM class_scores), c AS (SELECT target, avg(CAST(p <= 1 AS DOUBLE)) AS a, avg(CAST(p <= 5 AS DOUBLE)) AS b FROM r GROUP BY target) SELECT 'micro' AS average, round(avg(CAST(p <= 1 AS DOUBLE)), 9) AS acc_1, round(avg(CAST(p <= 5 AS DOUBLE)), 9) AS acc_5 FROM r UNION ALL SELECT 'macro', round(avg(a), 9), round(avg(b), 9) FROM c UNION ALL SELECT CAST(target AS VARCHAR), round(a, 9), round(b, 9) FROM c")
def agg_topk_accuracy(spark, sf):
    d = view(spark, sf, "class_scores")
    one = lambda a: C.agg_topk_accuracy(d, average=a).select(F.lit(a).alias("average"), "acc_1", "acc_5")
    each = C.agg_topk_accuracy(d, average="none").select(F.col("class").cast("string").alias("average"), "acc_1", "acc_5")
    return rounded(one("micro").unionByName(one("macro")).unionByName(each), 9)


@query(f"SELECT round(avg(a), 9) AS recall_1, round(avg(b), 9) AS recall_5 FROM (SELECT target, avg(CAST(p <= 1 AS DOUBLE)) AS a, avg(CAST(p <= 5 AS DOUBLE)) AS b FROM (SELECT target, {PLACE} AS p FROM class_scores) GROUP BY target)")
def agg_topk_recall(spark, sf):
    return rounded(C.agg_topk_recall(view(spark, sf, "class_scores")), 9)


LONG_SCORES = "(SELECT id, CAST(c AS INT) AS class, scores[c + 1] AS score, target, targets FROM class_scores, range(10) t(c))"


@query(f"""
    WITH l AS (SELECT class, CAST(target = class AS INT) AS t, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2e0 AS r FROM {LONG_SCORES}),
    p AS (SELECT class, (sum(r) FILTER (t = 1) - sum(t) * (sum(t) + 1) / 2e0) / (sum(t) * sum(1 - t)) AS a FROM l GROUP BY class HAVING sum(t) > 0 AND sum(1 - t) > 0)
    SELECT round(avg(a), 9) AS auroc, count(*) AS n_classes FROM p""")
def agg_auroc(spark, sf):
    return rounded(C.agg_auroc(view(spark, sf, "class_scores")), 9)


F1 = "2e0 * tp / nullif(2 * tp + fp + fn, 0)"


@query(f"""
    WITH m AS (SELECT {TOP.format(k=1)}[1] AS said, target FROM class_scores),
    a AS (SELECT c.class, count(*) FILTER (said = c.class AND target = c.class) AS tp, count(*) FILTER (said = c.class AND target <> c.class) AS fp, count(*) FILTER (said <> c.class AND target = c.class) AS fn FROM m, (SELECT said AS class FROM m UNION SELECT target FROM m) c GROUP BY c.class),
    b AS (SELECT class, count(*) FILTER (score >= 1e-1 AND list_contains(targets, class)) AS tp, count(*) FILTER (score >= 1e-1 AND NOT list_contains(targets, class)) AS fp, count(*) FILTER (score < 1e-1 AND list_contains(targets, class)) AS fn FROM {LONG_SCORES} GROUP BY class)
    SELECT 'multiclass_macro' AS kind, round(avg(coalesce({F1}, 0)), 9) AS f1 FROM a UNION ALL SELECT 'multiclass_micro', round(2e0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) FROM a
    UNION ALL SELECT 'multilabel_macro', round(avg(coalesce({F1}, 0)), 9) FROM b UNION ALL SELECT 'multilabel_micro', round(2e0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) FROM b""")
def agg_f1(spark, sf):
    d = view(spark, sf, "class_scores")
    out = None
    for kind, target, multi in (("multiclass", "target", False), ("multilabel", "targets", True)):
        for average in ("macro", "micro"):
            one = C.agg_f1(d, "scores", target, multi, average, 0.1).select(F.lit(f"{kind}_{average}").alias("kind"), "f1")
            out = one if out is None else out.unionByName(one)
    return rounded(out, 9)


CURVE = f"(SELECT class, p, tp, seen, positives FROM (SELECT class, score, p, sum(p) OVER (PARTITION BY class ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY class ORDER BY score DESC) AS seen, sum(p) OVER (PARTITION BY class) AS positives FROM (SELECT class, score, count(*) FILTER (list_contains(targets, class)) AS p, count(*) AS n FROM {LONG_SCORES} GROUP BY class, score)) WHERE positives > 0)"


@query(f"SELECT round(avg(ap), 9) AS average_precision, count(*) AS n_classes FROM (SELECT class, sum(p * 1e0 / positives * tp / seen) AS ap FROM {CURVE} GROUP BY class)")
def agg_avg_precision(spark, sf):
    return rounded(C.agg_avg_precision(view(spark, sf, "class_scores")), 9)


@query(f"SELECT round(avg(p), 9) AS map_11pt FROM (SELECT class, k, coalesce(max(tp * 1e0 / seen) FILTER (round(tp * 1e0 / positives, 12) >= round(k / 10e0, 12)), 0) AS p FROM {CURVE}, range(11) t(k) GROUP BY class, k)")
def agg_map_11pt(spark, sf):
    return rounded(C.agg_map_11pt(view(spark, sf, "class_scores")), 9)


HIT = f"CAST(list_has_any({TOP.format(k=5)}, targets) AS DOUBLE)"


@query(f"SELECT round(avg({HIT}), 9) AS any_match, count(*) AS n FROM class_scores WHERE len(targets) > 0")
def agg_any_match(spark, sf):
    return rounded(C.agg_any_match(view(spark, sf, "class_scores")), 9)


@query(f"""
    WITH r AS (SELECT attr_a, attr_b, {HIT} AS hit FROM class_scores)
    SELECT 'all' AS attribute, NULL AS value, round(avg(hit), 9) AS any_match, count(*) AS n FROM r
    UNION ALL SELECT 'attr_a', CAST(attr_a AS VARCHAR), round(avg(hit), 9), count(*) FROM r GROUP BY attr_a
    UNION ALL SELECT 'attr_b', CAST(attr_b AS VARCHAR), round(avg(hit), 9), count(*) FROM r GROUP BY attr_b""")
def agg_any_match_by(spark, sf):
    return rounded(C.agg_any_match_by(view(spark, sf, "class_scores"), ["attr_a", "attr_b"]), 9)


@query("SELECT round(sum(m) / 12, 9) AS macro_mrr FROM (SELECT target, sum(1e0 / len(list_filter(scores, lambda s: s >= scores[target + 1]))) / (count(*) + 1e-6) AS m FROM class_scores GROUP BY target)")
def agg_macro_mrr(spark, sf):
    return rounded(C.agg_macro_mrr(view(spark, sf, "class_scores"), 12), 9)


@query("""
    WITH b AS (SELECT ctype, level, 3e-1 + level / 10e0 AS base FROM (SELECT DISTINCT ctype, level FROM corruption)),
    c AS (SELECT ctype, level, 1 - avg(CAST(correct AS DOUBLE)) AS e FROM corruption GROUP BY ctype, level),
    p AS (SELECT ctype, avg(e) / avg(base) AS r FROM b JOIN c USING (ctype, level) GROUP BY ctype)
    SELECT ctype, round(r, 9) AS relative_error, CAST(0 AS BIGINT) AS n_absent FROM p UNION ALL SELECT NULL, round(avg(r), 9), CAST(0 AS BIGINT) FROM p""")
def agg_corruption_error(spark, sf):
    d = view(spark, sf, "corruption")
    return rounded(C.agg_corruption_error(d, d.select("ctype", "level").distinct().withColumn("error", F.lit(0.3) + F.col("level") / 10)), 9)


# ---- dense maps


AREAS = """(SELECT image_id, class, sum(i) AS both_, sum(p) + sum(g) - sum(i) AS union_, sum(p) AS pred_area, sum(g) AS label_area FROM (
    SELECT image_id, pred AS class, CAST(pred = gt AS INT) AS i, 1 AS p, 0 AS g FROM seg_px WHERE gt <> 255 UNION ALL SELECT image_id, gt, 0, 0, 1 FROM seg_px WHERE gt <> 255) GROUP BY image_id, class)"""


@query(f"SELECT image_id, class, CAST(both_ AS BIGINT) AS \"intersect\", CAST(union_ AS BIGINT) AS \"union\", CAST(pred_area AS BIGINT) AS pred_area, CAST(label_area AS BIGINT) AS label_area FROM {AREAS}")
def agg_seg_areas(spark, sf):
    return X.agg_seg_areas(view(spark, sf, "seg_px"), 5)


@query(f"""
    WITH s AS (SELECT class, sum(both_) * 1e0 AS i, sum(union_) AS u, sum(pred_area) AS p, sum(label_area) AS g FROM {AREAS} GROUP BY class)
    SELECT round(100 * sum(i) / sum(g), 2) AS a_acc, round(100 * avg(i / u), 2) AS m_iou, round(100 * avg(i / g), 2) AS m_acc, round(100 * avg(2 * i / (p + g)), 2) AS m_dice, round(100 * avg(i / p), 2) AS m_precision, round(100 * avg(i / g), 2) AS m_recall, round(100 * avg(2 * (i / p) * (i / g) / (i / p + i / g)), 2) AS m_f FROM s""")
def agg_seg_metrics(spark, sf):
    return X.agg_seg_metrics(X.agg_seg_areas(view(spark, sf, "seg_px"), 5))


@query("""
    WITH r AS (SELECT image_id, gt AS g, least(greatest(pred, 1e-3), 9e0) AS p FROM depth_px WHERE gt > 1e-3 AND gt < 9e0),
    i AS (SELECT image_id, avg(CAST(greatest(g / p, p / g) < 125e-2 AS DOUBLE)) AS a1, avg(CAST(greatest(g / p, p / g) < 15625e-4 AS DOUBLE)) AS a2, avg(CAST(greatest(g / p, p / g) < 1953125e-6 AS DOUBLE)) AS a3,
      avg(abs(g - p) / g) AS abs_rel, avg((g - p) * (g - p) / g) AS sq_rel, sqrt(avg((g - p) * (g - p))) AS rmse, sqrt(avg(power(ln(p) - ln(g), 2))) AS rmse_log, sqrt(var_pop(ln(p) - ln(g))) * 100 AS silog, avg(abs(log10(g) - log10(p))) AS log10, avg(abs(g - p)) AS mae FROM r GROUP BY image_id)
    SELECT round(avg(a1), 6) AS a1, round(avg(a2), 6) AS a2, round(avg(a3), 6) AS a3, round(avg(abs_rel), 6) AS abs_rel, round(avg(sq_rel), 6) AS sq_rel, round(avg(rmse), 6) AS rmse, round(avg(rmse_log), 6) AS rmse_log, round(avg(silog), 5) AS silog, round(avg(log10), 6) AS log10, round(avg(mae), 6) AS mae, count(*) AS n_images FROM i""")
def agg_depth_metrics(spark, sf):
    return rounded(X.agg_depth_metrics(view(spark, sf, "depth_px"), 1e-3, 9.0)).withColumn("silog", F.round("silog", 5))


@query("SELECT image_id, round(regr_slope(gt, pred), 6) AS scale, round(regr_intercept(gt, pred), 6) AS shift, count(*) AS n FROM depth_px WHERE gt > 0 GROUP BY image_id")
def agg_affine_align(spark, sf):
    return rounded(X.agg_affine_align(view(spark, sf, "depth_px")).groupBy("image_id").agg(F.max("scale").alias("scale"), F.max("shift").alias("shift"), F.count(F.lit(1)).alias("n")))


@query("""
    WITH d AS (SELECT run_id AS image_id, event_id AS query_id, CAST(c AS INT) AS class, value / 50e0 - c AS logit, 2e-1 + step % 5 / 10e0 AS cx, 3e-1 AS cy, 1e-1 AS w, 2e-1 AS h FROM history, range(3) t(c)),
    r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY logit DESC, query_id, class) AS rank FROM d)
    SELECT image_id, query_id, class, CAST(rank AS INT) AS rank, round(1 / (1 + exp(-logit)), 9) AS score, round((cx - w / 2) * 640, 6) AS x0, round((cy - h / 2) * 480, 6) AS y0, round((cx + w / 2) * 640, 6) AS x1, round((cy + h / 2) * 480, 6) AS y1 FROM r WHERE rank <= 10""")
def top_detections(spark, sf):
    h = view(spark, sf, "history")
    dets = h.select(F.col("run_id").alias("image_id"), F.col("event_id").alias("query_id"), F.transform(F.array(*(F.lit(float(c)) for c in range(3))), lambda c: F.col("value") / 50 - c).alias("logits"), (F.lit(0.2) + F.col("step") % 5 / 10).alias("cx"), F.lit(0.3).alias("cy"), F.lit(0.1).alias("w"), F.lit(0.2).alias("h"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    out = X.top_detections(dets, 10)
    return out.select("image_id", "query_id", "class", "rank", F.round("score", 9).alias("score"), *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")))
