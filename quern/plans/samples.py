"""Queries of the join, filter, set and sampling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import joins as J
from quern.operators import sampling as S
from quern.plans.fixtures import view
from quern.plans.registry import registry, rounded

QUERIES, ORACLES, query = registry()


def h(key: str, *salt: str) -> str:
    return "md5(concat_ws(':', CAST(" + key + " AS VARCHAR), " + ", ".join(salt) + "))"


def u(key: str, *salt: str) -> str:
    return f"(CAST(('0x' || substr({h(key, *salt)}, 1, 8)) AS BIGINT) / 4294967296e0)"


STRATUM = "CAST(grp * 21 + CASE WHEN label < 4e-1 THEN floor(label * 50) ELSE 20 END AS INT)"


@query("SELECT sample_id, label FROM scored WHERE sample_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def flt_remove_list(spark, sf):
    removals = view(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("sample_id"))
    return J.flt_remove_list(view(spark, sf, "scored"), removals).select("sample_id", "label")


@query("SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal = 0 THEN NULL WHEN c_acctbal / 5000e0 >= 5e-1 THEN 1 ELSE 0 END AS grp FROM customer")
def prj_group_flag(spark, sf):
    c = view(spark, sf, "customer")
    return J.prj_group_flag(c.withColumn("g", F.when(F.col("c_acctbal") == 0, float("nan")).otherwise(F.col("c_acctbal") / 5000.0)), "g").select("c_custkey", "c_acctbal", "grp")


DEFECT = {"blur": "l_quantity", "tint": "l_tax * 100", "clip": "CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount * 100 END", "saturation": "l_extendedprice / 1000e0"}


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l_quantity < 5 THEN 'A' WHEN l_tax * 100 > 65e-1 THEN 'B' WHEN CASE WHEN l_linenumber = 1 THEN l_extendedprice / 1000e0 < 12 ELSE l_discount * 100 > 85e-1 END THEN 'C' ELSE '' END AS reason FROM lineitem) GROUP BY reason")
def prj_defect_reason(spark, sf):
    rows = view(spark, sf, "lineitem").select(*(F.expr(e).alias(n) for n, e in DEFECT.items()))
    return J.prj_defect_reason(rows, 5.0, 6.5, 8.5).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT run_id, pooling, CASE WHEN pooling IN ('BUILDING', 'MACHINERY') THEN grid_size END AS grid_size, CASE WHEN pooling = 'BUILDING' THEN lr_ END AS lr FROM (SELECT *, CAST(CAST(floor(lr) AS BIGINT) AS VARCHAR) AS lr_ FROM runs)")
def prj_conditional_mask(spark, sf):
    runs = view(spark, sf, "runs").select("run_id", F.create_map(F.lit("pooling"), F.col("pooling"), F.lit("grid_size"), F.col("grid_size"), F.lit("lr"), F.floor("lr").cast("string")).alias("params"))
    out = J.prj_conditional_mask(runs, {"grid_size": {"pooling": ["BUILDING", "MACHINERY"]}, "lr": {"pooling": ["BUILDING"]}})
    return out.select("run_id", *(F.col("params")[k].alias(k) for k in ("pooling", "grid_size", "lr")))


@query("SELECT id, round(CAST(scores[3] AS DOUBLE), 6) AS s0, round(CAST(scores[8] AS DOUBLE), 6) AS s1, round(CAST(scores[1] AS DOUBLE), 6) AS s2 FROM class_scores")
def prj_class_subset(spark, sf):
    out = J.prj_class_subset(view(spark, sf, "class_scores"), [2, 7, 0])
    return out.select("id", *(F.round(F.col("scores")[i].cast("double"), 6).alias(f"s{i}") for i in range(3)))


@query("SELECT axis, CASE WHEN axis = 'grid_size' OR avg(CAST(try_cast(value AS DOUBLE) IS NULL AS DOUBLE)) > 2e-1 THEN 'categorical' ELSE 'continuous' END AS kind, count(*) AS n FROM axes WHERE value IS NOT NULL GROUP BY axis")
def prj_numeric_axis_detect(spark, sf):
    return J.prj_numeric_axis_detect(view(spark, sf, "axes"), ["grid_size"])


@query("SELECT sample_id, round(a.pred, 9) AS m1, round(b.pred, 9) AS m2, round(c.pred, 9) AS m3 FROM (SELECT * FROM preds WHERE model = 'm1') a LEFT JOIN (SELECT * FROM preds WHERE model = 'm2') b USING (sample_id) LEFT JOIN (SELECT * FROM preds WHERE model = 'm3') c USING (sample_id)")
def join_align_models(spark, sf):
    return rounded(J.join_align_models(view(spark, sf, "preds"), "m1", ["m1", "m2", "m3"]), 9)


@query("SELECT sample_id, " + ", ".join(f"round(max(pred) FILTER (fold = {f}), 9) AS pred_{f}" for f in range(5)) + " FROM (SELECT sample_id, fold, pred FROM scored UNION ALL SELECT sample_id, (fold + 1) % 5, pred / 2e0 FROM scored) GROUP BY sample_id")
def join_folds_outer(spark, sf):
    s = view(spark, sf, "scored").select("sample_id", "fold", "pred")
    both = s.unionByName(s.select("sample_id", ((F.col("fold") + 1) % 5).alias("fold"), (F.col("pred") / 2).alias("pred")))
    return rounded(J.join_folds_outer(both, [0, 1, 2, 3, 4]), 9)


@query("SELECT aug_id, label FROM aug_pool WHERE source_a NOT IN (SELECT sample_id FROM scored WHERE fold = 0) AND source_b NOT IN (SELECT sample_id FROM scored WHERE fold = 0)")
def join_leakage_anti(spark, sf):
    return J.join_leakage_anti(view(spark, sf, "aug_pool"), view(spark, sf, "scored").filter("fold = 0")).select("aug_id", "label")


STATS = "(SELECT entity_id, median(label) AS entity_median, count(*) AS n FROM scored WHERE fold < 2 GROUP BY entity_id)"


@query(f"SELECT sample_id, round(entity_median, 9) AS entity_median, coalesce(n, 0) AS entity_n FROM scored LEFT JOIN {STATS} USING (entity_id)")
def join_entity_lookup(spark, sf):
    from quern.operators.metrics import agg_entity_stats

    s = view(spark, sf, "scored")
    return rounded(J.join_entity_lookup(s, agg_entity_stats(s.filter("fold < 2"))).select("sample_id", "entity_median", "entity_n"), 9)


@query("SELECT sample_id, entity_id FROM scored WHERE label < 4e-1 AND entity_id IN (SELECT entity_id FROM scored WHERE label > 9e-1) AND sample_id NOT IN (SELECT sample_id FROM scored WHERE fold = 2)")
def join_flag_propagate(spark, sf):
    s = view(spark, sf, "scored")
    return J.join_flag_propagate(s, s.filter("label > 0.9D").select("entity_id").distinct(), s.filter("fold = 2"), 0.4).select("sample_id", "entity_id")


@query("SELECT sample_id, coalesce(k, CASE WHEN fold = 1 THEN NULL WHEN pred >= 5e-1 THEN 1 ELSE 0 END) AS attribute, CASE WHEN k IS NOT NULL THEN 'lookup' WHEN fold <> 1 THEN 'classifier' ELSE 'unknown' END AS provenance FROM scored LEFT JOIN (SELECT c_custkey AS entity_id, CAST(c_nationkey % 2 AS INT) AS k FROM customer WHERE c_mktsegment = 'BUILDING') USING (entity_id)")
def join_known_attribute(spark, sf):
    s = view(spark, sf, "scored")
    known = view(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("entity_id"), (F.col("c_nationkey") % 2).cast("int").alias("attribute"))
    return J.join_known_attribute(s, known, s.filter("fold <> 1").select("sample_id", F.col("pred").alias("probability"))).select("sample_id", "attribute", "provenance")


@query("SELECT sample_id, label, grp FROM scored UNION ALL SELECT aug_id, label, grp FROM aug_pool WHERE label >= 5e-1")
def set_union_pool(spark, sf):
    return J.set_union_pool(view(spark, sf, "scored"), view(spark, sf, "aug_pool").filter("label >= 0.5D").withColumnRenamed("aug_id", "sample_id"))


@query(f"(SELECT sample_id, label FROM scored WHERE label >= 8e-1) UNION ALL (SELECT sample_id, label FROM scored WHERE label < 8e-1 ORDER BY {h('sample_id', chr(39) + '42' + chr(39))}, sample_id LIMIT 1000)")
def set_tail_plus_sample(spark, sf):
    return J.set_tail_plus_sample(view(spark, sf, "scored"), 0.8, 1000).select("sample_id", "label")


@query("SELECT sample_id, label FROM scored WHERE sample_id NOT IN (SELECT sample_id FROM scored WHERE fold = 3)")
def set_complement_split(spark, sf):
    s = view(spark, sf, "scored")
    return J.set_complement_split(s, s.filter("fold = 3")).select("sample_id", "label")


@query("SELECT DISTINCT metric FROM history WHERE metric LIKE 'p%' OR metric LIKE 'c%'")
def set_metric_union(spark, sf):
    runs = view(spark, sf, "history").groupBy("run_id", "metric").agg(F.max("value").alias("v")).select("run_id", F.create_map("metric", "v").alias("metrics"))
    return J.set_metric_union(runs, ["p", "c"])


# ---- samples

Q42 = "'42'"


@query(f"SELECT sample_id FROM (SELECT sample_id, row_number() OVER (ORDER BY {h('sample_id', Q42)}, sample_id) AS r, count(*) OVER () AS n FROM scored) WHERE r <= greatest(floor(n * 15e-2), 1)")
def smp_random_holdout(spark, sf):
    return S.smp_random_holdout(view(spark, sf, "scored")).select("sample_id")


@query(f"SELECT sample_id, {STRATUM} AS stratum FROM scored")
def smp_strata(spark, sf):
    return S.smp_strata(view(spark, sf, "scored")).select("sample_id", "stratum")


@query(f"""
    WITH s AS (SELECT sample_id, {STRATUM} AS stratum FROM scored), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {h('sample_id', Q42)}, sample_id) AS r FROM s),
    c AS (SELECT stratum, count(*) AS size FROM s GROUP BY 1), q AS (SELECT stratum, size, round(size * 1000e0 / sum(size) OVER (), 9) AS q FROM c),
    t AS (SELECT stratum, size, floor(q) AS base, row_number() OVER (ORDER BY round(q - floor(q), 9) DESC, stratum) <= 1000 - sum(floor(q)) OVER () AS extra FROM q)
    SELECT sample_id, stratum FROM r JOIN t USING (stratum) WHERE r <= least(base + CAST(extra AS INT), size)""")
def smp_proportional(spark, sf):
    return S.smp_proportional(view(spark, sf, "scored"), 1000).select("sample_id", "stratum")


@query(f"SELECT sample_id, {STRATUM} AS stratum, CAST((row_number() OVER (PARTITION BY {STRATUM} ORDER BY {h('sample_id', Q42)}, sample_id) - 1) % 5 AS INT) AS fold FROM scored")
def smp_kfold(spark, sf):
    return S.smp_kfold(view(spark, sf, "scored"), 5).select("sample_id", "stratum", "fold")


@query(f"SELECT sample_id, row_number() OVER (ORDER BY {h('sample_id', Q42)}, sample_id) <= 2000 AS monitor FROM scored")
def smp_full_data(spark, sf):
    return S.smp_full_data(view(spark, sf, "scored")).select("sample_id", "monitor")


P08 = "least(1e0, power(label * 2, 8e-1))"


@query(f"SELECT sample_id, round({P08}, 9) AS p, round(label * 2 / {P08}, 9) AS residual, round(least(greatest(label * 2, 25e-2), 1), 9) AS strength FROM scored WHERE {P08} >= 999e-3 OR {u('sample_id', Q42, chr(39) + '3' + chr(39))} < {P08}")
def smp_importance(spark, sf):
    rows = view(spark, sf, "scored").withColumn("weight", F.col("label") * 2)
    return rounded(S.smp_importance(rows, rho=0.8, epoch=3).select("sample_id", "p", "residual", "strength"), 9)


@query(f"""
    WITH r AS (SELECT sample_id, row_number() OVER (ORDER BY {h('sample_id', Q42, chr(39) + '1' + chr(39))}, sample_id) - 1 AS p, count(*) OVER () AS t FROM scored),
    a AS (SELECT sample_id, p FROM r UNION ALL SELECT sample_id, t + p FROM r WHERE p < (7 - t % 7) % 7)
    SELECT sample_id, CAST(p % 7 AS INT) AS shard, CAST(floor(p / 7) AS BIGINT) AS pos FROM a""")
def smp_epoch_shards(spark, sf):
    return S.smp_epoch_shards(view(spark, sf, "scored"), 7, epoch=1).select("sample_id", "shard", "pos")


@query(f"""
    WITH r AS (SELECT sample_id, grp, row_number() OVER (PARTITION BY grp ORDER BY {h('sample_id', Q42, chr(39) + '0' + chr(39))}, sample_id) AS r FROM scored),
    c AS (SELECT count(*) FILTER (grp = 0) AS f, count(*) FILTER (grp = 1) AS m FROM scored), n AS (SELECT f, m, least(greatest(floor(32 * f / (f + m) + 5e-1), 1), 31) AS nf FROM c),
    b AS (SELECT nf, 32 - nf AS nm, least(floor(f / nf), floor(m / (32 - nf))) AS b FROM n)
    SELECT sample_id, CAST(floor((r - 1) / CASE WHEN grp = 0 THEN nf ELSE nm END) AS BIGINT) AS batch_id FROM r, b WHERE floor((r - 1) / CASE WHEN grp = 0 THEN nf ELSE nm END) < b""")
def smp_balanced_batches(spark, sf):
    return S.smp_balanced_batches(view(spark, sf, "scored"), 32).select("sample_id", "batch_id")


FEW = "SELECT id, target, CAST(k AS INT) AS \"try\", row_number() OVER (PARTITION BY {p} ORDER BY md5(concat_ws(':', CAST(id AS VARCHAR), CAST(k AS VARCHAR))), id || ':' || k) AS r, count(*) OVER (PARTITION BY {p}) AS n, len(targets) AS labels FROM class_scores, range(2) t(k)"


@query(f"SELECT id, target, \"try\" FROM ({FEW.format(p='target, k')}) WHERE r <= greatest(floor(n * 2e-1), 1)")
def smp_few_shot(spark, sf):
    return S.smp_few_shot(view(spark, sf, "class_scores"), 0.2, 2, "target").select("id", "target", "try")


@query(f"WITH f AS ({FEW.format(p='k')}), s AS (SELECT \"try\", sum(labels) AS a, sum(labels) FILTER (r <= greatest(floor(n * 3e-1), 1)) AS g, any_value(greatest(floor(n * 3e-1), 1)) AS t FROM f GROUP BY \"try\") SELECT id, \"try\" FROM f JOIN s USING (\"try\") WHERE r <= greatest(floor(t * (a * 3e-1) / g + 5e-1), 1)")
def smp_few_shot_multilabel(spark, sf):
    return S.smp_few_shot_multilabel(view(spark, sf, "class_scores"), 0.3, 2, "targets").select("id", "try")


@query(f"SELECT id, CASE WHEN n > 1 AND r <= greatest(floor(n * 1e-1), 1) THEN 'val' ELSE 'train' END AS split FROM (SELECT id, row_number() OVER (PARTITION BY target ORDER BY {h('id', chr(39) + '0' + chr(39))}, id) AS r, count(*) OVER (PARTITION BY target) AS n FROM class_scores)")
def smp_class_split(spark, sf):
    return S.smp_class_split(view(spark, sf, "class_scores"), label="target").select("id", "split")


def mix(name: str, table: str, key: str) -> str:
    return f"SELECT '{name}' AS source, CAST({key} AS VARCHAR) AS id, CAST(floor((row_number() OVER (ORDER BY {h(key, Q42, chr(39) + name + chr(39))}, CAST({key} AS VARCHAR)) - 1) / 16) AS BIGINT) AS batch FROM {table}"


@query(f"""
    WITH r AS ({mix('a', 'scored', 'sample_id')} UNION ALL {mix('b', 'aug_pool', 'aug_id')}),
    f AS (SELECT source, count(*) AS have FROM (SELECT source, batch FROM r GROUP BY 1, 2 HAVING count(*) = 16) GROUP BY source),
    s AS (SELECT CAST(k AS BIGINT) AS slot, CASE WHEN {u('k', Q42)} < 75e-2 THEN 'a' ELSE 'b' END AS source FROM range(CAST((SELECT sum(have) FROM f) AS BIGINT)) t(k)),
    d AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS batch FROM s),
    e AS (SELECT min(slot) AS stop FROM d LEFT JOIN f USING (source) WHERE batch >= coalesce(have, 0))
    SELECT slot, d.source, r.id FROM d JOIN r ON d.source = r.source AND d.batch = r.batch, e WHERE stop IS NULL OR slot < stop""")
def smp_mixture(spark, sf):
    return S.smp_mixture({"a": view(spark, sf, "scored").select(F.col("sample_id").alias("id")), "b": view(spark, sf, "aug_pool").select(F.col("aug_id").alias("id"))}, {"a": 3.0, "b": 1.0}, 16)


