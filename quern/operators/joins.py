"""Joins, filters, projections and set operations on sample tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.expr import defect_reason, group_flag, order_hash


def flt_remove_list(df: DataFrame, removals: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows whose key is not in the removal list."""
    return df.join(removals.select(key), key, "left_anti")


def flt_scope_gate(clusters: DataFrame, scope: str = "intra", min_cohesion: float = 0.90) -> DataFrame:
    return clusters.filter((F.col("scope") == scope) & (F.col("cohesion") >= min_cohesion))


def prj_group_flag(df: DataFrame, col: str, threshold: float = 0.5) -> DataFrame:
    """``df`` with grp; a missing value stays null (and is counted in no group)."""
    return df.withColumn("grp", group_flag(col, threshold))


def prj_defect_reason(df: DataFrame, blur: float, tint: float, clip: float, saturation: float = 12.0) -> DataFrame:
    return df.withColumn("reason", defect_reason(blur, tint, clip, saturation))


def prj_conditional_mask(runs: DataFrame, rules: dict[str, dict[str, Sequence[str]]], params: str = "params") -> DataFrame:
    """Params without those whose parents don't have a required value; ``rules``: param -> {parent: allowed values}."""
    keep = None
    p = F.col(params)
    for name, parents in rules.items():
        off = None
        for parent, allowed in parents.items():
            bad = ~F.coalesce(p[parent].isin(*allowed), F.lit(False))
            off = bad if off is None else off | bad
        keep = (F.when(off, F.array(F.lit(name))).otherwise(F.array().cast("array<string>")), *(keep or ()))
    hidden = F.concat(*keep) if keep else F.array().cast("array<string>")
    return runs.withColumn(params, F.map_filter(p, lambda k, v: ~F.array_contains(hidden, k)))


def prj_class_subset(df: DataFrame, mapping: Sequence[int], scores: str = "scores") -> DataFrame:
    """Scores of the mapped classes only, in the mapping's order."""
    return df.withColumn(scores, F.transform(F.array(*(F.lit(i) for i in mapping)), lambda i: F.element_at(F.col(scores), i + 1)))


def prj_numeric_axis_detect(long: DataFrame, forced: Sequence[str] = (), max_bad: float = 0.2) -> DataFrame:
    """Kind of each axis of (axis, value): categorical if forced or more than ``max_bad`` of its values are no numbers, else continuous; axes without values are left out."""
    known = long.filter("value IS NOT NULL").groupBy("axis").agg(F.avg(F.expr("CAST(try_cast(value AS DOUBLE) IS NULL AS DOUBLE)")).alias("bad"), F.count(F.lit(1)).alias("n"))
    return known.select("axis", F.when(F.col("axis").isin(*forced) | (F.col("bad") > max_bad), "categorical").otherwise("continuous").alias("kind"), "n")


def join_align_models(preds_long: DataFrame, order_model: str, models: Sequence[str], key: str = "sample_id") -> DataFrame:
    """One row per key of the first model, a column per model; null where a model lacks the key."""
    base = preds_long.filter(F.col("model") == order_model).select(key)
    wide = preds_long.groupBy(key).pivot("model", list(models)).agg(F.first("pred"))
    return base.join(wide, key, "left")


def join_folds_outer(preds_long: DataFrame, folds: Sequence[int], fold: str = "fold", key: str = "sample_id") -> DataFrame:
    """Predictions of the folds side by side, every key that any fold has."""
    wide = preds_long.groupBy(key).pivot(fold, list(folds)).agg(F.first("pred"))
    return wide.select(key, *(F.col(str(f)).alias(f"pred_{f}") for f in folds))


def join_leakage_anti(aug: DataFrame, val: DataFrame, prefix: str = "source", ignore: Sequence[str] = ("source_blend",), key: str = "sample_id", aug_key: str = "aug_id") -> DataFrame:
    """Augmented rows of which no source is a validation key."""
    sources = [c for c in aug.columns if c.startswith(prefix) and c not in ignore]
    long = aug.select(aug_key, F.explode(F.array(*(F.col(c).cast("string") for c in sources))).alias("__s"))
    leaked = long.join(val.select(F.col(key).cast("string").alias("__s")), "__s", "left_semi").select(aug_key).distinct()
    return aug.join(leaked, aug_key, "left_anti")


def join_entity_lookup(df: DataFrame, stats: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Each row with its entity's median and count (0 where unknown); rows without an entity are skipped."""
    return df.filter(F.col(entity).isNotNull()).join(stats.select(entity, "entity_median", F.col("n").alias("entity_n")), entity, "left").withColumn("entity_n", F.coalesce("entity_n", F.lit(0)))


def join_flag_propagate(df: DataFrame, flagged: DataFrame, keep: DataFrame, cut: float, entity: str = "entity_id", key: str = "sample_id") -> DataFrame:
    """Rows of flagged entities with a label below ``cut`` that are not in the keep set."""
    return df.filter(F.col("label") < cut).join(flagged.select(entity), entity, "left_semi").join(keep.select(key), key, "left_anti")


def join_known_attribute(df: DataFrame, known: DataFrame, fallback: DataFrame, threshold: float = 0.5, entity: str = "entity_id", key: str = "sample_id") -> DataFrame:
    """An attribute from the entity's known value, else from a classifier's probability, with where it came from."""
    rows = df.join(known.select(entity, F.col("attribute").alias("__k")), entity, "left").join(fallback.select(key, "probability"), key, "left")
    guess = (F.col("probability") >= threshold).cast("int")
    return rows.select(*df.columns, F.coalesce("__k", guess).alias("attribute"), F.when(F.col("__k").isNotNull(), "lookup").when(guess.isNotNull(), "classifier").otherwise("unknown").alias("provenance"))


def set_union_pool(train: DataFrame, aug: DataFrame, columns: Sequence[str] = ("sample_id", "label", "grp")) -> DataFrame:
    return train.select(*columns).unionByName(aug.select(*columns))


def set_tail_plus_sample(df: DataFrame, cut: float = 0.3, n: int = 16_000, seed: int = 42, key: str = "sample_id") -> DataFrame:
    """All rows from the cut on, and at most ``n`` of the rest by hash order (the sample is the feature)."""
    rest = df.filter(F.col("label") < cut).withColumn("__h", order_hash(key, seed)).orderBy("__h", key).limit(n).drop("__h")
    return df.filter(F.col("label") >= cut).unionByName(rest)


def set_complement_split(df: DataFrame, val: DataFrame, key: str = "sample_id") -> DataFrame:
    return df.join(val.select(key), key, "left_anti")


def set_metric_union(runs: DataFrame, prefixes: Sequence[str], metrics: str = "metrics") -> DataFrame:
    """Distinct metric names with one of the prefixes."""
    names = runs.select(F.explode(F.map_keys(metrics)).alias("metric")).distinct()
    return names.filter(F.col("metric").rlike("^(" + "|".join(prefixes) + ")"))
