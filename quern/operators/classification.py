"""Classification metrics over (scores array, target) rows. Scores are arrays with one value per class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.rank import running_sums


def place_of(scores: str, target: Column) -> Column:
    """Place (1 = first) of a class when scores are sorted from the largest, ties by class number."""
    own = F.element_at(F.col(scores), target + 1)
    ahead = F.size(F.filter(F.col(scores), lambda s, i: (s > own) | ((s == own) & (i < target))))
    return ahead + 1


def top_classes(scores: str, k: int) -> Column:
    """The k classes with the largest scores, ties by class number."""
    pairs = F.transform(F.col(scores), lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p["i"])


def agg_num_classes(df: DataFrame, label: str = "label") -> DataFrame:
    """Largest label + 1, or the width of one-hot rows."""
    if dict(df.dtypes)[label].startswith("array"):
        return df.agg(F.max(F.size(label)).alias("n_classes"))
    return df.agg((F.max(label) + 1).alias("n_classes"))


def agg_topk_accuracy(df: DataFrame, scores: str = "scores", target: str = "target", ks: Sequence[int] = (1, 5), average: str = "micro") -> DataFrame:
    """Accuracy at each k: over rows (micro), the mean over classes (macro), or per class (none)."""
    rows = df.filter(F.col(target).isNotNull()).select(F.col(target).alias("class"), place_of(scores, F.col(target)).alias("place"))
    aggs = [F.avg((F.col("place") <= k).cast("double")).alias(f"acc_{k}") for k in ks]
    if average == "micro":
        return rows.agg(*aggs)
    per_class = rows.groupBy("class").agg(*aggs, F.count(F.lit(1)).alias("n"))
    return per_class if average == "none" else per_class.agg(*(F.avg(f"acc_{k}").alias(f"acc_{k}") for k in ks))


def agg_topk_recall(df: DataFrame, scores: str = "scores", target: str = "target", ks: Sequence[int] = (1, 5), average: str = "macro") -> DataFrame:
    """Recall at each k; over rows that is the accuracy, over classes the mean of the classes' shares."""
    out = agg_topk_accuracy(df, scores, target, ks, average)
    return out.select(*(F.col(c).alias(c.replace("acc_", "recall_")) for c in out.columns))


def score_rows(df: DataFrame, scores: str, positive: Column) -> DataFrame:
    """(class, score, positive) for each row and class."""
    return df.select(F.posexplode(scores).alias("class", "score"), positive.alias("__t")).select("class", "score", "__t")


def agg_auroc(df: DataFrame, scores: str = "scores", target: str = "target") -> DataFrame:
    """Macro one-versus-rest area under the ROC curve, by rank sums over distinct scores.

    Rows are first counted per class and score; running counts go over range partitions, so a class of any size is
    spread over many tasks.
    """
    long = df.filter(F.col(target).isNotNull()).select(F.posexplode(scores).alias("class", "score"), F.col(target).alias("t"))
    cells = long.groupBy("class", "score").agg(F.count_if(F.col("t") == F.col("class")).alias("p"), F.count_if(F.col("t") != F.col("class")).alias("q"))
    ranked = running_sums(cells, ["class"], [F.col("score")], {"upto": "q"}).withColumn("lower", F.col("upto") - F.col("q"))
    per = ranked.groupBy("class").agg(F.sum(F.col("p") * (F.col("lower") + F.col("q") / 2)).alias("u"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    return per.filter("np > 0 AND nq > 0").agg(F.avg(F.col("u") / (F.col("np") * F.col("nq"))).alias("auroc"), F.count(F.lit(1)).alias("n_classes"))


def agg_f1(df: DataFrame, scores: str = "scores", target: str = "target", multilabel: bool = False, average: str = "macro", threshold: float = 0.5) -> DataFrame:
    """F1 of the largest score (multiclass) or of scores from the threshold on (multilabel, target an array of classes)."""
    if multilabel:
        long = df.select(F.posexplode(scores).alias("class", "s"), F.col(target).alias("t")).select("class", (F.col("s") >= threshold).alias("said"), F.array_contains("t", F.col("class")).alias("true"))
        per = long.groupBy("class").agg(F.count_if(F.col("said") & F.col("true")).alias("tp"), F.count_if(F.col("said") & ~F.col("true")).alias("fp"), F.count_if(~F.col("said") & F.col("true")).alias("fn"))
    else:
        rows = df.select(F.element_at(top_classes(scores, 1), 1).alias("said"), F.col(target).alias("true"))
        hits = rows.select(F.explode(F.array(F.struct(F.col("said").alias("class"), (F.col("said") == F.col("true")).cast("int").alias("tp"), (F.col("said") != F.col("true")).cast("int").alias("fp"), F.lit(0).alias("fn")), F.struct(F.col("true").alias("class"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), (F.col("said") != F.col("true")).cast("int").alias("fn")))).alias("x")).select("x.*")
        per = hits.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    if average == "micro":
        return per.agg((2 * F.sum("tp") / F.nullif(2 * F.sum("tp") + F.sum("fp") + F.sum("fn"), F.lit(0))).alias("f1"))
    return per.agg(F.avg(F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))).alias("f1"))


def pr_curve(df: DataFrame, scores: str, targets: str) -> DataFrame:
    """Per class and distinct score, from the largest: hits and rows so far, and the class's positives."""
    long = df.select(F.posexplode(scores).alias("class", "score"), F.col(targets).alias("t"))
    cells = long.groupBy("class", "score").agg(F.count_if(F.array_contains("t", F.col("class"))).alias("p"), F.count(F.lit(1)).alias("n"))
    curve = running_sums(cells, ["class"], [F.desc("score")], {"tp": "p", "seen": "n"})
    return curve.join(cells.groupBy("class").agg(F.sum("p").alias("positives")), "class").select("class", "score", "p", "tp", "seen", "positives")


def agg_avg_precision(df: DataFrame, scores: str = "scores", targets: str = "targets") -> DataFrame:
    """Macro multilabel average precision: the step integral of each class's precision over recall."""
    curve = pr_curve(df, scores, targets).filter("positives > 0")
    per = curve.groupBy("class").agg(F.sum(F.col("p") / F.col("positives") * F.col("tp") / F.col("seen")).alias("ap"))
    return per.agg(F.avg("ap").alias("average_precision"), F.count(F.lit(1)).alias("n_classes"))


def agg_map_11pt(df: DataFrame, scores: str = "scores", targets: str = "targets", levels: int = 11) -> DataFrame:
    """Mean over classes and recall levels of the largest precision at that recall or more."""
    curve = pr_curve(df, scores, targets).filter("positives > 0").select("class", F.round(F.col("tp") / F.col("positives"), 12).alias("recall"), (F.col("tp") / F.col("seen")).alias("precision"))
    at = curve.withColumn("level", F.explode(F.array(*(F.lit(i) for i in range(levels)))))
    best = at.groupBy("class", "level").agg(F.coalesce(F.max(F.when(F.col("recall") >= F.round(F.col("level") / (levels - 1), 12), F.col("precision"))), F.lit(0.0)).alias("p"))
    return best.groupBy("class").agg(F.avg("p").alias("ap")).agg(F.avg("ap").alias("map_11pt"))


def agg_any_match(df: DataFrame, scores: str = "scores", targets: str = "targets", k: int = 5) -> DataFrame:
    """Share of rows with a target among the k best classes; rows without targets are left out."""
    rows = df.filter(F.size(targets) > 0)
    return rows.agg(F.avg(F.arrays_overlap(top_classes(scores, k), F.col(targets)).cast("double")).alias("any_match"), F.count(F.lit(1)).alias("n"))


def agg_any_match_by(df: DataFrame, attrs: Sequence[str], scores: str = "scores", targets: str = "targets", k: int = 5) -> DataFrame:
    """The same over all rows and per value of each attribute, in one pass (grouping sets)."""
    rows = df.filter(F.size(targets) > 0).select(*(F.col(a).cast("string").alias(a) for a in attrs), F.arrays_overlap(top_classes(scores, k), F.col(targets)).cast("double").alias("hit"))
    sets = [[], *([F.col(a)] for a in attrs)]
    out = rows.groupingSets(sets, *(F.col(a) for a in attrs)).agg(F.avg("hit").alias("any_match"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("__g"))
    last = len(attrs) - 1
    name, value = F.lit("all"), F.lit(None).cast("string")
    for i, a in enumerate(attrs):
        mine = F.col("__g").bitwiseAND(F.lit(1 << (last - i))) == 0
        name, value = F.when(mine, a).otherwise(name), F.when(mine, F.col(a)).otherwise(value)
    return out.select(name.alias("attribute"), value.alias("value"), "any_match", "n")


def agg_macro_mrr(df: DataFrame, n_classes: int, scores: str = "scores", target: str = "target") -> DataFrame:
    """Mean reciprocal of how many scores reach the target's, per class (1e-6 added to its count), over all classes, absent ones too."""
    own = F.element_at(F.col(scores), F.col(target) + 1)
    rows = df.filter(F.col(target).isNotNull()).select(F.col(target).alias("class"), (1 / F.size(F.filter(F.col(scores), lambda s: s >= own))).alias("rr"))
    per = rows.groupBy("class").agg((F.sum("rr") / (F.count(F.lit(1)) + 1e-6)).alias("m"))
    return per.agg((F.sum("m") / n_classes).alias("macro_mrr"))


def agg_corruption_error(df: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per corruption type the mean error over its levels divided by the baseline's; the last row (type null) is their mean.

    ``df`` is (ctype, level, correct), ``baseline`` (ctype, level, error). Cells without rows are left out and counted.
    """
    cells = df.groupBy("ctype", "level").agg((1 - F.avg(F.col("correct").cast("double"))).alias("error"))
    both = baseline.select("ctype", "level", F.col("error").alias("base")).join(cells, ["ctype", "level"], "left")
    per = both.groupBy("ctype").agg((F.avg("error") / F.avg(F.when(F.col("error").isNotNull(), F.col("base")))).alias("relative_error"), F.count_if(F.col("error").isNull()).alias("n_absent"))
    return per.unionByName(per.agg(F.avg("relative_error").alias("relative_error"), F.sum("n_absent").alias("n_absent")).withColumn("ctype", F.lit(None).cast("string")))
