"""Dense-map metrics on long pixel tables, and detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def agg_seg_areas(px: DataFrame, n_classes: int, ignore: int = 255, reduce_zero: bool = False) -> DataFrame:
    """Per image and class: intersection, union, predicted and labelled area; ignored pixels count nowhere."""
    gt = F.col("gt")
    if reduce_zero:
        gt = F.when((gt == 0) | (gt == ignore), F.lit(ignore)).otherwise(gt - 1)
    rows = px.select("image_id", gt.alias("gt"), "pred").filter(F.col("gt") != ignore)
    cells = rows.groupBy("image_id", "gt", "pred").agg(F.count(F.lit(1)).alias("n"))
    long = cells.select("image_id", F.explode(F.array(F.struct(F.col("pred").alias("class"), F.lit(1).alias("p"), F.lit(0).alias("g")), F.struct(F.col("gt").alias("class"), F.lit(0).alias("p"), F.lit(1).alias("g")))).alias("x"), "n", (F.col("pred") == F.col("gt")).cast("int").alias("same"))
    areas = long.filter((F.col("x.class") >= 0) & (F.col("x.class") < n_classes)).groupBy("image_id", "x.class").agg(F.sum(F.col("n") * F.col("x.p") * F.col("same")).alias("intersect"), F.sum(F.col("n") * F.col("x.p")).alias("pred_area"), F.sum(F.col("n") * F.col("x.g")).alias("label_area"))
    return areas.select("image_id", "class", "intersect", (F.col("pred_area") + F.col("label_area") - F.col("intersect")).alias("union"), "pred_area", "label_area")


def agg_seg_metrics(areas: DataFrame, beta: float = 1.0) -> DataFrame:
    """Overall accuracy, and means over classes (those that are defined) of IoU, accuracy, dice, precision, recall and F, in percent with two places."""
    per = areas.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("intersect", "union", "pred_area", "label_area")))
    i, u, p, g = (F.col(c) for c in ("intersect", "union", "pred_area", "label_area"))
    precision, recall = F.try_divide(i, p), F.try_divide(i, g)
    f = F.try_divide((1 + beta**2) * precision * recall, beta**2 * precision + recall)
    pct = lambda c: F.round(c * 100, 2)
    return per.agg(
        pct(F.sum(i) / F.sum(g)).alias("a_acc"), pct(F.avg(F.try_divide(i, u))).alias("m_iou"), pct(F.avg(recall)).alias("m_acc"), pct(F.avg(F.try_divide(2 * i, p + g))).alias("m_dice"),
        pct(F.avg(precision)).alias("m_precision"), pct(F.avg(recall)).alias("m_recall"), pct(F.avg(f)).alias("m_f"),
    )


DEPTH = ("a1", "a2", "a3", "abs_rel", "sq_rel", "rmse", "rmse_log", "silog", "log10", "mae")


def agg_depth_metrics(px: DataFrame, lo: float, hi: float, ignored: float = 0.0) -> DataFrame:
    """Ten depth errors per image and their means over images. Ground truth outside (lo, hi) is left out; predictions are held in [lo, hi]."""
    rows = px.filter((F.col("gt") > lo) & (F.col("gt") < hi) & (F.col("gt") != ignored)).select("image_id", "gt", F.least(F.greatest("pred", F.lit(lo)), F.lit(hi)).alias("pred"))
    g, p = F.col("gt"), F.col("pred")
    ratio, d = F.greatest(g / p, p / g), F.log(p) - F.log(g)
    per = rows.groupBy("image_id").agg(
        *(F.avg((ratio < 1.25**k).cast("double")).alias(f"a{k}") for k in (1, 2, 3)),
        F.avg(F.abs(g - p) / g).alias("abs_rel"), F.avg((g - p) * (g - p) / g).alias("sq_rel"), F.sqrt(F.avg((g - p) * (g - p))).alias("rmse"), F.sqrt(F.avg(d * d)).alias("rmse_log"),
        F.coalesce(F.nanvl(F.sqrt(F.greatest(F.avg(d * d) - F.avg(d) * F.avg(d), F.lit(0.0))) * 100, F.lit(0.0)), F.lit(0.0)).alias("silog"),
        F.avg(F.abs(F.log10(g) - F.log10(p))).alias("log10"), F.avg(F.abs(g - p)).alias("mae"),
    )
    return per.agg(*(F.avg(m).alias(m) for m in DEPTH), F.count(F.lit(1)).alias("n_images"))


def agg_affine_align(px: DataFrame) -> DataFrame:
    """Per image the least-squares scale and shift of the prediction to the truth on valid pixels; 1 and 0 where singular."""
    valid = px.filter("gt > 0")
    m = valid.groupBy("image_id").agg(F.regr_slope("gt", "pred").alias("s"), F.regr_intercept("gt", "pred").alias("t"), F.var_pop("pred").alias("v"))
    ok = (F.col("v") > 1e-12) & F.col("s").isNotNull()
    fitted = m.select("image_id", F.when(ok, F.col("s")).otherwise(1.0).alias("scale"), F.when(ok, F.col("t")).otherwise(0.0).alias("shift"))
    return px.join(fitted, "image_id", "left").select(*px.columns, F.coalesce("scale", F.lit(1.0)).alias("scale"), F.coalesce("shift", F.lit(0.0)).alias("shift"), (F.coalesce("scale", F.lit(1.0)) * F.col("pred") + F.coalesce("shift", F.lit(0.0))).alias("aligned"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def top_detections(dets: DataFrame, k: int = 100) -> DataFrame:
    """The k best (query, class) pairs of each image by sigmoid score, boxes as corners in pixels.

    ``dets``: image_id, query_id, logits array, cx, cy, w, h (shares of the image), width, height.
    """
    long = dets.select("image_id", "query_id", F.posexplode("logits").alias("class", "logit"), "cx", "cy", "w", "h", "width", "height")
    best = Window.partitionBy("image_id").orderBy(F.desc("logit"), "query_id", "class")
    rows = long.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return rows.select(
        "image_id", "query_id", "class", "rank", sigmoid(F.col("logit")).alias("score"), ((F.col("cx") - F.col("w") / 2) * F.col("width")).alias("x0"), ((F.col("cy") - F.col("h") / 2) * F.col("height")).alias("y0"),
        ((F.col("cx") + F.col("w") / 2) * F.col("width")).alias("x1"), ((F.col("cy") + F.col("h") / 2) * F.col("height")).alias("y1"),
    )
