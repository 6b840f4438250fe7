"""Sinks: predictions, typed result tables, metric logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.expr import clip


def prediction_rows(df: DataFrame, group_marker: str | None = None, key: str = "sample_id", pred: str = "pred") -> DataFrame:
    """Key and label in [0, 1], and a constant group column where a marker is given."""
    out = df.select(key, clip(pred, 0, 1).alias("label"))
    return out.withColumn("gender", F.lit(group_marker)) if group_marker is not None else out


def snk_predictions(df: DataFrame, path: str, group_marker: str | None = None, key: str = "sample_id", pred: str = "pred") -> None:
    prediction_rows(df, group_marker, key, pred).write.mode("overwrite").option("header", True).csv(path)


def result_types(df: DataFrame) -> DataFrame:
    """Columns widened to string, bigint and double; booleans become strings, other types are refused."""
    wide = {"string": "string", "boolean": "string", "tinyint": "bigint", "smallint": "bigint", "int": "bigint", "bigint": "bigint", "float": "double", "double": "double"}
    bad = {c: t for c, t in df.dtypes if t not in wide}
    if bad:
        raise TypeError(f"result columns of other types: {bad}")
    return df.select(*(F.col(c).cast(wide[t]).alias(c) for c, t in df.dtypes))


def result_rows(spark: SparkSession, results: dict) -> DataFrame:
    """A dict of scalars as one row, of equally long lists as rows."""
    lists = {k: v if isinstance(v, (list, tuple)) else [v] for k, v in results.items()}
    return result_types(spark.createDataFrame([*zip(*lists.values(), strict=True)], [*lists]))


def stack_results(*tables: DataFrame) -> DataFrame:
    """Typed results one below the other; columns that a table lacks are null."""
    out = result_types(tables[0])
    for t in tables[1:]:
        out = out.unionByName(result_types(t), allowMissingColumns=True)
    return out


def snk_results(spark: SparkSession, results: DataFrame | dict, path: str, fmt: str | None = None) -> None:
    """Write typed results as CSV or JSON lines, by format or by the path's ending."""
    df = result_types(results) if isinstance(results, DataFrame) else result_rows(spark, results)
    if (fmt or path.rsplit(".", 1)[-1]) == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").json(path)


def snk_metric_log(df: DataFrame, path: str, metric: str = "metric", value: str = "value") -> None:
    """Append one JSON line {metric: value} per row."""
    df.select(F.to_json(F.create_map(F.col(metric), F.col(value))).alias("value")).write.mode("append").text(path)
