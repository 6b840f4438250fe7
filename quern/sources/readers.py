"""Sources: sample tables, file inventories, captions, pair lists, archive indexes, class indexes, shards, runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.expr import first_of, no_nan
from quern.sources.files import RANGE, list_files, open_system, read_members, tar_members


def _clean(df: DataFrame, key: str) -> DataFrame:
    """NaN to null in floating columns; rows without a key go."""
    kinds = dict(df.dtypes)
    return df.select(*(no_nan(c).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns)).dropna(subset=[key])


def src_samples_csv(spark: SparkSession, path: str | list[str], schema: str, key: str = "sample_id") -> DataFrame:
    """A sample CSV with a header, typed by ``schema``; bad numbers are null and rows without a key go."""
    return _clean(spark.read.schema(schema).option("header", True).option("nanValue", "nan").csv(path), key)


def src_multi_csv(spark: SparkSession, paths: Sequence[str], schema: str, key: str = "sample_id") -> DataFrame:
    """Several CSV files as one; those that don't exist are left out."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).globStatus(p) is not None and len(p.getFileSystem(conf).globStatus(p)) > 0

    found = [p for p in paths if there(p)]
    return src_samples_csv(spark, found, schema, key) if found else spark.createDataFrame([], schema)


def src_file_inventory(spark: SparkSession, roots: str | list[str], exts: Sequence[str] = ("jpg", "jpeg", "png", "webp")) -> DataFrame:
    """basename, path, length of the files under the roots with such an extension, empty ones too; of equal basenames the first path."""
    named = list_files(spark, roots).withColumn("basename", F.substring_index("path", "/", -1)).filter(F.lower(F.regexp_extract("basename", r"\.([^.]+)$", 1)).isin(*exts))
    return named.groupBy("basename").agg(F.min("path").alias("path"), F.min_by("length", "path").alias("length"))


def src_readability_check(df: DataFrame, inventory: DataFrame, key: str = "filename", probe: Callable[[bytes], bool] | None = None) -> DataFrame:
    """Referenced files that are missing, empty or refused by ``probe`` (bytes -> readable; a file that can't be read, or a probe that fails, is refused too): key, problem."""
    found = df.select(key).distinct().join(inventory.withColumnRenamed("basename", key), key, "left")
    bad = found.select(key, F.when(F.col("path").isNull(), "missing").when(F.col("length") == 0, "empty").alias("problem")).filter("problem IS NOT NULL")
    if probe is None:
        return bad

    def readable(uri: str) -> bool:
        system, path, _ = open_system(uri)
        try:
            with system.open_input_stream(path) as file:
                return bool(probe(file.read()))
        except Exception:  # whatever a decoder raises on a damaged file
            return False

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            refused = batch[key][[not readable(p) for p in batch.path]]
            yield pd.DataFrame({key: refused, "problem": "unreadable"})

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bad.unionByName(found.filter("length > 0").select(key, "path").repartition(parts).mapInPandas(check, f"{key} string, problem string"))


def src_captions_json(spark: SparkSession, path: str, image_dir: str = "", multi_line: bool = True) -> DataFrame:
    """One row per image of nested JSON with its captions in order; images without captions stay. A file is one document, or
    (without ``multi_line``) has one on each line; a caption may stand in another document than its image."""
    doc = spark.read.option("multiLine", multi_line).schema("images array<struct<id: bigint, file_name: string>>, annotations array<struct<id: bigint, image_id: bigint, caption: string>>").json(path)
    images = doc.select(F.explode("images").alias("i")).select("i.id", "i.file_name")
    return captions(images, doc.select(F.explode("annotations").alias("a")).select("a.image_id", "a.caption"), image_dir)


def captions(images: DataFrame, annotations: DataFrame, image_dir: str = "") -> DataFrame:
    """id, image, captions (sorted) from (id, file_name) and (image_id, caption)."""
    lists = annotations.groupBy(F.col("image_id").alias("id")).agg(F.array_sort(F.collect_list("caption")).alias("captions"))
    prefix = image_dir.rstrip("/") + "/" if image_dir else ""
    return images.join(lists, "id", "left").select("id", F.concat(F.lit(prefix), F.col("file_name")).alias("image"), F.coalesce("captions", F.array().cast("array<string>")).alias("captions"))


def src_pair_list(spark: SparkSession, path: str, kind: str = "pair", ext: str = "png") -> DataFrame:
    return pair_list(spark.read.text(path), kind, ext)


def pair_list(lines: DataFrame, kind: str = "pair", ext: str = "png") -> DataFrame:
    """image, target from lines ``image depth _`` (slashes at the ends trimmed), or from one name per line with the mask's extension put in."""
    line = lines.select(F.trim("value").alias("value")).filter("value <> ''")
    if kind == "derive":
        return line.select(F.col("value").alias("image"), F.regexp_replace("value", r"\.[^.]*$", f".{ext}").alias("target")).orderBy("image")
    parts = F.split("value", r"\s+")
    slashless = lambda c: F.trim(c, F.lit("/"))
    return line.select(slashless(parts[0]).alias("image"), slashless(parts[1]).alias("target")).orderBy("image")


def src_archive_index(spark: SparkSession, logs: str, blocklist: Sequence[str] = ()) -> DataFrame:
    """Byte ranges of archive members from one log per archive (the file's stem is the class id)."""
    lines = spark.read.text(logs).select(F.regexp_extract(F.substring_index("_metadata.file_path", "/", -1), r"(?s)^(.+?)(\.[^.]*)?$", 1).alias("class_id"), "value")
    return archive_index(lines, blocklist)


def archive_index(lines: DataFrame, blocklist: Sequence[str] = ()) -> DataFrame:
    """class_index, class_id, start_offset, end_offset, filename from lines ``block N: name`` of (class_id, value); a member ends where the next block begins."""
    parsed = lines.select("class_id", F.regexp_extract("value", r"^block (\d+): (.*)$", 1).alias("b"), F.regexp_extract("value", r"^block (\d+): (.*)$", 2).alias("filename")).filter("b <> ''").withColumn("block", F.col("b").cast("long"))
    ends = parsed.withColumn("next", F.lead("block").over(Window.partitionBy("class_id").orderBy("block")))
    classes = parsed.select("class_id").distinct().withColumn("class_index", F.row_number().over(Window.orderBy("class_id")) - 1)  # one row per archive
    members = ends.filter(F.col("next").isNotNull() & ~F.col("filename").startswith("** Block of NULs") & ~F.col("filename").isin(*blocklist))
    return members.join(classes, "class_id").select("class_index", "class_id", (F.col("block") * 512).alias("start_offset"), (F.col("next") * 512).alias("end_offset"), "filename")


def src_class_index(paths: DataFrame, names: DataFrame, split: str = "train") -> DataFrame:
    """Per path its class id, sample number, class index and name; the test split has no classes."""
    parts = paths.select("path", F.nullif(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.lit("")).alias("class_id"), F.regexp_extract("path", r"_(\d+)\.[^./]*$", 1).cast("long").alias("sample"))
    if split == "test":
        return parts.select("path", F.lit(None).cast("string").alias("class_id"), "sample", F.lit(None).cast("int").alias("class_index"), F.lit(None).cast("string").alias("class_name"))
    index = names.withColumn("class_index", F.row_number().over(Window.orderBy("class_id")) - 1)  # one row per class
    return parts.join(index.select("class_id", "class_index", "class_name"), "class_id", "left").select("path", "class_id", "sample", "class_index", "class_name")


def src_tar_shards(spark: SparkSession, glob: str | list[str], range_bytes: int = RANGE) -> DataFrame:
    """One row per member of the tar shards: shard, name, content. A task reads a range of a shard, found by a scan of its headers."""
    return read_members(tar_members(spark, glob), range_bytes)


def src_runs(spark: SparkSession, path: str, name_contains: str | None = None, limit: int = 500) -> DataFrame:
    return runs(spark.read.parquet(path), name_contains, limit)


def runs(df: DataFrame, name_contains: str | None = None, limit: int = 500, legacy: Sequence[str] = ("best_score", "eval_score", "eval_loss")) -> DataFrame:
    """Runs newest first, at most ``limit`` (the feature), of experiments whose name holds a text; score is the first metric that is there of several names."""
    rows = df.filter(F.col("experiment").contains(name_contains)) if name_contains else df
    return rows.withColumn("score", first_of(F.col("metrics"), legacy)).orderBy(F.desc("start_time"), "run_id").limit(limit)
