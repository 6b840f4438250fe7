"""Helpers shared by the corpus operators: shared scratch tables, batches of text, skew-safe group minima.

Operators rename a caller's columns to c0, c1, ... (``numbered``) before they add their own, and name them again at the
end, so no name of the caller, whatever it is, meets one of theirs.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text that a Python task holds in numpy form at once; a longer text is a chunk of its own.
CHUNK_CHARS = 1_500_000
#: Rows of text that pass between the JVM and Python at once; Spark's own bound counts rows, not bytes, and is 10,000.
BATCH_ROWS = 1_000
#: Parts into which the rows of one key are dealt, so that a hot key is no task's alone.
SALTS = 32


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary folder of this machine, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-quern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """The top-level column of that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame) -> DataFrame:
    """The same columns as c0, c1, ..."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def place(df: DataFrame, name: str) -> str:
    """What ``numbered`` calls the column of that name (in any case, as Spark resolves names)."""
    exact = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not exact:
        raise ValueError(f"there is no column {name}")
    return f"c{exact[0]}"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS``, so that long texts fit in memory; a lower setting stays."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(size)) <= BATCH_ROWS:
        spark.conf.set(size, str(BATCH_ROWS))


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many characters, one row at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _run(fn: Callable, n_keep: int, at: int, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(at).to_pylist()]
        for a, b in chunks(texts):
            part = batch.slice(a, b - a)
            made = fn(texts[a:b])
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(n_keep)), *(pa.array(made[f.name], f.type) for f in list(schema)[n_keep:])], schema=schema)


def map_text(df: DataFrame, text: str, keep: list[str], fn: Callable[[list[str]], dict], made: str) -> DataFrame:
    """Columns ``keep`` and those in the DDL ``made``, which ``fn`` makes from a list of whole texts (null: empty)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    bound_batches(df.sparkSession)
    names = [*keep] if text in keep else [*keep, text]  # places, not names, tell columns apart
    source = df.select(*map(col, names))
    out = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in source.schema.fields[: len(keep)]), *T._parse_datatype_string(made).fields])
    return source.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(partial(_run, fn, len(keep), names.index(text), to_arrow_schema(out)), out)


def salt(of: Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(salts)).cast("int")


def group_minima(rows: DataFrame, key: list[str], of: str) -> tuple[DataFrame, DataFrame]:
    """Smallest ``of`` and number of rows of each key, by salted partial counts.

    Returns (parts, groups): parts has one row per key and salt that occurs, groups one row per key
    (``first``, ``group_size``). Nothing gathers the rows of a key.
    """
    parts = rows.withColumn("__salt", salt(F.col(of))).groupBy(*key, "__salt").agg(F.min(of).alias("__m"), F.count(F.lit(1)).alias("__n"))
    parts = materialise(parts, "parts")
    groups = parts.groupBy(*key).agg(F.min("__m").alias("first"), F.sum("__n").alias("group_size"))
    return parts.drop("__m", "__n"), groups


def spread(rows: DataFrame, parts: DataFrame, groups: DataFrame, key: list[str], of: str) -> DataFrame:
    """Each row with what ``groups`` says of its key: groups go to their salts first, so a hot key meets many tasks."""
    dealt = parts.join(groups, key)
    return rows.withColumn("__salt", salt(F.col(of))).join(dealt, [*key, "__salt"]).drop("__salt")


def row_key(id_col: Column, text: Column) -> list[Column]:
    """What tells a document's row from others: ``own`` (id missing, id, hash of the raw text). Rows with equal keys repeat
    both id and text. Keys order by id, null last, then by hash."""
    i = id_col.cast("long")
    return [F.struct(i.isNull().alias("no_id"), F.coalesce(i, F.lit(0)).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text")).alias("own")]


def keep_rows(docs: DataFrame, stay: DataFrame, repeated: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose key is in ``stay`` (column own, distinct); of rows that repeat a
    key in ``repeated`` (those that occur more than once) one.

    Keys grow with the documents, so they are merged, not broadcast, whatever their number.
    """
    plain = numbered(docs)
    source = plain.select("*", *row_key(F.col(place(docs, id_col)), F.col(place(docs, text_col)))).select(*plain.columns, "own.*")
    again = materialise(stay.join(repeated, "own", "left_semi").select("own.*"), "repeated-keys")
    once = stay.join(repeated, "own", "left_anti").select("own.*")
    keys = ["no_id", "id", "text"]
    kept = source.join(once.hint("merge"), keys, "left_semi").select(*plain.columns)
    if not again.isEmpty():
        # written first, so that a key with many rows is split over tasks, and then meets as one row per task
        some = materialise(source.join(again.hint("merge"), keys, "left_semi"), "repeated-rows")
        kept = kept.unionByName(some.dropDuplicates(keys).select(*plain.columns))
    return kept.toDF(*docs.columns)
