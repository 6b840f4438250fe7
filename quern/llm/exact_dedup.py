"""Exact deduplication with a persistent digest index, bucketed and sorted by hash.

The index is a table ``(digest, keep_id)``, one row per distinct text seen so far, written into hash buckets that
are sorted by digest. Documents come in batches of rows. A batch's digests (pre-aggregated where the rows are, so a hot
text is a row per task) are sort-merge anti-joined with the index, which removes the texts that earlier batches or earlier
calls brought (the index side needs no shuffle), and what is left is appended. Which row stays is then read from the
index, for every row. Only DataFrame operations run here.

Defined cases. A null text counts as empty; all empty texts are equal. White space runs ``[\\x20\\x09-\\x0D]+``
count as one space; nothing is trimmed, so " a" and "a" differ. Null ids lose against any other id; a group with
null ids only has a null keep_id. Rows that repeat both id and text count in group_size and exactly one of them is
kept; of rows of one id whose equal texts differ in white space, that with the smallest hash. One id may have several
texts: each is judged by itself. An empty batch leaves the index as it is. Other columns of the caller, whatever their
names, are not read, and ``drop_exact_copies`` returns them as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import col, group_minima, keep_rows, materialise, row_key, scratch, spread

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))


class DigestIndex:
    """A digest index at ``path`` (a folder that all executors see), known to the catalog as ``name`` until ``close``.

    ``buckets`` is part of the index and must be the same whenever it is opened. Opening an existing path in a new
    session attaches the same files.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, name: str | None = None):
        self.spark, self.path, self.name = spark, path, name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)  # another session may have appended
        return self.spark.table(self.name)

    def unknown(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` (digest and more) whose digest the index lacks."""
        return batch.join(self.table().hint("merge"), "digest", "left_anti")

    def append(self, batch: DataFrame) -> None:
        """Add the digests of ``batch`` (digest, keep_id; distinct) that the index lacks.

        A batch that is run again after a failure adds nothing twice.
        """
        self.unknown(batch).repartition(self.buckets, "digest").sortWithinPartitions("digest").select("digest", "keep_id").write.insertInto(self.name)

    def compact(self, path: str) -> DigestIndex:
        """The same index at another path with one sorted file per bucket, after many appends."""
        other = DigestIndex(self.spark, path, self.buckets)
        self.table().repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(other.name)
        return other

    def close(self) -> None:
        """Take the name out of the catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def batch_digests(rows: DataFrame, batches: int) -> list[DataFrame]:
    """The rows (own, digest) in ``batches`` ranges of ascending ids, null ids in the last: each as digest, keep_id, distinct."""
    cuts = rows.filter("NOT own.no_id").agg(F.percentile_approx("own.id", F.array(*(F.lit(i / batches) for i in range(1, batches)))).alias("c")).first().c if batches > 1 else None
    number = F.lit(0)
    for c in cuts or ():
        number = number + (F.col("own.no_id") | (F.col("own.id") > c)).cast("int")
    parts = rows.groupBy("digest", number.alias("batch")).agg(F.min("own").alias("first"))
    parts = materialise(parts.select("batch", "digest", F.expr("IF(first.no_id, NULL, first.id)").alias("keep_id")), "batches")
    return [parts.filter(F.col("batch") == b).select("digest", "keep_id") for b in range(len(cuts or ()) + 1)]


def _found(docs: DataFrame, index: DigestIndex | None, id_col: str, text_col: str, batches: int) -> DataFrame:
    """Per row of ``docs``: own (key, with its number among the rows), digest, keep_id, group_size, kept. Written."""
    spark = docs.sparkSession
    own = index or DigestIndex(spark, scratch(spark, "digest-index"))
    i, t = col(id_col), col(text_col)
    rows = materialise(docs.select(*row_key(i, t), digest(t).alias("digest")).withColumn("row", F.monotonically_increasing_id()), "digests")
    for batch in batch_digests(rows, batches):
        own.append(batch)
    rows = rows.select("digest", F.struct("own", "row").alias("at"))
    parts, groups = group_minima(rows, ["digest"], "at")
    known = groups.join(own.table(), "digest")
    stays = F.col("at.row").eqNullSafe(F.col("first.row")) & F.when(F.col("at.own.no_id"), F.col("keep_id").isNull()).otherwise(F.col("at.own.id").eqNullSafe(F.col("keep_id")))
    found = spread(rows, parts, known, ["digest"], "at").select("at.own", "digest", "keep_id", "group_size", stays.alias("kept"))
    found = materialise(found, "found")
    if index is None:
        own.close()
    return found


def exact_groups(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    ``docs`` goes to the index in ``batches`` ranges of ascending ids, so of equal texts the smallest id is indexed
    first. With an index that holds earlier documents, a text indexed before keeps its earlier keep_id, and kept is
    false for the new copy. group_size counts the rows of ``docs``.
    """
    return _found(docs, index, id_col, text_col, batches).select(
        F.expr("IF(own.no_id, NULL, own.id)").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """The documents that stay, with all their columns. Rows that repeat an id with an equal text leave one row."""
    found = _found(docs, index, id_col, text_col, batches)
    repeated = found.groupBy("own").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("own")
    return keep_rows(docs, found.filter("kept").select("own"), repeated, id_col, text_col)
