"""Listings of files, empty ones included, and members of tar archives by byte ranges; read through pyarrow's file systems."""

from __future__ import annotations

import re
import tarfile
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.rank import materialise

#: Bytes of an archive that one task reads, members that start in them as a whole.
RANGE = 64 << 20
#: Bytes of small members that a task hands on together.
TOGETHER = 4 << 20


def open_system(uri: str):
    """The file system of a URI or an absolute path (any characters as they are), the path in it, and what stands before such paths in URIs."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    system, path = fs.FileSystem.from_uri(quote(uri, safe="/:@")) if "://" in uri else (fs.LocalFileSystem(), uri)
    at = uri.find(path)
    return system, path, uri[:at] if at > 0 else ""


def _children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What lies in each folder: path, length (null for folders)."""
    from pyarrow import fs

    for batch in batches:
        for uri in batch.path:
            system, path, prefix = open_system(uri)
            found = system.get_file_info(fs.FileSelector(path, recursive=False))
            yield pd.DataFrame({"path": [prefix + f.path for f in found], "length": pd.array([f.size if f.type == fs.FileType.File else None for f in found], "Int64")})


def _tasks(spark: SparkSession) -> int:
    """Tasks that folders or archives are dealt to: given, since Spark would put names of a few bytes together in one task."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


WILD = re.compile(r"\*|\?|\[[^]/]+\]")


def _pattern(path: str) -> str:
    """A regular expression for a path with wildcards, none of which crosses a slash, and for all that lies below it."""
    parts = zip(WILD.split(path), [*WILD.findall(path), ""], strict=True)
    wild = {"*": "[^/]*", "?": "[^/]", "": ""}
    return "^" + "".join(re.escape(text) + wild.get(w, w.replace("[!", "[^")) for text, w in parts) + "(/.*)?$"


def _rows(spark: SparkSession, found: list[tuple]) -> DataFrame:
    """path, length of what the driver looked at, without Python workers."""
    rows = F.array(*(F.struct(F.lit(path).alias("path"), F.lit(length).cast("long").alias("length")) for path, length in found)) if found else F.lit(None)
    return spark.range(1).select(F.inline(rows.cast("array<struct<path: string, length: bigint>>")))


def list_files(spark: SparkSession, roots: str | list[str]) -> DataFrame:
    """path, length of all files under the roots, in all folders below, empty ones too. A root may be a file, a folder or a
    path with wildcards.

    Folders are listed by tasks, level by level, each level written; only the roots are looked at on the driver. Where roots
    overlap, a file comes once; roots that don't exist hold nothing. One root is neither shuffled nor, without wildcards, matched.
    """
    from pyarrow import fs

    files, folders, patterns, any_wild = [], [], [], False
    roots = [roots] if isinstance(roots, str) else list(roots)
    for root in roots:
        whole = root.rstrip("/")
        wild = WILD.search(whole)
        any_wild |= wild is not None
        base = whole[: wild.start()].rpartition("/")[0] if wild else whole
        system, path, prefix = open_system(base or "/")
        patterns.append(_pattern(prefix + path.rstrip("/") + whole[len(base) :]))
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            files.append((prefix + path, info.size))
        elif info.type == fs.FileType.Directory:
            folders.append((prefix + path, None))
    out = _rows(spark, files)
    level = _rows(spark, folders).select("path").distinct()
    while not level.isEmpty():
        found = materialise(level.repartition(_tasks(spark), "path").mapInPandas(_children, "path string, length long"), "listing")
        out = out.unionByName(found.filter("length IS NOT NULL"))
        level = found.filter("length IS NULL").select("path")
    out = out.distinct() if len(roots) > 1 else out
    return out.filter(F.greatest(F.lit(False), *(F.col("path").rlike(p) for p in patterns))) if any_wild else out


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members of each archive, from its headers alone: shard, name, start, size."""
    for batch in batches:
        for uri in batch.path:
            system, path, _ = open_system(uri)
            rows: list[tuple] = []
            with system.open_input_file(path) as file, tarfile.open(fileobj=file, mode="r:") as tar:
                for m in tar:
                    if m.isreg() and not m.issparse():
                        rows.append((uri, m.name, m.offset_data, m.size))
                    tar.members.clear()  # it keeps all that it has seen
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["shard", "name", "start", "size"])
                        rows = []
            yield pd.DataFrame(rows, columns=["shard", "name", "start", "size"])


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members by their ranges, one after another."""
    name, file, held, size = None, None, [], 0
    for batch in batches:
        for r in batch.itertuples(index=False):
            if r.shard != name:
                if file is not None:
                    file.close()
                system, path, _ = open_system(r.shard)
                name, file = r.shard, system.open_input_file(path)
            held.append((r.shard, r.name, file.read_at(r.size, r.start)))
            size += r.size
            if size >= TOGETHER or len(held) == 10_000:
                yield pd.DataFrame(held, columns=["shard", "name", "content"])
                held, size = [], 0
    yield pd.DataFrame(held, columns=["shard", "name", "content"])
    if file is not None:
        file.close()


def tar_members(spark: SparkSession, glob: str | list[str]) -> DataFrame:
    """shard, name, start, size of the archives' regular members, found by a scan of the headers that skips the contents. Written."""
    shards = list_files(spark, glob).select("path")
    return materialise(shards.repartition(_tasks(spark), "path").mapInPandas(_headers, "shard string, name string, start long, size long"), "tar-members")


def read_members(members: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """shard, name, content of members (of ``tar_members``, or some of them): each range of an archive is a task's, in order.

    A task holds one member's content at a time, or a few megabytes of small ones, so an archive may be of any size.
    """
    dealt = members.withColumn("range", F.floor(F.col("start") / range_bytes))
    ranges = dealt.select("shard", "range").distinct().count()
    tasks = max(1, min(ranges, 100_000))
    placed = dealt.repartition(tasks, "shard", "range").sortWithinPartitions("shard", "start").select("shard", "name", "start", "size")
    return placed.mapInPandas(_contents, "shard string, name string, content binary")
