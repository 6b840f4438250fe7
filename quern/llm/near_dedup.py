"""Near-duplicates by ProbMinHash sketches, banding and exact verification.

A text's shingles are its distinct runs of five words (lower case, split at white space), all of weight 1: a link is
defined by sets, and weights by counts would differ between copies of which only one repeats lines. Every shingle sends
arrivals of an exponential process whose rate is its weight; each arrival falls on one of the sketch's slots, and a slot
keeps the shingle that arrived first. Arrivals of a text are made in rounds for all shingles together, and a shingle
stops as soon as its next arrival is later than the latest first arrival of any slot (early termination). Two sketches
agree in a slot with the probability Jaccard similarity of the two texts; for equal weights that is the Jaccard
similarity of their shingle sets.

Four slots make a band; documents that share a band of the 28 are candidates. Candidates are verified exactly: Jaccard
similarity of the shingle sets, 0.8 or more. A pair at 0.8 is missed with probability (1 - 0.8**4)**28, 4e-7.

How the work stays in proportion: equal texts (same word sequence) are one row from the start, by salted counts. In a
small bucket (``pairs_up_to`` rows) all pairs are candidates. In a larger one every row is paired with the bucket's
smallest number, its pivot, and those pairs are verified first. Most rows of a hot group are then in one class. Rows that
share a pivot and are still in different classes are compared exactly, block against block: each row outside the
pivot's largest class meets all rows of the pivot, and only links leave the task. So no candidate is dropped, a hot
group costs one pair per row and pivot, and no task or shuffle holds more than blocks of bounded size. Classes are the
connected components of the verified links.

Nodes are texts, not ids: each different word sequence has a number of its own, so an id with several texts is judged
text by text, and rows without an id take part.

Defined cases. A null text counts as empty; texts without words are equal to each other and to nothing else. A text of
one to four words has one shingle, all of it. Null ids never become a class's id unless all of its ids are null.
Repeated rows are copies of each other; ``drop_near_copies`` leaves one row of each class, whatever repeats. Other
columns of the caller, whatever their names, are not read and are returned as they are. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import col, group_minima, keep_rows, map_text, materialise, row_key, spread

WORDS, BANDS, ROWS = 5, 28, 4
SLOTS = BANDS * ROWS
_U = np.uint64


class WordHashes(dict):
    """64-bit hashes of the words met; emptied when it grows too large."""

    def __missing__(self, word: str) -> int:
        got = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 500_000:
            self.clear()
        if len(word) <= 60:
            self[word] = got
        return got


_HASHES = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: str) -> np.ndarray:
    return np.array([*map(_HASHES.__getitem__, text.lower().split())], np.uint64)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of five words, in order."""
    n = min(WORDS, len(words))
    if not n:
        return words
    h = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        h = mix(h + words[i : len(words) - n + 1 + i] + _U(0x9E3779B97F4A7C15))
    return h


def sketches(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, docs: int, slots: int = SLOTS) -> np.ndarray:
    """ProbMinHash of ``docs`` weighted sets at once: the shingle that arrives first in each slot."""
    first = np.full(docs * slots, np.inf)
    owner = np.zeros(docs * slots, np.uint64)
    time = np.zeros(len(elements))
    step = 0
    while len(elements):
        step += 1
        r = mix(elements + _U(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((r >> _U(11)).astype(np.float64) + 1) * 2.0**-53) / weights
        at = doc * slots + (mix(r) % _U(slots)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        owner[at[won]] = elements[won]
        live = time <= first.reshape(docs, slots).max(1)[doc]
        elements, weights, doc, time = elements[live], weights[live], doc[live], time[live]
    return owner.reshape(docs, slots)


def bands(owner: np.ndarray) -> np.ndarray:
    """A key for each band of a sketch."""
    h = np.zeros((len(owner), BANDS), np.uint64)
    for i in range(ROWS):
        h = mix(h + owner.reshape(-1, BANDS, ROWS)[:, :, i] + _U(i + 1))
    return h.view(np.int64)


def sketch_texts(texts: list[str]) -> dict:
    """A digest of the word sequence, the number of distinct shingles and the band keys of each text."""
    digests, sizes, parts = [], [], []
    for t in texts:
        words = word_hashes(t)
        digests.append(xxhash.xxh3_128_digest(words.tobytes()))
        parts.append(np.unique(shingles(words)))
        sizes.append(len(parts[-1]))
    doc = np.repeat(np.arange(len(texts)), sizes)
    keys = bands(sketches(np.concatenate(parts), np.ones(len(doc)), doc, len(texts)))
    return {"digest": digests, "n_shingles": sizes, "bands": [k if n else [] for k, n in zip(keys, sizes, strict=True)]}


def shingle_sets(texts: list[str]) -> dict:
    return {"shingles": [np.unique(shingles(word_hashes(t))).view(np.int64) for t in texts]}


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of ``pairs`` (a, b, distinct nodes) those whose shingle sets have that Jaccard similarity, with it; and the sets of all
    nodes in them. ``texts``: node, text."""
    pairs = materialise(pairs, "candidates")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = materialise(map_text(texts(needed), "text", ["node"], shingle_sets, "shingles array<long>"), "shingles")
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = with_a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = both.select("a", "b", F.size("x").alias("m"), F.size("y").alias("n"), F.size(F.array_intersect("x", "y")).alias("c"))
    found = common.select("a", "b", (F.col("c") / (F.col("m") + F.col("n") - F.col("c"))).alias("similarity")).filter(F.col("similarity") >= threshold)
    return materialise(found, "links"), sets


#: Shingles in a block of texts that are compared with another block (1.6 MB).
BLOCK_SHINGLES = 200_000


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _meet(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of the first block and each class among the second block's rows, one link (if there is any)."""
    for batch in batches:
        columns = {c: _arrays(batch.column(c)) for c in ("ids", "labels", "sizes", "shingles", "ids2", "labels2", "sizes2", "shingles2")}
        links: list[tuple[int, int, float]] = []
        for ids, labels, sizes, flat, ids2, labels2, sizes2, flat2 in zip(*columns.values(), strict=True):
            known, number = np.unique(flat2, return_inverse=True)
            starts = np.cumsum(sizes2) - sizes2
            for i, own in enumerate(np.split(flat, np.cumsum(sizes)[:-1])):
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                mark = np.zeros(len(known), np.int32)
                mark[at[known[at] == own]] = 1
                common = np.add.reduceat(mark[number], starts)
                similarity = common / (len(own) + sizes2 - common)
                hit = np.flatnonzero((similarity >= threshold) & (labels2 != labels[i]))
                _, first = np.unique(labels2[hit], return_index=True)
                links += [(min(ids[i], ids2[j]), max(ids[i], ids2[j]), similarity[j]) for j in hit[first]]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64()), pa.array([x[2] for x in links], pa.float64())], names=["a", "b", "similarity"])


def across_classes(stars: DataFrame, labels: DataFrame, sets: DataFrame, threshold: float) -> DataFrame | None:
    """Links between rows that share a pivot (stars: a pivot, b row) and are in different classes; None where there are no such rows."""
    spark = stars.sparkSession
    rows = stars.unionByName(stars.select("a", F.col("a").alias("b"))).distinct()
    rows = rows.join(labels.withColumnRenamed("node", "b"), "b", "left").select("a", "b", F.coalesce("label", "b").alias("label"))
    rows = materialise(rows, "pivots")
    counts = rows.groupBy("a", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = materialise(counts.groupBy("a").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("a", "main"), "mixed")
    if mixed.isEmpty():
        return None
    rows = materialise(rows.join(mixed, "a"), "open").join(sets.withColumnRenamed("node", "b"), "b")
    rows = materialise(rows.select("a", "b", "label", (F.col("label") != F.col("main")).alias("asks"), "shingles"), "open-sets")
    parts = rows.groupBy("a").agg(F.ceil(F.sum(F.size("shingles")) / BLOCK_SHINGLES).cast("int").alias("parts"))

    def blocks(some: DataFrame, number: str, tail: str) -> DataFrame:
        packed = some.groupBy("a", number, "parts").agg(F.collect_list(F.struct("b", "label", "shingles")).alias("l"))  # of about BLOCK_SHINGLES
        return packed.select("a", number, "parts", *(F.transform("l", lambda x: x[c]).alias(n + tail) for n, c in (("ids", "b"), ("labels", "label"))), F.transform("l", lambda x: F.size(x["shingles"])).alias("sizes" + tail), F.flatten(F.transform("l", lambda x: x["shingles"])).alias("shingles" + tail))

    dealt = rows.join(materialise(parts, "parts"), "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    asked = blocks(dealt, "block", "2").drop("parts")
    asking = blocks(dealt.filter("asks").withColumnRenamed("block", "own"), "own", "").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = materialise(asking.drop("own", "parts"), "asking").join(materialise(asked, "asked"), ["a", "block"]).drop("a", "block")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:  # a row is a pair of blocks
        spark.conf.set(size, "8")
        return materialise(pairs.mapInArrow(partial(_meet, threshold), "a long, b long, similarity double"), "more-links")
    finally:
        spark.conf.set(size, before)


def components(links: DataFrame) -> DataFrame:
    """Smallest id of each linked id's connected component: node, label.

    Labels flow to the neighbours and are then followed to the labels' own labels, so the rounds grow with the logarithm
    of the longest chain. Only minima by key are gathered.
    """
    edges = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = materialise(labels.join(near, "node").select("node", "label", F.least("label", "m").alias("new")), "step")
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("further"))
        new = materialise(step.join(jump, "new", "left").select("node", F.col("label").alias("old"), F.coalesce("further", "new").alias("label")), "labels")
        if new.filter("old <> label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def _pairs_in(members: DataFrame, key: list[str], threshold: float) -> DataFrame:
    """Pairs of nodes that share a key, of sizes that allow the threshold."""
    a = members.select(*key, F.col("node").alias("a"), F.col("n_shingles").alias("m"))
    b = members.select(*key, F.col("node").alias("b"), F.col("n_shingles").alias("n"))
    return a.join(b, key).filter("a < b").filter(F.least("m", "n") >= threshold * F.greatest("m", "n")).select("a", "b")


def _classes(docs: DataFrame, threshold: float, id_col: str, text_col: str, pairs_up_to: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: own, digest; parts: digest and salts; classes: digest, rep and keep (keys of the first row of the text and of
    the class), group_size, class_size)."""
    i, t = col(id_col), col(text_col)
    keyed = docs.select(*row_key(i, t), t.alias("text"))
    rows = materialise(map_text(keyed, "text", ["own"], sketch_texts, "digest binary, n_shingles int, bands array<long>"), "sketches")
    parts, groups = group_minima(rows, ["digest", "n_shingles", "bands"], "own")
    groups = materialise(groups.withColumn("node", F.monotonically_increasing_id()).withColumnRenamed("first", "rep"), "texts")

    keys = groups.select("node", "n_shingles", F.posexplode("bands").alias("band", "key"))
    sizes = materialise(keys.groupBy("band", "key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1"), "sizes")
    members = materialise(keys.join(sizes, ["band", "key"]), "buckets")
    small = members.filter(F.col("n_rows") <= pairs_up_to)
    stars = materialise(members.filter((F.col("n_rows") > pairs_up_to) & (F.col("node") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    pairs = _pairs_in(small, ["band", "key"], threshold).unionByName(stars).distinct()

    def texts(needed: DataFrame) -> DataFrame:
        """The text of each needed node, from the first row that has it (rows that repeat its key have the same text). What is
        needed grows with the documents, so it is merged, not broadcast, whatever its number."""
        wanted = materialise(groups.select("node", "rep").join(needed, "node").select("node", "rep.*"), "needed")
        return keyed.select("own.*", F.col("text").alias("said")).join(wanted.hint("merge"), ["no_id", "id", "text"]).select("node", F.col("said").alias("text")).dropDuplicates(["node"])

    links, sets = verified(pairs, texts, threshold)
    labels = components(links)
    more = across_classes(stars, labels, sets, threshold)
    if more is not None:
        labels = components(materialise(links.unionByName(more), "all-links"))

    classes = groups.select("digest", "node", "rep", "group_size").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = materialise(classes.select("digest", "rep", "group_size", "label"), "classes")
    whole = classes.groupBy("label").agg(F.min("rep").alias("keep"), F.sum("group_size").alias("class_size"))
    classes = materialise(classes.join(whole, "label").drop("label"), "sized")
    return rows.select("own", "digest"), parts.select("digest", "__salt"), classes


def near_groups(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", pairs_up_to: int = 12) -> DataFrame:
    """One row per document: id, rep_id (smallest id with the same words), class_id (smallest id of the class), class_size
    (documents in the class). Buckets of up to ``pairs_up_to`` texts are compared pair by pair, larger ones by pivot and
    blocks; the classes are the same."""
    rows, parts, classes = _classes(docs, threshold, id_col, text_col, pairs_up_to)
    return spread(rows, parts, classes, ["digest"], "own").select(
        F.expr("IF(own.no_id, NULL, own.id)").alias(id_col), F.expr("IF(rep.no_id, NULL, rep.id)").alias("rep_id"), F.expr("IF(keep.no_id, NULL, keep.id)").alias("class_id"), F.col("class_size").cast("long").alias("class_size")
    )


def drop_near_copies(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", pairs_up_to: int = 12) -> DataFrame:
    """One document of each class, the one with the smallest id, with all its columns."""
    rows, _, classes = _classes(docs, threshold, id_col, text_col, pairs_up_to)
    stay = materialise(classes.select(F.col("keep").alias("own")).distinct(), "stay")
    repeated = rows.groupBy("own").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("own")
    return keep_rows(docs, stay, repeated, id_col, text_col)
