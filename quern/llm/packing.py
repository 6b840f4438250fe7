"""Best-fit-decreasing packing of token sequences, with a segment tree over remaining capacities.

Every document's ids (with an end id) are one piece, or, where they are more than ``most``, pieces of ``most`` ids of
which the first may be shorter. Pieces are packed in order of falling length, each into the tightest open sequence that
holds it, or into a new one. Which pieces of one length are placed first makes no difference to the packing, so the packing
needs the pieces' lengths and how many pieces have each: at most ``most`` numbers, whatever the corpus. ``BestFit`` holds
the open sequences by remaining capacity in a segment tree; a search descends it once and finds the tightest in
logarithmic time. Sequences of equal content are kept as ranges, so a run of equal pieces is one search per range, and
the plan has one row per run. A range is split only where the pieces of a length run out, and a sequence holds less than
sqrt(2 * most) different lengths, so the plan has less than 5 * most * sqrt(2 * most) rows (650,000 for 2,048), which is
what the tasks get.

On Spark: one pass over the texts encodes, cuts and counts; it gives each piece its number among the pieces of its length
within its partition and is written. Partitions' counts by length are summed, so pieces of one length are numbered without
a sort, and every piece looks up its place in the plan by length and number.

Ids are those of the tokenizers library for whole texts. Words are encoded once per Python process by the library (letters
by its BPE model, everything else by the whole tokenizer) and kept up to a bound; texts with other white space than blanks
and line ends go to it whole.

Defined cases. A null or empty text is the end id alone. Special strings inside texts count as the library's default has
them. Repeated rows and ids are packed row by row; null ids stay null. Other columns of the caller, whatever their names,
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bound_batches, chunks, col, materialise
from .token_counts import byte_symbols
from .token_files import MARKS

#: Entries that the words' ids of a Python process hold at most, and characters of a word that is kept.
CACHE, SHORT = 1_200_000, 40
#: White space other than blanks and line ends, for any reader of the property.
OTHER_SPACE = re.compile("[^\\S \\n]|\u180e")
#: A run of blanks and line ends with the word after it; no pre-token reaches over its ends.
STRETCH = re.compile(r"[ \n]*[^ \n]+|[ \n]+")


class WordBytes(dict):
    """Ids (as bytes) of words after ``lead`` (a blank or nothing), encoded by the library when they are first asked for."""

    def __init__(self, tokenizer, lead: str, dtype: np.dtype, tails: WordBytes | None = None):
        self.tokenizer, self.lead, self.dtype, self.tails = tokenizer, lead, dtype, self if tails is None else tails
        self.model, self.symbols = tokenizer.model.tokenize, {b: ord(c) for b, c in byte_symbols().items()}

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        if core.isalpha() and max(core) < "\u0250":  # letters in any version of Unicode: one pre-token
            got = np.array([t.id for t in self.model((self.lead + core).encode("utf-8").decode("latin-1").translate(self.symbols))], self.dtype).tobytes()
            if len(core) < len(word):
                got += self.tails[word[len(core) :]]
        else:
            got = self.encoded(self.lead + word)
        if len(word) <= SHORT:
            if len(self) >= CACHE:
                self.clear()
            self[word] = got
        return got


_OPEN: dict[str, tuple] = {}


class DocumentIds:
    """Ids of whole texts, little-endian unsigned integers of ``dtype``."""

    def __init__(self, path: str):
        if path not in _OPEN:
            import os

            import tokenizers

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            tokenizer = tokenizers.Tokenizer.from_file(path)
            dtype = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
            bare = WordBytes(tokenizer, "", dtype)
            _OPEN[path] = bare, WordBytes(tokenizer, " ", dtype, bare), bare.encoded("\n")
        self.bare, self.spaced, self.line = _OPEN[path]
        self.dtype = self.bare.dtype

    def __call__(self, text: str) -> bytes:
        if OTHER_SPACE.search(text):
            return self.bare.encoded(text)
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] == "\n" or text[-1:] in (" ", "\n"):
            parts = []
            for s in STRETCH.findall(text):
                word = s.lstrip(" \n")
                space = s[: len(s) - len(word)]
                parts.append(self.spaced[word] if space == " " and word else self.bare[word] if not space else self.bare.encoded(s))
            return b"".join(parts)
        bare, spaced = self.bare, self.spaced.__getitem__
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append(b"".join([bare[first] if first else b"", *map(spaced, rest)]))
        return self.line.join(lines)


class BestFit:
    """Open sequences by remaining capacity: a segment tree tells which capacities occur, a queue per capacity holds ranges (first, how many)."""

    def __init__(self, most: int):
        self.most, self.leaves = most, 1 << most.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.open: dict[int, deque] = defaultdict(deque)
        self.n = 0  # sequences so far

    def _mark(self, capacity: int, there: bool) -> None:
        at = self.leaves + capacity
        self.tree[at] = there
        while at > 1:
            at //= 2
            self.tree[at] = self.tree[2 * at] | self.tree[2 * at + 1]

    def put(self, capacity: int, first: int, n: int) -> None:
        if capacity and n:
            if not self.open[capacity]:
                self._mark(capacity, True)
            self.open[capacity].append((first, n))

    def take(self, capacity: int) -> tuple[int, int]:
        got = self.open[capacity].popleft()
        if not self.open[capacity]:
            self._mark(capacity, False)
        return got

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity from ``length`` on that an open sequence has."""
        at = self.leaves + length
        while not self.tree[at]:
            while at & 1:  # a right child: what is larger lies right of its parent
                at //= 2
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        return at - self.leaves

    def place(self, length: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """Place n pieces of one length: (how many, first sequence, pieces a sequence, offset of the first piece there) per run.

        A sequence that took a piece and still has room for another is tighter than all others that fit, so it takes the
        next ones until it has no room.
        """
        while n:
            capacity = self.tightest(length)
            if capacity is None:
                capacity, each = self.most, self.most // length
                first, there = self.n, -(-n // each)
                self.n += there
            else:
                each = capacity // length
                first, there = self.take(capacity)
            now = min(n, there * each)
            full, rest = divmod(now, each)
            self.put(capacity - each * length, first, full)
            self.put(capacity - rest * length, first + full, 1 if rest else 0)
            self.put(capacity, first + full + (rest > 0), there - full - (rest > 0))
            yield now, first, each, self.most - capacity
            n -= now


def plan(lengths: dict[int, int], most: int) -> dict[str, np.ndarray]:
    """The packing of so many pieces of each length (1 to most), in runs: length, first (number among the pieces of its
    length), sequence, each, offset; ordered by length and first."""
    fit, runs = BestFit(most), []
    for length in sorted(lengths, reverse=True):
        first = 0
        for n, sequence, each, offset in fit.place(length, lengths[length]):
            runs.append((length, first, sequence, each, offset))
            first += n
    runs.sort()
    return dict(zip(("length", "first", "sequence", "each", "offset"), np.array(runs, np.int64).reshape(-1, 5).T, strict=True))


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one, or pieces of ``most`` after a first of what is left."""
    first = n if n <= most else n % most or most
    return [(0, first), *((at, most) for at in range(first, n, most))]


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("nth", pa.int64())])


def _pieces(vocabulary: str, end_id: int, most: int, with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode, part, seen = DocumentIds(vocabulary), TaskContext.get().partitionId(), Counter()
    end = np.array([end_id], encode.dtype).tobytes()
    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for a, b in chunks(texts):
            rows = []
            for doc, text in zip(docs[a:b], texts[a:b], strict=True):
                ids = np.frombuffer(encode(text) + end, encode.dtype).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), most)):
                    data = ids[start : start + n].tobytes()
                    rows.append((doc, k, start, n, zlib.crc32(data), data if with_ids else None, part, seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)


def _placed(plan_of, at: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns ``at``, then sequence_id and offset, looked up by length and number, the last two columns."""
    runs = plan_of.value
    key = runs["length"] << 48 | runs["first"]
    for batch in batches:
        length, number = (batch.column(k).to_numpy() for k in (-2, -1))
        run = np.searchsorted(key, length << 48 | number, "right") - 1
        ahead, each = number - runs["first"][run], runs["each"][run]
        made = [runs["sequence"][run] + ahead // each, runs["offset"][run] + ahead % each * length]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in at), *map(pa.array, made)], names=[*(batch.schema.names[k] for k in at), "sequence_id", "offset"])


def pack(docs: DataFrame, vocabulary: str, most: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and with ``with_ids`` ids (little-endian unsigned 32-bit).

    ``vocabulary``: path of a byte-level BPE .json on every worker.
    """
    if not 0 < most < 1 << 15:
        raise ValueError("a sequence holds 1 to 32,767 ids")
    spark = docs.sparkSession
    bound_batches(spark)
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, nth long"
    made = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(partial(_pieces, vocabulary, end_id, most, with_ids), ddl)
    pieces = materialise(made.select(*kept, "part", "nth"), "pieces")
    counts = materialise(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over partitions
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    lengths = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``most`` rows
    runs = spark.sparkContext.broadcast(plan(lengths, most))
    numbered = pieces.join(starts, ["length", "part"]).select(*kept, F.col("length").alias("l"), (F.col("before") + F.col("nth")).alias("number"))
    types = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "ids": "binary"}
    packed = numbered.mapInArrow(partial(_placed, runs, list(range(len(kept)))), ", ".join(f"{c} {types[c]}" for c in kept) + ", sequence_id long, offset long")
    return packed.withColumnRenamed("doc_id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences (of ``pack`` with ids): sequence_id, n_tokens, ids (its pieces one after another) and the pieces' offsets, for position and attention masks."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most ``most`` ids
    rows = packed.groupBy("sequence_id").agg(parts.alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda done, x: F.concat(done, x["ids"]))
    return rows.select("sequence_id", (F.length(joined) / 4).cast("long").alias("n_tokens"), joined.alias("ids"), F.transform("p", lambda x: x["offset"]).alias("offsets"))
