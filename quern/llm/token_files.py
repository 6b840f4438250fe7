"""Token ids in length-delimited binary record files with masked checksums and a separate offset index.

File format: records one after another; a record is an 8-byte little-endian length, the masked CRC-32 of those 8 bytes,
the data, and the masked CRC-32 of the data. The mask rotates the checksum right by 15 bits and adds 0xA282EAD8 (the
framing that TFRecord readers know, with CRC-32 in place of CRC-32C, which no library here computes). The data are the
document's ids as little-endian unsigned integers of ``width`` bytes (2 where every id is below 65,536, else 4).

The index is a Parquet table beside the files: doc_id, pos (rank in ascending doc_id order within its file), file,
offset, n_tokens, before (ids of earlier records in the file), width. It lets a reader fetch any record alone, in any order.

Documents are range-partitioned by doc_id, so each file holds one range in order and no task sees more than its range.
Every attempt of a task writes files of its own name; the index, which Spark commits, names those of the attempts that
succeeded. Files go through pyarrow's file systems, so ``path`` may be any URI that they open.

Defined cases. A null text is empty: one end id. Rows that share a doc_id are written in the order of their texts.
Null ids come first. Other columns of the caller, whatever their names, are not read. An empty table gives an index
without rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bound_batches, chunks, col
from .token_counts import byte_symbols

#: Fixed values of the framing.
MASK, HEAD, TAIL = 0xA282EAD8, 12, 4
#: Words whose ids a Python process keeps at most.
CACHE = 800_000


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    size = struct.pack("<Q", len(data))
    return b"".join((size, struct.pack("<I", masked(size)), data, struct.pack("<I", masked(data))))


def unframe(record: bytes) -> bytes:
    """The data of one record; raises ValueError where a length or checksum is wrong."""
    if len(record) < HEAD + TAIL or struct.unpack("<I", record[8:12])[0] != masked(record[:8]):
        raise ValueError("the record's length is damaged")
    n = struct.unpack("<Q", record[:8])[0]
    data = record[HEAD : HEAD + n]
    if len(record) < HEAD + n + TAIL or struct.unpack("<I", record[HEAD + n : HEAD + n + TAIL])[0] != masked(data):
        raise ValueError("the record's data are damaged")
    return data


#: ASCII punctuation; a run of it after letters is a pre-token of its own.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Known(dict):
    """Ids (as bytes) of the words that this Python process has met; a new word is encoded when it is first asked for.

    A word that is letters with punctuation after it is two pre-tokens. One pre-token of letters, normalised by the
    library, goes to the library's BPE model as such; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.normalise, self.model = self.tokenizer.normalizer.normalize_str, self.tokenizer.model.tokenize
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.letters = {b: ord(c) for b, c in byte_symbols().items()}

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _letters(self, word: str) -> bytes | None:
        plain = word.lower() if word.isascii() else self.normalise(word)
        if not plain.isalpha():
            return None
        return self._bytes([t.id for t in self.model(plain if plain.isascii() else plain.encode("utf-8").decode("latin-1").translate(self.letters))])

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        got = self._letters(core) if core.isalpha() else None
        if got is None:
            got = self._bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)
        elif len(core) < len(word):
            got += self[word[len(core) :]]
        if len(word) <= 60:
            if len(self) >= CACHE:
                self.clear()
            self[word] = got
        return got


_OPEN: dict[str, Known] = {}


class WordIds:
    """Ids of whole texts by the tokenizers library.

    The vocabulary drops white space and its normaliser works character by character (composition never crosses a
    space), so a text's ids are the ids of its words in order.
    """

    def __init__(self, path: str, end_id: int | None):
        self.known = _OPEN.get(path) or _OPEN.setdefault(path, Known(path))
        self.width, self.dtype = self.known.width, self.known.dtype
        self.end = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        get = self.known.__getitem__
        return [b"".join([*map(get, t.replace("\n", " ").split(" ")), self.end]) for t in texts]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


INDEX = "doc_id long, pos long, file string, offset long, n_tokens long, before long, width int"


def _write(vocabulary: str, end_id: int | None, path: str, file_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encode = WordIds(vocabulary, end_id)
    system, folder = _open(path)
    out, task, seq, name, offset, pos, before = None, uuid.uuid4().hex, 0, "", 0, 0, 0
    schema = pa.schema([("doc_id", pa.int64()), ("pos", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64()), ("width", pa.int32())])
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for a, b in chunks(texts):
            rows = []
            for doc, data in zip(ids[a:b], encode(texts[a:b]), strict=True):
                if out is None or offset >= file_bytes:
                    if out is not None:
                        out.close()
                    name, seq, offset, pos, before = f"records-{task}-{seq:06d}", seq + 1, 0, 0, 0
                    out = system.open_output_stream(f"{folder}/{name}")
                record = frame(data)
                out.write(record)
                n = len(data) // encode.width
                rows.append((doc, pos, name, offset, n, before, encode.width))
                offset, pos, before = offset + len(record), pos + 1, before + n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    if out is not None:
        out.close()


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int | None = 2, file_bytes: int = 1 << 28, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files and their index under ``path`` (a URI in a folder that all executors see); returns the index."""
    spark = docs.sparkSession
    bound_batches(spark)
    system, folder = _open(path)
    system.create_dir(f"{folder}/records", recursive=True)
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    ordered = rows.repartitionByRange(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "text")
    index = ordered.mapInArrow(partial(_write, vocabulary, end_id, f"{path}/records", file_bytes), INDEX)
    index.write.mode("errorifexists").parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def _read(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    system, folder = _open(path)
    name, file = "", None
    for batch in batches:
        names, offsets, sizes, widths = (batch.column(k).to_pylist() for k in ("file", "offset", "n_tokens", "width"))
        data = []
        for want, at, n, width in zip(names, offsets, sizes, widths, strict=True):
            if want != name:
                if file is not None:
                    file.close()
                name, file = want, system.open_input_file(f"{folder}/{want}")
            got = unframe(file.read_at(HEAD + n * width + TAIL, at))
            data.append(np.frombuffer(got, f"<u{width}").astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "file", "before")), pa.array(data, pa.binary())], names=["doc_id", "file", "before", "ids"])
    if file is not None:
        file.close()


def read_token_files(index: DataFrame, path: str) -> DataFrame:
    """doc_id, file, before, ids (little-endian unsigned 32-bit) of the indexed records, each read by its offset and checked."""
    bound_batches(index.sparkSession)
    return index.select("doc_id", "file", "offset", "n_tokens", "before", "width").mapInArrow(partial(_read, f"{path}/records"), "doc_id long, file string, before long, ids binary")


def token_positions(index: DataFrame, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Files are ordered by their first doc_id, and only their totals (one row per file) are summed in one place.
    """
    read = read_token_files(index, path).select("doc_id", "file", "before", F.expr("length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    files = index.groupBy("file").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    return read.join(files, "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
