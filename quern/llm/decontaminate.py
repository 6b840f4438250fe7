"""Benchmark decontamination by the q-gram lemma.

A passage of ``L`` characters that occurs in a document with at most ``k`` edits shares at least ``L + 1 - q - k*q`` of its
q-grams with it, and their diagonals (place in the document minus place in the passage) lie within ``k`` of each other.
So: q-grams of the whole document that the benchmark has are found by lookup; each hit is counted in the two overlapping
diagonal bands (of width 2(k+1), one every k+1) that it lies in; bands that reach the passage's bound are regions; and a
region is reported only if a banded alignment finds the passage there within ``k`` edits.

Passages are the benchmark's items; a long item is cut into overlapping segments of ``SEGMENT`` characters. Items longer
than that also have segments of ``SHORT`` characters every ``SHORT_STRIDE``, so any verbatim excerpt of ``SEGMENT``
characters, wherever it begins, holds a whole segment and is found; of items up to that length the whole is. Text is compared in lower case with white space runs as one space. ``k`` is a tenth of
the segment's length.

Items shorter than 2q + 2 characters have too few q-grams to tell a region from chance, so they are searched for exactly,
as whole words (no letter or digit touches them), all at once by an Aho-Corasick automaton.

The benchmark's q-grams go to the tasks in blocks of at most ``BLOCK_CHARS`` characters of passages (about 60 bytes a
character, 120 MB a block); a larger benchmark is taken in several passes over the documents, one block at a time, whose
result is written before the next block is made, so what is held and broadcast is bounded whatever the benchmark's size.
Documents are processed whole, in overlapping tiles: equal tiles (a line that repeats) are searched once, q-grams that tiles
and passages share are expanded a bounded number at a time, equal segments of several items are one, and equal windows are
aligned once, many windows together.

Defined cases. Null texts count as empty and are clean. Null or blank items match nothing. Repeated documents are judged
row by row; an item that occurs twice under one id is one item. An empty benchmark leaves every document clean, and an
empty table gives an empty result. Other columns of the caller, whatever their names, are not read;
``drop_contaminated`` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import col, map_text, materialise, numbered, place

Q, SEGMENT, STRIDE, EDITS = 8, 120, 60, 0.1
LEAST = 2 * Q + 2  # characters from which an item is found by its q-grams
SHORT, SHORT_STRIDE = 80, 40  # SHORT + SHORT_STRIDE - 1 characters hold a whole short segment
BLOCK_CHARS = 2_000_000
#: Texts are searched in tiles that overlap by more than a passage with its edits; equal tiles once. Shared q-grams that are
#: expanded at once, and alignments done at once.
TILE, OVER, HITS, PAIRS = 2048, 192, 4_000_000, 2_000
_U = np.uint64


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def grams(p: np.ndarray, q: int = Q) -> np.ndarray:
    """A code for the q-gram at each place: its eight points folded to a byte each, so equal q-grams have equal codes."""
    folded = ((p ^ (p >> 8)) & 0xFF).astype(np.uint8)
    if len(folded) < q:
        return np.zeros(0, np.uint64)
    return np.lib.stride_tricks.sliding_window_view(folded, q).copy().view("<u8").ravel()


def segments(text: str) -> list[tuple[int, str]]:
    """(start, segment) that cover a normalised item."""
    def cut(size: int, stride: int) -> list[tuple[int, str]]:
        return [(s, text[s : s + size]) for s in [*range(0, len(text) - size, stride), len(text) - size]]

    whole = [(0, text)] if len(text) <= SEGMENT + STRIDE // 2 else cut(SEGMENT, STRIDE)
    return whole if len(text) <= SEGMENT else whole + cut(SHORT, SHORT_STRIDE)


def banded_distances(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """For each row the fewest edits by which ``a`` occurs inside the first ``sizes`` points of ``b`` (free ends in b), with start
    and end in b; edits are -1 where there are more than k.

    The columns of each step are a band of diagonals, as wide as the rows of ``b`` are longer than those of ``a``.
    """
    pairs, n = a.shape
    out = np.full((pairs, 3), -1, np.int64)
    if not pairs:
        return out
    lanes = np.arange(-k, max(0, b.shape[1] - n) + k + 1, dtype=np.int32)  # diagonal: place in b minus place in a
    one, far = np.int32(1 << 12), np.int32(1 << 28)  # a cell holds its edits times one and its start; ties go to the first start
    live, shift = np.arange(pairs), lanes * one
    # outside of b nothing is equal; no way leads back into it from its end, and none comes from before its begin
    wide = np.full((pairs, k + 1 + b.shape[1] + n + len(lanes)), 0xFFFFFFFF, np.uint32)
    wide[:, k + 1 : k + 1 + b.shape[1]] = np.where(np.arange(b.shape[1]) < sizes[:, None], b, 0xFFFFFFFF)
    cell = np.broadcast_to(np.where((lanes >= 0) & (lanes <= b.shape[1]), np.maximum(lanes, 0), far), (pairs, len(lanes))).astype(np.int32)
    for i in range(1, n + 1):
        new = cell + (wide[:, i : i + len(lanes)] != a[:, i - 1 : i]) * one  # match or replace
        np.minimum(new[:, :-1], cell[:, 1:] + one, out=new[:, :-1])  # a point of a that b lacks
        cell = np.minimum.accumulate(new - shift, 1) + shift  # points of b that a lacks
        if i % 8 == 0:
            keep = cell.min(1) < (k + 1) * one
            if not keep.all():
                live, cell, a, wide, sizes = (x[keep] for x in (live, cell, a, wide, sizes))
                if not len(live):
                    return out
    cell = np.where(lanes + n <= sizes[:, None], cell, far)
    best, row = (cell // one).argmin(1), np.arange(len(live))
    found = cell[row, best]
    good = found < (k + 1) * one
    out[live[good]] = np.stack([found // one, found % one, lanes[best] + n], 1)[good]
    return out


def banded_distance(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """The same of one pair: edits, start and end in b; None if over ``k``."""
    edits, start, end = banded_distances(a[None], b[None], np.array([len(b)]), k)[0].tolist()
    return (edits, start, end) if edits >= 0 else None


class Block:
    """A block of segments with the sorted codes of their q-grams and where each occurs; and an automaton of short items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.text, self.items, self.need, self.k = [], [], [], []
        known: dict[str, int] = {}
        codes, owner, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        short: dict[str, list[int]] = {}
        for item, text in items:
            if len(text) < LEAST:
                short.setdefault(text, []).append(item)
                continue
            for _, s in segments(text):
                if s in known:  # equal segments are one, with several items
                    if self.items[known[s]][-1] != item:
                        self.items[known[s]].append(item)
                    continue
                known[s] = len(self.text)
                g = grams(points(s))
                k = max(0, min(int(len(s) * EDITS), (len(g) - 2) // Q))  # so that the bound is two q-grams at least
                self.items.append([item])
                self.text.append(s)
                self.k.append(k)
                self.need.append(len(g) - k * Q)
                codes.append(g)
                owner.append(np.full(len(g), len(self.text) - 1))
                place.append(np.arange(len(g)))
        code = np.concatenate(codes)
        order = np.argsort(code, kind="stable")
        self.code, first, self.times = np.unique(code[order], return_index=True, return_counts=True)
        self.first, self.owner, self.place = first, np.concatenate(owner)[order], np.concatenate(place)[order]
        self.width = np.array(self.k, np.int64) + 1
        self.needed = np.array(self.need, np.int64)
        self.length = np.array([len(t) for t in self.text])
        self.bits = max(20, (8 * len(self.code)).bit_length())  # eight slots a code, so that few others look like one
        self.short = None
        if short:
            self.short = ahocorasick.Automaton()
            for text, owners in short.items():
                self.short.add_word(text, (len(text), owners))
            self.short.make_automaton()
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.slot(self.code)] = True

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def shared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in a text whose q-gram the block has, and the number of that q-gram."""
        maybe = np.flatnonzero(self.seen[self.slot(codes)])
        at = np.minimum(np.searchsorted(self.code, codes[maybe]), len(self.code) - 1)
        real = self.code[at] == codes[maybe]
        return maybe[real], at[real]

    def regions(self, at: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """(segment, diagonal where the band begins) of the bands that reach their segment's bound, from shared q-grams: places in
        the text and numbers."""
        times = self.times[gram]
        where = np.repeat(self.first[gram] - np.cumsum(times) + times, times) + np.arange(times.sum())
        at, owner, place = np.repeat(at, times), self.owner[where], self.place[where]
        width = self.width[owner]
        band = (at - place) // width
        both_owner = np.concatenate([owner, owner])
        both_band = np.concatenate([band, band - 1])
        both_place = np.concatenate([place, place])
        key = both_owner * (1 << 40) + (both_band + (1 << 20))
        # most bands have a hit or two: those whose hashed count can't reach the bound go first (a hashed count is never too small)
        slot = ((key.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(64 - 21)).astype(np.int64)
        able = np.bincount(slot, minlength=1 << 21)[slot] >= self.needed[both_owner]
        # then distinct places of the segment are counted
        order = np.lexsort((both_place[able], key[able]))
        key, place = key[able][order], both_place[able][order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1])
        keys, times = np.unique(key[fresh], return_counts=True)
        keys = keys[times >= self.needed[keys >> 40]]
        seg = keys >> 40
        return np.stack([seg, ((keys & ((1 << 40) - 1)) - (1 << 20)) * self.width[seg]], 1)


def short_items(block: Block, text: str) -> Iterator[tuple[int, int, int]]:
    """(item, start, end) of the short items that a normalised text has as whole words."""
    for last, (n, owners) in block.short.iter(text):
        a, b = last + 1 - n, last + 1
        if not (a and text[a - 1].isalnum() and text[a].isalnum()) and not (b < len(text) and text[b].isalnum() and text[last].isalnum()):
            yield from ((item, a, b) for item in owners)


def _groups(at: np.ndarray, hits: np.ndarray, begins: np.ndarray) -> Iterator[slice]:
    """Ranges of shared q-grams (places ``at``) with at most HITS hits: of several tiles, of one, or overlapping ones within a tile."""
    edges = np.searchsorted(at, begins)
    total = np.append(0, np.cumsum(hits))
    first = 0
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if total[b] - total[first] > HITS:
            if a > first:
                yield slice(first, a)
            first = a
            if total[b] - total[a] > HITS:
                for x in range(int(at[a]), int(at[b - 1]) + 1, OVER):
                    yield slice(*np.searchsorted(at, (x, x + 2 * OVER)))
                first = b
    if len(at) > first:
        yield slice(first, len(at))


def _verified(block: Block, tiles: list[str], windows: dict[tuple[int, str], list[tuple[int, int]]], out: list[dict]) -> None:
    """Put what occurs in the windows (segment, text of the window: where it lies) to the tiles' finds."""
    unsure: dict[tuple[int, int], list[tuple[int, str]]] = {}

    def put(seg: int, window: str, edits: int, start: int, end: int) -> None:
        for tile, lo in windows[seg, window]:
            found = seg, lo + start, lo + end
            out[tile][found] = min(edits, out[tile].get(found, edits))

    for seg, window in windows:
        n, k = int(block.length[seg]), block.k[seg]
        same = window.find(block.text[seg])
        if same >= 0:
            put(seg, window, 0, same, same + n)
        elif k:
            unsure.setdefault((n, k), []).append((seg, window))
    for (n, k), pairs in unsure.items():
        for i in range(0, len(pairs), PAIRS):
            some = pairs[i : i + PAIRS]
            sizes = np.array([len(w) for _, w in some])
            a = points("".join(block.text[seg] for seg, _ in some)).reshape(-1, n)
            b = points("".join(w.ljust(sizes.max(), "\0") for _, w in some)).reshape(len(some), -1)
            for (seg, window), (edits, start, end) in zip(some, banded_distances(a, b, sizes, k).tolist(), strict=True):
                if edits >= 0:
                    put(seg, window, edits, start, end)


def in_tiles(block: Block, tiles: list[str]) -> list[dict[tuple[int, int, int], int]]:
    """For each tile (segment, start, end) -> edits of the segments found in it."""
    out: list[dict] = [{} for _ in tiles]
    if not block.text or not tiles:
        return out
    gap = SEGMENT * 2 + 64  # bands don't mix tiles
    begins = np.cumsum([0, *(len(t) + gap for t in tiles)])
    p = np.zeros(begins[-1], np.uint32)
    for t, b in zip(tiles, begins, strict=False):
        p[b : b + len(t)] = points(t)
    at, gram = block.shared(grams(p))
    for part in _groups(at, block.times[gram], begins):
        windows: dict[tuple[int, str], list[tuple[int, int]]] = {}
        for seg, diagonal in block.regions(at[part], gram[part]).tolist():
            k, n = block.k[seg], int(block.length[seg])
            i = int(np.searchsorted(begins, max(0, diagonal + (k + 1) + n // 2), side="right")) - 1
            if i < len(tiles):
                lo, hi = max(diagonal - k - int(begins[i]), 0), diagonal + 2 * (k + 1) + n + k - int(begins[i])
                if window := tiles[i][lo : max(hi, 0)]:
                    windows.setdefault((seg, window), []).append((i, lo))
        _verified(block, tiles, windows, out)
    return out


def find(block: Block, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
    """For each text (item, start, end, edits) of the passages found, places in the normalised text.

    A find at an inner edge of a tile may be cut; the tile beside it has it whole.
    """
    plain = [normalised(t) for t in texts]
    where: dict[str, list[tuple[int, int]]] = {}
    for i, t in enumerate(plain):
        for a in range(0, max(1, len(t) - OVER), TILE):
            where.setdefault(t[a : a + TILE + OVER], []).append((i, a))
    out: list[dict] = [{} for _ in texts]
    for (tile, places), found in zip(where.items(), in_tiles(block, [*where]), strict=True):
        for (seg, x, y), edits in found.items():
            for i, a in places:
                if (x or not a) and (y < len(tile) or a + y == len(plain[i])):
                    for item in block.items[seg]:
                        key = item, a + x, a + y
                        out[i][key] = min(edits, out[i].get(key, edits))
    if block.short is not None:
        for i, t in enumerate(plain):
            out[i].update((found, 0) for found in short_items(block, t))
    return [_joined(o) for o in out]


def _joined(found: dict) -> list[tuple[int, int, int, int]]:
    """Overlapping finds of one item as one: from the first start to the last end, with the most edits of any of them."""
    out: list[list[int]] = []
    for (item, a, b), e in sorted(found.items()):
        if out and out[-1][0] == item and a <= out[-1][2]:
            out[-1][2], out[-1][3] = max(out[-1][2], b), max(out[-1][3], e)
        else:
            out.append([item, a, b, e])
    return [tuple(o) for o in out]


SPANS = "array<struct<item_id: bigint, start: int, end: int, edits: int>>"

class Finder:
    """Spans of whole texts for one broadcast block."""

    def __init__(self, block, name: str):
        self.block, self.name = block, name

    def __call__(self, texts: list[str]) -> dict:
        return {self.name: [[dict(zip(("item_id", "start", "end", "edits"), f, strict=True)) for f in fs] for fs in find(self.block.value, texts)]}


def item_lists(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in lists of bounded size; they come to the driver as they are asked for."""
    rows = benchmark.select(col(item_col).cast("long").alias("i"), col(text_col).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").distinct().orderBy("i", "t")
    items, size = [], 0
    for r in rows.toLocalIterator():
        text = normalised(r.t)
        if not text or (items and items[-1] == (r.i, text)):
            continue
        if items and size + len(text) > BLOCK_CHARS:
            yield items
            items, size = [], 0
        items.append((r.i, text))
        size += len(text)
    if items:
        yield items


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> list[Block]:
    """All blocks of a small benchmark at once."""
    return [*map(Block, item_lists(benchmark, item_col, text_col))]


def _passes(rows: DataFrame, benchmark: DataFrame, text: str, spans: str | None) -> DataFrame:
    """``rows`` after a pass for each block: with what was found added to the column ``spans``, or (None) without the rows in
    which something was found."""
    spark = rows.sparkSession
    names, lists = rows.columns, item_lists(benchmark)
    items = next(lists, None)
    while items:
        following = next(lists, None)
        keep = names if following or spans is None else [n for n in names if n != text]  # no pass after the last needs the text
        held = spark.sparkContext.broadcast(Block(items))
        rows = map_text(rows, text, keep, Finder(held, "part"), f"part {SPANS}")
        rows = rows.filter(F.size("part") == 0).drop("part") if spans is None else rows.withColumn(spans, F.concat(spans, "part")).drop("part")
        if following:  # one block at a time
            rows = materialise(rows, "passages")
            held.destroy()
        items = following
    return rows


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and passage found in it: id, item_id, start, end (in the normalised text), edits."""
    rows = docs.select(col(id_col).alias("key"), col(text_col).alias("text"), F.expr(f"CAST(array() AS {SPANS})").alias("spans"))
    found = _passes(rows, benchmark, "text", "spans")
    return found.select(F.col("key").alias(id_col), F.explode("spans").alias("s")).select(col(id_col), "s.item_id", "s.start", "s.end", "s.edits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents in which no passage was found, with all their columns."""
    return _passes(numbered(docs), benchmark, place(docs, text_col), None).toDF(*docs.columns)
