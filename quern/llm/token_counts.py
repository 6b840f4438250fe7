"""Token counts of a byte-level BPE vocabulary (.json) by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens. Distinct pre-tokens that a task has not met yet are held together as one ragged numpy
array of symbols; each round finds every sequence's lowest-rank adjacent pair and merges all its occurrences in all
sequences at once; the symbols that survive are the token count. A very long pre-token (over ``ALONE`` bytes) goes through
the same rounds alone, with its pairs sorted by rank, so that a round costs what it merges and not its length. Counts of
pre-tokens and of words are cached per task up to a bound (the cache only saves work).

Defined cases. A null text is empty and has no bytes and no tokens. The vocabulary's special strings inside a text
count as one token each, as the tokenizers library does by default. Repeated rows and ids are counted row by row. Other
columns of the caller, whatever their names, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import regex
from pyspark.sql import DataFrame

from ._common import map_text

#: Fixed values of the byte-level scheme: the pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries that a task's caches hold at most, and characters of what they hold.
CACHE, SHORT = 500_000, 60
#: Bytes from which a pre-token is merged alone.
ALONE = 2_000


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """The merge table as sorted arrays: pair -> rank and merged symbol."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        vocab = model["model"]["vocab"]
        self.special = [t["content"] for t in model["added_tokens"]]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made, self.made_by_rank = key[order], np.arange(len(key))[order], made[order], made
        symbols = byte_symbols()
        self.of_byte = np.array([vocab[symbols[b]] for b in range(256)], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; ``len(self.key)`` where it never merges."""
        pair = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        return np.where(self.key[at] == pair, self.rank[at], len(self.key))

    def count_alone(self, piece: bytes) -> int:
        """Symbols that survive in one long piece: the lowest rank's pairs merge at once, round by round."""
        sym = self.of_byte[np.frombuffer(piece, np.uint8)].astype(np.int32)
        n, never = len(sym), len(self.key)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        rank = np.append(self.ranks(sym[:-1], sym[1:]), never).astype(np.int32)  # of the pair that begins at each symbol; gone ones: never
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[rank[at] < never]
            at = at[np.argsort(rank[at], kind="stable")]
            found, first = np.unique(rank[at], return_index=True)
            for r, part in zip(found.tolist(), np.split(at, first[1:]), strict=True) if len(found) else ():
                if r not in waiting:
                    heapq.heappush(heap, r)
                waiting.setdefault(r, []).append(part)

        wait(np.arange(n, dtype=np.int32))
        left = n
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            # of overlapping occurrences (aaa) every other one merges, from the left
            first = np.flatnonzero(np.append(True, after[at[:-1]] != at[1:]))
            run = np.repeat(first, np.diff(np.append(first, len(at))))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            gone = after[at]
            rank[gone] = never
            sym[at] = self.made_by_rank[r]
            after[at] = after[gone]
            inside = after[at] < n
            before[after[at][inside]] = at[inside]
            left -= len(at)
            touched = np.unique(np.append(at, before[at][before[at] >= 0]))
            has = after[touched] < n
            rank[touched[~has]] = never
            touched = touched[has]
            rank[touched] = self.ranks(sym[touched], sym[after[touched]])
            wait(touched)
        return left

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that survive in each piece."""
        long = {i: self.count_alone(p) for i, p in enumerate(pieces) if len(p) > ALONE}
        if long:
            pieces = [b"" if i in long else p for i, p in enumerate(pieces)]
        size = np.array([len(p) for p in pieces], np.int64)
        out = size.copy()
        out[[*long]] = [*long.values()]
        live = np.flatnonzero(size > 1)
        sym = self.of_byte[np.frombuffer(b"".join(p for p in pieces if len(p) > 1), np.uint8)]
        seq = np.repeat(np.arange(len(live)), size[live])
        never = len(self.key)
        while len(sym) > 1:
            pair = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.key, pair), never - 1)
            rank = np.where((self.key[at] == pair) & (seq[:-1] == seq[1:]), self.rank[at], never)
            best = np.full(len(live), never)
            np.minimum.at(best, seq[:-1], rank)
            hit = (rank < never) & (rank == best[seq[:-1]])
            if not hit.any():
                break
            # of overlapping occurrences (aaa) every other one merges, from the left
            where = np.flatnonzero(hit)
            first = np.flatnonzero(np.diff(where, prepend=-2) != 1)
            run = np.repeat(first, np.diff(np.append(first, len(where))))
            where = where[(np.arange(len(where)) - run) % 2 == 0]
            sym = sym.copy()
            sym[where] = self.made[at[where]]
            keep = np.ones(len(sym), bool)
            keep[where + 1] = False
            # sequences without a pair left are done and leave the arrays
            done = best == never
            keep &= ~done[seq]
            np.subtract.at(out, live[seq[where]], 1)
            sym, seq = sym[keep], seq[keep]
            number = np.cumsum(~done) - 1
            live, seq = live[~done], number[seq]
        return out


class Words(dict):
    """Counts of words and pre-tokens met so far in this Python process; tasks that follow in it go on with them."""


_OPEN: dict[str, tuple] = {}


class CountTokens:
    """Bytes and tokens of whole texts."""

    def __init__(self, path: str, limit: int, cache: int = CACHE):
        self.path, self.limit, self.cache = path, limit, cache

    def _learn(self, merges: Merges, split, words: Words, pieces: Words, new: set[str]) -> None:
        """Counts of new stretches of text, each cut into pre-tokens."""
        if len(words) > self.cache:
            words.clear()
        if len(pieces) > self.cache:
            pieces.clear()
        cut = {w: split.findall(w) for w in new}
        unmet = list({p for ps in cut.values() for p in ps} - pieces.keys())
        pieces.update(zip(unmet, merges.count([p.encode("utf-8") for p in unmet]).tolist(), strict=True))
        words.update((w, sum(map(pieces.__getitem__, ps))) for w, ps in cut.items())
        for p in unmet:
            if len(p) > SHORT:
                del pieces[p]

    def __call__(self, texts: list[str]) -> dict:
        if self.path not in _OPEN:
            merges = Merges(self.path)
            special = regex.compile("|".join(map(regex.escape, merges.special))) if merges.special else None
            _OPEN[self.path] = merges, special, regex.compile(PATTERN), regex.compile(r"\s\s"), Words(), Words()
        merges, special, split, twice, words, pieces = _OPEN[self.path]
        # A word with its one leading space is cut into pre-tokens on its own; where white space is not single, the whole text is.
        cut, fixed = [], []
        for t in texts:
            if twice.search(t) or (special and "<" in t):
                parts = special.split(t) if special else [t]
                fixed.append(len(parts) - 1)
                cut.append(parts)
            else:
                first, space, rest = t.partition(" ")
                fixed.append(0)
                cut.append([first, *(f" {w}" for w in rest.split(" "))] if space else [first])
        if new := set().union(*cut) - words.keys():
            if len(words) + len(new) > self.cache:  # so that none goes while it is needed
                words.clear()
                new = set().union(*cut)
            self._learn(merges, split, words, pieces, new)
        counts = [n + sum(map(words.__getitem__, ws)) for ws, n in zip(cut, fixed, strict=True)]
        for w in new:
            if len(w) > SHORT:
                words.pop(w, None)
        return {"n_bytes": [len(t.encode("utf-8")) for t in texts], "n_tokens": counts, "over_limit": [n > self.limit for n in counts]}


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_bytes, n_tokens, over_limit (n_tokens > limit). ``vocabulary``: path of a byte-level BPE .json on every worker."""
    return map_text(docs, text_col, [id_col], CountTokens(vocabulary, limit), "n_bytes long, n_tokens long, over_limit boolean")
