"""Packing against the library's ids and a plain best-fit-decreasing over all pieces."""

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from quern.llm import packing

from .test_tokens import ODD

VOCABULARY = P.path("byte_bpe_50k.json")


def plain_best_fit(lengths, most):
    """Number of sequences and their contents (lengths in order), piece by piece."""
    bins, room = [], []  # room: sorted (remaining, bin)
    for n in sorted(lengths, reverse=True):
        at = bisect_left(room, (n, -1))
        if at == len(room):
            bins.append([])
            left, b = most, len(bins) - 1
        else:
            left, b = room.pop(at)
        bins[b].append(n)
        insort(room, (left - n, b))
    return bins


def filled(bins):
    """How many sequences hold so many ids; among sequences with equal room it is open which takes a piece."""
    return Counter(sum(b) for b in bins)


def brute_pieces(docs, most, end=0):
    library = Tokenizer.from_file(VOCABULARY)
    out = []
    for doc, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end]
        n_pieces = -(-len(ids) // most)
        first = len(ids) - most * (n_pieces - 1)
        for k in range(n_pieces):
            start = 0 if k == 0 else first + (k - 1) * most
            part = np.array(ids[start : first if k == 0 else start + most], "<u4")
            out.append((doc, k, start, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=str)


def check(rows, docs, most):
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == brute_pieces(docs, most)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    want = plain_best_fit([r.length for r in rows], most)
    assert filled([[n for _, n in p] for p in held.values()]) == filled(want)


def test_query_equals_plain_best_fit(spark, sf):
    from quern.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(QUERIES["op13_packing"](spark, sf).collect(), docs, 2048)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"), allowMissingColumns=True)
    rows = packing.pack(docs.repartition(3), VOCABULARY, 50).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], 50)
    assert packing.pack(no_docs, VOCABULARY).count() == 0


def test_sequences_hold_the_pieces(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 17)) for i in range(60)], "doc_id long, text string")
    packed = packing.pack(docs, VOCABULARY, 16, 9, with_ids=True)
    rows = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        s = rows[r.sequence_id]
        assert bytes(s.ids)[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids) and r.offset in s.offsets and s.n_tokens <= 16
    assert sum(r.n_tokens for r in rows.values()) == sum(r.length for r in packed.collect())


def test_runs_equal_piece_by_piece():
    rng = random.Random(3)
    for most in (1, 2, 7, 10, 64, 100):
        for _ in range(40):
            lengths = Counter(rng.randint(1, most) for _ in range(rng.choice([0, 1, 5, 200, 3000])))
            runs = packing.plan(lengths, most)
            held = defaultdict(dict)
            order = sorted(range(len(runs["first"])), key=lambda i: (runs["length"][i], runs["first"][i]))
            for i, nxt in zip(order, [*order[1:], None], strict=False):
                length, first = int(runs["length"][i]), int(runs["first"][i])
                last = int(runs["first"][nxt]) if nxt is not None and runs["length"][nxt] == length else lengths[length]
                for j in range(last - first):
                    place = held[int(runs["sequence"][i]) + j // int(runs["each"][i])]
                    offset = int(runs["offset"][i]) + j % int(runs["each"][i]) * length
                    assert offset not in place
                    place[offset] = length
            got = filled([p.values() for p in held.values()])
            assert got == filled(plain_best_fit(list(lengths.elements()), most))


def test_tightest_finds_the_smallest_that_fits():
    fit = packing.BestFit(20)
    for capacity in (3, 9, 20):
        fit.put(capacity, capacity, 1)
    assert [fit.tightest(n) for n in (1, 3, 4, 9, 10, 20)] == [3, 3, 9, 9, 20, 20]
    fit.take(20)
    assert fit.tightest(10) is None


def test_word_ids_equal_the_library():
    library = Tokenizer.from_file(VOCABULARY)
    encode = packing.DocumentIds(VOCABULARY)
    texts = [*ODD, " ".join(ODD), *(f"a{c}b{c} {c}{c}C{c}.{c} d'{c}s é{c}\n{c}x 9{c}" for c in map(chr, [*range(1, 128), 0x85, 0xA0, 0x301, 0x180E, 0x2028, 0x3000])), "a \nb", "\na\n", " a", "\n", "x\ny z,\nW's don't. <|endoftext|> <|endoftext|>\n<|endoftext|>a"]
    for t in texts:
        assert np.frombuffer(encode(t), encode.dtype).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
