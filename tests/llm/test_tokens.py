import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from quern.llm import bpe_codec, token_counts, token_files
from quern.llm._common import scratch

ODD = ["", " ", "  a", "a  b \n c\n\n d ", "<|endoftext|>x <|endoftext|>", "it's I'LL  don't\t\tz", "aaaa aaaaaaa", "é\x1cb\x85c  d", "日本語 テスト", "x" * 500 + " y", "a\u00a0b", "🙂🙂 🙂", "123 4567 ½", "ſtoken İ Σας ΣΑΣ a\u0301 \u0301b", "a\r\nb\r\n", " \n \n a", "Abc, ABC. <|ENDOFTEXT|>X, <|startoftext|>Y. x</w> ǅ", "ʰʰ aʰ, ᾳ ﬁn ...,,!"]


def test_counts_equal_the_library(odd_docs):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ODD + [chr(c) + " a" + chr(c) + "b" for c in range(32, 0x3000, 7)]
    got = token_counts.CountTokens(P.path("byte_bpe_50k.json"), 3)(texts)
    assert got["n_tokens"] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert got["over_limit"] == [n > 3 for n in got["n_tokens"]]
    rows = token_counts.count_tokens(odd_docs, P.path("byte_bpe_50k.json")).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want


def test_counts_with_a_cache_that_overflows():
    path = P.path("byte_bpe_50k.json")
    token_counts._OPEN.pop(path, None)
    texts = [f"w{i} x{i}y z{i}" for i in range(200)]
    small = token_counts.CountTokens(path, 9, cache=10)
    library = Tokenizer.from_file(path)
    assert [n for t in texts for n in small([t])["n_tokens"]] == [len(library.encode(t).ids) for t in texts]


def test_codec_equals_the_library_and_round_trips(odd_docs, monkeypatch):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = bpe_codec.open_ranks(path)
    monkeypatch.setattr(bpe_codec, "STRETCH", 20)
    codec = bpe_codec.Codec(path)
    for t in [*ODD, " ".join(ODD), "word " * 50 + "\n\n  end"]:
        assert codec.encode(t) == library.encode_ordinary(t)
        assert [s for s in bpe_codec.stretches(t, 20)] and "".join(bpe_codec.stretches(t, 20)) == t
        assert codec.decode(codec.encode(t)) == t.encode()
    got = {(r.doc_id, r.n_tokens): r for r in bpe_codec.encode_decode(odd_docs, path, ids_too=True).collect()}
    for r in odd_docs.collect():
        ids = library.encode_ordinary(r.text or "")
        g = got[r.doc_id, len(ids)]
        assert g.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() and list(g.ids) == ids and bytes(g.decoded) == (r.text or "").encode()


def test_token_files_round_trip(spark, odd_docs):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = odd_docs.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"), allowMissingColumns=True)
    path = scratch(spark, "tokens")
    index = token_files.write_token_files(docs, P.path("word_bpe_49k.json"), path, file_bytes=300, partitions=3)
    assert index.select("file").distinct().count() > 3
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_positions(index, path).collect()))
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in docs.collect()))
    want, start = [], 0
    for known, i, _, text in rows:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((known, i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_empty_tables(spark, no_docs):
    assert token_counts.count_tokens(no_docs, P.path("byte_bpe_50k.json")).count() == 0
    assert bpe_codec.encode_decode(no_docs, P.path("byte_bpe_multi_50k.tiktoken")).count() == 0
    path = scratch(spark, "tokens")
    index = token_files.write_token_files(no_docs, P.path("word_bpe_49k.json"), path)
    assert token_files.token_positions(index, path).count() == 0


def test_damaged_records_are_refused():
    record = token_files.frame(b"abcd" * 9)
    assert token_files.unframe(record) == b"abcd" * 9
    for i in range(len(record)):
        with pytest.raises(ValueError, match="damaged"):
            token_files.unframe(record[:i] + bytes([record[i] ^ 1]) + record[i + 1 :])


def test_word_ids_equal_the_library_for_every_ascii_mark():
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [f"a{c}b{c} {c}{c}C{c}.{c} d'{c}s é{c}\n{c}x 9{c}" for c in map(chr, [*range(1, 128), 0x85, 0xA0, 0x301, 0x2028, 0x3000])]
    got = token_files.WordIds(P.path("word_bpe_49k.json"), None)(texts)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_very_long_runs():
    """A run of 20 million characters without a safe boundary, and equality with the library where that survives."""
    codec = bpe_codec.Codec(P.path("byte_bpe_multi_50k.tiktoken"))
    library = codec.encoding[0]
    for text in (" " * 300_000 + "x", "\n" * 200_000 + " b", "ab" * 100_000, "a b\n" * 50_000, "é" * 100 + " \t " * 50_000 + "y z", "don't" * 40_000, "\x1c \x85" * 60_000, "\u00a0\u3000" * 60_000 + " 7"):
        assert codec.encode(text) == library.encode_ordinary(text), text[:9]
    for text in (" " * 20_000_000 + "x", "\n" * 20_000_000, "ab" * 10_000_000):
        assert codec.decode(codec.encode(text)) == text.encode()
    count = token_counts.CountTokens(P.path("byte_bpe_50k.json"), 9)
    assert count([" " * 20_000_000 + "x", "\n" * 20_000_000])["n_tokens"] == [20_000_000, 10_000_000]


def test_long_pieces_merge_alone_as_in_company():
    rng = np.random.default_rng(4)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    merges = token_counts.Merges(P.path("byte_bpe_50k.json"))
    for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "aé日"):
        for n in (2, 3, 50, 1_000, 5_000):
            text = "".join(rng.choice([*letters], n))
            want = len(library.encode(text, add_special_tokens=False).ids)
            assert merges.count_alone(text.encode()) == want == merges.count([text.encode(), b"ab"])[0]
