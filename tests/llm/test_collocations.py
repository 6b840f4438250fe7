"""Toivonen mining against counting everything."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quern.llm import collocations as C
from quern.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, longest=5, top=2000, keep=100):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        within = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    within[p[i : i + m]] = max(within[p[i : i + m]], a)
        rows = []
        for p, a in found.items():
            if p not in within or 100 * within[p] < keep * a:
                s, j = min((1000 * a * n[lang] // (counts[p[:j]] * counts[p[j:]]), j) for j in range(1, len(p)))
                rows.append((-s, -a, " ".join(p).encode(), counts[p[:j]], counts[p[j:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_query_sql(spark, sf):
    compare(QUERIES["op11_collocations"](spark, sf), connect(sf), ORACLES["op11_collocations"])


def test_query_with_brute_force_at_a_low_threshold(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(C.collocations(docs, least=12, top=500)) == brute([(r.lang, r.text) for r in docs.collect()], 12, top=500)


def text_of(rng, n):
    words = ["a", "B", "the", "New", "york", "city hall", "é", "É", "don't", "x\x00y", "日本"]
    return "".join(rng.choice([*words, rng.choice(words)]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "? ", "\r\n"]) for _ in range(n))


@pytest.mark.parametrize("share", [0.0, 0.1, 1.0])
def test_any_sample_gives_the_same(spark, odd_docs, no_docs, share):
    """Without a sample every frequent phrase is a border failure."""
    rng = random.Random(4)
    docs = [(i if i % 9 else None, rng.choice(["en", "", None]), text_of(rng, rng.choice([0, 1, 3, 200]))) for i in range(80)]
    docs += [docs[7]] * 5 + [(900, "en", None), (901, "en", "new york city is big " * 400)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").repartition(3)
    want = brute([(lang, t) for _, lang, t in docs], 6, top=40, keep=90)
    assert len(want) > 60
    assert rows_of(C.collocations(df, least=6, top=40, keep=90, share=share)) == want
    if share == 0.1:
        assert rows_of(C.collocations(odd_docs, least=2, share=share)) == brute([(r.lang, r.text) for r in odd_docs.collect()], 2)
        assert C.collocations(no_docs).count() == 0


def test_slices_and_a_full_filter_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    texts = [text_of(rng, 300) for _ in range(6)] + ["one two three four five six " * 50, "x" * 400 + " y z " * 30]
    seen = []
    for cut in (1, 17, 100, 10_000_000):
        monkeypatch.setattr(C, "SLICE", cut)
        out = Counter()
        full = type("B", (), {"value": np.full(1 << 14, 0xFFFFFFFFFFFFFFFF, np.uint64)})
        import pyarrow as pa

        for b in C._count(range(1, 6), full, None, None, iter([pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])])):
            for p, n in zip(*(b.column(i).to_pylist() for i in (0, 1)), strict=True):
                out[p] += n
        seen.append(out)
    assert all(s == seen[0] for s in seen)
    assert seen[0]["one two three four five\ten"] == 50


def test_failures_need_one_more_pass(spark, monkeypatch):
    """A phrase that the sample lacks is found by its failed parts, of all lengths at once."""
    passes = []
    monkeypatch.setattr(C, "materialise", lambda df, name, real=C.materialise: passes.append(name) or real(df, name))
    docs = spark.createDataFrame([(1, "en", "uno dos tres quatro cinco. " * 200)], "doc_id long, lang string, text string")
    got = rows_of(C.collocations(docs, share=0.0))
    assert [r[2] for r in got] == ["uno dos tres quatro cinco"] and passes.count("frequent") == 2
    passes.clear()
    assert rows_of(C.collocations(docs, share=1.0)) == got and passes.count("frequent") == 1
