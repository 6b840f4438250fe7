"""The registered corpus queries over whole tables against SQL, the libraries and brute force."""

import hashlib
import html
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quern.llm import bpe_codec, decontaminate, quality, url_filter
from quern.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect

from .conftest import prose
from .test_near_dedup import classes, edited
from .test_text_operators import brute_base, fewest_edits


@pytest.fixture(scope="module")
def docs(spark, sf):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())


def test_exact_dedup_sql(spark, sf):
    compare(QUERIES["op2_exact_dedup"](spark, sf), connect(sf), ORACLES["op2_exact_dedup"])


def test_quality(spark, sf, docs):
    """Scores again from the trained tables, row by row in plain Python."""
    got = {r.doc_id: r for r in QUERIES["op1_quality"](spark, sf).collect()}
    assert {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in docs} == {i: r.held_out for i, r in got.items()}
    assert all(r.predicted == (r.score >= 0.7) for r in got.values())
    gam = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    for i, t in docs:
        bins = [sum(e <= v for e in edges) for v, edges in zip(quality.features(t), gam.edges, strict=True)]
        z = gam.base + sum(table[k] for table, k in zip(gam.tables, bins, strict=True)) + sum(table[bins[a] // 4][bins[b] // 4] for (a, b), table in gam.pairs.items())
        assert abs(got[i].score - 1 / (1 + np.exp(-z))) < 1e-9


def test_token_counts(spark, sf, docs):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [(i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 1024) for i, t in docs]
    assert sorted(tuple(r) for r in QUERIES["op3_token_counts"](spark, sf).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == want


def test_secret_scan(spark, sf, docs):
    got = {r.doc_id: r for r in QUERIES["op4_secret_scan"](spark, sf).collect()}
    for i, t in docs:
        base = brute_base(t)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [base.count(f"{k}:") for k in ("assign", "access", "hex")]
        assert set(filter(None, base.split(","))) <= set(got[i].spans.split(","))


def test_codec(spark, sf, docs):
    library = bpe_codec.open_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    got = {r.doc_id: r for r in QUERIES["op5_bpe_codec"](spark, sf).collect()}
    for i, t in docs:
        ids = library.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_near_dedup(spark, sf, docs):
    got = sorted(((r.doc_id, r.class_id) for r in QUERIES["op6_near_dedup"](spark, sf).collect()), key=str)
    assert got == classes(docs)


def test_html_extraction(spark, sf):
    def brute(page):
        inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        parts = (re.sub(r"<[^>]+>", "", p) for p in re.split(r"<(?:/?p|/?h1|br)>", inside))
        return " ".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)

    got = {r.page_id: r for r in QUERIES["op7_html_extraction"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        assert got[r.page_id].text == brute(r.html) and got[r.page_id].n_chars == len(brute(r.html)) and got[r.page_id].url == r.url


def test_url_filter(spark, sf):
    """Rules and the model's verdict by plain Python: an n-gram scorer of its own, trained from the same table."""
    got = {r.page_id: r for r in QUERIES["op8_url_filter"](spark, sf).collect()}
    weights = url_filter.fit_url_model(url_filter.labelled_urls(spark))

    def p_unwanted(text):
        points, most, slots = [ord(c) for c in "\x02" + text + "\x03"], (1 << 64) - 1, []
        for n in (3, 4, 5):
            for k in range(len(points) - n + 1):
                h = n
                for x in points[k : k + n]:
                    h = (h ^ x) * 0x9E3779B97F4A7C15 & most
                    h ^= h >> 29
                slots.append((h * 0xBF58476D1CE4E5B9 & most) >> 50)
        return 1 / (1 + np.exp(-(sum(float(weights[k]) for k in slots) / max(1, len(slots)) ** 0.5 + float(weights[-1]))))

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        m = re.match(r".*?://([^/?#]*)([^?#]*)", r.url, re.S)
        host, path = m[1].lower(), m[2]
        fits = [(v, h + p) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        verdict, rule = max(fits, key=lambda f: len(f[1]), default=(None, None))
        p = p_unwanted(host + path)
        assert abs(got[r.page_id].p_unwanted - p) < 1e-4
        if verdict is None:
            verdict = "block" if got[r.page_id].p_unwanted >= 0.5 else "allow"
        assert tuple(got[r.page_id])[:5] == (r.page_id, host, path, rule, verdict)


def test_token_files(spark, sf, docs):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want, start = [], 0
    for i, t in docs:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op9_token_files"](spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_decontamination(spark, sf, docs):
    """Every segment against every document that could hold it, by the full table of edits: found if and only if within the budget."""
    items = [(r.item_id, decontaminate.normalised(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r for r in QUERIES["op10_decontamination"](spark, sf).collect()}
    text = {i: decontaminate.normalised(t) for i, t in docs}
    whole = {(i, k) for i, t in text.items() for k, item in items if item in t}
    assert whole <= set(got)
    segments = [(k, s, max(0, min(int(len(s) * decontaminate.EDITS), (len(s) - decontaminate.Q - 1) // decontaminate.Q))) for k, item in items if len(item) >= decontaminate.LEAST for _, s in decontaminate.segments(item)]
    # of most + 1 disjoint pieces of a segment within its budget one is in the document unedited
    want = set()
    for k, s, most in segments:
        n = (len(s) - most) // (most + 1)
        pieces = {s[j * n : (j + 1) * n] for j in range(most + 1)}
        for i, t in text.items():
            if (i, k) not in want and any(x in t for x in pieces) and fewest_edits(s, t) <= most:
                want.add((i, k))
    assert set(got) == want
    for (i, k), r in got.items():
        assert r.edits > 0 or text[i][r.start : r.end] in dict(items)[k]


def test_pipeline_equals_brute_force(spark, tmp_path):
    """A small corpus with planted junk, copies, near copies and passages: every stage is told from plain Python."""
    import random

    rng = random.Random(11)
    items = [(i, prose(40, 700 + i)) for i in range(4)]
    rows = [(i, prose(60 + i % 30, i)) for i in range(40)]
    rows += [(100 + i, rows[i][1].replace(" ", "  ", 3)) for i in range(10)]
    rows += [(200 + i, edited(rows[20 + i][1], 1, rng)) for i in range(8)]
    rows += [(300 + i, prose(60, 50 + i) + " " + items[i % 4][1] + " " + prose(10, 90 + i)) for i in range(8)]
    rows += [(400 + i, "!! ".join(f"WORD{(i + j) % 5}" for j in range(80))) for i in range(40)]
    labels = [(i, 0 if i >= 400 else 1, 0) for i, _ in rows]
    rows += [(None, prose(70, 95)), (900, None)]
    spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = f"file://{tmp_path}"
    all_docs = spark.read.parquet(f"{sf}/documents.parquet")
    gam = quality.train(all_docs, spark.read.parquet(f"{sf}/labels.parquet"))
    left = [(i, t) for i, t in rows if gam.score(np.array([quality.features(t or "")]))[0] >= 0.7]
    assert all(i is None or i < 400 or i == 900 for i, _ in left) and {i for i, _ in rows if i is not None and i < 400} <= {i for i, _ in left}
    seen, exact = set(), []
    for i, t in sorted(left, key=lambda r: (r[0] is None, r[0] or 0)):
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        if key not in seen:
            seen.add(key)
            exact.append((i, t))
    best = dict(classes(exact))
    near = [(i, t) for i, t in exact if best[i] == i]
    clean = [(i, t) for i, t in near if not any(decontaminate.normalised(p) in decontaminate.normalised(t or "") for _, p in items)]
    library = bpe_codec.open_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    want = sorted((str(i), len(library.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in clean)
    got = sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want and 30 < len(want) < 60
    assert [n for n, _ in corpus_pipeline.STAGES][:1] == ["quality classifier"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, all_docs, sf).columns == all_docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, all_docs.limit(0), sf).count() == 0
