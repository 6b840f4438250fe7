import base64
import csv
import hashlib
import json
import math
import os
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest

from quern.llm import decontaminate, html_extract, quality, secret_scan, url_filter

from .conftest import prose


# quality


def test_quality_held_out_accuracy(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs, quality.train(docs, labels)).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(got) > 50 and (got.predicted == got.quality).mean() > 0.95
    assert ((got.score >= 0) & (got.score <= 1)).all() and (got.predicted == (got.score >= 0.7)).all()


def test_quality_odd_rows_and_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, "a"), (1, 0, "b"), (2, 1, "a"), (4, None, "a"), (None, 1, "a"), (999, 0, "a"), (7, 1, "a"), (10, 0, "a")], "doc_id long, quality int, text string")
    gam = quality.train(odd_docs, labels)
    got = quality.score_quality(odd_docs, gam)
    assert got.count() == odd_docs.count() and got.filter("score IS NULL OR predicted IS NULL OR held_out IS NULL").count() == 0
    assert quality.score_quality(no_docs, gam).count() == 0
    assert quality.keep_quality(odd_docs, gam).columns == odd_docs.columns
    blind = quality.train(odd_docs, labels.limit(0))
    assert {r.score for r in quality.score_quality(odd_docs, blind).collect()} == {0.5}


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = np.zeros((2000, len(quality.FEATURES)))
    x[:, :2] = rng.uniform(size=(2000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    gam = quality.fit(x, y, rounds=5, pair_rounds=60)
    assert (0, 1) in gam.pairs and ((gam.score(x) > 0.5) == y).mean() > 0.9


def plain_scores(x, y, new, rounds, pair_rounds, n_pairs, rate=0.15, leaves=3, l2=2.0):
    """The same model by its definition, in plain Python over lists of rows: scores of ``new``."""
    n, m = len(x), len(x[0])

    def quantile(values, q):
        v = sorted(values)
        at = q * (len(v) - 1)
        i = min(int(at), len(v) - 2)
        return v[i] + (v[i + 1] - v[i]) * (at - i)

    edges = [sorted({quantile([r[j] for r in x], k / 32) for k in range(1, 32)}) for j in range(m)]
    bins = lambda r: [sum(e <= r[j] for e in edges[j]) for j in range(m)]
    b = [bins(r) for r in x]
    base = math.log(sum(y) / (n - sum(y)))
    tables = [[0.0] * (len(e) + 1) for e in edges]
    pairs = {}

    def logit(r):
        return base + sum(t[k] for t, k in zip(tables, r, strict=True)) + sum(t[r[i] // 4][r[j] // 4] for (i, j), t in pairs.items())

    def residuals():
        p = [1 / (1 + math.exp(-logit(r))) for r in b]
        return [v - q for v, q in zip(y, p, strict=True)], [q * (1 - q) for q in p]

    def leaf(rows, g, h):
        return sum(g[i] for i in rows), sum(h[i] for i in rows) + l2

    def worth(rows, g, h):
        s, t = leaf(rows, g, h)
        return s * s / t

    for _ in range(rounds):
        for j in range(m):
            g, h = residuals()
            parts = [(0, len(tables[j]))]
            inside = lambda a, c, j=j: [i for i in range(n) if a <= b[i][j] < c]
            while len(parts) < leaves:
                best = max(((worth(inside(a, c), g, h) + worth(inside(c, d), g, h) - worth(inside(a, d), g, h), k, c) for k, (a, d) in enumerate(parts) for c in range(a + 1, d)), default=(0, 0, 0))
                if best[0] <= 1e-9:
                    break
                a, d = parts.pop(best[1])
                parts += [(a, best[2]), (best[2], d)]
            for a, d in parts:
                s, t = leaf(inside(a, d), g, h)
                for k in range(a, d):
                    tables[j][k] += rate * s / t
    g, h = residuals()
    cells = lambda i, j: [[[k for k in range(n) if b[k][i] // 4 == u and b[k][j] // 4 == v] for v in range(8)] for u in range(8)]
    gain = {(i, j): sum(worth(c, g, h) for row in cells(i, j) for c in row) for i in range(m) for j in range(i + 1, m)}
    chosen = sorted(gain, key=lambda k: (-gain[k], k))[:n_pairs]
    pairs.update({k: [[0.0] * 8 for _ in range(8)] for k in chosen})
    for _ in range(pair_rounds):
        for i, j in chosen:
            g, h = residuals()
            grid = cells(i, j)
            box = lambda a, c, d, e, grid=grid: [k for row in grid[a:c] for cell in row[d:e] for k in cell]
            best = (-1.0, [])
            for flip in (False, True):
                at = (lambda u, v, box=box: box(*u, *v)) if not flip else (lambda u, v, box=box: box(*v, *u))
                for cut in range(1, 8):
                    sides = [max((worth(at(u, (0, c)), g, h) + worth(at(u, (c, 8)), g, h), c) for c in range(1, 8)) for u in ((0, cut), (cut, 8))]
                    total = sides[0][0] + sides[1][0]
                    if total > best[0] + 1e-12:
                        best = (total, [(u, v) if not flip else (v, u) for u, (_, c) in zip(((0, cut), (cut, 8)), sides, strict=True) for v in ((0, c), (c, 8))])
            for (a, c), (d, e) in best[1]:
                s, t = leaf(box(a, c, d, e), g, h)
                for u in range(a, c):
                    for v in range(d, e):
                        pairs[i, j][u][v] += rate * s / t
    return [1 / (1 + math.exp(-logit(bins(r)))) for r in new]


def test_model_equals_plain_python():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    new = np.concatenate([x[:10], rng.normal(size=(20, 4)) * 2])
    gam = quality.fit(x, y, rounds=3, pair_rounds=2, n_pairs=2)
    assert np.allclose(gam.score(new), plain_scores(x.tolist(), y.tolist(), new.tolist(), 3, 2, 2), atol=1e-9)


def test_features_by_hand():
    f = dict(zip(quality.FEATURES, quality.features("The cat! the CAT 12 a|b\nthe cat\nThe end.\n"), strict=True))
    assert math.isclose(f["log_chars"], math.log1p(41)) and math.isclose(f["log_words"], math.log1p(10)) and math.isclose(f["mean_word"], 31 / 10)
    assert f["long_words"] == 0 and f["short_words"] == 0.1 and math.isclose(f["digits"], 2 / 41) and math.isclose(f["marks"], 3 / 41) and math.isclose(f["odd_marks"], 1 / 41)
    assert f["distinct_words"] == 0.8 and f["top_word"] == 0.2 and f["repeats_next"] == 0 and f["bars"] == f["exclaims"] == f["capital_words"] == 0.1
    assert f["repeated_lines"] == 0 and math.isclose(f["ends_in_stop"], 1 / 3) and math.isclose(f["upper"], 5 / 41)


def test_repeated_labelled_ids_are_one_training_row(spark):
    docs = spark.createDataFrame([(i % 40, prose(20 + i % 40, i % 40)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    one = quality.train(docs.dropDuplicates(["doc_id"]), labels)
    many = quality.train(docs, labels)
    x = np.array([quality.features(prose(30, k)) for k in range(9)])
    assert np.allclose(one.score(x), many.score(x), atol=1e-12)


# secrets


def brute_base(text):
    out = []
    for kind, pattern, group, least in (("assign", r"""(?a:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)):
        out += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return ",".join(s for _, _, s in sorted(out))


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x80 | len(size)]) + size) + body


def string(s):
    return len(s).to_bytes(4, "big") + s


def ssh(keys):
    public = string(string(b"ssh-ed25519") + string(bytes(range(32))))
    return secret_scan.SSH_MAGIC + b"".join(map(string, (b"none", b"none", b""))) + keys.to_bytes(4, "big") + public * keys + string(b"abcdabcd" + b"private" * 9)


def pkcs8(inner):
    return der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2b\x65\x70")), der(4, inner))


RSA = der(0x30, der(2, b"\0"), *(der(2, bytes(range(1, 60))) for _ in range(8)))
EC = der(0x30, der(2, b"\1"), der(4, bytes(range(32))), der(0xA0, der(6, b"\x2a\x86\x48")))
DSA = der(0x30, der(2, b"\0"), *(der(2, bytes(range(1, 40))) for _ in range(5)))
PKCS8 = pkcs8(der(4, bytes(32)))
SEALED = der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")), der(0x30, der(0x30, der(6, b"\x2a\x03")))), der(4, bytes(64)))
SSH, SSH_MANY = ssh(1), ssh(20)
KEYS = [(RSA, "der"), (EC, "der"), (DSA, "der"), (PKCS8, "der"), (pkcs8(RSA), "der"), (pkcs8(EC), "der"), (SEALED, "der"), (SSH, "ssh"), (SSH_MANY, "ssh")]
#: Cut, or longer than said; PKCS#8 around prose or around more than a key; a digest's structure; an SSH key whose public part doesn't fill its strings.
NO_KEYS = [RSA[:-1], RSA + b"\0", SSH[:-3], b"\x30\x03\x02\x01\x05" * 20, bytes(90), pkcs8(b"plain prose, which is no key at all, is it?"), pkcs8(der(4, b"x") + b"z"), der(0x30, der(0x30, der(6, b"\x2b\x0e\x03"), der(5)), der(4, bytes(40))), SSH.replace(b"ssh-ed25519", b"ssh-ed2551", 1)]
B64 = lambda b: base64.b64encode(b).decode()
URL64 = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
TOKEN = URL64(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()) + "." + URL64(b'{"sub":"1"}') + "." + URL64(b"signature-bytes")


@pytest.mark.parametrize("data, kind", [*KEYS, *((d, None) for d in NO_KEYS)])
def test_structures_are_parsed_to_the_end(data, kind):
    for text in (f"é key {B64(data)} end", f"x {data.hex()} y" if kind != "ssh" else f"k: {B64(data)}", f"-----BEGIN PRIVATE KEY-----\n{B64(data)[:40]}\n{B64(data)[40:]}\n-----END PRIVATE KEY-----"):
        got = {k for _, _, k in secret_scan.confirmed_spans(text)}
        assert got == ({kind} if kind else set())


@pytest.mark.parametrize("data, kind", KEYS)
def test_keys_wrapped_over_lines_without_marks(data, kind):
    whole = B64(data)
    for width in (64, 76):
        lines = [whole[i : i + width] for i in range(0, len(whole), width)]
        for end in ("\n", "\r\n  ", "\\n", "\\r\\n"):
            said = end.join(lines)
            for before, after in (("", ""), ("k=", "\nnext line of words"), ("MAB" + "a" * 50 + "\n", " end"), ("x\\n", "\n")):
                assert secret_scan.confirmed_spans(before + said + after)[-1:] == [(len(before), len(before) + len(said), kind)]
    label = "X" * 80
    assert [s[2] for s in secret_scan.confirmed_spans(f"-----BEGIN {label}-----\n{chr(10).join(lines)}\n-----END {label}-----")] == [kind]


@pytest.mark.parametrize("data, kind", [(RSA, "der"), (PKCS8, "der"), (SSH, "ssh")])
def test_keys_after_names_and_in_escaped_pem(data, kind):
    for name in ("PRIVATE_KEY=", "key=", "https://h.example/?k=", "a --key=", "x=-", "a-b/"):
        for text in (name + B64(data), name + URL64(data) + "&x=1"):
            assert [s for s in secret_scan.confirmed_spans(text) if s[2] == kind] == [(len(name), len(name) + len(re.match(r"[\w+/=-]*", text[len(name) :].split("&")[0])[0]), kind)]
    lines = [B64(data)[i : i + 64] for i in range(0, len(B64(data)), 64)]
    head = ["Proc-Type: 4,CLEAR", "DEK-Info: none-x,00\tff", ""]
    for body in (lines, head + lines):
        for end in ("\n", "\r\n", "\\n", "\\r\\n"):
            pem = end.join(["-----BEGIN PRIVATE KEY-----", *body, "-----END PRIVATE KEY-----"])
            for text in (f'{{"key": "{pem}{end}"}}', pem.replace("/", "\\/") if "\\" in end else pem):
                assert (text.index("-----BEGIN"), text.rindex("-----") + 5, kind) in secret_scan.confirmed_spans(text), text


def test_long_pem_and_no_slow_search():
    long = pkcs8(der(4, bytes(100_000)))
    assert [s[2] for s in secret_scan.confirmed_spans("-----BEGIN PRIVATE KEY-----\n" + B64(long) + "\n-----END PRIVATE KEY-----")] == ["der"]
    assert [s[2] for s in secret_scan.confirmed_spans("x=" + B64(long))] == ["der"]
    start = time.monotonic()
    for part in ("-----BEGIN K-----\n", "-----BEGIN K-----", "-----BEGIN K-----a:", "a: b\n", "M" + "A" * 50 + "\n", "MA" * 30 + "/"):
        secret_scan.confirmed_spans("-----BEGIN K-----" + part * 20_000)
    assert time.monotonic() - start < 20


def test_signed_tokens():
    assert [s[2] for s in secret_scan.confirmed_spans(f"a {TOKEN} b")] == ["jwt"]
    assert not secret_scan.confirmed_spans("a " + TOKEN.replace("eyJhbGciOi", "eyJhbGdiOi", 1) + " b")
    assert not secret_scan.confirmed_spans("a " + "abcdefgh.ijklmnop.qrstuvwx" * 2)


def test_base_spans_match_brute_force(odd_docs, no_docs, spark):
    rng = random.Random(5)
    parts = ["password=", "Token: ", 'api_key"="', "apikey =", "SECRET:", "abcdef0123", "AKIA", "ABCDEFGH12345678", "a1b2c3d4e5f60718293a4b5c", " ", "x", "é", "==", ":", "\n", "passwd='", "tokentoken=abc", "…"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(1500)]
    got = secret_scan.scan(texts)
    for t, d, n in zip(texts, got["base_sha256"], got["n_hex"], strict=True):
        assert d == hashlib.sha256(brute_base(t).encode()).hexdigest()
        assert n == brute_base(t).count("hex:")
    rows = secret_scan.scan_secrets(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r.spans for r in rows if r.doc_id == 3} == {""}
    assert secret_scan.scan_secrets(no_docs).count() == 0


# URLs


def test_url_parts_and_rules(spark):
    cases = [
        (1, "HTTPS://Www.Example.COM/en/712?q#f", "www.example.com", "/en/712", "example.com/en/7", "allow"),
        (2, "http://a.com/en/5", "a.com", "/en/5", "com/en/", "block"),
        (3, "http://b.example.net/de/81", "b.example.net", "/de/81", "example.net/de/8", "block"),
        (4, "http://x.net/de/9#y", "x.net", "/de/9", "net/de/", "allow"),
        (5, "//org/es/", "", "", None, None),
        (6, None, "", "", None, None),
        (7, "x://org/es/?a://b", "org", "/es/", "org/es/", "block"),
        (8, "http://forg/es/", "forg", "/es/", None, None),
        (9, "http://h?x/y", "h", "", None, None),
        (10, "", "", "", None, None),
        (10, "", "", "", None, None),
    ]
    pages = spark.createDataFrame([(c[0], c[1], "h", "p") for c in cases], "page_id long, url string, host string, path string")
    weights = url_filter.fit_url_model(url_filter.labelled_urls(spark))
    got = sorted(url_filter.judge_urls(pages, weights).collect(), key=lambda r: r.page_id)
    assert [(r.page_id, r.host, r.path, r.rule) for r in got] == [c[:1] + c[2:5] for c in cases]
    assert all(r.verdict == c[5] for r, c in zip(got, cases, strict=True) if c[5]) and {r.verdict for r in got} <= {"allow", "block"}
    assert url_filter.judge_urls(pages.limit(0), weights).count() == 0


def test_url_model_tells_unseen_hosts(spark):
    weights = url_filter.fit_url_model(url_filter.labelled_urls(spark))
    bad = ["shop.cheap-pills.example.org/fr/1", "best-casino.example.com/x", "xxx-video.example.net/"]
    good = ["library.example.org/fr/1", "weather-news.example.com/x", "www.thtion.example.net/"]
    p = url_filter.Score(weights, 14)(bad + good)["p_unwanted"]
    assert (p[:3] > 0.5).all() and (p[3:] < 0.5).all()
    with pytest.raises(ValueError, match="more than"):
        url_filter.fit_url_model(url_filter.labelled_urls(spark), max_rows=10)


def plain_model(rows, bits=14, rounds=300):
    """The same model by its definition, with dictionaries and loops over grams: weights by slot, bias."""

    def slots(text):
        points = [ord(c) for c in "\x02" + text + "\x03"]
        found, most = [], (1 << 64) - 1
        for n in (3, 4, 5):
            for i in range(len(points) - n + 1):
                h = n
                for x in points[i : i + n]:
                    h = (h ^ x) * 0x9E3779B97F4A7C15 & most
                    h ^= h >> 29
                found.append((h * 0xBF58476D1CE4E5B9 & most) >> 64 - bits)
        return found

    def score(text, w, bias):
        s = slots(text)
        return 1 / (1 + math.exp(-(sum(w[k] for k in s) / math.sqrt(max(1, len(s))) + bias)))

    rows = sorted(rows)
    grams = [slots(t) for t, _ in rows]
    w, g2, bias = [0.0] * (1 << bits), [1e-8] * (1 << bits), 0.0
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-(sum(w[k] for k in s) / math.sqrt(max(1, len(s))) + bias))) for s in grams]
        e = [(a - y) / len(rows) for a, (_, y) in zip(p, rows, strict=True)]
        g = [1e-4 * x for x in w]
        for x, s in zip(e, grams, strict=True):
            for k in s:
                g[k] += x / math.sqrt(len(s))
        for k, x in enumerate(g):
            g2[k] += x * x
            w[k] -= 2.0 * x / math.sqrt(g2[k]) * 0.1
        bias -= 2.0 * sum(e)
    return lambda text: score(text, w, bias)


def test_url_model_equals_plain_python(spark):
    rows = [(f"{w}.example/{p}", y) for y, words in ((1, "casino pills betting"), (0, "library garden school")) for w in words.split() for p in ("a", "b/c")]
    weights = url_filter.fit_url_model(spark.createDataFrame([("http://" + t, y) for t, y in rows], "url string, label int"), bits=8, rounds=40)
    plain = plain_model(rows, 8, 40)
    texts = [t for t, _ in rows] + ["", "x", "é日本🙂/a", "casino.org", "http" * 50]
    assert np.allclose(url_filter.Score(weights, 8)(texts)["p_unwanted"], [plain(t) for t in texts], atol=1e-4)


def test_url_model_on_hosts_that_share_no_word(spark):
    """Accuracy on a file of hosts none of whose names has a word (four letters or more) of the labelled table."""
    with open(url_filter.LABELS, newline="") as f:
        words = {w for r in csv.DictReader(f) for w in r["host"].split(".")[0].split("-") if len(w) >= 4}
    with open(Path(__file__).with_name("url_held_out.csv"), newline="") as f:
        held = [(int(r["label"]), r["host"] + r["path"]) for r in csv.DictReader(f)]
    assert not [(w, h) for _, h in held for w in words if w in h.split("/")[0]]
    p = url_filter.Score(url_filter.fit_url_model(url_filter.labelled_urls(spark)), 14)([h for _, h in held])["p_unwanted"]
    right = (p >= 0.5) == np.array([y for y, _ in held], bool)
    assert right.mean() >= 0.55, (right.mean(), [h for (_, h), r in zip(held, right, strict=True) if not r])


def test_labelled_hosts_are_not_those_of_the_pages(spark, sf):
    words = {w for r in spark.read.parquet(f"{sf}/pages.parquet").collect() for w in r.url.split("://")[-1].split("/")[0].lower().split(".")}
    with open(url_filter.LABELS, newline="") as f:
        assert not words & {r["host"].split(".")[0] for r in csv.DictReader(f)}


# pages


def page(body, n=0, head="<nav><ul><li><a>Home {n}</a></li></ul></nav>"):
    return f"<!DOCTYPE html><html><head><title>t</title><script>var x='</p>'</script></head><body>{head.replace('{n}', str(n))}{body}<footer>&copy; {n}</footer></body></html>"


def test_wrapper_induction_drops_constant_blocks(spark):
    rows = [(i, f"http://h.example/{i}", page(f"<div id=main><h1>Title {i}</h1><div>Share this story with friends</div><p>{prose(30, i)}<p>More of {i} &amp; so on</div><div class=sidebar>S {i}</div>", i)) for i in range(12)]
    rows += [(100, "http://alone.example/", page("<article><h1>A</h1><p>one <b>two</b>three<br>four</article>")), (101, None, None), (102, "no host", "<p>x<p> y&nbsp;z"), (103, "http://h.example/1", rows[1][2]), (103, "http://h.example/1", rows[1][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'a' AS host", "'b' AS wrapper", "'c' AS text")
    got = {r.page_id: r for r in html_extract.extract_pages(pages).collect()}
    for i in range(12):
        assert got[i].text == f"Title {i} {prose(30, i)} More of {i} & so on" and got[i].n_chars == len(got[i].text)
    assert (got[100].text, got[101].text, got[102].text, got[103].text) == ("A one twothree four", "", "x y z", got[1].text)
    assert html_extract.extract_pages(pages).count() == len(rows) and html_extract.extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("inner", ["<section><p>{}</p></section>", "<ul><li>{}</li></ul>", "<blockquote><p>{}</p></blockquote>", "<table><tr><td>{}</td></tr></table>", "<section><div><p>{0}</p></div><p>near {0}</p></section>"])
def test_nothing_outside_a_large_inner_block_is_lost(spark, inner):
    body = lambda i: f"<div class=post><p>intro {i}</p>{inner.format(prose(60, i))}<p>end {i}</p></div>"
    want = lambda i: " ".join(re.sub("<[^>]*>", " ", body(i)).split())
    assert html_extract.extract(page(body(1)), None) == want(1)
    pages = spark.createDataFrame([(i, f"http://p.example/{i}", page(body(i), i)) for i in range(8)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()} == {i: want(i) for i in range(8)}


def test_template_is_found_whatever_the_menus_and_the_first_page(spark):
    menu = "<nav><ul>" + "".join(f"<li>Entry {k}</li>" for k in range(30)) + "</ul></nav>"
    notice = "<div class=box>Share this story with friends</div>"
    body = lambda i: f"<div class=post><p>{prose(30, i)}</p>{notice if i else ''}<p>end {i}</p></div>"
    for first in (None, "", page(body(0), 0, menu), page("<table><tr><td>other layout</td></tr></table>", 0, menu)):
        rows = [(0, "http://t.example/0", first)] + [(i, f"http://t.example/{i}", page(body(i), 0, menu)) for i in range(1, 9)]
        got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert all(got[i] == f"{prose(30, i)} end {i}" for i in range(1, 9))
        assert got[0] == ("" if not first else "other layout" if "other" in first else f"{prose(30, 0)} end 0")


def test_copies_are_no_template(spark):
    same = [prose(30, k) for k in range(5)]
    rows = [(i, f"http://c.example/{i}", page("<div class=post>" + "".join(f"<p>{t}</p>" for t in same) + f"<p>end {i}</p></div>", i)) for i in range(8)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: " ".join(same) + f" end {i}" for i in range(8)}


def tree(nested, outer=-1, out=None):
    """A skeleton from (label, children)."""
    out = [] if out is None else out
    out.append([outer, nested[0], "", 0, 0])
    me = len(out) - 1
    for c in nested[1:]:
        tree(c, me, out)
    return out


def test_simple_tree_matching_is_the_largest_ordered_matching():
    a = tree(("r", ("a",), ("b",), ("c", ("x",), ("y",))))
    b = tree(("r", ("b",), ("a",), ("c", ("y",), ("z",))))
    assert len(html_extract.match(a, b)) == 4 and html_extract.match(tree(("a",)), tree(("b",))) == []

    def largest(x, y):  # by its definition, over nested tuples
        if x[0] != y[0]:
            return 0
        rows = [[0] * len(y) for _ in range(len(x))]
        for i in range(1, len(x)):
            for j in range(1, len(y)):
                rows[i][j] = max(rows[i - 1][j], rows[i][j - 1], rows[i - 1][j - 1] + largest(x[i], y[j]))
        return 1 + rows[-1][-1]

    rng = random.Random(3)

    def grown(depth):
        return (rng.choice("ab"), *(grown(depth - 1) for _ in range(rng.randrange(5) if depth else 0)))

    for _ in range(300):
        x, y = ("r", *(grown(3) for _ in range(4))), ("r", *(grown(3) for _ in range(4)))
        s, t = tree(x), tree(y)
        pairs = html_extract.match(s, t)
        assert len(pairs) == largest(x, y) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        partner = dict(pairs)
        assert all(s[i][1] == t[j][1] and (i == 0 or partner[s[i][0]] == t[j][0]) for i, j in pairs)


def test_very_deep_and_very_wide_pages():
    start = time.monotonic()
    deep = "<div>" * 50_000 + "text" + "</div>" * 50_000 + "<p>end"
    other = "<div>" * 49_990 + "<ul><li>a</ul>" + "</div>" * 40_000
    assert html_extract.extract(deep, ["x"]) == "text end"
    html_extract.skeletons([deep, other])
    assert len(html_extract.match(*map(html_extract.skeleton, (deep, other)))) == 49_991
    wide = "<ul>" + "".join(f"<li>entry {i}" for i in range(20_000)) + "</ul>"
    holes = "<ul>" + "".join(f"<li>entry {i}" if i % 7 else f"<li><p>e {i}</p>" for i in range(19_990)) + "</ul>"
    assert len(html_extract.match(*map(html_extract.skeleton, (wide, holes)))) == 19_992
    assert html_extract.extract("<div>" * 50_000 + "</section>" * 50_000 + "x", None) == "x"
    assert html_extract.extract("<li>" * 50_000 + "x", None) == html_extract.extract("<p>" * 50_000 + "x", None) == "x"
    assert time.monotonic() - start < 60


def test_wrapper_alone_tells_menus_and_template_without_telling_names(spark):
    """No article, no telling tag or class: menus differ from page to page, a notice is the same; only the wrapper finds both."""
    rng = random.Random(9)

    def made(i):
        menu = "".join(f'<li><a href="/{rng.randrange(99)}">{prose(2, rng.randrange(10**6))}</a>' for _ in range(3 + i % 4))
        near = "".join(f'<div><a href="#">{prose(4, rng.randrange(10**6))}</a></div>' for _ in range(4))
        return f"<html><body><div class=xa><ul>{menu}</ul></div><div class=xb><h2>Title {i}</h2><p>{prose(40, i)} <a href=#>one link</a></p><ul><li>point {i}<li>other {i}</ul></div><div class=xc>Terms of use apply to all readers</div><div class=xd>{near}</div></body></html>"

    rows = [(i, f"http://w.example/{i}", made(i)) for i in range(12)]
    want = {i: f"Title {i} {prose(40, i)} one link point {i} other {i}" for i in range(12)}
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    assert all(html_extract.extract(h, None) != want[i] for i, _, h in rows)


def test_indexes_keep_their_links(spark):
    rows = [(i, f"http://l.example/{i}", "<html><body><ul>" + "".join(f"<li><a href=#>{prose(5, 100 * i + k)}</a>" for k in range(9)) + f"</ul><p>{prose(6, i)}</p></body></html>") for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join([*(prose(5, 100 * i + k) for k in range(9)), prose(6, i)]) for i in range(8)}


@pytest.mark.parametrize("broken", ["<", "<p", "<!--", "<div class=", "<a title=\"x>y", "<p>a</div></p>b", "</p></p>", "<script>", "<style>x</style", "<p>" * 300, "<a><div><a>x</div></a>", "<li></ul><li>"])
def test_broken_markup_never_fails(broken):
    assert isinstance(html_extract.extract(broken, None), str)
    html_extract.skeletons([broken])


# benchmark


def spoilt(text, rate, rng):
    out = list(text)
    for _ in range(int(len(out) * rate)):
        i = rng.randrange(len(out))
        out[i] = rng.choice(["", "q", out[i] + "z"])
    return "".join(out)


def test_passages_are_found_with_edits_and_clean_documents_left(spark, odd_docs, no_docs):
    rng = random.Random(2)
    items = [(i, prose(25 + i, 200 + i)) for i in range(12)] + [(90, None), (91, "  "), (None, prose(40)), (92, "short one here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, want = [], set()
    for k in range(60):
        i = k % 12
        text = prose(150, 500 + k)
        if k < 40:
            passage = items[i][1].upper().replace(" ", "\n  ", 3) if k % 4 == 0 else spoilt(items[i][1], 0.04 * (k % 3), rng)
            text = f"{text[:400]} {passage} {text[400:]}"
            want.add((k, i))
        rows.append((k, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.find_passages(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and all(r.edits == 0 for r in got if r.doc_id % 4 == 0 and r.doc_id < 40)
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == set(range(40, 60))
    assert decontaminate.find_passages(odd_docs, bench).count() == 0 and decontaminate.drop_contaminated(no_docs, bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == 60


def test_short_items_are_found_as_whole_words(spark):
    bench = spark.createDataFrame([(1, "forty two"), (2, "x"), (3, "Q: no?"), (4, "日本"), (5, "seventeen letters"), (6, "forty two")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "the answer is Forty   two, of course"), (2, "fortytwo xx"), (3, "forty two"), (4, "a x b"), (5, "q: no?"), (6, "in 日本 と"), (7, "seventeen letters"), (8, "seventeen lettersx"), (9, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start, r.end, r.edits) for r in decontaminate.find_passages(docs, bench).collect())
    assert got == [(1, 1, 14, 23, 0), (1, 6, 14, 23, 0), (3, 1, 0, 9, 0), (3, 6, 0, 9, 0), (4, 2, 2, 3, 0), (5, 3, 0, 6, 0), (6, 4, 3, 5, 0), (7, 5, 0, 17, 0)]
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {2, 8, 9}


def fewest_edits(a, b):
    """Fewest edits by which ``a`` occurs anywhere in ``b``, by the full table."""
    row = np.zeros(len(b) + 1, np.int64)
    b = np.array([*map(ord, b)])
    for i, x in enumerate(a, 1):
        new = np.append(i, np.minimum(row[1:] + 1, row[:-1] + (b != ord(x))))
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row.min())


def test_passages_equal_brute_force_both_ways():
    """Each segment of each item against each text by the full table of edits: found if and only if within its budget."""
    rng = random.Random(12)
    items = [(i, prose(n, 40 + i)) for i, n in enumerate((3, 4, 8, 14, 17, 40))]
    texts = [prose(60, 400 + k) for k in range(30)]
    for k in range(24):
        some = items[k % 6][1]
        cut = rng.randrange(max(1, len(some) // 3)) if k % 3 == 0 else 0
        texts[k] = f"{texts[k][:150]} {spoilt(some[cut:], rng.choice([0, 0.04, 0.08, 0.12, 0.2]), rng)} {texts[k][150:]}"
    block = decontaminate.Block([(i, decontaminate.normalised(t)) for i, t in items])
    got = {(k, item) for k, found in enumerate(decontaminate.find(block, texts)) for item, *_ in found}
    want = {(k, i) for k, t in enumerate(texts) for s in range(len(block.text)) for i in block.items[s] if fewest_edits(block.text[s], decontaminate.normalised(t)) <= block.k[s]}
    assert got == want and len(want) > 10


@pytest.mark.parametrize("length", [121, 140, 150, 151, 233, 400])
def test_excerpts_are_found_at_every_offset(length):
    item = prose(80, 77)[:length].strip().ljust(length, "x")
    block = decontaminate.Block([(1, item)])
    texts = [f"{prose(20, 900 + s)} {item[s : s + 120].strip()} {prose(20, 800 + s)}" for s in range(length - 119) if " " not in (item[s], item[s + 119])]
    assert texts and all(f and {x[0] for x in f} == {1} for f in decontaminate.find(block, texts))


def test_benchmark_in_several_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(i, prose(40, i)) for i in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(i, prose(60, 300 + i) + " " + prose(40, i)) for i in range(6)], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 500)
    assert len(decontaminate.blocks(bench)) > 2
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_passages(docs, bench).collect()} == {(i, i) for i in range(6)}


def test_banded_distance_equals_full_table():
    rng = random.Random(8)
    for _ in range(200):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 25)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(0, 8))) + spoilt(a, 0.2, rng) + "".join(rng.choice("ab") for _ in range(rng.randrange(0, 8)))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        k = 6
        got = decontaminate.banded_distance(decontaminate.points(a), decontaminate.points(b), k)
        assert (got[0] if got else None) == (min(row) if min(row) <= k else None)


def test_repeated_characters_and_shared_prompts_equal_brute_force(monkeypatch):
    """Few different q-grams, each at many places, and items that share most of their text; small bounds, so that slices are cut everywhere."""
    rng = random.Random(31)
    prompt = prose(7, 5)[:60]
    items = [(0, "-" * 130), (1, "=-" * 40), (2, "-" * 130), *((10 + i, f"{prompt} {prose(4, 70 + i)}") for i in range(5))]
    texts = ["-" * 129, "-" * 700, "-" * 100 + "=" + "-" * 300, "=-" * 300, "".join(rng.choice("-=") for _ in range(400)), " ".join(f"{prompt} {prose(4, 70 + i % 5)}" for i in range(12)), prose(90, 1)]
    for tile, hits in ((2048, 4_000_000), (193, 5_000), (500, 50)):
        monkeypatch.setattr(decontaminate, "TILE", tile)
        monkeypatch.setattr(decontaminate, "HITS", hits)
        block = decontaminate.Block([(i, decontaminate.normalised(t)) for i, t in items])
        found = decontaminate.find(block, texts)
        want = {(k, i) for k, t in enumerate(texts) for s in range(len(block.text)) for i in block.items[s] if fewest_edits(block.text[s], decontaminate.normalised(t)) <= block.k[s]}
        assert {(k, item) for k, fs in enumerate(found) for item, *_ in fs} == want and len(want) >= 12
        assert [f[:3] for f in found[1] if f[0] in (0, 2)] == [(0, 0, 700), (2, 0, 700)]


def _in_a_process_of_its_own(code, seconds, megabytes):
    import subprocess
    import sys

    run = subprocess.run([sys.executable, "-c", f"import resource; resource.setrlimit(resource.RLIMIT_AS, ({megabytes} << 20,) * 2)\n{code}"], cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), capture_output=True, text=True, timeout=seconds, env=os.environ | {"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1"})
    assert run.returncode == 0, run.stderr[-800:]
    return run.stdout.split()


def test_long_runs_and_many_quotes_stay_within_memory():
    runs = "from quern.llm import decontaminate as d\nb = d.Block([(1, '-' * 130)])\nprint([[x[:3] for x in f] for f in d.find(b, ['-' * 1_500_000, '-= ' * 200_000])])"
    assert "".join(_in_a_process_of_its_own(runs, 60, 3000)) == "[[(1,0,1500000)],[]]"
    quotes = (
        "from quern.llm import decontaminate as d\nimport random\nr = random.Random(1)\np = ' '.join(f'word{r.randrange(99)}' for _ in range(13))\n"
        "items = [(i, f'{p} {i:05d}') for i in range(300)]\nb = d.Block(items)\nf = d.find(b, [' '.join(f'{p} {i:05d}' for i in range(200))])\nprint(len({x[0] for x in f[0]}), len(f[0]))"
    )
    assert _in_a_process_of_its_own(quotes, 120, 3000) == ["300", "60000"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="page no-sidebar"><p>Main text here.', "Main text here."),
        ('<div class="content has-comments"><p>Main', "Main"),
        ('<article class="post header-fixed"><p>Main', "Main"),
        ('<div class="menu">m</div><div class="social-science"><p>Main text</div>', "Main text"),
        ('<div class="comments"><p>all there is', "all there is"),
        ('<p>One two three</p><div class="sidebar-left">s</div><div class="comment-list">c</div><div id="social-share">z</div><div class="site-footer">f</div>', "One two three"),
        ("<p>a<!-->b</p><p>c</p><!-- n --><p>d", "ab c d"),
        ("<p>a<!-- <p>b", "a"),
        ("<ul><li>a<ul><li>b</li><li>c</ul><li>d</ul>e", "a b c d e"),
    ],
)
def test_names_tell_of_blocks_and_not_of_pages(page, text):
    assert html_extract.extract(page, None) == text


def test_lists_of_sources_inside_articles_stay(spark):
    links = lambda s, i: "<ul class=refs>" + "".join(f"<li><a href=/{s}{i}{j}>{prose(2, 50 * i + j)}</a></li>" for j in range(4)) + "</ul>"
    pages = [(i, f"http://x.example/{i}", f"<html><body><ul class=top>{links('m', i)}</ul><article><p>{prose(40, i)}</p><h2>Sources</h2>{links('s', i + 100)}</article></body></html>") for i in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for r in html_extract.extract_pages(df).collect():
        want = " ".join([prose(40, r.page_id), *(prose(2, 50 * (r.page_id + 100) + j) for j in range(4))])
        assert r.text.replace(" Sources ", " ").endswith(want)  # the heading is the same on all pages, and so template


def test_broken_pages_take_time_in_proportion():
    for page in ("<a " * 350_000, '<p x="' * 170_000, "<div>" * 100_000 + "<li>" * 100_000, "<li><ul>" * 10_000 + "<div>" * 80_000 + "</li>" * 100_000, "<div><li>" * 60_000 + '<p x="' * 60_000 + ">", "<!--" * 250_000, "< <" * 300_000):
        began = time.time()
        html_extract.extract(page, None)
        assert time.time() - began < 10, page[:12]
