import itertools
import random

import numpy as np

from quern.llm import near_dedup

from .conftest import prose


def classes(rows, threshold=0.8):
    """Smallest id of each row's class by brute force over all pairs of different word sequences."""
    words = [(t or "").lower().split() for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if words[i] == words[j] or (sets[i] and len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) >= threshold):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    best = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            best[root(i)] = min(best.get(root(i), k), k)
    return sorted(((k, best.get(root(i))) for i, (k, _) in enumerate(rows)), key=str)


def edited(text, n, rng):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_odd_rows(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = near_dedup.near_groups(odd_docs).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == classes(rows)
    kept = near_dedup.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 7, 8, 10, 11]


def test_one_id_with_several_texts_and_repeated_rows(spark):
    rng = random.Random(1)
    base = [prose(90, 70 + k) for k in range(3)]
    rows = [(1, base[0]), (1, base[0]), (1, base[1]), (2, edited(base[0], 1, rng)), (None, edited(base[1], 1, rng)), (4, base[2]), (4, base[2]), (9, "other words"), (9, base[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (12, 1):
        got = near_dedup.near_groups(docs, pairs_up_to=most).collect()
        assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == classes(rows)
        assert sorted(r.class_size for r in got) == [1, 2, 2, 2, 2, 4, 4, 4, 4]
        kept = near_dedup.drop_near_copies(docs, pairs_up_to=most).collect()
        assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, base[0]), (1, base[1]), (4, base[2]), (9, "other words")])


def test_hot_group_of_near_copies_loses_no_class(spark):
    rng = random.Random(6)
    base = prose(120, 5)
    rows = [(k, edited(base, k % 3, rng)) for k in range(150)] + [(500 + k, edited(prose(80, k), 0, rng)) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_groups(docs, pairs_up_to=4).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == classes(rows)


def test_empty(no_docs):
    assert near_dedup.near_groups(no_docs).count() == 0
    assert near_dedup.drop_near_copies(no_docs).count() == 0


def test_planted_copies_match_brute_force_in_small_and_large_buckets(spark):
    rng = random.Random(3)
    rows = [(i, prose(80 + i % 50, i)) for i in range(40)]
    for base in range(8):
        rows += [(100 * (base + 1) + j, edited(rows[base][1], j % 5, rng)) for j in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes(rows)
    for most in (12, 2):
        assert sorted(((r.doc_id, r.class_id) for r in near_dedup.near_groups(docs, pairs_up_to=most).collect()), key=str) == want


def test_copies_that_differ_in_repeated_lines_share_a_band():
    missed = 0
    for k in range(300):
        line = prose(30, 5000 + k).split()
        once, often = (" ".join([prose(60, k), *line * n, *line[:4]]) for n in (1, 200))
        keys = near_dedup.sketch_texts([once, often + " " + prose(12, 9000 + k), often])["bands"]
        missed += sum(not set(keys[0].tolist()) & set(x.tolist()) for x in keys[1:])
        a, b = near_dedup.shingle_sets([once, often + " " + prose(12, 9000 + k)])["shingles"]
        assert len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    assert missed == 0, missed


def test_sketches_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    a = {k: float(w) for k, w in zip(range(60), rng.uniform(1, 4, 60), strict=True)}
    b = {k: float(w) for k, w in zip(range(20, 80), rng.uniform(1, 4, 60), strict=True)}
    p, q = ({k: w / sum(x.values()) for k, w in x.items()} for x in (a, b))
    true = sum(1 / sum(max(p.get(j, 0) / p[i], q.get(j, 0) / q[i]) for j in p.keys() | q.keys()) for i in p.keys() & q.keys())
    elements = near_dedup.mix(np.array([*a, *b], np.uint64) + np.uint64(99))
    doc = np.repeat([0, 1], [len(a), len(b)])
    got = near_dedup.sketches(elements, np.array([*a.values(), *b.values()]), doc, 2, 4096)
    assert abs((got[0] == got[1]).mean() - true) < 0.03


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "a long, b long")
    got = {r.node: r.label for r in near_dedup.components(links).collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 51: 50}
