import hashlib
import re
from collections import defaultdict

from quern.llm import exact_dedup
from quern.llm._common import scratch


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        for i in ids:
            out.append((i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force_on_odd_rows(odd_docs):
    got = exact_dedup.exact_groups(odd_docs).collect()
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({b[3] for b in brute(rows)})


def test_empty(no_docs):
    assert exact_dedup.exact_groups(no_docs).count() == 0
    assert exact_dedup.drop_exact_copies(no_docs).columns == no_docs.columns


def test_index_persists_and_appends_only_what_is_new(spark, odd_docs):
    index = exact_dedup.DigestIndex(spark, scratch(spark, "index"), 4)
    first = odd_docs.filter("doc_id <= 2")
    exact_dedup.exact_groups(first, index)
    n = index.table().count()
    exact_dedup.exact_groups(first, index)
    assert index.table().count() == n
    again = exact_dedup.DigestIndex(spark, index.path, 4)
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_groups(odd_docs.filter("doc_id = 2 OR doc_id = 9"), again).collect()}
    assert got == {2: (1, False), 9: (9, True)}
    assert index.compact(scratch(spark, "compact")).table().count() == again.table().count() == n + 1


def test_stage_keeps_one_row_of_each_text(odd_docs):
    kept = exact_dedup.drop_exact_copies(odd_docs).collect()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept]
    assert len(norm) == len(set(norm)) == 7  # prose twice, "", a long one, "a b c d", x, and one of many scripts
    assert 1 in [r.doc_id for r in kept] and 2 not in [r.doc_id for r in kept]


def test_anti_join_removes_what_earlier_batches_brought(spark, sf, monkeypatch):
    """Batches are raw: the index must drop the texts that it has, else rows would double."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    removed, plain = [], exact_dedup.DigestIndex.unknown

    def unknown(self, batch):
        left = plain(self, batch)
        removed.append(batch.count() - left.count())
        return left

    monkeypatch.setattr(exact_dedup.DigestIndex, "unknown", unknown)
    assert exact_dedup.exact_groups(docs).count() == docs.count()
    assert removed[0] == 0 and removed[1] > 0
    monkeypatch.setattr(exact_dedup.DigestIndex, "unknown", lambda self, batch: batch)
    assert exact_dedup.exact_groups(docs).count() > docs.count()


def test_leaves_no_table_in_the_catalog(spark, odd_docs):
    before = {t.name for t in spark.catalog.listTables()}
    exact_dedup.exact_groups(odd_docs).collect()
    exact_dedup.drop_exact_copies(odd_docs).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_one_id_with_several_texts(spark):
    docs = spark.createDataFrame([(3, "B"), (5, "A"), (5, "B"), (None, "B"), (7, "z  z"), (7, "z z"), (7, "z z")], "doc_id long, text string")
    assert sorted((r.doc_id, re.sub(" +", " ", r.text)) for r in exact_dedup.drop_exact_copies(docs).collect()) == [(3, "B"), (5, "A"), (7, "z z")]
    got = exact_dedup.exact_groups(docs).collect()
    assert sorted((r.doc_id, r.keep_id) for r in got if r.kept) == [(3, 3), (5, 5), (7, 7)] and len(got) == 7


def test_hot_group_is_dealt_over_salts(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE concat('t', id) END AS text")
    got = exact_dedup.exact_groups(docs).filter("keep_id = 0")
    assert got.count() == 1000 and got.filter("kept").count() == 1
