"""The corpus operators' queries over whole tables, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, collocations, decontaminate, exact_dedup, html_extract, near_dedup, packing, quality, secret_scan, shallot, token_counts, token_files, url_filter
from ._common import scratch, table


def vocabulary(name: str) -> str:
    """A public tokenizer's file; the package is installed on every worker at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = url_filter.fit_url_model(url_filter.labelled_urls(spark))
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), weights)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    index = token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), path)
    return token_files.token_positions(index, path)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shallot.clusters(table(spark, sf_dir, "embeddings"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_exact_dedup, op3_token_counts, op4_secret_scan, op5_bpe_codec, op6_near_dedup, op7_html_extraction, op8_url_filter, op9_token_files, op10_decontamination, op11_collocations, op12_clustering, op13_packing)}



def _kmeans_sql(rounds: int = 5, k: int = 40, dims: int = 64) -> str:
    """Every vector against every centroid, in long form (vector or centroid, component, value)."""
    near = "SELECT vec_id, c, d FROM (SELECT v.vec_id, m.c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM v JOIN m{r} m USING (i) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1"
    sql = f"""WITH v AS MATERIALIZED (SELECT vec_id, i, CAST(floor(256 * CAST(embedding[i + 1] AS DOUBLE)) AS BIGINT) AS x FROM embeddings, range({dims}) t(i)
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
        m0 AS MATERIALIZED (SELECT c, i, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM (SELECT DISTINCT vec_id FROM v) ORDER BY c LIMIT {k}) USING (vec_id))"""
    for r in range(rounds):
        sql += f""", a{r} AS MATERIALIZED ({near.format(r=r)}),
            m{r + 1} AS MATERIALIZED (SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{r} JOIN v USING (vec_id) GROUP BY ALL)
                UNION ALL SELECT c, i, x FROM m{r} WHERE c NOT IN (SELECT c FROM a{r}))"""
    return sql + f""", z AS MATERIALIZED ({near.format(r=rounds)})
        SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
        FROM z JOIN (SELECT c, sha256(string_agg(x, ',' ORDER BY i)) AS h FROM m{rounds} GROUP BY c) USING (c)"""


ORACLES = {
    "op11_collocations": r"""
        WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) r(k)) GROUP BY ALL HAVING count(*) >= 100),
        n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
        c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
        s AS (SELECT c.lang, c.k, c.phrase, a, p.f AS l, q.f AS r, n, (1000::HUGEINT * a * n) // (p.f::HUGEINT * q.f) AS score
            FROM c JOIN range(1, 5) g(j) ON j < c.k JOIN f p ON p.lang = c.lang AND p.phrase = array_to_string(ws[1:j], ' ') JOIN f q ON q.lang = c.lang AND q.phrase = array_to_string(ws[j + 1:c.k], ' ') JOIN n ON n.lang = c.lang
            QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, j) = 1),
        b AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.lang = s.lang AND x.k > s.k AND contains(' ' || x.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * x.a >= 100 * s.a))
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM b QUALIFY rank <= 2000""",
    "op12_clustering": _kmeans_sql(),
    "op2_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
        FROM d""",
}
