"""Queries of the vector, near-duplicate, outlier and probe operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.expr import dot, vec_template
from quern.operators import joins as J
from quern.operators import neighbours as N
from quern.operators import probes as P
from quern.operators import vectors as V
from quern.operators.metrics import agg_entity_stats
from quern.plans.fixtures import view
from quern.plans.registry import registry, rounded

QUERIES, ORACLES, query = registry()

#: The driver's vectors are nearly orthogonal, so queries use lower thresholds than the operators' defaults.
INTRA, CROSS = 0.30, 0.40
DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
PAIRS = f"(SELECT a.vec_id AS a, b.vec_id AS b, {DOT} AS similarity FROM vectors a JOIN vectors b ON a.vec_id < b.vec_id WHERE {DOT} >= {INTRA}e0)"
WITHIN = f"(SELECT a.vec_id AS a, b.vec_id AS b, a.entity_id AS entity, {DOT} AS similarity FROM vectors a JOIN vectors b ON a.entity_id = b.entity_id AND a.vec_id < b.vec_id WHERE {DOT} >= 2e-1)"
#: Pairs of different entities, and clusters of both kinds of pairs.
ACROSS = f"(SELECT a.vec_id AS a, b.vec_id AS b, {DOT} AS similarity FROM vectors a JOIN vectors b ON a.vec_id < b.vec_id AND a.entity_id <> b.entity_id WHERE {DOT} >= {CROSS}e0)"
CLUSTERS = """edges AS MATERIALIZED (SELECT a, b FROM {pairs} UNION ALL SELECT b, a FROM {pairs}), reach(node, other) AS (SELECT a, a FROM edges UNION SELECT reach.node, edges.b FROM reach JOIN edges ON edges.a = reach.other),
    members AS MATERIALIZED (SELECT node, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS cluster_size FROM (SELECT node, min(other) AS cluster_id FROM reach GROUP BY node))"""
STATS = f"""m AS MATERIALIZED (SELECT node AS vec_id, cluster_id, cluster_size, v.entity_id, v.embedding, v.y FROM members JOIN vectors v ON v.vec_id = members.node),
    c AS MATERIALIZED (SELECT cluster_id, any_value(cluster_size) AS cluster_size, count(DISTINCT entity_id) AS n_entities, round(max(y) - min(y), 4) AS label_spread, round(median(y), 4) AS cluster_median,
      (SELECT round(min({DOT}), 4) FROM m a JOIN m b ON a.cluster_id = b.cluster_id AND a.vec_id < b.vec_id WHERE a.cluster_id = m.cluster_id) AS cohesion FROM m GROUP BY cluster_id)"""


@query("""SELECT vec_id, round(sqrt(list_dot_product(t, t)), 6) AS norm, round(t[1], 6) AS first, round(t[64], 6) AS last FROM (SELECT vec_id, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS t FROM
    (SELECT vec_id, list_transform(e, lambda x: x - list_sum(e) / 64) AS c FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)))""")
def vec_template_(spark, sf):
    out = view(spark, sf, "embeddings").select("vec_id", vec_template("embedding").alias("t"))
    return rounded(out.select("vec_id", F.sqrt(dot("t", "t")).alias("norm"), F.col("t")[0].alias("first"), F.col("t")[63].alias("last")))


QUERIES["vec_template"], ORACLES["vec_template"] = QUERIES.pop("vec_template_"), ORACLES.pop("vec_template_")


@query("SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vec_cosine(spark, sf):
    e = view(spark, sf, "embeddings")
    return rounded(e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id").select("vec_id", dot("embedding", "y").alias("similarity")))


@query(f"SELECT a, b, entity, round(similarity, 6) AS similarity FROM {WITHIN}")
def join_pairs_within(spark, sf):
    return rounded(V.join_pairs_within(view(spark, sf, "vectors"), 0.2))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({DOT}, 6) AS similarity FROM vectors a JOIN vectors b ON a.vec_id < b.vec_id AND a.entity_id <> b.entity_id WHERE {DOT} >= {CROSS}e0")
def join_pairs_cross(spark, sf):
    return rounded(V.join_pairs_cross(view(spark, sf, "vectors"), CROSS))


NEAR = "(SELECT q.vec_id AS query_id, q.label AS truth, t.vec_id AS train_id, t.label AS label, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])), 12) AS similarity FROM embeddings q JOIN embeddings t ON q.vec_id % 20 = 0 AND t.vec_id % 20 <> 0)"


def split(spark, sf):
    e = view(spark, sf, "embeddings")
    return e.filter("vec_id % 20 = 0"), e.filter("vec_id % 20 <> 0")


@query(f"SELECT query_id, train_id, round(similarity, 6) AS similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, train_id) AS rank FROM {NEAR}) WHERE rank <= 10")
def join_knn_topk(spark, sf):
    return rounded(N.join_knn_topk(*split(spark, sf), 10, cells=24, probes=3))


@query("SELECT count(*) AS n_queries, true AS reached FROM embeddings WHERE vec_id % 20 = 0")
def join_knn_topk_recall(spark, sf):
    """Of the exact neighbours at least nine in ten are found by as many probes as were measured to be enough."""
    asked, train = split(spark, sf)
    exact, near = (N.join_knn_topk(asked, train, 10, cells=24, probes=3, recall=r).select("query_id", "train_id") for r in (None, 0.9))
    hits = near.join(exact, ["query_id", "train_id"]).agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(exact.agg(F.count(F.lit(1)).alias("all"))).join(asked.agg(F.count(F.lit(1)).alias("n_queries"))).select("n_queries", (F.col("hits") >= 0.9 * F.col("all")).alias("reached"))


@query(f"""
    WITH n AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, train_id) AS rank FROM {NEAR}) WHERE rank <= 100),
    p AS (SELECT *, e / sum(e) OVER (PARTITION BY query_id) AS p FROM (SELECT *, exp((similarity - max(similarity) OVER (PARTITION BY query_id)) / 7e-2) AS e FROM n)),
    v AS (SELECT k, query_id, truth, label, round(sum(p), 12) AS p FROM p JOIN (SELECT unnest([10, 20, 100]) AS k) ks ON rank <= k GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY k, query_id ORDER BY p DESC, label) AS place FROM v)
    SELECT k, round(count(*) FILTER (place = 1 AND label = truth) * 1e0 / count(DISTINCT query_id), 9) AS top1, round(count(*) FILTER (place <= 5 AND label = truth) * 1e0 / count(DISTINCT query_id), 9) AS top5, count(DISTINCT query_id) AS n FROM r GROUP BY k""")
def knn_vote(spark, sf):
    return rounded(N.knn_vote(*split(spark, sf), ks=(10, 20, 100)), 9)


@query(f"SELECT round(-avg(ln(sqrt(greatest(2 - 2 * s, 0)) + 1e-8)), 6) AS spread, count(*) AS n FROM (SELECT a.vec_id, max(round({DOT} / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 12)) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY a.vec_id)")
def agg_nn_spread(spark, sf):
    return rounded(N.agg_nn_spread(view(spark, sf, "embeddings")))


def balanced(n: int) -> str:
    sql = "l AS (SELECT id AS sample, CAST(c AS INT) AS prototype, scores[c + 1] AS logit FROM class_scores, range(10) t(c)), q0 AS (SELECT sample, prototype, exp((CAST(logit AS DOUBLE) - (SELECT max(logit) FROM l)) / 1e-1) AS q FROM l)"
    for i in range(n):
        sql += f", c{i} AS (SELECT sample, prototype, q / sum(q) OVER (PARTITION BY prototype) / 10 AS q FROM q{i}), q{i + 1} AS (SELECT sample, prototype, q / sum(q) OVER (PARTITION BY sample) / (SELECT count(*) FROM class_scores) AS q FROM c{i})"
    return f"WITH {sql} SELECT sample, prototype, round(q * (SELECT count(*) FROM class_scores), 6) AS q FROM q{n}"


@query(balanced(3))
def agg_balanced_assign(spark, sf):
    long = view(spark, sf, "class_scores").select(F.col("id").alias("sample"), F.posexplode("scores").alias("prototype", "logit")).withColumn("logit", F.col("logit").cast("double"))
    return rounded(V.agg_balanced_assign(long, 0.1))


def clustered(spark, sf):
    vecs = view(spark, sf, "vectors")
    return vecs, V.dup_clusters(V.join_links_within(vecs, 0.2))


def across(spark, sf):
    vecs = view(spark, sf, "vectors")
    return vecs, V.dup_clusters(V.join_links_cross(vecs, CROSS), "cross")


@query(f"WITH RECURSIVE {CLUSTERS.format(pairs=WITHIN)} SELECT node, cluster_id, 'intra' AS scope, cluster_size FROM members")
def dup_clusters(spark, sf):
    return clustered(spark, sf)[1]


@query(f"WITH RECURSIVE {CLUSTERS.format(pairs=ACROSS)} SELECT node, cluster_id, 'cross' AS scope, cluster_size FROM members")
def dup_clusters_cross(spark, sf):
    return across(spark, sf)[1]


@query(f"WITH RECURSIVE {CLUSTERS.format(pairs=ACROSS)}, {STATS} SELECT cluster_id, 'cross' AS scope, cluster_size, n_entities, label_spread, cluster_median, cohesion FROM c")
def agg_cluster_stats_cross(spark, sf):
    vecs, members = across(spark, sf)
    return V.agg_cluster_stats(members, vecs)


@query(f"WITH RECURSIVE {CLUSTERS.format(pairs=WITHIN)}, {STATS} SELECT cluster_id, 'intra' AS scope, cluster_size, n_entities, label_spread, cluster_median, cohesion FROM c")
def agg_cluster_stats(spark, sf):
    vecs, members = clustered(spark, sf)
    return V.agg_cluster_stats(members, vecs)


def members(spark, sf):
    vecs, found = clustered(spark, sf)
    stats = V.agg_cluster_stats(found, vecs)
    return vecs, stats, found.select(F.col("node").alias("vec_id"), "cluster_id", "scope", "cluster_size").join(vecs.select("vec_id", "entity_id", "y"), "vec_id").join(stats.select("cluster_id", "cohesion", "label_spread"), "cluster_id")


@query(f"WITH RECURSIVE {CLUSTERS.format(pairs=WITHIN)}, {STATS} SELECT cluster_id, 'intra' AS scope, cluster_size, label_spread, cohesion FROM c WHERE cohesion >= 1e-1")
def flt_scope_gate(spark, sf):
    vecs, found = clustered(spark, sf)
    return J.flt_scope_gate(V.agg_cluster_stats(found, vecs), min_cohesion=0.1).select("cluster_id", "scope", "cluster_size", "label_spread", "cohesion")


FLAGS = """f AS (SELECT m.vec_id, m.cluster_id, m.cluster_size, m.entity_id, m.y, cohesion, median(y) OVER (PARTITION BY m.cluster_id) AS med FROM m JOIN (SELECT cluster_id, cohesion FROM c) USING (cluster_id)),
    g AS (SELECT *, round(abs(y - med), 9) > 1e-1 AS far FROM f), o AS (SELECT *, far AND cluster_size >= 3 AND count(*) FILTER (far) OVER (PARTITION BY cluster_id) < cluster_size - 1 AS outlier FROM g)"""


@query(f"WITH RECURSIVE {CLUSTERS.format(pairs=WITHIN)}, {STATS}, {FLAGS} SELECT vec_id, cluster_id, round(med, 9) AS cluster_median, outlier FROM o")
def dup_flag_cluster(spark, sf):
    return rounded(V.dup_flag_cluster(members(spark, sf)[2]).select("vec_id", "cluster_id", "cluster_median", "outlier"), 9)


CONSENSUS = """e AS (SELECT entity_id, median(y) AS em, count(*) AS n FROM vectors GROUP BY entity_id), p AS (SELECT o.*, em, round(abs(y - em), 9) > 1e-1 AS pfar FROM o JOIN e USING (entity_id) WHERE cluster_size = 2 AND n >= 4),
    prop AS (SELECT vec_id, entity_id, y, med AS consensus, 'cluster' AS source, cohesion, cluster_id FROM o WHERE outlier AND cohesion >= 5e-2
      UNION ALL SELECT vec_id, entity_id, y, em, 'entity', cohesion, cluster_id FROM p WHERE pfar AND cohesion >= 5e-2 AND cluster_id IN (SELECT cluster_id FROM p GROUP BY cluster_id HAVING count(*) FILTER (pfar) = 1))"""


@query(f"WITH RECURSIVE {CLUSTERS.format(pairs=WITHIN)}, {STATS}, {FLAGS}, {CONSENSUS} SELECT vec_id, entity_id, round(y, 9) AS y, round(consensus, 9) AS consensus, source, cohesion, cluster_id, round(abs(y - consensus), 6) AS deviation FROM prop")
def dup_flag_consensus(spark, sf):
    vecs, _, rows = members(spark, sf)
    stats = agg_entity_stats(vecs.select("entity_id", F.col("vec_id").alias("sample_id"), F.col("y").alias("label")))
    return rounded(V.dup_flag_consensus(rows, stats, min_cohesion=0.05), 9)


@query(f"""WITH RECURSIVE {CLUSTERS.format(pairs=WITHIN)}, {STATS}, {FLAGS}, {CONSENSUS}, {CLUSTERS.format(pairs=ACROSS).replace("edges", "edges2").replace("reach", "reach2").replace("members", "members2")},
      c2 AS (SELECT cluster_id, round(max(y) - min(y), 4) AS label_spread FROM members2 JOIN vectors v ON v.vec_id = members2.node GROUP BY cluster_id)
    SELECT 'clusters_intra' AS item, count(*) AS n FROM c HAVING count(*) > 0 UNION ALL SELECT 'conflicts_intra', count(*) FROM c WHERE label_spread >= 1e-1 HAVING count(*) > 0
    UNION ALL SELECT 'clusters_cross', count(*) FROM c2 HAVING count(*) > 0 UNION ALL SELECT 'conflicts_cross', count(*) FROM c2 WHERE label_spread >= 1e-1 HAVING count(*) > 0 UNION ALL SELECT 'flagged_' || source, count(*) FROM prop GROUP BY source""")
def dup_conflict_report(spark, sf):
    vecs, stats, rows = members(spark, sf)
    _, far = across(spark, sf)
    entities = agg_entity_stats(vecs.select("entity_id", F.col("vec_id").alias("sample_id"), F.col("y").alias("label")))
    return V.dup_conflict_report(stats.unionByName(V.agg_cluster_stats(far, vecs)), V.dup_flag_consensus(rows, entities, min_cohesion=0.05))


@query(f"WITH RECURSIVE {CLUSTERS.format(pairs=WITHIN)}, {STATS} SELECT cluster_id, cluster_size, label_spread FROM c ORDER BY label_spread >= 1e-1 DESC, label_spread DESC, cluster_id LIMIT 20")
def top_spread_clusters(spark, sf):
    vecs, found = clustered(spark, sf)
    return V.top_spread_clusters(V.agg_cluster_stats(found, vecs), 20).select("cluster_id", "cluster_size", "label_spread")


@query()
def probe_logreg(spark, sf):
    """All strengths; a fifth of the vectors to choose by, a fifth to report on."""
    e = view(spark, sf, "embeddings").withColumn("part", F.col("vec_id") % 5)
    train, val, test = (e.filter(c).drop("part") for c in ("part > 1", "part = 1", "part = 0"))
    return P.probe_logreg(train, val, test).select("vec_id", "label", "prediction", "val_score", "c")


@query("WITH v AS (SELECT experiment_id AS probe, avg(value) AS top1 FROM history WHERE metric = 'click' GROUP BY 1), b AS (SELECT probe FROM v ORDER BY top1 DESC, probe LIMIT 1) SELECT experiment_id AS probe, metric AS test_set, round(avg(value), 6) AS top1 FROM history WHERE experiment_id = (SELECT probe FROM b) GROUP BY 1, 2")
def probe_linear_select(spark, sf):
    h = view(spark, sf, "history")
    val = h.filter("metric = 'click'").groupBy(F.col("experiment_id").alias("probe")).agg(F.avg("value").alias("top1"))
    test = h.groupBy(F.col("experiment_id").alias("probe"), F.col("metric").alias("test_set")).agg(F.avg("value").alias("top1"))
    return rounded(V.probe_linear_select(val, test))


def _linear(batch):
    return batch.assign(score=batch.label * 0.5 + batch.pred * 0.25)[["sample_id", "score"]]


@query("SELECT sample_id, round(label * 5e-1 + pred * 25e-2, 9) AS score FROM scored")
def score_batch(spark, sf):
    return rounded(V.score_batch(view(spark, sf, "scored").select("sample_id", "label", "pred"), _linear, "sample_id long, score double"), 9)


@query("SELECT DISTINCT CAST(l_orderkey % 5000 - 10 AS BIGINT) AS index FROM lineitem WHERE l_orderkey % 5000 >= 10")
def score_dedupe_index(spark, sf):
    return V.score_dedupe_index(view(spark, sf, "lineitem").select((F.col("l_orderkey") % 5000 - 10).alias("index")))
