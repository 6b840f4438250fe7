"""Derived views over the driver's tables; one SQL text for both engines (``1e0`` is a double in both)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "scored": """
        SELECT o_orderkey AS sample_id, o_custkey AS entity_id, o_totalprice / 500000e0 AS label,
               LEAST(GREATEST(o_totalprice / 500000e0 + (CAST((o_orderkey * 7919) % 101 AS DOUBLE) - 50e0) / 500e0
                 + CASE WHEN o_orderstatus = 'F' THEN 3e-2 ELSE 0e0 END, 0e0), 1e0) AS pred,
               CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS grp, CAST(o_orderkey % 5 AS INT) AS fold
        FROM orders""",
    "preds": """
        SELECT s.sample_id, s.label, s.grp, m.model,
               LEAST(GREATEST(s.pred + (CAST((s.sample_id * m.k) % 31 AS DOUBLE) - 15e0) / 400e0, 0e0), 1e0) AS pred
        FROM scored s CROSS JOIN (SELECT 'm1' AS model, 17 AS k UNION ALL SELECT 'm2', 23 UNION ALL SELECT 'm3', 29) m
        WHERE NOT (m.model = 'm2' AND s.sample_id % 11 = 0)""",
    "history": """
        SELECT event_id, user_id AS run_id, CAST(user_id % 6 AS INT) AS experiment_id, event_type AS metric, value,
               CAST(ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS BIGINT) AS step
        FROM events""",
    "runs": """
        SELECT c_custkey AS run_id, CONCAT('exp', CAST(c_nationkey % 6 AS VARCHAR(9)), '_trial', CAST(c_custkey AS VARCHAR(9))) AS run_name,
               CAST(c_nationkey % 6 AS INT) AS experiment_id, CAST(c_custkey * 37 % 1009 AS BIGINT) AS start_time, c_mktsegment AS pooling,
               CAST(c_nationkey AS VARCHAR(9)) AS grid_size, c_acctbal AS lr,
               CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE (c_acctbal + 1000e0) / 11000e0 END AS score,
               CASE WHEN c_custkey % 7 = 0 THEN 'FAILED' ELSE 'FINISHED' END AS status
        FROM customer""",
    "axes": """
        SELECT run_id, 'pooling' AS axis, pooling AS value, score FROM runs
        UNION ALL SELECT run_id, 'grid_size', grid_size, score FROM runs
        UNION ALL SELECT run_id, 'lr', CAST(CAST(FLOOR(lr) AS BIGINT) AS VARCHAR(9)), score FROM runs""",
    "vectors": "SELECT vec_id, vec_id % 20 AS entity_id, embedding, label, CAST(label AS DOUBLE) / 9e0 AS y FROM embeddings",
    "seg_px": """
        SELECT l_orderkey % 50 AS image_id, CAST(l_suppkey % 5 AS INT) AS pred,
               CASE WHEN l_quantity > 48 THEN 255 WHEN l_linenumber % 2 = 0 THEN CAST(l_suppkey % 5 AS INT)
                    ELSE CAST(l_partkey % 5 AS INT) END AS gt
        FROM lineitem""",
    "depth_px": """
        SELECT l_orderkey % 50 AS image_id, l_extendedprice / 10000e0 AS gt, l_extendedprice / 10000e0 * (9e-1 + l_discount + l_tax) AS pred
        FROM lineitem""",
    "corruption": "SELECT event_type AS ctype, CAST(user_id % 5 AS INT) + 1 AS level, CASE WHEN value > 30 THEN 1 ELSE 0 END AS correct FROM events",
    "aug_pool": """
        SELECT p_partkey AS aug_id, (p_partkey * 13) % 997 AS source_a, (p_partkey * 29) % 997 AS source_b, p_partkey AS source_blend,
               CAST(p_size AS DOUBLE) / 50e0 AS label, CAST(p_partkey % 2 AS INT) AS grp
        FROM part""",
    "class_scores": "SELECT vec_id AS id, slice(embedding, 1, 10) AS scores, label AS target, array(label, (label + 3) % 10) AS targets, CAST(vec_id % 3 AS INT) AS attr_a, CAST(vec_id % 2 AS INT) AS attr_b FROM embeddings",
    "target_pmf": """
        SELECT bin, SUM(m) / SUM(SUM(m)) OVER () AS mass
        FROM (SELECT CAST(o_orderkey % 100 AS INT) AS bin, o_totalprice * EXP(-CAST(o_orderkey % 100 AS DOUBLE) / 30e0) AS m FROM orders) t GROUP BY bin""",
}
#: The same where DuckDB spells a function another way.
DUCK = {"class_scores": VIEWS["class_scores"].replace("slice(embedding, 1, 10)", "embedding[1:10]").replace("array(label, (label + 3) % 10)", "[label, (label + 3) % 10]")}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")


def _uses(sql: str) -> list[str]:
    return [n for n in (*VIEWS, *TABLES) if re.search(rf"\b(FROM|JOIN)\s+{n}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver or a view over them."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    parts = {n: view(spark, sf_dir, n) for n in _uses(sql)}
    for n in parts:
        sql = re.sub(rf"\b(FROM|JOIN)(\s+){n}\b", rf"\1\2{{{n}}}", sql)
    return spark.sql(sql, **parts)


def duck(sql: str) -> str:
    """DuckDB SQL with the views that it uses put before it."""
    found: list[str] = []

    def need(text: str) -> None:
        for n in _uses(text):
            if n in VIEWS and n not in found:
                need(DUCK.get(n, VIEWS[n]))
                found.append(n)

    need(sql)
    views = [f"{n} AS ({DUCK.get(n, VIEWS[n])})" for n in found]
    text = sql.strip()
    recursive = text[:14].upper() == "WITH RECURSIVE"
    if text[:4].upper() == "WITH":
        text = text[14 if recursive else 4 :].strip()
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join([*views, text])
    return (f"WITH {', '.join(views)} " if views else "") + text
