"""Queries of the trial, window, source, sink and streaming operators."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quern.functions.expr import floor_double
from quern.functions.expr import fn_interp as interp
from quern.functions.expr import fn_param_lines as param_lines
from quern.functions.expr import fn_range_label as range_label
from quern.functions.expr import fn_short as short
from quern.functions.expr import fn_uri_rewrite as uri_rewrite
from quern.functions.rank import shared_path
from quern.operators import trials as T
from quern.plans.fixtures import view
from quern.plans.registry import registry, rounded
from quern.sources import readers as IN
from quern.sources import sinks as OUT
from quern.streaming import live

QUERIES, ORACLES, query = registry()


@query("""
    WITH v AS (SELECT axis, value AS part, score FROM axes WHERE axis IN ('pooling', 'grid_size') AND value IS NOT NULL),
    x AS (SELECT axis, try_cast(value AS DOUBLE) AS x, score FROM axes WHERE axis = 'lr'), e AS (SELECT list_distinct(quantile_cont(x, [0, 25e-2, 5e-1, 75e-2, 1])) AS e FROM x),
    a AS (SELECT axis, part, score FROM v UNION ALL SELECT axis, 'q' || greatest(len(list_filter(e, lambda t: t < x)), 1), score FROM x, e)
    SELECT axis, part, count(*) AS n, round(min(score), 9) AS best, round(avg(score), 9) AS avg, round(median(score), 9) AS median FROM a GROUP BY axis, part""")
def agg_axis_breakdown(spark, sf):
    return rounded(T.agg_axis_breakdown(view(spark, sf, "axes"), ["pooling", "grid_size"], ["lr"]), 9)


@query("""
    SELECT axis, count(*) AS n, round(min(try_cast(value AS DOUBLE)), 6) AS lo, round(max(try_cast(value AS DOUBLE)), 6) AS hi, round(stddev_samp(try_cast(value AS DOUBLE)), 6) AS std, count(DISTINCT value) AS n_distinct,
           array_to_string(list_sort(list_distinct(list(value)))[1:6], '|') AS first_values FROM axes WHERE value IS NOT NULL GROUP BY axis""")
def agg_axis_coverage(spark, sf):
    return rounded(T.agg_axis_coverage(view(spark, sf, "axes")))


@query("SELECT run_id, round(score, 9) AS score FROM runs WHERE status = 'FINISHED' AND score IS NOT NULL ORDER BY score, run_id LIMIT 15")
def agg_best_trials(spark, sf):
    return rounded(T.agg_best_trials(view(spark, sf, "runs"), 15).select("run_id", "score"), 9)


BEST = """m AS (SELECT *, coalesce(value < min(value) OVER (PARTITION BY run_id, metric ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM history),
    i AS (SELECT *, step - max(CASE WHEN better THEN step END) OVER (PARTITION BY run_id, metric ORDER BY step) AS idle FROM m), s AS (SELECT *, min(CASE WHEN idle >= 3 THEN step END) OVER (PARTITION BY run_id, metric) AS stops FROM i)"""


@query(f"WITH {BEST} SELECT run_id, metric, arg_min(step, struct_pack(v := value, s := step)) AS best_epoch, round(min(value), 9) AS best_value, max(step) AS stopped_at FROM s WHERE stops IS NULL OR step <= stops GROUP BY run_id, metric")
def agg_best_epoch(spark, sf):
    return rounded(T.agg_best_epoch(view(spark, sf, "history"), 3, ["run_id", "metric"]), 9)


@query("SELECT run_id, round(min(score) OVER (PARTITION BY experiment_id ORDER BY start_time, run_id), 9) AS best_so_far FROM runs")
def win_best_so_far(spark, sf):
    return rounded(T.win_best_so_far(view(spark, sf, "runs")).select("run_id", "best_so_far"), 9)


@query("SELECT experiment_id, run_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY score DESC NULLS LAST, run_id) AS rank FROM runs) WHERE rank <= 5")
def win_top_n_per_group(spark, sf):
    return T.win_top_n_per_group(view(spark, sf, "runs"), 5, ["experiment_id"], "score", desc=True).select("experiment_id", "run_id", "rank")


@query("""
    WITH l AS (SELECT run_id, metric, arg_max(value, step) AS v FROM history WHERE step > 12 GROUP BY 1, 2), f AS (SELECT run_id, metric, avg(value) AS f FROM history GROUP BY 1, 2)
    SELECT run_id, metric, round(coalesce(v, f), 6) AS last_value FROM l FULL JOIN f USING (run_id, metric)""")
def win_last_value(spark, sf):
    h = view(spark, sf, "history")
    fallback = h.groupBy("run_id", "metric").agg(F.avg("value").alias("value"))
    return rounded(T.win_last_value(h.filter("step > 12"), fallback))  # shorter histories have a summary only


@query("SELECT event_id, round(100e0 * step / max(step) OVER (PARTITION BY run_id), 6) AS progress FROM history")
def win_progress(spark, sf):
    return rounded(T.win_progress(view(spark, sf, "history")).select("event_id", "progress"))


RECENT = "OVER (PARTITION BY run_id, metric ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query(f"""SELECT run_id, metric, step, round(l[CAST(floor((len(l) + 1) / 2) AS BIGINT)], 6) AS median, round(a, 6) AS avg, round(g, 6) AS global_avg, round(m, 6) AS max FROM (
    SELECT run_id, metric, step, list_sort(list(value) {RECENT}) AS l, avg(value) {RECENT} AS a, avg(value) OVER (PARTITION BY run_id, metric ORDER BY step) AS g, max(value) {RECENT} AS m FROM history)""")
def win_smoothed(spark, sf):
    return rounded(T.win_smoothed(view(spark, sf, "history")).drop("value"))


WERR = "round((1/30e0 + label) * (pred - label) * (pred - label), 12)"


@query(f"""
    SELECT side, CAST(rank AS INT) AS rank, sample_id, round(werr, 9) AS werr FROM (SELECT 'worst' AS side, row_number() OVER (ORDER BY werr DESC, sample_id) AS rank, sample_id, werr FROM (SELECT sample_id, {WERR} AS werr FROM scored)
    UNION ALL SELECT 'best', row_number() OVER (ORDER BY werr, sample_id), sample_id, werr FROM (SELECT sample_id, {WERR} AS werr FROM scored)) WHERE rank <= 20""")
def top_worst_best_k(spark, sf):
    return rounded(T.top_worst_best_k(view(spark, sf, "scored"), 20).select("side", "rank", "sample_id", "werr"), 9)


@query("SELECT sample_id, label FROM scored WHERE label > 9e-1 ORDER BY label DESC, sample_id")
def top_label_tail(spark, sf):
    return T.top_label_tail(view(spark, sf, "scored"), 0.9).select("sample_id", "label")


ORDERS = {"best": "score ASC NULLS LAST", "worst": "score DESC NULLS LAST", "recent": "start_time DESC NULLS LAST"}


@query(" UNION ALL ".join(f"SELECT '{m}' AS mode, run_id, row_number() OVER (ORDER BY {o}, run_id) AS position FROM runs" for m, o in ORDERS.items()))
def srt_trial_order(spark, sf):
    out = None
    for mode in ORDERS:
        one = T.srt_trial_order(view(spark, sf, "runs"), mode).select(F.lit(mode).alias("mode"), "run_id", "position")
        out = one if out is None else out.unionByName(one)
    return out


# ---- scalar functions


@query("SELECT sample_id, round(CASE WHEN pred <= 0 THEN 0 WHEN pred <= 2e-1 THEN pred / 2e-1 * 1e-1 WHEN pred <= 6e-1 THEN 1e-1 + (pred - 2e-1) / 4e-1 * 7e-1 WHEN pred < 1 THEN 8e-1 + (pred - 6e-1) / 4e-1 * 2e-1 ELSE 1 END, 9) AS y FROM scored")
def fn_interp(spark, sf):
    xs, ys = (F.array(*(F.lit(v) for v in p)) for p in ((0.0, 0.2, 0.6, 1.0), (0.0, 0.1, 0.8, 1.0)))
    return rounded(view(spark, sf, "scored").select("sample_id", interp("pred", xs, ys).alias("y")), 9)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 's3://other/' || c_custkey ELSE CASE WHEN c_custkey % 3 = 0 THEN 'file://' ELSE '' END || '/data/new/mlruns/' || c_nationkey || '/a' END AS uri FROM customer")
def fn_uri_rewrite(spark, sf):
    c = view(spark, sf, "customer")
    old = F.when(F.col("c_custkey") % 3 == 2, F.concat(F.lit("s3://other/"), F.col("c_custkey"))).otherwise(F.concat(F.when(F.col("c_custkey") % 3 == 0, "file://").otherwise(""), F.lit("/home/x/mlruns/old/mlruns/"), F.col("c_nationkey"), F.lit("/a")))
    return c.select("c_custkey", uri_rewrite(old, "mlruns", "/data/new/").alias("uri"))


@query("SELECT doc_id, CAST(regexp_extract(source, 'src([0-9]+)', 1) AS BIGINT) AS entity, lang || ':' || substr(source, 1, 2) AS family, CASE WHEN contains(lower(lang), 'en') THEN 'english' ELSE 'other' END AS label FROM documents")
def fn_text_parts(spark, sf):
    d = view(spark, sf, "documents")
    return d.select("doc_id", F.nullif(F.regexp_extract("source", r"src(\d+)", 1), F.lit("")).cast("long").alias("entity"), F.concat_ws(":", "lang", F.substring("source", 1, 2)).alias("family"), F.when(F.lower("lang").contains("en"), "english").otherwise("other").alias("label"))


def with_params(spark, sf):
    return view(spark, sf, "runs").withColumn("params", F.create_map(F.lit("pooling"), "pooling", F.lit("grid_size"), "grid_size", F.lit("pretrain_lr"), F.col("lr").cast("decimal(12,2)").cast("string")))


@query("""SELECT * FROM (SELECT run_id, 'pooling' AS param, pooling AS value FROM runs UNION ALL SELECT run_id, 'grid_size', grid_size FROM runs UNION ALL SELECT run_id, 'pretrain_lr', CAST(CAST(lr AS DECIMAL(12,2)) AS VARCHAR) FROM runs)
    WHERE contains(lower(param), 'in') OR contains(lower(value), 'in')""")
def flt_params(spark, sf):
    return T.flt_params(with_params(spark, sf), "In")


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 57) || '...' ELSE text END AS short FROM documents")
def fn_short(spark, sf):
    return view(spark, sf, "documents").select("doc_id", short("text").alias("short"))


@query("SELECT run_id, printf('[%.3f, %.3f]', floor(lr / 1e3), floor(lr / 1e3) + 1) AS label FROM runs")
def fn_range_label(spark, sf):
    low = floor_double(F.col("lr") / 1000)
    return view(spark, sf, "runs").select("run_id", range_label(low, low + 1).alias("label"))


@query("SELECT run_id, run_name || '|pooling=' || CASE WHEN length(pooling) > 8 THEN left(pooling, 5) || '...' ELSE pooling END || '|grid_size=' || grid_size AS lines FROM runs")
def fn_param_lines(spark, sf):
    return with_params(spark, sf).select("run_id", param_lines("run_name", "params", ["pooling", "absent", "grid_size"], 8, "|").alias("lines"))


# ---- sources and sinks: tables are written by Spark in the format first, then read by the operator


def written(spark, df, name, put):
    path = shared_path(spark, name)
    put(df.write, path)
    return path


def put_files(spark, rows, name):
    """Files of the names in ``name`` with their rows' ``content`` in order, under a new shared folder; each
    folder, and each file that lies in none, is written by one task, so that making folders takes no longer with more tasks."""
    root = shared_path(spark, name)

    def put(batches):
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(root)
        last, out, n, made = None, None, 0, set()
        for batch in batches:
            names, contents = batch.name.to_numpy(object), batch.content.to_numpy(object)
            starts = [*np.flatnonzero(np.append(True, names[1:] != names[:-1])), len(names)] if len(names) else []
            for a, b in zip(starts, starts[1:], strict=False):
                if names[a] != last:
                    if out is not None:
                        out.close()
                    path = f"{folder}/{names[a]}"
                    if (parent := path.rsplit("/", 1)[0]) not in made:
                        system.create_dir(parent, recursive=True)
                        made.add(parent)
                    last, out, n = names[a], system.open_output_stream(path), n + 1
                out.write("".join(contents[a:b]).encode())
        if out is not None:
            out.close()
        yield pd.DataFrame({"n": [n], "folders": [len(made)]})

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, so that small rows, each a file, are not put together in one task
    folder = F.regexp_replace("name", "/[^/]*$", "")
    made = rows.repartition(tasks, folder).sortWithinPartitions("name", "content").mapInPandas(put, "n long, folders long")
    made.write.parquet(shared_path(spark, f"{name}-written"))
    return root


SAMPLES = "sample_id long, label double, grp int"


@query("SELECT sample_id, round(label, 9) AS label, grp FROM scored WHERE fold <> 4")
def src_samples_csv(spark, sf):
    rows = view(spark, sf, "scored").select(F.when(F.col("fold") != 4, F.col("sample_id")).alias("sample_id"), "label", "grp")
    path = written(spark, rows, "samples", lambda w, p: w.option("header", True).csv(p))
    return rounded(IN.src_samples_csv(spark, path, SAMPLES), 9)


@query("SELECT sample_id, round(label, 9) AS label, grp FROM scored")
def src_multi_csv(spark, sf):
    s = view(spark, sf, "scored")
    paths = [written(spark, s.filter(f"fold = {f}").select("sample_id", "label", "grp"), "part", lambda w, p: w.option("header", True).csv(p)) for f in range(5)]
    return rounded(IN.src_multi_csv(spark, [*paths, paths[0] + "-absent"], SAMPLES), 9)


@query("SELECT i.id, 'img/' || i.id || '.jpg' AS image, coalesce(array_to_string(list_sort(c), '|'), '') AS captions FROM (SELECT DISTINCT conv_id AS id FROM conversations) i LEFT JOIN (SELECT conv_id AS id, list(text) AS c FROM conversations WHERE role = 'user' GROUP BY 1) USING (id)")
def src_captions_json(spark, sf):
    """Conversations as nested documents of 200 images or so with their annotations, one a line."""
    c = view(spark, sf, "conversations")
    docs = F.greatest(F.lit(1), F.lit(c.count()) / 1000).cast("int")
    shard = F.pmod(F.xxhash64("conv_id"), docs).alias("shard")
    images = c.select(shard, "conv_id").distinct().groupBy("shard").agg(F.collect_list(F.struct(F.col("conv_id").alias("id"), F.concat("conv_id", F.lit(".jpg")).alias("file_name"))).alias("images"))
    notes = c.filter("role = 'user'").groupBy(shard).agg(F.collect_list(F.struct((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("conv_id").alias("image_id"), F.col("text").alias("caption"))).alias("annotations"))
    path = written(spark, images.join(notes, "shard", "left").drop("shard"), "captions", lambda w, p: w.json(p))
    return IN.src_captions_json(spark, path, "img/", multi_line=False).select("id", "image", F.array_join("captions", "|").alias("captions"))


@query("SELECT 'rgb/' || p_partkey || '.jpg' AS image, 'depth/' || p_partkey || '.png' AS target FROM part")
def src_pair_list(spark, sf):
    lines = view(spark, sf, "part").select(F.concat(F.lit("/rgb/"), "p_partkey", F.lit(".jpg   depth/"), "p_partkey", F.lit(".png/ 518.8")).alias("value"))
    return IN.src_pair_list(spark, written(spark, lines, "pairs", lambda w, p: w.text(p)))


@query("""
    WITH m AS (SELECT 'n' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS class_id, l_orderkey * 8 + l_linenumber AS block, 'f' || l_orderkey || '_' || l_linenumber || '.jpg' AS filename FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber FROM lineitem)),
    n AS (SELECT *, lead(block) OVER (PARTITION BY class_id ORDER BY block) AS nxt FROM m), c AS (SELECT class_id, CAST(row_number() OVER (ORDER BY class_id) - 1 AS INT) AS class_index FROM (SELECT DISTINCT class_id FROM m))
    SELECT class_index, class_id, block * 512 AS start_offset, nxt * 512 AS end_offset, filename FROM n JOIN c USING (class_id) WHERE nxt IS NOT NULL AND filename <> 'f1_1.jpg'""")
def src_archive_index(spark, sf):
    rows = view(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber").distinct()
    lines = rows.select(F.concat(F.lit("n"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0"), F.lit(".log")).alias("name"), F.concat(F.lit("block "), F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.lit(": f"), "l_orderkey", F.lit("_"), "l_linenumber", F.lit(".jpg\n")).alias("content"))
    return IN.src_archive_index(spark, put_files(spark, lines, "logs"), ["f1_1.jpg"])


@query("SELECT p.path, p.class_id, p.sample, c.class_index, c.class_name FROM (SELECT 'train/c' || o_custkey % 50 || '/c' || o_custkey % 50 || '_' || o_orderkey || '.JPEG' AS path, 'c' || o_custkey % 50 AS class_id, o_orderkey AS sample FROM orders) p LEFT JOIN (SELECT class_id, class_name, CAST(row_number() OVER (ORDER BY class_id) - 1 AS INT) AS class_index FROM (SELECT 'c' || n_nationkey AS class_id, n_name AS class_name FROM nation)) c USING (class_id)")
def src_class_index(spark, sf):
    k = F.concat(F.lit("c"), F.col("o_custkey") % 50)
    paths = view(spark, sf, "orders").select(F.concat(F.lit("train/"), k, F.lit("/"), k, F.lit("_"), "o_orderkey", F.lit(".JPEG")).alias("path"))
    names = view(spark, sf, "nation").select(F.concat(F.lit("c"), "n_nationkey").alias("class_id"), F.col("n_name").alias("class_name"))
    return IN.src_class_index(paths, names)


@query("SELECT run_id, experiment, round(score, 9) AS score FROM (SELECT run_id, 'exp' || experiment_id AS experiment, CASE WHEN run_id % 2 = 0 THEN score ELSE score * 2 END AS score, start_time FROM runs WHERE experiment_id = 1) ORDER BY start_time DESC, run_id LIMIT 500")
def src_runs(spark, sf):
    r = view(spark, sf, "runs")
    metrics = F.when(F.col("run_id") % 2 == 0, F.create_map(F.lit("best_score"), "score")).otherwise(F.create_map(F.lit("eval_score"), F.col("score") * 2))
    table = r.select("run_id", F.concat(F.lit("exp"), "experiment_id").alias("experiment"), "start_time", metrics.alias("metrics"))
    return rounded(IN.src_runs(spark, written(spark, table, "runs", lambda w, p: w.parquet(p)), "exp1").select("run_id", "experiment", "score"), 9)


def _shard(part):
    """A folder for about a thousand parts."""
    return F.concat(F.lit("s"), F.pmod(F.xxhash64("p_partkey"), F.lit(-(-part.count() // 1000) or 1)), F.lit("/"))


@query("SELECT 'p' || p_partkey || '.png' AS basename, CASE WHEN p_partkey % 4 = 0 THEN 'a' ELSE 'd' || p_size % 5 END AS folder, CAST(CASE WHEN p_partkey % 4 = 0 THEN 1 WHEN p_partkey % 6 = 1 THEN 0 ELSE strlen(coalesce(p_name, '')) END AS BIGINT) AS length FROM part")
def src_file_inventory(spark, sf):
    """A file for each part, some empty, of which some have a namesake in a folder before theirs, and a note beside each that is no image.

    About a thousand parts share a folder of folders, so that listings, a folder at a time, are dealt to tasks at any size."""
    part = view(spark, sf, "part").withColumn("p_name", F.when(F.col("p_partkey") % 6 == 1, "").otherwise(F.coalesce("p_name", F.lit(""))))
    name, shard = F.concat(F.lit("p"), "p_partkey", F.lit(".png")), _shard(part)
    files = part.select(F.concat(shard, F.lit("d"), F.col("p_size") % 5, F.lit("/"), name).alias("name"), F.col("p_name").alias("content"))
    files = files.unionByName(part.filter("p_partkey % 4 = 0").select(F.concat(shard, F.lit("a/"), name).alias("name"), F.lit("x").alias("content")))
    files = files.unionByName(part.select(F.concat(shard, F.lit("d0/p"), "p_partkey", F.lit(".txt")).alias("name"), F.lit("note").alias("content")))
    found = IN.src_file_inventory(spark, put_files(spark, files, "files"))
    return found.select("basename", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), "length")


@query("SELECT 'p' || p_partkey || '.png' AS filename, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 7 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'missing' ELSE 'empty' END ELSE 'unreadable' END AS problem FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 7 = 0 OR p_partkey % 5 = 0")
def src_readability_check(spark, sf):
    """A file for most parts, about a thousand parts to a folder: some are empty, some aren't what they should be."""
    part = view(spark, sf, "part")
    names = part.select(F.concat(F.lit("p"), "p_partkey", F.lit(".png")).alias("filename"), "p_partkey")
    files = names.filter("p_partkey % 3 <> 0").select(F.concat(_shard(part), "filename").alias("name"), F.when(F.col("p_partkey") % 7 == 0, "").when(F.col("p_partkey") % 5 == 0, "junk").otherwise("PNG").alias("content"))
    root = put_files(spark, files, "images")
    return IN.src_readability_check(names, IN.src_file_inventory(spark, root), probe=_is_image)


def _is_image(content: bytes) -> bool:
    return content.startswith(b"PNG")


@query("SELECT name, n_bytes FROM (SELECT 'doc-' || doc_id || '.txt' AS name, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents)")
def src_tar_shards(spark, sf):
    import io
    import tarfile

    docs = view(spark, sf, "documents")
    shards = -(-docs.count() // 500)  # about 500 documents a shard, however many there are
    root = shared_path(spark, "shards")

    def pack(batches):
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(root)
        system.create_dir(folder, recursive=True)
        for pdf in batches:
            out = io.BytesIO()
            with tarfile.open(fileobj=out, mode="w") as tar:
                for i, t in zip(pdf.doc_id, pdf.text, strict=True):
                    data = (t or "").encode()
                    info = tarfile.TarInfo(f"doc-{i}.txt")
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
            name = f"shard-{uuid.uuid4().hex}.tar"
            with system.open_output_stream(f"{folder}/{name}") as f:
                f.write(out.getvalue())
            yield pd.DataFrame({"name": [name]})

    made = docs.select("doc_id", "text").repartition(shards, "doc_id").mapInPandas(pack, "name string")
    index = shared_path(spark, "shard-index")
    made.write.parquet(index)  # names of the attempts that succeeded
    listed = spark.read.parquet(index)
    members = IN.src_tar_shards(spark, f"{root}/*.tar", 1 << 20).withColumn("shard_name", F.substring_index("shard", "/", -1)).join(listed.withColumnRenamed("name", "shard_name"), "shard_name", "left_semi")
    return members.select("name", F.length("content").cast("long").alias("n_bytes"))


@query("SELECT sample_id, round(least(greatest(pred * 13e-1 - 1e-1, 0), 1), 6) AS label, 'x' AS gender FROM scored")
def snk_predictions(spark, sf):
    path = shared_path(spark, "predictions")
    OUT.snk_predictions(view(spark, sf, "scored").withColumn("pred", F.col("pred") * 1.3 - 0.1), path, "x")
    return rounded(spark.read.schema("sample_id long, label double, gender string").option("header", True).csv(path))


@query("SELECT sample_id AS id, round(label, 9) AS value, CAST(grp = 1 AS VARCHAR) AS flag FROM scored UNION ALL SELECT aug_id, round(label, 9), NULL FROM aug_pool")
def snk_results(spark, sf):
    a = view(spark, sf, "scored").select(F.col("sample_id").alias("id"), F.round("label", 9).alias("value"), (F.col("grp") == 1).alias("flag"))
    b = view(spark, sf, "aug_pool").select(F.col("aug_id").alias("id"), F.round("label", 9).alias("value"))
    path = shared_path(spark, "results") + ".json"
    OUT.snk_results(spark, OUT.stack_results(a, b), path)
    return spark.read.schema("id long, value double, flag string").json(path)


@query("SELECT metric, count(*) AS n, round(sum(value), 4) AS total FROM history GROUP BY metric")
def snk_metric_log(spark, sf):
    h = view(spark, sf, "history")
    path = shared_path(spark, "metric-log")
    OUT.snk_metric_log(h.filter("step <= 2"), path)
    OUT.snk_metric_log(h.filter("step > 2"), path)
    lines = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,double>")).alias("metric", "value"))
    return lines.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


# ---- streams: events are written as files, streamed to the end, and the last state per key is compared with the batch


def streamed(spark, sf, batches: int = 3):
    """The events as files of Spark's own partitions, streamed in ``batches`` steps."""
    h = view(spark, sf, "history")
    files = max(batches, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = shared_path(spark, "stream")
    h.repartition(files, "event_id").write.parquet(path)
    return spark.readStream.schema(h.schema).option("maxFilesPerTrigger", -(-files // batches)).parquet(path)


def last_state(spark, out, key):
    """Of each key the row of the last batch that had it."""
    rows = live.run_available(out, shared_path(spark, "live"))
    return rows.groupBy(*key).agg(F.max_by(F.struct(*(c for c in out.columns if c not in key)), "batch").alias("s")).select(*key, "s.*")


@query("SELECT experiment_id, run_id, metric, round(min(value), 6) AS best_value, round(arg_max(value, step), 6) AS last_value, count(*) AS n FROM history GROUP BY 1, 2, 3")
def str_live_best(spark, sf):
    key = ("experiment_id", "run_id", "metric")
    return rounded(last_state(spark, live.str_live_best(streamed(spark, sf), key), key))


@query("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_id, metric ORDER BY step DESC) AS b FROM history),
    l AS (SELECT run_id, metric, list_sort(list(value)) AS l, avg(value) AS a, arg_max(value, step) AS last FROM r WHERE b <= 20 GROUP BY 1, 2), g AS (SELECT run_id, metric, count(*) AS n, avg(value) AS g FROM history GROUP BY 1, 2)
    SELECT run_id, metric, n, round(l[CAST(floor((len(l) + 1) / 2) AS BIGINT)], 6) AS median, round(a, 6) AS avg, round(g, 6) AS global_avg, round(last, 6) AS last FROM l JOIN g USING (run_id, metric)""")
def str_smoothed(spark, sf):
    return rounded(last_state(spark, live.str_smoothed(streamed(spark, sf)), ("run_id", "metric")))


@query(f"WITH {BEST} SELECT run_id, metric, arg_min(step, struct_pack(v := value, s := step)) AS best_step, round(min(value), 6) AS best_value, coalesce(any_value(stops), -1) AS stopped_at FROM s WHERE stops IS NULL OR step <= stops GROUP BY run_id, metric")
def str_early_stop(spark, sf):
    last = last_state(spark, live.str_early_stop(streamed(spark, sf), 3, ("run_id", "metric")), ("run_id", "metric"))
    return rounded(last.withColumn("stopped_at", F.coalesce("stopped_at", F.lit(-1))))
