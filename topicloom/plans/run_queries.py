"""Queries over tables of run results and over the feature tables of several models."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.functions import text as X
from topicloom.functions.numeric import r6 as R
from topicloom.functions.numeric import sigfigs
from topicloom.operators import runs as O
from topicloom.plans.base import RUNS, SENT_TOPIC, SENTS, THETA, Base, r6
from topicloom.sources import readers, writers

AXES = ["model", "dataset", "category"]
GRID = """grid AS (SELECT model, dataset, CAST(i AS INTEGER) AS iteration, 130 AS expected_count FROM (SELECT DISTINCT model FROM runs UNION SELECT 'absent') CROSS JOIN (SELECT DISTINCT dataset FROM runs) CROSS JOIN range(0, 4) x(i))"""


def _coverage(b: Base):
    runs = b.runs()
    models = runs.select("model").union(b.spark.createDataFrame([("absent",)], "model STRING")).distinct()
    # the grid of the axes is the product asked for: models x data sets x iterations, a handful each
    grid = models.crossJoin(runs.select("dataset").distinct()).withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("expected_count", F.lit(130))
    return O.coverage(runs, grid, ["model", "dataset", "iteration"])


def _named(b: Base):
    e = b.table("events").select(
        F.concat(F.lit("accuracy_"), F.col("event_type"), F.lit("_k"), (F.col("user_id") % 7 + 5).cast("string"), F.when(F.col("user_id") % 2 == 0, "").otherwise(F.concat(F.lit("_ratio0."), (F.col("user_id") % 4 + 1).cast("string")))).alias("name")
    ).distinct()
    return readers.axes_of_name(e, "name")


FEATURES = f"{THETA}, ft AS (SELECT DISTINCT data_run, doc_id FROM theta)"

QUERIES = {
    "run_coverage": (_coverage, lambda: f"""WITH {RUNS}, {GRID}, h AS (SELECT model, dataset, iteration, count(*) AS run_count FROM runs GROUP BY ALL)
SELECT model, dataset, iteration, expected_count, coalesce(run_count, 0) AS run_count, CASE WHEN coalesce(run_count, 0) = 0 THEN 'missing' WHEN run_count < expected_count THEN 'partial' WHEN run_count = expected_count THEN 'complete' ELSE 'extra' END AS status FROM grid LEFT JOIN h USING (model, dataset, iteration)"""),
    "coverage_rollup": (
        lambda b: O.coverage_rollup(b.runs(), "model", "category").select("model", "category", "runs", F.col("level").cast("int").alias("level")),
        lambda: f"WITH {RUNS} SELECT model, category, count(*) AS runs, CAST(grouping_id(model, category) AS INTEGER) AS level FROM runs GROUP BY ROLLUP (model, category)",
    ),
    "latest_run_pick": (
        lambda b: readers.latest_per_key(b.runs(), AXES).select(*AXES, "execution_id"),
        lambda: f"WITH {RUNS} SELECT model, dataset, category, execution_id FROM (SELECT *, row_number() OVER (PARTITION BY model, dataset, category ORDER BY started_at DESC, execution_id DESC) AS r FROM runs) WHERE r = 1",
    ),
    "mean_std_iterations": (
        lambda b: O.mean_std(b.runs(), AXES, "metric").select(*AXES, "n", R("mean").alias("mean"), R("std").alias("std")),
        lambda: f"WITH {RUNS} SELECT model, dataset, category, count(*) AS n, {r6('avg(metric)')} AS mean, {r6('coalesce(stddev_samp(metric), 0.0)')} AS std FROM runs GROUP BY ALL",
    ),
    "mean_std_table": (
        lambda b: O.table_mean_std(b.runs(), ["model"], "metric").select("model", R("mean").alias("mean"), R("std").alias("std")),
        lambda: f"WITH {RUNS} SELECT model, {r6('avg(metric)')} AS mean, {r6('stddev_pop(metric)')} AS std FROM runs GROUP BY model",
    ),
    "category_average": (
        lambda b: O.category_average(b.runs(), ["model", "dataset"], "category", "metric").select("model", "dataset", R("mean").alias("mean"), "categories"),
        lambda: f"WITH {RUNS}, p AS (SELECT model, dataset, category, avg(metric) AS m FROM runs WHERE category <> 'all' GROUP BY ALL) SELECT model, dataset, {r6('avg(m)')} AS mean, count(*) AS categories FROM p GROUP BY ALL",
    ),
    "best_and_second": (
        lambda b: O.marked(O.mean_std(b.runs(), ["dataset", "model"], "metric").select("dataset", "model", R("mean").alias("mean")), ["dataset"], "mean"),
        lambda: f"WITH {RUNS}, m AS (SELECT dataset, model, {r6('avg(metric)')} AS mean FROM runs GROUP BY ALL) SELECT dataset, model, mean, CASE dense_rank() OVER (PARTITION BY dataset ORDER BY mean DESC) WHEN 1 THEN 'best' WHEN 2 THEN 'second' ELSE '' END AS mark FROM m",
    ),
    "feature_intersection": (
        lambda b: O.in_all(b.theta().select("data_run", "doc_id").distinct(), "data_run", "doc_id"),
        lambda: f"WITH {FEATURES} SELECT doc_id FROM ft GROUP BY doc_id HAVING count(DISTINCT data_run) = (SELECT count(DISTINCT data_run) FROM ft)",
    ),
    "row_count_alignment": (
        lambda b: O.row_counts_agree(b.theta().select("data_run", "doc_id").distinct(), "data_run", "doc_id"),
        lambda: f"WITH {FEATURES}, c AS (SELECT data_run, count(doc_id) AS n FROM ft GROUP BY 1), u AS (SELECT n FROM c GROUP BY n ORDER BY count(*) DESC, n DESC LIMIT 1) SELECT data_run, c.n, c.n = u.n AS kept FROM c, u",
    ),
    "axes_from_names": (_named, lambda: """SELECT DISTINCT 'accuracy_' || event_type || '_k' || (user_id % 7 + 5) || CASE WHEN user_id % 2 = 0 THEN '' ELSE '_ratio0.' || (user_id % 4 + 1) END AS name, 'accuracy' AS metric, event_type AS dataset, CAST(user_id % 7 + 5 AS INTEGER) AS topics, 'ratio' AS mode,
CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE CAST('0.' || (user_id % 4 + 1) AS DOUBLE) END AS value FROM events"""),
    "condition_ids": (
        lambda b: b.runs().select("model", "category", "iteration").distinct().select("model", "category", "iteration", F.format_string("it%02d__k%03d__%s__", "iteration", F.lit(20), "category").alias("condition"), F.substring(F.sha1(F.concat_ws("|", "model", "category")), 1, 8).alias("fp")),
        lambda: f"WITH {RUNS} SELECT DISTINCT model, category, iteration, format('it{{:02d}}__k020__{{}}__', iteration, category) AS condition, substr(sha1(concat_ws('|', model, category)), 1, 8) AS fp FROM runs",
    ),
    "experiment_summary": (
        lambda b: b.runs().groupBy("model", "dataset").agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("category").alias("categories"), F.min("started_at").alias("first_start"), F.max("started_at").alias("last_start"), R(F.max("metric")).alias("best")),
        lambda: f"WITH {RUNS} SELECT model, dataset, count(*) AS runs, count(DISTINCT category) AS categories, min(started_at) AS first_start, max(started_at) AS last_start, {r6('max(metric)')} AS best FROM runs GROUP BY ALL",
    ),
    "incomplete_runs": (
        lambda b: _coverage(b).where(F.col("status").isin("missing", "partial")).groupBy("model", "dataset").agg(F.count(F.lit(1)).alias("cells"), F.sum(F.col("expected_count") - F.col("run_count")).alias("lacking")),
        lambda: f"""WITH {RUNS}, {GRID}, h AS (SELECT model, dataset, iteration, count(*) AS run_count FROM runs GROUP BY ALL), j AS (SELECT *, coalesce(run_count, 0) AS rc FROM grid LEFT JOIN h USING (model, dataset, iteration))
SELECT model, dataset, count(*) AS cells, sum(expected_count - rc)::BIGINT AS lacking FROM j WHERE rc < expected_count GROUP BY ALL""",
    ),
    "significant_digits": (
        lambda b: O.mean_std(b.runs(), ["model"], "metric").select("model", sigfigs("mean").alias("mean")),
        lambda: f"WITH {RUNS} SELECT model, CAST(printf('%.4g', avg(metric)) AS DOUBLE) AS mean FROM runs GROUP BY model",
    ),
    "aligned_sentences": (
        lambda b: b.sentence_topic().select("data_run", "doc_id", "sent_id").distinct().join(b.sentences().select("doc_id", "sent_id", F.size("tokens").alias("n_tokens")), ["doc_id", "sent_id"], "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0))),
        lambda: f"WITH {SENTS}, {SENT_TOPIC} SELECT DISTINCT data_run, doc_id, sent_id, CAST(coalesce(len(tokens), 0) AS INTEGER) AS n_tokens FROM st LEFT JOIN sents USING (doc_id, sent_id)",
    ),
    "latex_summary": (
        lambda b: writers.latex_rows(O.mean_std(b.runs(), ["dataset", "model"], "metric").select("dataset", X.latex(F.col("model")).alias("model"), F.floor("mean").cast("string").alias("mean")), ["dataset", "model", "mean"], ["dataset", "model"]),
        lambda: f"WITH {RUNS} SELECT dataset, model, dataset || ' & ' || model || ' & ' || CAST(floor(avg(metric))::BIGINT AS VARCHAR) || ' \\\\' AS latex FROM runs GROUP BY dataset, model",
    ),
}
