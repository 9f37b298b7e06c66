"""Tables of run results: coverage, means, alignment and marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def mean_std(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., n, mean, std): sample deviation, 0 for one run."""
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def table_mean_std(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., mean, std) with population deviation."""
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def category_average(runs: DataFrame, by: list[str], category: str, value: str) -> DataFrame:
    """Mean over categories of their means, without 'all'."""
    per = runs.where(F.col(category) != "all").groupBy(*by, category).agg(F.avg(value).alias("m"))
    return per.groupBy(*by).agg(F.avg("m").alias("mean"), F.count(F.lit(1)).alias("categories"))


def coverage(runs: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """(key..., run_count, expected_count, status): missing, partial, complete, extra, or unexpected for keys outside the grid."""
    have = runs.groupBy(*key).agg(F.count(F.lit(1)).alias("run_count"))
    rows = expected.join(have, key, "full_outer").withColumn("run_count", F.coalesce("run_count", F.lit(0).cast("long")))
    n, want = F.col("run_count"), F.col("expected_count")
    status = F.when(want.isNull(), "unexpected").when(n == 0, "missing").when(n < want, "partial").when(n == want, "complete").otherwise("extra")
    return rows.withColumn("status", status)


def coverage_rollup(runs: DataFrame, a: str, b: str) -> DataFrame:
    return runs.rollup(a, b).agg(F.count(F.lit(1)).alias("runs"), F.grouping_id().alias("level"))


def marked(table: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds mark: best, second or ''."""
    rank = F.dense_rank().over(W.partitionBy(*by).orderBy(F.col(value).desc()))
    return table.withColumn("mark", F.when(rank == 1, "best").when(rank == 2, "second").otherwise(""))


def in_all(features: DataFrame, model: str, key: str) -> DataFrame:
    """Keys that every model has."""
    n = features.agg(F.count_distinct(model).alias("n"))
    have = features.groupBy(key).agg(F.count_distinct(model).alias("m"))
    return have.join(F.broadcast(n), F.col("m") == F.col("n"), "left_semi").select(key)  # one row


def row_counts_agree(features: DataFrame, model: str, key: str) -> DataFrame:
    """(model, n, kept): models with as many rows as most of them; others are left out."""
    counts = features.groupBy(model).agg(F.count(key).alias("n"))
    usual = counts.groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), F.col("n").desc()).limit(1)
    return counts.join(F.broadcast(usual.select(F.col("n").alias("u"))), F.lit(True)).select(model, "n", (F.col("n") == F.col("u")).alias("kept"))  # one row


def doc_coverage(docs: DataFrame, labelled: DataFrame, selected: DataFrame, features: DataFrame, model: str, key: str) -> DataFrame:
    """One row: documents in all, with a label, selected, and common to all models among the selected."""
    count = lambda df, name: df.agg(F.count_distinct(key).alias(name))
    common = in_all(features, model, key).join(selected.select(key).distinct(), key, "left_semi")
    one = count(docs, "raw")
    for df, name in ((labelled, "label_filtered"), (selected, "selected"), (common, "common")):
        one = one.crossJoin(F.broadcast(count(df, name)))  # one row each
    return one


def catalog(runs: DataFrame, by: str, *columns: str) -> DataFrame:
    """(by, features): the distinct combinations of some columns, in order, as one list per key."""
    item = F.concat_ws("/", *columns)
    return runs.select(by, item.alias("f")).distinct().groupBy(by).agg(F.array_join(F.array_sort(F.collect_list("f")), ",").alias("features"))


def in_order(table: DataFrame, column: str, configured: list[str]) -> DataFrame:
    """Adds place: configured names by their rank, then the others by name."""
    names = table.select(column).distinct()
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in configured]), F.col(column)), F.lit(0)), F.lit(len(configured) + 1))
    places = names.withColumn("place", F.row_number().over(W.orderBy(rank, column)))  # one row per name
    return table.join(F.broadcast(places), column)


def matching(runs: DataFrame, meta: dict, limited: tuple[str, str] = ("mode", "value")) -> DataFrame:
    """Runs whose columns equal the given values; where none of them asks for a limited run, those with a mode or value are left out."""
    out = runs
    for name, value in meta.items():
        out = out.where(F.col(name).eqNullSafe(F.lit(value)))
    for name in limited:
        if name in runs.columns and name not in meta:
            out = out.where(F.col(name).isNull())
    return out


def not_done(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """The wanted keys for which no equivalent output exists."""
    return wanted.join(done.select(*key).distinct(), key, "left_anti")


def resolved(runs: DataFrame, key: list[str], at: str = "started_at", tie: str = "execution_id", strict: bool = False) -> DataFrame:
    """The last run of every key, with candidates, the number of runs it was chosen from; strict raises an error where there is more than one."""
    best = F.max(F.struct(F.col(at), F.col(tie))).alias("_b")
    out = runs.groupBy(*key).agg(best, F.count(F.lit(1)).alias("candidates")).select(*key, F.col(f"_b.{at}").alias(at), F.col(f"_b.{tie}").alias(tie), "candidates")
    if strict:
        out = out.withColumn("candidates", F.when(F.col("candidates") > 1, F.raise_error(F.concat(F.lit("ambiguous: "), F.concat_ws("/", *key))).cast("long")).otherwise(F.col("candidates")))
    return out


def check_rows(before: DataFrame, after: DataFrame, what: str) -> DataFrame:
    """after, if it has as many rows as before; else an error."""
    a, b = before.count(), after.count()
    if a != b:
        raise ValueError(f"{what}: {a} rows became {b}")
    return after


def aligned(left: DataFrame, right: DataFrame, key: str, at: str = "place") -> DataFrame:
    """The keys that both sides have, with their places on both, in the left one's order: what index maps between two tables of rows say."""
    return left.select(key, F.col(at).alias("left_place")).join(right.select(key, F.col(at).alias("right_place")), key)
