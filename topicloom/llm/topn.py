"""Problem 1: the N best items of every group, by a split into hot and cold groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicloom.session import bounded_broadcast, cut

HOT_ROWS = 50_000
MAX_BROADCAST_GROUPS = 20_000


def latest_scored(df: DataFrame, key: list[str], score: str, loaded_at: str = "loaded_at") -> DataFrame:
    """One row per key: its row with the latest loaded_at, if the score of that row is neither null nor NaN.

    Rows with a null loaded_at are older than all others. Of rows loaded at the same time, one with a
    valid score is taken before one without, then the higher score. Copies fold into one item on the
    map side, so a key that holds a large part of the table makes no large task. Null values in the
    key are values like any other. Columns outside key, score and loaded_at are dropped.
    """
    valid = F.col(score).isNotNull() & ~F.isnan(score)
    newest = F.max(F.struct(F.col(loaded_at).alias("at"), valid.alias("ok"), F.col(score).alias("value")))
    return (
        df.groupBy(*key)
        .agg(newest.alias("_newest"))
        .where("_newest.ok")
        .select(*key, F.col("_newest.value").alias(score))
    )


def top_n_per_group(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    n: int,
    hot_rows: int = HOT_ROWS,
    max_broadcast_groups: int = MAX_BROADCAST_GROUPS,
    rank: str = "rank",
) -> DataFrame:
    """The n first rows of every group in the given total order, with their rank from 1.

    Exact row counts per group part the groups. Groups of up to hot_rows rows take an ordinary
    window (whose limit Spark also applies before the shuffle). The rows of hotter groups are range
    sorted over group and order, which cuts every hot group into slices by rank (the range is the
    salt); each slice keeps its n first, and a second window ranks the few that are left. No task
    ever sorts a whole hot group. An empty table gives an empty result, groups of fewer than n rows
    all of their rows; rows equal in the whole order are ranked arbitrarily but all counted.
    df is read three times, so it should be a table, not a long plan.
    """
    names = [f"_g{i}" for i in range(len(group))]
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot_keys = cut(counts.select(*[F.col(g).alias(x) for g, x in zip(group, names, strict=True)]), "hot-groups")
    hint = bounded_broadcast(hot_keys, max_broadcast_groups)
    on = [F.col(g).eqNullSafe(F.col(x)) for g, x in zip(group, names, strict=True)]

    cold = df.join(hint, on, "left_anti")
    cold = cold.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)

    hot = df.join(hint, on, "left_semi").repartitionByRange(*[F.col(g) for g in group], *order)
    slices = W.partitionBy(*group, "_slice").orderBy(*order)
    hot = hot.withColumn("_slice", F.spark_partition_id())
    hot = hot.withColumn(rank, F.row_number().over(slices)).where(F.col(rank) <= n).drop(rank)
    hot = hot.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)
    return cold.unionByName(hot.drop("_slice"))


def best_sentences(sentence_topic: DataFrame, n: int = 10, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The n sentences of highest p per (data_run, topic_id); ties by smaller doc_id, then smaller sent_id."""
    rows = sentence_topic.where(F.col("topic_id").isNotNull())
    items = cut(latest_scored(rows, ["data_run", "topic_id", "doc_id", "sent_id"], "p"), "sentence-items")
    order = [F.col("p").desc(), F.col("doc_id").asc_nulls_last(), F.col("sent_id").asc_nulls_last()]
    return top_n_per_group(items, ["data_run", "topic_id"], order, n, hot_rows)


def best_topics(doc_topic: DataFrame, n: int = 3, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The n topics of highest theta per (data_run, doc_id); ties by smaller topic_id. Rows without topic_id are no items."""
    rows = doc_topic.where(F.col("topic_id").isNotNull())
    items = cut(latest_scored(rows, ["data_run", "doc_id", "topic_id"], "theta"), "document-items")
    return top_n_per_group(items, ["data_run", "doc_id"], [F.col("theta").desc(), F.col("topic_id").asc()], n, hot_rows)


def found(sentence_topic: DataFrame, doc_topic: DataFrame) -> DataFrame:
    key = ["data_run", "topic_id", "doc_id", "sent_id"]
    best = best_sentences(sentence_topic).select(F.lit("sentence").alias("level"), *key)
    topics = best_topics(doc_topic).withColumn("sent_id", F.lit(-1))
    return best.unionByName(topics.select(F.lit("document").alias("level"), *key))
