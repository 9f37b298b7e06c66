"""Deterministic samples by hash order: the same rows in every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicloom.functions.text import hash_order


def _exact_places(df: DataFrame, group: list[str], key: str, seed: str, blocks: int = 256) -> DataFrame:
    """Adds place (from 1, in hash order within the group) and size (of the group), without sorting a whole group in one task.

    The first bits of the hash part a group into blocks that follow each other in the order; counts
    of blocks give each block's start.
    """
    rows = df.withColumn("_h", hash_order(seed, F.col(key))).withColumn("_b", F.conv(F.substring("_h", 1, 2), 16, 10).cast("int") % blocks)
    counts = rows.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("size", F.sum("_n").over(W.partitionBy(*group)))
    inside = W.partitionBy(*group, "_b").orderBy("_h", key)
    rows = rows.withColumn("_i", F.row_number().over(inside)).join(counts.drop("_n"), [*group, "_b"])
    return rows.withColumn("place", F.col("_before") + F.col("_i")).drop("_h", "_b", "_i", "_before")


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.6, seed: str = "42") -> DataFrame:
    """Adds split: 'train' for the first ceil(share * n) rows of each label in hash order, 'test' for the rest."""
    rows = _exact_places(df, [label], key, seed)
    first = F.ceil(F.lit(share) * F.col("size") - F.lit(1e-9))
    return rows.withColumn("split", F.when(F.col("place") <= first, "train").otherwise("test")).drop("place", "size")


def per_label(df: DataFrame, label: str, key: str, n: int, seed: str = "42") -> DataFrame:
    order = W.partitionBy(label).orderBy(hash_order(seed, F.col(key)), key)  # Spark keeps n rows of each label before it shuffles
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def limited_train(df: DataFrame, label: str, key: str, ratio: float | None = None, seed: str = "42", count: int | None = None, stratified: bool = True) -> DataFrame:
    """A smaller training set: floor(ratio * n) rows of each label, one at least, or count rows shared out by the labels' sizes likewise.

    Not stratified, as many rows of all, whatever their label. A ratio of 1 or more and a count of all
    rows or more give the whole set, 0 gives none.
    """
    if ratio is not None and ratio >= 1:
        return df
    if (ratio or 0) <= 0 and (count or 0) <= 0:
        return df.limit(0)
    if not stratified:
        rows = _exact_places(df.withColumn("_all", F.lit(0)), ["_all"], key, seed)
        most = F.lit(count) if ratio is None else F.greatest(F.lit(1), F.floor(F.lit(ratio) * F.col("size") + F.lit(1e-9)))
        return rows.where(F.col("place") <= most).drop("place", "size", "_all")
    rows = _exact_places(df, [label], key, seed)
    if ratio is None:
        total = df.agg(F.count(F.lit(1)).alias("_t"))
        rows = rows.crossJoin(F.broadcast(total))  # one row
        part = F.lit(float(count)) * F.col("size") / F.col("_t")
        return rows.where((F.col("_t") <= count) | (F.col("place") <= F.greatest(F.lit(1), F.floor(part + F.lit(1e-9))))).drop("place", "size", "_t")
    return rows.where(F.col("place") <= F.greatest(F.lit(1), F.floor(F.lit(ratio) * F.col("size") + F.lit(1e-9)))).drop("place", "size")


def until_two_classes(sample, label: str, seeds: list[str]) -> tuple[DataFrame, int]:
    """(the first sample(seed) that has two labels or more, attempts); an error if no seed gives one."""
    for attempt, seed in enumerate(seeds, 1):
        rows = sample(seed)
        if rows.select(label).distinct().limit(2).count() == 2:
            return rows, attempt
    raise ValueError(f"one label only in all of {len(seeds)} samples")


def fixed_size(df: DataFrame, key: list[str], n: int, seed: str = "42") -> DataFrame:
    """n rows, each equally likely; executors keep only the n first of their rows."""
    return df.orderBy(hash_order(seed, *[F.col(k) for k in key]), *key).limit(n)


def seed_of(iteration: Column, repeat: Column, retry: Column, base: int = 42, stride: int = 1000) -> Column:
    return F.lit(base) + iteration + repeat * F.lit(stride) + retry * F.lit(100_000)


def review_groups(judged: DataFrame) -> DataFrame:
    """Adds sample_group of judged sentences: drop, short, punct or random."""
    group = (
        F.when(F.col("reason") != "kept", "drop").when(F.col("word_count") <= 5, "short").when(F.col("punctuation_ratio") >= 0.25, "punct").otherwise("random")
    )
    return judged.withColumn("sample_group", group)


def review_sample(judged: DataFrame, n: int, seed: str = "42") -> DataFrame:
    """n sentences for review: dropped and short ones first, up to half or what the others leave, then any of the rest."""
    rows = review_groups(judged).withColumn("_p", F.col("sample_group").isin("drop", "short"))
    sizes = rows.agg(F.sum(F.col("_p").cast("long")).alias("pri"), F.sum((~F.col("_p")).cast("long")).alias("other")).first()
    pri, other = sizes["pri"] or 0, sizes["other"] or 0
    first = min(pri, max(n // 2, n - other))
    key = hash_order(seed, F.col("doc_id"), F.col("sent_id"))
    chosen = rows.where("_p").orderBy(key, "doc_id", "sent_id").limit(first)
    rest = rows.join(chosen.select("doc_id", "sent_id"), ["doc_id", "sent_id"], "left_anti").orderBy(key, "doc_id", "sent_id").limit(max(n - first, 0))
    return chosen.unionByName(rest).drop("_p")
