"""Topic words, co-occurrence and coherence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicloom.functions.numeric import EPS, cosine, r6
from topicloom.session import cut

AXES = ["data_run", "topic_id"]


def joint_mass(theta: DataFrame, bow: DataFrame, on: list[str], weight: str) -> DataFrame:
    """(data_run, topic_id, term, mass): sum of weight times count; joined on the documents (or sentences) that both sides have."""
    return theta.join(bow, on).groupBy(*AXES, "term").agg(F.sum(F.col(weight) * F.col("cnt")).alias("mass"))


def proxy_scores(theta: DataFrame, bow: DataFrame, on: list[str], weight: str, mode: str = "word_npmi") -> DataFrame:
    """(data_run, topic_id, term, score) of every pair with mass: pointwise mutual information over -ln p(w, k) or -ln p(w).

    Probabilities are shares of the tokens of the documents that the run has, weighted by topic.
    """
    mass = joint_mass(theta, bow, on, weight)
    covered = theta.select("data_run", *on).distinct().join(bow, on)
    words = covered.groupBy("data_run", "term").agg(F.sum("cnt").alias("w"))
    totals = covered.groupBy("data_run").agg(F.sum("cnt").alias("n"))
    topics = mass.groupBy(*AXES).agg(F.sum("mass").alias("k"))
    rows = mass.join(topics, AXES).join(words, ["data_run", "term"]).join(totals, "data_run")
    p_wk, p_w, p_k = F.col("mass") / F.col("n"), F.col("w") / F.col("n"), F.col("k") / F.col("n")
    safe = F.greatest(p_wk, F.lit(EPS))
    pmi = F.ln(safe / F.greatest(p_k * p_w, F.lit(EPS)))
    below = -F.ln(safe if mode == "npmi" else F.greatest(p_w, F.lit(EPS)))
    return rows.select(*AXES, "term", F.when(p_wk <= 0, F.lit(-1.0)).otherwise(F.try_divide(pmi, below)).alias("score"))


def top_words(scores: DataFrame, n: int, score: str = "score") -> DataFrame:
    """(data_run, topic_id, rank, term, score): the n best terms of each topic by rounded score, ties by term."""
    order = W.partitionBy(*AXES).orderBy(F.col("score").desc(), F.col("term").asc())
    rows = scores.select(*AXES, "term", r6(score).alias("score"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def dictionary_top_words(scores: DataFrame, dictionary: DataFrame, n: int, score: str = "score") -> DataFrame:
    """(data_run, topic_id, rank, term, score): the n best words of a dictionary (term) for each topic by rounded score, ties by term.

    Words of the dictionary that a topic has no score for stand last, with a null score; only as many
    of them as the ranks need are put beside a topic, never the whole dictionary.
    """
    words = dictionary.select("term").distinct()
    known = top_words(scores.join(words, "term", "left_semi"), n, score)
    # a topic's own words among the first n of the dictionary leave at most n others to fill up with
    first = words.orderBy("term").limit(2 * n)
    short = scores.select(*AXES).distinct().join(known.groupBy(*AXES).agg(F.count(F.lit(1)).alias("_have")), AXES, "left").withColumn("_have", F.coalesce("_have", F.lit(0))).where(F.col("_have") < n)
    spare = short.crossJoin(F.broadcast(first)).join(known.select(*AXES, "term"), [*AXES, "term"], "left_anti")  # 2 n words for each topic that lacks some
    order = W.partitionBy(*AXES).orderBy("term")
    filled = spare.withColumn("rank", (F.col("_have") + F.row_number().over(order)).cast("int")).where(F.col("rank") <= n)
    return known.select(*AXES, "rank", "term", "score").unionByName(filled.select(*AXES, "rank", "term", F.lit(None).cast("double").alias("score")))


def matrix_diversity(tops: DataFrame, runs: DataFrame, topics: DataFrame, n: int) -> DataFrame:
    """(data_run, diversity): distinct top words over all entries of the topics x n matrix; 0 for a run without topics or words."""
    size = topics.groupBy("data_run").agg(F.count_distinct("topic_id").alias("_k"))
    unique = tops.where(F.col("rank") <= n).groupBy("data_run").agg(F.count_distinct("term").alias("_u"), F.count(F.lit(1)).alias("_c"))
    rows = runs.select("data_run").distinct().join(size, "data_run", "left").join(unique, "data_run", "left")
    return rows.select("data_run", F.coalesce(F.try_divide(F.col("_u"), F.col("_c")), F.lit(0.0)).alias("diversity"), F.coalesce("_k", F.lit(0).cast("long")).alias("topics"))


def row_normal(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """value over its sum in by; 0 where the sum is 0. Sums are made first and joined, so no group is gathered."""
    mass = df.groupBy(*by).agg(F.sum(value).alias("_mass"))
    share = F.coalesce(F.try_divide(F.col(value), F.when(F.col("_mass") != 0, F.col("_mass"))), F.lit(0.0))
    return df.join(mass, by).withColumn(out, share).drop("_mass")


def diversity(tops: DataFrame) -> DataFrame:
    """(data_run, diversity): distinct top words over all of them."""
    return tops.groupBy("data_run").agg((F.count_distinct("term") / F.count(F.lit(1))).alias("diversity"))


def word_pairs(tops: DataFrame) -> DataFrame:
    """(data_run, topic_id, w1, w2) of the unordered pairs of the top words of each topic, from one small array per topic."""
    lists = tops.groupBy(*AXES).agg(F.array_sort(F.collect_set("term")).alias("ws"))
    rows = lists.select(*AXES, "ws", F.posexplode("ws").alias("i", "w1"))
    return rows.select(*AXES, "w1", F.explode(F.slice("ws", F.col("i") + 2, F.size("ws"))).alias("w2"))


def occurrences(toks: DataFrame, words: DataFrame, window: int | None) -> DataFrame:
    """(doc_id, term, wins): the windows of a document that hold a target word, as an array of runs (s, e) of their numbers; the one window 0 without a size.

    Only target words are kept before windows are formed. A document of n tokens has max(1, n - window + 1)
    windows; a place p lies in those from p - window + 1 to p, and places no further apart than a window
    share one run, so a word takes two numbers per run however often it occurs.
    """
    if window is None:
        hits = toks.join(words.select("term").distinct(), "term", "left_semi")
        return hits.select("doc_id", "term").distinct().withColumn("wins", F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"))))
    sized = toks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    hits = toks.join(words.select("term").distinct(), "term", "left_semi")
    spots = hits.groupBy("doc_id", "term").agg(F.array_sort(F.collect_list(F.col("pos").cast("int"))).alias("ps")).join(sized, "doc_id")
    last = F.greatest(F.col("n") - window, F.lit(0)).cast("int")
    first = F.filter("ps", lambda p, i: (i == 0) | (p - F.get("ps", i - 1) > window))
    final = F.filter("ps", lambda p, i: (i == F.size("ps") - 1) | (F.get("ps", i + 1) - p > window))
    runs = F.zip_with(first, final, lambda a, b: F.struct(F.greatest(a - (window - 1), F.lit(0)).alias("s"), F.least(b, last).alias("e")))
    return spots.select("doc_id", "term", runs.alias("wins"))


def run_length(runs: Column) -> Column:
    """How many numbers disjoint runs hold."""
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + (r["e"] - r["s"] + 1).cast("long"))


def joint_length(runs: Column) -> Column:
    """How many numbers lie in at least one of the runs, which may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("reach"))
    grow = lambda a, r: F.struct(
        (a["n"] + F.greatest(r["e"] - F.greatest(r["s"], a["reach"] + 1) + 1, F.lit(0)).cast("long")).alias("n"), F.greatest(a["reach"], r["e"]).alias("reach")
    )
    return F.aggregate(F.array_sort(runs), start, grow, lambda a: a["n"])


def window_total(toks: DataFrame, window: int | None) -> DataFrame:
    """One row: the number of windows (documents without a size)."""
    sized = toks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    each = F.lit(1) if window is None else F.greatest(F.col("n") - window + 1, F.lit(1))
    return sized.agg(F.sum(each).alias("windows"))


def cooccurrence(toks: DataFrame, tops: DataFrame, window: int | None) -> tuple[DataFrame, DataFrame]:
    """((term, c), (w1, w2, c)): windows with each target word, and with both words of each pair that stands in some topic."""
    occ = cut(occurrences(toks, tops, window), "occurrences")
    singles = occ.groupBy("term").agg(F.sum(run_length(F.col("wins"))).alias("c"))
    wanted = word_pairs(tops).select("w1", "w2").distinct()
    left = occ.select("doc_id", F.col("term").alias("w1"), F.col("wins").alias("a")).join(wanted, "w1")
    right = occ.select("doc_id", F.col("term").alias("w2"), F.col("wins").alias("b"))
    both = left.join(right, ["doc_id", "w2"])
    common = run_length(F.col("a")) + run_length(F.col("b")) - joint_length(F.concat("a", "b"))
    pairs = both.groupBy("w1", "w2").agg(F.sum(common).alias("c"))
    return singles, pairs.where("c > 0")


def _counted_pairs(toks: DataFrame, tops: DataFrame, window: int | None, counts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    singles, pairs = counts or cooccurrence(toks, tops, window)
    zero = F.lit(0).cast("long")
    rows = word_pairs(tops)
    rows = rows.join(singles.select(F.col("term").alias("w1"), F.col("c").alias("ci")), "w1", "left")
    rows = rows.join(singles.select(F.col("term").alias("w2"), F.col("c").alias("cj")), "w2", "left")
    rows = rows.join(pairs.select("w1", "w2", F.col("c").alias("cij")), ["w1", "w2"], "left").crossJoin(F.broadcast(window_total(toks, window)))  # one row
    for c in ("ci", "cj", "cij"):
        rows = rows.withColumn(c, F.coalesce(c, zero))
    return rows


def pair_score(measure: str, ci: Column, cj: Column, cij: Column, n: Column) -> Column:
    """doc_npmi, c_uci, c_npmi or u_mass of one pair from its counts."""
    pi, pj, pij = ci / n, cj / n, cij / n
    if measure == "doc_npmi":
        return F.when(cij == 0, F.lit(-1.0)).when(pij >= 1, F.lit(1.0)).otherwise(F.ln(pij / (pi * pj)) / -F.ln(pij))
    if measure == "u_mass":
        return F.when(ci == 0, F.lit(0.0)).otherwise(F.ln((pij + EPS) / pi))
    uci = F.ln((pij + EPS) / (pi * pj + EPS))
    missing = (ci == 0) | (cj == 0)
    if measure == "c_uci":
        return F.when(missing, F.lit(-1.0)).otherwise(uci)
    return F.when(missing, F.lit(-1.0)).when(pij >= 1, F.lit(1.0)).otherwise(uci / -F.ln(pij + EPS))


def coherence(toks: DataFrame, tops: DataFrame, measure: str, window: int | None = None) -> DataFrame:
    """(data_run, topic_id, coherence): mean over the pairs of each topic's top words; documents are the windows without a size."""
    rows = _counted_pairs(toks, tops, window)
    n = F.col("windows")
    safe = lambda c: F.greatest(F.col(c), F.lit(1))
    score = pair_score(measure, F.col("ci"), F.col("cj"), F.col("cij"), n) if measure != "doc_npmi" else F.when(F.col("cij") == 0, F.lit(-1.0)).when(F.col("cij") >= n, F.lit(1.0)).otherwise(F.try_divide(F.ln((F.greatest("cij", F.lit(1)) / n) / ((safe("ci") / n) * (safe("cj") / n))), -F.ln(F.greatest("cij", F.lit(1)) / n)))
    return rows.withColumn("s", score).groupBy(*AXES).agg(F.avg("s").alias("coherence"))


def coherence_cv(toks: DataFrame, tops: DataFrame, window: int = 110, min_frequency: int = 0) -> DataFrame:
    """(data_run, topic_id, coherence) by vectors: each word's NPMI with all top words against the sum of all those vectors, mean cosine."""
    counts = cooccurrence(toks, tops, window)
    pairs, singles = _counted_pairs(toks, tops, window, counts), counts[0]
    own = tops.select(*AXES, F.col("term").alias("w1"), F.col("term").alias("w2"))
    own = own.join(singles.select(F.col("term").alias("w1"), F.col("c").alias("ci")), "w1", "left").withColumn("ci", F.coalesce("ci", F.lit(0).cast("long")))
    own = own.withColumn("cj", F.col("ci")).withColumn("cij", F.col("ci")).crossJoin(F.broadcast(window_total(toks, window)))  # one row
    mirrored = pairs.select(*AXES, F.col("w2").alias("w1"), F.col("w1").alias("w2"), F.col("cj").alias("ci"), F.col("ci").alias("cj"), "cij", "windows")
    cells = pairs.select(*AXES, "w1", "w2", "ci", "cj", "cij", "windows").unionByName(mirrored).unionByName(own.select(*AXES, "w1", "w2", "ci", "cj", "cij", "windows"))
    n = F.col("windows")
    low = (F.col("ci") < min_frequency) | (F.col("cj") < min_frequency) | (F.col("ci") == 0) | (F.col("cj") == 0)
    co = F.when(F.col("cij") < min_frequency, F.lit(0)).otherwise(F.col("cij"))
    below = -F.ln(co / n + EPS)
    value = F.when(low, F.lit(0.0)).when(co >= n, F.lit(1.0)).otherwise(F.ln((co / n + EPS) / ((F.greatest("ci", F.lit(1)) / n) * (F.greatest("cj", F.lit(1)) / n))) / below)
    cells = cut(cells.select(*AXES, "w1", "w2", value.alias("v")), "cells")  # read twice
    vectors = cells.groupBy(*AXES, "w1").agg(F.transform(F.array_sort(F.collect_list(F.struct("w2", "v"))), lambda x: x["v"]).alias("vec"))
    sums = cells.groupBy(*AXES, "w2").agg(F.sum("v").alias("t")).groupBy(*AXES).agg(F.transform(F.array_sort(F.collect_list(F.struct("w2", "t"))), lambda x: x["t"]).alias("topic"))
    return vectors.join(sums, AXES).groupBy(*AXES).agg(F.avg(cosine("vec", "topic")).alias("coherence"))


def word_scores_by_assignment(counts: DataFrame) -> DataFrame:
    """sqrt(max(occ - tot / K, 0)) * clip(occ / tot - 1 / K, 0, 1) of counts (data_run, topic_id, term, occ); K the topics of the run, tot the count of the term in it."""
    topics = counts.groupBy("data_run").agg(F.count_distinct("topic_id").cast("double").alias("_k"))
    rows = counts.join(counts.groupBy("data_run", "term").agg(F.sum("occ").alias("tot")), ["data_run", "term"]).join(topics, "data_run")
    lift = F.sqrt(F.greatest(F.col("occ") - F.col("tot") / F.col("_k"), F.lit(0.0)))
    share = F.least(F.greatest(F.col("occ") / F.col("tot") - F.lit(1.0) / F.col("_k"), F.lit(0.0)), F.lit(1.0))
    return rows.withColumn("score", lift * share).drop("_k")


def class_tfidf(counts: DataFrame) -> DataFrame:
    """Term frequency in a topic times ln(1 + A / f): A the mean tokens of a topic, f the term's count over topics. Sums are made first and joined."""
    per_topic = counts.groupBy(*AXES).agg(F.sum("occ").alias("_n"))
    mean = per_topic.groupBy("data_run").agg((F.sum("_n") / F.count(F.lit(1))).alias("_mean"))
    per_term = counts.groupBy("data_run", "term").agg(F.sum("occ").alias("_f"))
    rows = counts.join(per_term, ["data_run", "term"]).join(per_topic.join(mean, "data_run"), AXES)
    return rows.withColumn("score", F.col("occ") / F.col("_n") * F.ln(1 + F.col("_mean") / F.col("_f"))).drop("_n", "_mean", "_f")
