"""Ways beyond former limits: blocks, rounds and runs give what the plain computation gives."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators import topics, topicwords
from topicloom.plans import preparation_queries
from topicloom.plans.base import Base


def vectors(spark, n, d=3, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, rng.integers(-2, 3, d).astype(float).tolist()) for i in range(n)], "topic_id INT, mean ARRAY<DOUBLE>")


def test_topics_meet_once_in_blocks(spark):
    t = vectors(spark, 23)
    whole = {(r["a"], r["b"]): r["cosine"] for r in topics.topic_similarity(t).collect()}
    blocks = [(r["a"], r["b"], r["cosine"]) for r in topics.topic_similarity(t, block=4).collect()]
    assert len(blocks) == len(whole) == 23 * 22 // 2 and {(a, b): c for a, b, c in blocks} == whole


def test_scores_by_blocks_of_topics(spark):
    t = vectors(spark, 11).withColumn("kappa", F.lit(1.0))
    v = vectors(spark, 7, seed=1).toDF("k", "vec")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(topics.scored_against(v, t, "k")) == key(topics.scored_against(v, t, "k", block=3))


@pytest.mark.parametrize("seed", range(3))
def test_greedy_rounds_take_the_pairs_of_the_walk(spark, seed):
    rng = random.Random(seed)
    rows = list({(rng.randrange(12), rng.randrange(12, 24), rng.randrange(5)) for _ in range(60)})
    df = spark.createDataFrame(rows, "a INT, b INT, s INT")
    order = [F.col("s"), F.col("a"), F.col("b")]
    walked = sorted(map(tuple, topics.greedy_unique(df, order).collect()))
    assert sorted(map(tuple, topics.greedy_unique(df, order, most=5).collect())) == walked


@pytest.mark.parametrize("kept", [10**6, 1])
def test_nearest_with_ties_in_small_blocks(spark, kept, monkeypatch):
    monkeypatch.setattr(topics, "KEPT_RESULTS", kept)
    rng = np.random.default_rng(2)
    x = rng.integers(-1, 2, (60, 3)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k LONG, vec ARRAY<DOUBLE>").repartition(3)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    got = {}
    for r in topics.nearest(df, df.where("k % 5 = 0"), "k", 4, block=3).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["neighbour"]
    for q in range(0, 60, 5):
        best = sorted((-round(float(unit[q] @ unit[i]), 9), i) for i in range(60) if i != q)[:4]
        assert [got[q][r] for r in (1, 2, 3, 4)] == [i for _, i in best]
    assert topics.nearest(df, df.limit(0), "k", 4).count() == 0


@pytest.mark.parametrize("seed,runs,cells", [(1, "abc", 1 << 22), (2, "abc", 7), (3, "a", 1 << 22)])
def test_documents_near_in_one_run_and_apart_in_another(spark, seed, runs, cells, monkeypatch):
    monkeypatch.setattr(topics, "CELLS", cells)
    rng = random.Random(seed)
    rows = [(r, d, t, rng.choice([0.0, 0.1, 0.5, 0.9])) for r in runs for d in range(-4, 60) for t in rng.sample(range(9), 3) if rng.random() < 0.9]
    rows += [(r, d, None, 0.3) for r in runs for d in (3, 8, 300)] + [(r, None, 2, 0.4) for r in runs] + [(None, 4, 5, 0.5), ("c", 8, 100, math.inf), ("a", 4, 50, math.inf)]
    rows = [(r, d, t, v) for i, (r, d, t, v) in enumerate(rows) if (r, d, t) not in {x[:3] for x in rows[:i]}]
    used = [x for x in rows if x[3] > 0 and x[0] is not None]
    sides = []
    for run in (min(x[0] for x in used), max(x[0] for x in used)):
        docs = {}
        for _, d, t, v in (x for x in used if x[0] == run and x[1] is not None):
            docs.setdefault(d, {})[t] = v
        length = {d: math.sqrt(sum(v * v for v in x.values())) for d, x in docs.items()}
        sides.append({d: {t: v / length[d] for t, v in x.items()} for d, x in docs.items()})
    cosine = lambda x, y: sum((x[t] * y[t] for t in x if t is not None and t in y), 0.0)
    want = {}
    for q, d in itertools.product(range(-4, 61), repeat=2):
        if q % 4 == 0 and q != d and all(i in x for i in (q, d) for x in sides) and 1 - (s := cosine(sides[0][q], sides[0][d])) <= 0.3 + 1e-9 and s > 0:
            if not 1 - (t := cosine(sides[1][q], sides[1][d])) < 0.4 - 1e-9:
                want[min(q, d), max(q, d)] = (round(1 - s, 9), round(1 - t, 9))
    theta = spark.createDataFrame(rows, "data_run STRING, doc_id LONG, topic_id INT, theta DOUBLE").repartition(3)
    got = topics.near_and_apart(theta, 0.3, 0.4, every=4, block=5).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == set(want)
    for r in got:
        assert (r["close"], r["far"]) == pytest.approx(want[r["a"], r["b"]], abs=1e-8, nan_ok=True)
    assert want or runs == "a"


def test_pairs_of_documents_are_not_shuffled(spark, tmp_path):
    rng = random.Random(5)
    rows = [(r, d, t, rng.random()) for r in "ab" for d in range(300) for t in rng.sample(range(6), 3)]
    theta = spark.createDataFrame(rows, "data_run STRING, doc_id LONG, topic_id INT, theta DOUBLE").withColumn("loaded_at", F.lit("2024-01-01").cast("timestamp"))
    theta.write.parquet(f"{tmp_path}/doc_topic.parquet")
    df = preparation_queries.QUERIES["cross_model_theta_pairs"][0](Base(spark, str(tmp_path)))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and df.count() > 0


def test_mean_vectors_of_null_keys_and_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), (None, [5.0, 6.0]), ("b", None)], "g STRING, vec ARRAY<DOUBLE>")
    assert {(r["g"], r["n"], tuple(r["total"]), r["dim"]) for r in topics.mean_vectors(df, "g").collect()} == {("a", 2, (4.0, 6.0), 2), (None, 1, (5.0, 6.0), 2)}
    assert topics.mean_vectors(df.limit(0), "g").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_window_runs_count_what_sets_count(spark, seed):
    rng = random.Random(seed)
    docs = {d: [rng.choice("abcde") for _ in range(rng.randrange(1, 40))] for d in range(12)}
    toks = spark.createDataFrame([(d, i, t) for d, ws in docs.items() for i, t in enumerate(ws)], "doc_id INT, pos INT, term STRING")
    tops = spark.createDataFrame([("r", 0, t) for t in "abcx"], "data_run STRING, topic_id INT, term STRING")
    size = rng.choice([1, 3, 7])
    singles, pairs = topicwords.cooccurrence(toks, tops, size)
    wins = {(d, t): {w for w in range(max(1, len(ws) - size + 1)) if t in ws[w : w + size]} for d, ws in docs.items() for t in "abc"}
    want1 = {t: sum(len(wins[d, t]) for d in docs) for t in "abc"}
    want2 = {(a, b): sum(len(wins[d, a] & wins[d, b]) for d in docs) for a, b in itertools.combinations("abc", 2)}
    assert {r["term"]: r["c"] for r in singles.collect()} == {t: c for t, c in want1.items() if c}
    assert {(r["w1"], r["w2"]): r["c"] for r in pairs.collect()} == {k: c for k, c in want2.items() if c}
