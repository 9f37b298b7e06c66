import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.models import clustering, gibbs
from topicloom.operators import corpus, runs, sampling, topics, topicwords
from topicloom.sources import readers, writers


def tokens_of(spark, docs):
    rows = [(i, p, t) for i, d in enumerate(docs) for p, t in enumerate(d)]
    return spark.createDataFrame(rows, "doc_id LONG, pos INT, term STRING")


def tops_of(spark, lists):
    return spark.createDataFrame([("r", k, w, 1.0, i) for k, ws in enumerate(lists) for i, w in enumerate(ws, 1)], "data_run STRING, topic_id INT, term STRING, score DOUBLE, rank INT")


def value(df):
    return df.select("coherence").collect()[0][0]


def test_doc_npmi(spark):
    toks = tokens_of(spark, [["alpha", "beta"], ["alpha", "gamma"], ["alpha", "beta", "gamma"], ["beta", "gamma"]])
    assert value(topicwords.coherence(toks, tops_of(spark, [["alpha", "beta", "gamma"]]), "doc_npmi")) == pytest.approx(-0.16992500144231246)


def test_missing_words(spark):
    toks = tokens_of(spark, [["alpha"], ["beta"], ["gamma"]])
    tops = tops_of(spark, [["alpha", "delta"]])
    assert value(topicwords.coherence(toks, tops, "doc_npmi")) == -1.0
    assert value(topicwords.coherence(tokens_of(spark, [["alpha"], ["beta"]]), tops_of(spark, [["alpha", "missing"]]), "c_npmi", 10)) == -1.0


def test_cv_edges(spark):
    assert value(topicwords.coherence_cv(tokens_of(spark, [["alpha"], ["beta"]]), tops_of(spark, [["no", "none"]]), 110)) == 0.0
    assert value(topicwords.coherence_cv(tokens_of(spark, [["alpha"], ["alpha"]]), tops_of(spark, [["alpha", "missing"]]), 110)) == 0.5


@pytest.mark.parametrize("window", [None, 2, 3, 10])
def test_windows_against_brute_force(spark, window):
    docs = [list("abcabd"), list("aab"), list("c"), list("bdbdbdac"), list("xyz")]
    words = ["a", "b", "d"]
    one, two, n = Counter(), Counter(), 0
    for d in docs:
        for w in [d] if window is None else [d[i : i + window] for i in range(max(1, len(d) - window + 1))]:
            n += 1
            seen = sorted(set(w) & set(words))
            one.update(seen)
            two.update(itertools.combinations(seen, 2))
    toks, tops = tokens_of(spark, docs), tops_of(spark, [words])
    singles, pairs = topicwords.cooccurrence(toks, tops, window)
    assert {r["term"]: r["c"] for r in singles.collect()} == dict(one)
    assert {(r["w1"], r["w2"]): r["c"] for r in pairs.collect()} == dict(two)
    assert topicwords.window_total(toks, window).first()[0] == n


def test_diversity(spark):
    assert topicwords.diversity(tops_of(spark, [["alpha", "beta"], ["beta", "gamma"]])).first()["diversity"] == 0.75


def test_proxy_scores(spark):
    theta = spark.createDataFrame([("r", 0, 0, 0.9), ("r", 0, 1, 0.1), ("r", 1, 0, 0.1), ("r", 1, 1, 0.9)], "data_run STRING, doc_id LONG, topic_id INT, theta DOUBLE")
    bow = spark.createDataFrame([(0, "a", 1), (1, "b", 1)], "doc_id LONG, term STRING, cnt LONG")
    got = {(r["topic_id"], r["term"]): r["score"] for r in topicwords.proxy_scores(theta, bow, ["doc_id"], "theta").collect()}
    assert got[0, "a"] == pytest.approx(math.log(0.45 / 0.25) / -math.log(0.5))


def test_selection_reasons(spark):
    schema = "doc_id LONG, sentences_raw ARRAY<STRING>, sentences_tokenized ARRAY<ARRAY<STRING>>, document_tokens ARRAY<STRING>"
    docs = spark.createDataFrame([(10, ["One.", "Two."], [["one"], []], ["one"]), (11, ["x"], [[]], []), (12, None, None, None), (13, ["a"], [["a"]], [])], schema)
    kept, dropped = corpus.selection(docs)
    assert [(r["doc_id"], r["sent_id"]) for r in kept.collect()] == [(10, 0)]
    assert {r["doc_id"]: r["reason"] for r in dropped.collect()} == {11: "no_tokenized_sentences", 12: "no_sentences", 13: "no_document_tokens"}


def test_latest_document(spark):
    df = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "only")], "doc_id LONG, prepared_at INT, v STRING")
    assert {r["doc_id"]: r["v"] for r in corpus.documents(df).collect()} == {1: "new", 2: "only"}


def test_split_shares(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") < 7, "rare").otherwise("usual").alias("label"))
    out = sampling.stratified_split(df, "label", "k")
    got = {(r["label"], r["split"]): r["n"] for r in out.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {("rare", "train"): 5, ("rare", "test"): 2, ("usual", "train"): 596, ("usual", "test"): 397}
    assert sampling.limited_train(df, "label", "k", 0.1).count() == 1 + 99
    assert sampling.per_label(df, "label", "k", 3).count() == 6
    assert sampling.fixed_size(df, ["k"], 10).count() == 10


def test_mean_and_deviation(spark):
    df = spark.createDataFrame([("a", 0.8), ("a", 0.6), ("b", 1.0)], "m STRING, v DOUBLE")
    got = {r["m"]: (r["mean"], r["std"]) for r in runs.mean_std(df, ["m"], "v").collect()}
    assert got["a"] == pytest.approx((0.7, math.sqrt(0.02))) and got["b"] == (1.0, 0.0)


def test_coverage_states(spark):
    have = spark.createDataFrame([("a",), ("b",), ("b",), ("x",)], "k STRING")
    want = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "k STRING, expected_count INT")
    assert {r["k"]: r["status"] for r in runs.coverage(have, want, ["k"]).collect()} == {"a": "partial", "b": "extra", "c": "missing", "x": "unexpected"}


def test_intersection(spark):
    rows = [("train", i) for i in range(5)] + [("ctm", i) for i in (0, 1, 2, 4)] + [("lda", i) for i in (1, 2, 4)]
    assert sorted(r["k"] for r in runs.in_all(spark.createDataFrame(rows, "m STRING, k INT"), "m", "k").collect()) == [1, 2, 4]


def test_shares_of_documents(spark):
    st = spark.createDataFrame([("r", 1, 0, 0, 0.9), ("r", 1, 0, 1, 0.1), ("r", 1, 1, 1, 0.5), ("r", 1, 1, 0, 0.5)], "data_run STRING, doc_id LONG, sent_id INT, topic_id INT, p DOUBLE")
    assert {r["topic_id"]: r["theta"] for r in topics.from_posteriors(st).collect()} == pytest.approx({0: 0.7, 1: 0.3})
    assert {r["sent_id"]: r["topic_id"] for r in topics.assignments(st).collect()} == {0: 0, 1: 0}


def test_geometry(spark):
    eye = spark.createDataFrame([(i, [float(i == j) for j in range(3)]) for i in range(3)], "topic_id INT, mean ARRAY<DOUBLE>")
    got = topics.overlap_metrics(topics.topic_similarity(eye)).first()
    assert (got["pairs"], got["diversity"], got["pairs_above"]) == (3, 1.0, 0)


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k LONG, vec ARRAY<DOUBLE>").repartition(4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T - 2 * np.eye(60)
    got = {(r["query"], r["rank"]): r["neighbour"] for r in topics.nearest(df, df.where("k % 7 = 0"), "k", 3, block=4).collect()}
    want = {(q, i + 1): int(n) for q in range(0, 60, 7) for i, n in enumerate(np.argsort(-s[q])[:3])}
    assert got == want


def test_gibbs_step_by_hand():
    ll = np.log(np.array([[0.5, 0.3, 0.2], [0.1, 0.1, 0.8], [0.3, 0.3, 0.4]]))
    z = gibbs.gibbs_sweep(np.array([0, 1, 2]), ll, np.full(3, 0.5), np.array([0.1, 0.6, 0.9]))
    counts, want = [1, 1, 1], []
    for i, (old, u) in enumerate(zip([0, 1, 2], [0.1, 0.6, 0.9], strict=True)):
        counts[old] -= 1
        w = np.cumsum(np.exp(ll[i]) * (np.array(counts) + 0.5))
        want.append(int(np.searchsorted(w, u * w[-1])))
        counts[want[-1]] += 1
    assert z.tolist() == want


def test_minka_raises_a_rare_topic_less():
    new = gibbs.minka_alpha({0: {5: 10, 4: 3}, 1: {1: 4}}, {5: 10, 6: 3}, np.array([0.8, 1.2]), 1)
    assert new[0] > new[1] > 0


def two_groups(spark):
    rng = np.random.default_rng(1)
    rows = []
    for d in range(10):
        centre = np.eye(8)[d % 2]
        for s in range(4):
            v = centre + 0.1 * rng.normal(size=8)
            rows.append((d, d * 4 + s, (v / np.linalg.norm(v)).tolist()))
    return spark.createDataFrame(rows, "doc_id LONG, unit LONG, vec ARRAY<DOUBLE>")


@pytest.mark.parametrize("kind", ["vmf", "gaussian"])
def test_two_topics_are_found(spark, kind):
    model, state = gibbs.train(two_groups(spark), "doc_id", "unit", "vec", 2, kind, 4)
    first = {r["doc_id"]: Counter(r["z"]).most_common(1)[0] for r in state.collect()}
    assert len({first[d][0] for d in range(0, 10, 2)}) == 1 and len({first[d][0] for d in range(10)}) == 2
    again, _ = gibbs.train(two_groups(spark).repartition(3), "doc_id", "unit", "vec", 2, kind, 4)
    assert np.allclose(model.mean, again.mean) and np.isfinite([h["mean_log_likelihood"] for h in model.history]).all()


@pytest.mark.parametrize("kind", ["skmeans", "movmf", "gmm"])
def test_clusterings(spark, kind):
    df = two_groups(spark)
    p = clustering.fit(df, "unit", "vec", 2, kind)
    got = {r["unit"]: r["topic_id"] for r in clustering.predict(df, "unit", "vec", p, kind).collect()}
    assert len({got[u] for u in range(40) if u // 4 % 2 == 0}) == 1 and len(set(got.values())) == 2


def test_csv_and_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a / b\nc", "x"), ('say "hi", ok', "y"), ("  ", "x")], "data STRING, target_str STRING")
    writers.csv_dataset(df, str(tmp_path / "c"), {"n": 3})
    got = readers.csv_corpus(spark, str(tmp_path / "c"), "data", "target_str", ["x", "y"])
    assert sorted((r["text"], r["label"]) for r in got.collect()) == [("a / b\nc", "x"), ('say "hi", ok', "y")]
    with pytest.raises(ValueError):
        readers.csv_corpus(spark, str(tmp_path / "c"), "nothing")
    lines = spark.createDataFrame([('{"tokens": ["a", " b "]}',), ('["c"]',), ("{broken",), (None,)], "value STRING")
    assert sorted(r["tokens"] for r in readers.tokenized_jsonl(lines).collect()) == [["a", "b"], ["c"]]


def test_xml_pages(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<m><page><title>T</title><ns>0</ns><id>1</id><revision><text>'''A''' [[b|c]] {{x}} d</text></revision></page><page><title>U</title><ns>1</ns><id>2</id><revision><text>no</text></revision></page></m>")
    assert [(r["id"], r["text"]) for r in readers.wiki_xml(spark, str(tmp_path / "d.xml")).collect()] == [(1, "A c d")]
