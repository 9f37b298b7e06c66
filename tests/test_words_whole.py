"""Word models without limits: the sentence model in blocks, weighted vectors with components taken off."""

import numpy as np
import pytest

from topicloom.models import words


def test_sentence_model_in_blocks_finds_the_two_vocabularies(spark):
    left, right = ["red", "blue", "green"], ["one", "two", "three"]
    rows = [(d, s, [(left if d % 2 else right)[(s + k) % 3] for k in range(4)]) for d in range(40) for s in range(3)]
    df = spark.createDataFrame(rows, "doc_id LONG, sent_id INT, words ARRAY<STRING>")
    for block in (7, 2000):
        assigned, counts = words.sentence_lda(df, 2, 6, seed=3, block_docs=block, soft=True)
        got = assigned.collect()
        assert len(got) == 120 and all(abs(sum(r["p"]) - 1) < 1e-9 for r in got)
        by = {}
        for r in counts.collect():
            by.setdefault(r["term"], {})[r["topic_id"]] = r["cnt"]
        assert sum(sum(v.values()) for v in by.values()) == 480
    one = sorted((r["doc_id"], r["sent_id"], r["topic_id"]) for r in words.sentence_lda(df, 2, 3, seed=3, block_docs=5)[0].collect())
    assert one == sorted((r["doc_id"], r["sent_id"], r["topic_id"]) for r in words.sentence_lda(df, 2, 3, seed=3)[0].collect())


def test_polya_evidence_of_repeated_words():
    ids = np.array([0, 1, 0])
    rows = np.array([[2.0, 0.0], [1.0, 3.0], [2.0, 0.0]])
    got = words._sentence_evidence(rows, words._seen(ids), np.array([5.0, 4.0]), 0.5, 4)
    want = [np.log(2.5) + np.log(1.5) + np.log(3.5) - np.log(7) - np.log(8) - np.log(9), np.log(0.5) + np.log(3.5) + np.log(1.5) - np.log(6) - np.log(7) - np.log(8)]
    assert got == pytest.approx(want)


@pytest.mark.parametrize("held", [1 << 28, 0])
def test_weighted_vectors_less_their_components(spark, held, monkeypatch):
    monkeypatch.setattr(words, "VECTOR_BYTES", held)
    rng = np.random.default_rng(0)
    vecs = {w: rng.normal(size=4) for w in "abcdef"}
    toks = [(d, s, w) for d in range(6) for s in range(2) for w in rng.choice(list("abcdef"), 3)] + [(9, 0, "unknown")]
    df = spark.createDataFrame([(d, s, str(w)) for d, s, w in toks], "doc_id LONG, sent_id INT, term STRING")
    table = spark.createDataFrame([(w, v.tolist()) for w, v in vecs.items()], "word STRING, vec ARRAY<DOUBLE>")
    weights = words.usif_weights(df)
    given = {r["term"]: r["weight"] for r in weights.collect()}
    got = {(r["doc_id"], r["sent_id"]): np.array(r["vec"]) for r in words.usif_vectors(df, weights, table, 2).collect()}
    means = {}
    for d, s, w in toks:
        means.setdefault((d, s), [])
        if w in vecs:
            means[d, s].append(given[w] * vecs[w] / np.linalg.norm(vecs[w]))
    means = {k: np.mean(v, axis=0) if v else np.zeros(4) for k, v in means.items()}
    x = np.array(list(means.values()))
    _, values, directions = np.linalg.svd(x - x.mean(0), full_matrices=False)
    share = values[:2] ** 2 / (values[:2] ** 2).sum()
    for k, v in means.items():
        for u, w in zip(directions[:2], share, strict=True):
            v = v - w * (v @ u) * u
        assert got[k] == pytest.approx(v, abs=1e-9)
    assert (got[9, 0] == 0).all()


def test_no_sentences(spark):
    none = spark.createDataFrame([], "doc_id LONG, sent_id INT, term STRING")
    table = spark.createDataFrame([("a", [1.0, 2.0])], "word STRING, vec ARRAY<DOUBLE>")
    assert words.usif_vectors(none, words.usif_weights(none), table).count() == 0
