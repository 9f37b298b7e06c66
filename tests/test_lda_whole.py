"""Online LDA over every term of the documents."""

import pytest

from topicloom.models import words


def test_lda_keeps_every_term(spark):
    rows = [(i, ["common", f"only{i}", f"also{i}"]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id LONG, words ARRAY<STRING>")
    model, counted = words._count_vectors(docs, "words", 100)
    assert set(model.vocabulary) == {w for _, ws in rows for w in ws}
    assert all(r["features"].numNonzeros() == 3 for r in counted.collect())


def test_lda_of_rare_terms_only_and_of_too_many(spark):
    docs = spark.createDataFrame([(i, [f"only{i}"]) for i in range(6)], "doc_id LONG, words ARRAY<STRING>")
    theta, terms = words.online_lda(docs, 2, rounds=2)
    assert theta.select("doc_id").distinct().count() == 6 and {r["term"] for r in terms.collect()} == {f"only{i}" for i in range(6)}
    with pytest.raises(ValueError, match="6 terms"):
        words.online_lda(docs, 2, vocab=5)
