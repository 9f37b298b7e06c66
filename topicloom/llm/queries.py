"""The registered queries of this subpackage, and SQL for those that SQL can state over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from topicloom.llm import abuse, mixing, overlap, quoting, sampling, sentences, termcounts, tokens, topn
from topicloom.session import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def on(f: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: f(*[table(spark, sf_dir, n) for n in names])

    return {
        "p1_found": on(topn.found, "sentence_topic", "doc_topic"),
        "p2_found": on(quoting.found, "train"),
        "p2_new_text": on(quoting.new_text, "train"),
        "p3_found": on(overlap.found, "train", "test"),
        "p3_report": on(overlap.report, "train", "test"),
        "p4_found": on(sentences.found, "preprocessed_document"),
        "p4_units": on(sentences.sentence_units, "preprocessed_document"),
        "p5_sample": on(sampling.reservoir_sample, "reference_stream"),
        "p6_found": on(termcounts.found, "preprocessed_document"),
        "p6_ngrams": on(lambda d: termcounts.marked_terms(d, max_n=5), "preprocessed_document"),
        "p6_vocabulary": on(termcounts.against_vocabulary, "preprocessed_document", "gaussian_lda_vocab"),
        "p7_ids": on(tokens.ids, "documents"),
        "p8_mix": on(lambda d, m: mixing.mix(d, m)[0], "documents", "mix_targets"),
        # as many tokens as 80 % of the supply, which scarce sources can't fill at their targets: the exponent is bisected
        "p8_tempered": on(lambda d, m: mixing.mix(d, m, budget=0.8)[0], "documents", "mix_targets"),
        "p8_tempered_report": on(lambda d, m: mixing.mix(d, m, budget=0.8)[1], "documents", "mix_targets"),
        "p9_found": on(abuse.found, "documents"),
        "p9_rates": on(abuse.rates, "documents"),
        "p9_scores": on(lambda d: abuse.scored(d).select("doc_id", "source", "score"), "documents"),
        "p8_report": on(lambda d, m: mixing.mix(d, m)[1], "documents", "mix_targets"),
    }


P1_FOUND = """
WITH s AS (
  SELECT *, row_number() OVER (PARTITION BY data_run, topic_id, doc_id, sent_id
    ORDER BY loaded_at DESC NULLS LAST, (p IS NOT NULL AND NOT isnan(p)) DESC, p DESC NULLS LAST) AS rn
  FROM sentence_topic WHERE topic_id IS NOT NULL
), d AS (
  SELECT *, row_number() OVER (PARTITION BY data_run, doc_id, topic_id
    ORDER BY loaded_at DESC NULLS LAST, (theta IS NOT NULL AND NOT isnan(theta)) DESC, theta DESC NULLS LAST) AS rn
  FROM doc_topic WHERE topic_id IS NOT NULL
), sr AS (
  SELECT *, row_number() OVER (PARTITION BY data_run, topic_id ORDER BY p DESC, doc_id, sent_id) AS r
  FROM s WHERE rn = 1 AND p IS NOT NULL AND NOT isnan(p)
), dr AS (
  SELECT *, row_number() OVER (PARTITION BY data_run, doc_id ORDER BY theta DESC, topic_id) AS r
  FROM d WHERE rn = 1 AND theta IS NOT NULL AND NOT isnan(theta)
)
SELECT 'sentence' AS level, data_run, topic_id, doc_id, sent_id FROM sr WHERE r <= 10
UNION ALL
SELECT 'document', data_run, topic_id, doc_id, CAST(-1 AS INTEGER) FROM dr WHERE r <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND}
