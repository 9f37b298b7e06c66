"""Registered queries of the core against their SQL, on the smallest tables."""

import glob
import math
import os

import pytest

from topicloom.plans import catalogue, preparation_queries, selection_queries, step_queries

FOLDER = "/root/testdata/sf0.001"
NAMES = """coherence_doc_npmi coherence_c_npmi topic_diversity proxy_word_npmi_words class_tfidf_words doc_topic_from_posteriors sentence_given_topic label_topic_profile_pmi
sentence_quality audit_review_sample modelable_selection drop_reasons vocabulary_df_filter sentence_bow stratified_split reference_jsonl_scan topic_cosine_matrix
predictive_perplexity whitening_moments nearest_vectors run_coverage best_and_second usif_word_weights streaming_cooccurrence""".split()


#: The queries of these modules, all that have SQL.
NAMES += [n for m in (preparation_queries, selection_queries, step_queries) for n, (_, sql) in m.QUERIES.items() if sql]
NAMES += ["greedy_unique_pairs", "whitened_covariance", "assignment_word_scores", "sliding_window_counts"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.6f}"


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    result = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in result.fetchall())
    assert sorted(names) == cols and got == want


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
