"""The streaming count over the words of all topics against its SQL, and against the ten words of streaming_cooccurrence."""

import glob
import os

import pytest

from topicloom.plans import catalogue
from topicloom.plans.model_queries import TARGET_WORDS

FOLDER = "/root/testdata/sf0.001"


def test_stream_counts_every_topic_word(spark):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = sorted(map(tuple, catalogue.queries()["streaming_topic_cooccurrence"](spark, FOLDER).select("w1", "w2", "c").collect()))
    assert got == sorted(con.execute(f"SELECT w1, w2, c FROM ({catalogue.oracle_sql()['streaming_topic_cooccurrence']})").fetchall())
    top = {r["term"] for r in catalogue.queries()["weighted_tf_words"](spark, FOLDER).collect()}
    assert {w for w, other, _ in got if not other} == top and top - set(TARGET_WORDS)


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    from topicloom.streaming import cooccurrence

    schema = "doc_id LONG, document_tokens ARRAY<STRING>"
    one = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", None, " C "])], schema)
    two = spark.createDataFrame([(3, ["a", "b"]), (4, None), (5, ["c", "a"])], schema)
    paths = [str(tmp_path / x) for x in ("in", "out", "checkpoint")]
    one.coalesce(1).write.parquet(paths[0])
    key = lambda df: sorted(map(tuple, df.select("w1", "w2", "c").collect()))
    assert key(cooccurrence.stream_pairs(spark, paths[0], one.schema, None, *paths[1:])) == key(cooccurrence.document_pairs(one))
    two.coalesce(1).write.mode("append").parquet(paths[0])
    for _ in range(2):  # the second run finds nothing new
        assert key(cooccurrence.stream_pairs(spark, paths[0], one.schema, None, *paths[1:])) == key(cooccurrence.document_pairs(one.unionByName(two)))
