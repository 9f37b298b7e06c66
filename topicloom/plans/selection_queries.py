"""Queries over what can be selected, what is dropped and what is put back, and over results written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.functions import text as X
from topicloom.functions.numeric import r6 as R
from topicloom.operators import corpus, runs, topics
from topicloom.plans.base import BOW, DOCS, LABELS, RUNS, SENT_TOPIC, SENTS, THETA, VOCAB, Base, r6
from topicloom.plans.corpus_queries import MD5, SELECT_SQL
from topicloom.plans.preparation_queries import TOKEN_SQL, _raw_sql
from topicloom.plans.topic_queries import ASSIGNED
from topicloom.plans.vector_queries import _PAIRS_SQL, _pairs
from topicloom.session import scratch
from topicloom.sources import readers, writers


def _predicates(b: Base):
    """Five predicates of every document: tokens, text, a sentence that is not blank, a modelable one, a word of the vocabulary."""
    docs = b.docs("document_tokens", "raw_text", "sentences_raw", "sentences_tokenized")
    kept = corpus.selection(docs)[0].select("doc_id").distinct().withColumn("_k", F.lit(True))
    known = corpus.restrict(b.tokens(), b.vocab()).select("doc_id").distinct().withColumn("_v", F.lit(True))
    rows = docs.join(kept, "doc_id", "left").join(known, "doc_id", "left")
    no = F.lit(False)
    return rows.select(
        "doc_id",
        F.coalesce(F.size(corpus.usable("document_tokens")) > 0, no).alias("has_tokens"),
        (F.coalesce(F.trim("raw_text"), F.lit("")) != "").alias("has_text"),
        F.coalesce(F.exists("sentences_raw", lambda s: F.coalesce(F.trim(s), F.lit("")) != ""), no).alias("has_sentence"),
        F.coalesce("_k", no).alias("is_modelable"),
        F.coalesce("_v", no).alias("has_vocabulary"),
    )


def _vocabulary_drops(b: Base):
    """Documents with modelable sentences of which none has a word of the vocabulary."""
    kept = corpus.selection(b.docs("sentences_raw", "sentences_tokenized", "document_tokens"))[0]
    known = corpus.restrict(corpus.sentence_tokens(b.sentences()), b.vocab()).select("doc_id", "sent_id").distinct()
    left = kept.join(known, ["doc_id", "sent_id"], "left_semi").select("doc_id").distinct()
    return kept.select("doc_id").distinct().join(left, "doc_id", "left_anti").withColumn("reason", F.lit("no_vocabulary_tokens"))


def _empty_documents(b: Base):
    """For every run the documents with sentences that it has no rows of: their sums are 0, their means uniform over its topics."""
    st = b.sentence_topic()
    sizes = st.groupBy("data_run").agg((F.max("topic_id") + 1).alias("k"))
    docs = b.sentences().select("doc_id").distinct()
    grid = docs.crossJoin(F.broadcast(sizes))  # documents x runs, as asked
    return grid.join(st.select("data_run", "doc_id").distinct(), ["data_run", "doc_id"], "left_anti").select("data_run", "doc_id", F.lit(0.0).alias("from_sums"), R(F.lit(1.0) / F.col("k")).alias("from_means"))


def _ranked_pairs(b: Base):
    """The fifty pairs of largest gap; ties by the far and the close distance, then by the ids."""
    gap = F.round(F.col("far") - F.col("close"), 6)
    rows = _pairs(b).withColumn("gap", gap).orderBy(F.col("gap").desc(), F.col("far").desc(), "close", "a", "b").limit(50)
    return rows.select("a", "b", "gap")


def _results(b: Base):
    """Topic shares written by run, read again with one run pruned."""
    path = scratch(b.spark, "results")
    writers.result_table(topics.from_counts(topics.assignments(b.sentence_topic())).select("data_run", "doc_id", "topic_id", "n"), path, ["data_run"])
    return b.spark.read.schema("data_run STRING, doc_id LONG, topic_id INT, n LONG").parquet(path).groupBy("data_run", "topic_id").agg(F.sum("n").alias("sentences"), F.count(F.lit(1)).alias("documents"))


def _whitespace_documents(b: Base, size: int = 300, max_df: float = 0.8):
    """Documents as the terms among the most frequent ones that are not in too many documents."""
    rows = b.table("documents").where("text is not null").select("doc_id", F.explode(X.whitespace_terms(F.col("text"), ["the", "a", "of", "and", "in"])).alias("term"))
    n = rows.agg(F.count_distinct("doc_id").alias("_n"))
    terms = corpus.document_frequency(rows).crossJoin(F.broadcast(n)).where(F.col("df") <= F.lit(max_df) * F.col("_n"))  # one row
    kept = terms.orderBy(F.col("cf").desc(), "term").limit(size).select("term")
    return corpus.bag_of_words(corpus.restrict(rows, kept), ["doc_id"])


def _places(b: Base):
    """Where the documents of the first run stand in the last one, each run's documents in order of their ids."""
    docs = b.theta().select("data_run", "doc_id").distinct()
    ends = docs.agg(F.min("data_run").alias("first"), F.max("data_run").alias("last"))
    sides = []
    for side in ("first", "last"):
        ids = docs.join(F.broadcast(ends.select(F.col(side).alias("data_run"))), "data_run").select("doc_id")  # one row
        sides.append(readers.numbered([ids.orderBy("doc_id")], "place"))
    return runs.aligned(*sides, "doc_id")


JAPANESE = X.JAPANESE_TOKEN
QUERIES = {
    "document_predicates": (
        _predicates,
        lambda: f"""WITH {SELECT_SQL}, {VOCAB.removeprefix(DOCS)[1:].strip()}, kn AS (SELECT DISTINCT doc_id FROM toks WHERE term IN (SELECT term FROM vocab))
SELECT d.doc_id, coalesce(len(list_filter(document_tokens, lambda t: t IS NOT NULL AND trim(t) <> '')) > 0, false) AS has_tokens, trim(coalesce(raw_text, '')) <> '' AS has_text,
coalesce(len(list_filter(sentences_raw, lambda s: trim(coalesce(s, '')) <> '')) > 0, false) AS has_sentence, w.reason IS NULL AS is_modelable, kn.doc_id IS NOT NULL AS has_vocabulary
FROM docs d JOIN why w USING (doc_id) LEFT JOIN kn USING (doc_id)""",
    ),
    "vocabulary_drops": (
        _vocabulary_drops,
        lambda: f"""WITH {SELECT_SQL}, {VOCAB.removeprefix(DOCS)[1:].strip()}, {SENTS.removeprefix(DOCS)[1:].strip()},
kn AS (SELECT DISTINCT doc_id, sent_id FROM (SELECT doc_id, sent_id, unnest(tokens) AS t FROM sents) WHERE t IS NOT NULL AND trim(t) <> '' AND lower(trim(t)) IN (SELECT term FROM vocab)),
k AS (SELECT c.doc_id, c.sent_id FROM cells c JOIN why w USING (doc_id) WHERE w.reason IS NULL AND good)
SELECT doc_id, 'no_vocabulary_tokens' AS reason FROM (SELECT DISTINCT doc_id FROM k) WHERE doc_id NOT IN (SELECT doc_id FROM k JOIN kn USING (doc_id, sent_id))""",
    ),
    "label_extraction": (
        lambda b: corpus.extracted_labels(b.docs("source", "sentences_raw"), "source", "sentences_raw", ["newsgroup", "newswire", "encyclopedia"]).select("doc_id", "label"),
        lambda: f"WITH {DOCS} SELECT doc_id, trim(source) AS label FROM docs WHERE trim(source) IN ('newsgroup', 'newswire', 'encyclopedia') AND len(list_filter(sentences_raw, lambda s: trim(coalesce(s, '')) <> '')) > 0",
    ),
    "empty_document_shares": (
        _empty_documents,
        lambda: f"""WITH {SENTS}, {SENT_TOPIC}, k AS (SELECT data_run, max(topic_id) + 1 AS k FROM st GROUP BY 1), d AS (SELECT DISTINCT doc_id FROM sents)
SELECT data_run, doc_id, 0.0::DOUBLE AS from_sums, {r6('1.0::DOUBLE / k')} AS from_means FROM d CROSS JOIN k ANTI JOIN (SELECT DISTINCT data_run, doc_id FROM st) h USING (data_run, doc_id)""",
    ),
    "bag_of_words_repaired": (
        lambda b: b.docs("document_tokens").where(F.size(corpus.usable("document_tokens")) > 0).select("doc_id").join(b.bow().groupBy("doc_id").agg(F.sum("cnt").alias("n")), "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))),
        lambda: f"WITH {BOW} SELECT d.doc_id, coalesce(sum(cnt), 0)::BIGINT AS n FROM (SELECT DISTINCT doc_id FROM toks) d LEFT JOIN bow USING (doc_id) GROUP BY d.doc_id",
    ),
    "mean_std_rounded": (
        lambda b: runs.table_mean_std(b.runs(), ["model", "dataset"], "metric").select("model", "dataset", F.bround(R("mean"), 2).alias("mean"), F.bround(R("std"), 2).alias("std")),
        lambda: f"WITH {RUNS} SELECT model, dataset, round_even({r6('avg(metric)')}, 2) AS mean, round_even({r6('stddev_pop(metric)')}, 2) AS std FROM runs GROUP BY ALL",
    ),
    "script_run_tokens": (
        lambda b: b.docs("raw_text", "lang").where("lang = 'ja' and raw_text is not null").select("doc_id", F.posexplode(X.script_runs(F.col("raw_text"))).alias("pos", "token")),
        lambda: f"WITH {DOCS}, t AS (SELECT doc_id, list_transform(regexp_extract_all(raw_text, '{JAPANESE}'), lambda w: CASE WHEN regexp_matches(w, '^[0-9]') THEN '<NUM>' ELSE lower(w) END) AS a FROM docs WHERE lang = 'ja' AND raw_text IS NOT NULL) SELECT doc_id, CAST(i AS INTEGER) AS pos, a[i + 1] AS token FROM (SELECT *, unnest(range(0, len(a))) AS i FROM t)",
    ),
    "whitespace_documents": (
        _whitespace_documents,
        lambda: """WITH w AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ')) AS term FROM documents), r AS (SELECT * FROM w WHERE term <> '' AND term NOT IN ('the', 'a', 'of', 'and', 'in')),
k AS (SELECT term FROM r GROUP BY term HAVING count(DISTINCT doc_id) <= 0.8::DOUBLE * (SELECT count(DISTINCT doc_id) FROM r) ORDER BY count(*) DESC, term LIMIT 300)
SELECT doc_id, term, count(*) AS cnt FROM r WHERE term IN (SELECT term FROM k) GROUP BY ALL""",
    ),
    "ranked_pairs": (_ranked_pairs, lambda: f"SELECT a, b, gap FROM (SELECT a, b, far, close, round(far - close, 6) AS gap FROM ({_PAIRS_SQL})) ORDER BY gap DESC, far DESC, close, a, b LIMIT 50"),
    "result_round_trip": (
        _results,
        lambda: f"WITH {ASSIGNED} SELECT data_run, topic_id, count(*) AS sentences, count(DISTINCT doc_id) AS documents FROM asg GROUP BY ALL",
    ),
    "aligned_places": (
        _places,
        lambda: f"""WITH {THETA}, d AS (SELECT DISTINCT data_run, doc_id FROM theta), f AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM d WHERE data_run = (SELECT min(data_run) FROM d)),
l AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM d WHERE data_run = (SELECT max(data_run) FROM d)) SELECT f.doc_id, f.p AS left_place, l.p AS right_place FROM f JOIN l USING (doc_id)""",
    ),
    "tokenized_documents": (
        lambda b: corpus.tokenized(b.docs("raw_text", "lang").where("lang = 'ja'"), "raw_text", "japanese").select("doc_id", F.size("sentences_raw").alias("sentences"), F.array_join("document_tokens", " ").alias("tokens")),
        lambda: f"""WITH {_raw_sql().replace('FROM docs)', "FROM docs WHERE lang = 'ja')", 1)}, t AS (SELECT doc_id, sent_id, list_transform(regexp_extract_all(raw, '{JAPANESE}'), lambda w: CASE WHEN regexp_matches(w, '^[0-9]') THEN '<NUM>' ELSE lower(w) END) AS a FROM sents)
SELECT p.doc_id, CAST(len(p.a) AS INTEGER) AS sentences, coalesce((SELECT string_agg(array_to_string(t.a, ' '), ' ' ORDER BY sent_id) FROM t WHERE t.doc_id = p.doc_id AND len(t.a) > 0), '') AS tokens FROM parts p""",
    ),
    "reference_corpus": (
        lambda b: corpus.reference_corpus(b.table("documents"), "doc_id", "text", 200, 20, fold=False).select("doc_id", F.array_join("tokens", " ").alias("tokens")),
        lambda: f"""WITH t AS (SELECT doc_id, {TOKEN_SQL.format(x="coalesce(text, '')")} AS a FROM documents)
SELECT doc_id, array_to_string(a, ' ') AS tokens FROM t WHERE len(a) >= 20 ORDER BY {MD5.format(seed=42, key='doc_id::VARCHAR')}, doc_id LIMIT 200""",
    ),
    "labelled_shares": (
        lambda b: b.theta().join(b.labels(), "doc_id").groupBy("data_run", "label", "topic_id").agg(R(F.sum("theta")).alias("mass"), F.count(F.lit(1)).alias("documents")),
        lambda: f"WITH {DOCS}, {LABELS}, {THETA} SELECT data_run, label, topic_id, {r6('sum(theta)')} AS mass, count(*) AS documents FROM theta JOIN labels USING (doc_id) GROUP BY ALL",
    ),
}
