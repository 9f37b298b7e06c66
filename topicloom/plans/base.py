"""Frames and SQL that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators import corpus, topics, topicwords
from topicloom.session import cut, table

TOP_N = 10


class Base:
    """The usual starting frames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._made = spark, sf_dir, {}

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def once(self, name: str, make) -> DataFrame:
        """A frame that several steps of a query read: written once, read back after."""
        if name not in self._made:
            self._made[name] = cut(make(), name)
        return self._made[name]

    def docs(self, *columns: str) -> DataFrame:
        """The latest row of every document; only the columns named are carried through the aggregation."""
        rows = self.table("preprocessed_document")
        return corpus.documents(rows.select("doc_id", "prepared_at", *columns) if columns else rows)

    def tokens(self) -> DataFrame:
        return self.once("tokens", lambda: corpus.tokens(self.docs("document_tokens")))

    def sentences(self) -> DataFrame:
        return corpus.sentences(self.docs("sentences_raw", "sentences_tokenized"))

    def vocab(self) -> DataFrame:
        return self.once("vocabulary", lambda: corpus.vocabulary(self.tokens()))

    def theta(self) -> DataFrame:
        return topics.valid_latest(self.table("doc_topic"), ["data_run", "doc_id", "topic_id"], "theta")

    def sentence_topic(self) -> DataFrame:
        rows = self.table("sentence_topic").where("topic_id is not null")
        return topics.valid_latest(rows, ["data_run", "doc_id", "sent_id", "topic_id"], "p")

    def labels(self) -> DataFrame:
        """(doc_id, label): the source of each document, trimmed, in lower case."""
        return self.docs("source").select("doc_id", F.lower(F.trim("source")).alias("label")).where("label <> ''")

    def bow(self) -> DataFrame:
        return corpus.bag_of_words(corpus.restrict(self.tokens(), self.vocab()), ["doc_id"])

    def top_words(self) -> DataFrame:
        """The words of most weight of every topic of every run, among those of the vocabulary."""
        mass = topicwords.joint_mass(self.theta(), self.bow(), ["doc_id"], "theta")
        return topicwords.top_words(mass.where("mass > 0"), TOP_N, "mass")

    def vectors(self) -> DataFrame:
        rows = self.table("embeddings")
        return rows.select("vec_id", F.col("label").alias("topic_id"), F.col("embedding").cast("array<double>").alias("vec"))

    def train(self) -> DataFrame:
        """(row_id, label, source, posted_at), once per row."""
        rows = self.table("train").select("row_id", F.lower(F.trim("target_str")).alias("label"), F.lower(F.trim("source")).alias("source"), "posted_at")
        return rows.groupBy("row_id").agg(F.max(F.struct("label", "source", "posted_at")).alias("_m")).select("row_id", "_m.*")

    def runs(self) -> DataFrame:
        """Run results made of the events: model, dataset, category, iteration, start and a metric."""
        e = self.table("events")
        return e.select(
            F.col("event_type").alias("model"),
            F.concat(F.lit("set"), (F.col("user_id") % 3).cast("string")).alias("dataset"),
            F.when(F.col("user_id") % 5 == 0, "all").otherwise(F.concat(F.lit("cat"), (F.col("user_id") % 5).cast("string"))).alias("category"),
            (F.col("event_id") % 4).cast("int").alias("iteration"),
            F.col("ts").alias("started_at"),
            F.col("event_id").alias("execution_id"),
            F.col("value").alias("metric"),
        )


R6 = "floor(({}) * 1e6 + 0.5001) / 1e6"


def r6(x: str) -> str:
    return R6.format(x)


DOCS = """docs AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prepared_at DESC NULLS LAST) AS rn FROM preprocessed_document) WHERE rn = 1)"""
TOKS = DOCS + """,
raw_toks AS (SELECT doc_id, unnest(list_filter(document_tokens, lambda t: t IS NOT NULL AND trim(t) <> '')) AS t, unnest(range(0, len(list_filter(document_tokens, lambda t: t IS NOT NULL AND trim(t) <> '')))) AS pos FROM docs WHERE document_tokens IS NOT NULL),
toks AS (SELECT doc_id, pos, lower(trim(t)) AS term FROM raw_toks)"""
SENTS = DOCS + """,
sents AS (SELECT doc_id, i AS sent_id, sentences_raw[i + 1] AS raw, sentences_tokenized[i + 1] AS tokens FROM
  (SELECT doc_id, sentences_raw, sentences_tokenized, unnest(range(0, least(len(sentences_raw), len(sentences_tokenized)))) AS i FROM docs WHERE sentences_raw IS NOT NULL AND sentences_tokenized IS NOT NULL))"""
VOCAB = TOKS + """,
nd AS (SELECT count(DISTINCT doc_id) AS n_docs FROM toks),
freq AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM toks GROUP BY term),
vocab AS (SELECT term, df, cf FROM freq, nd WHERE df >= 3 AND df <= 0.7::DOUBLE * n_docs)"""
BOW = VOCAB + """,
bow AS (SELECT doc_id, term, count(*) AS cnt FROM toks WHERE term IN (SELECT term FROM vocab) GROUP BY doc_id, term)"""
THETA = """theta AS (SELECT data_run, doc_id, topic_id, theta FROM (SELECT *, row_number() OVER (PARTITION BY data_run, doc_id, topic_id ORDER BY loaded_at DESC NULLS LAST, theta DESC NULLS LAST) AS rn FROM doc_topic) WHERE rn = 1 AND theta IS NOT NULL AND NOT isnan(theta))"""
SENT_TOPIC = """st AS (SELECT data_run, doc_id, sent_id, topic_id, p FROM (SELECT *, row_number() OVER (PARTITION BY data_run, doc_id, sent_id, topic_id ORDER BY loaded_at DESC NULLS LAST, p DESC NULLS LAST) AS rn FROM sentence_topic WHERE topic_id IS NOT NULL) WHERE rn = 1 AND p IS NOT NULL AND NOT isnan(p))"""
LABELS = "labels AS (SELECT doc_id, lower(trim(source)) AS label FROM docs WHERE lower(trim(source)) <> '')"
MASS = BOW + ",\n" + THETA + """,
mass AS (SELECT data_run, topic_id, term, sum(theta * cnt) AS mass FROM theta JOIN bow USING (doc_id) GROUP BY ALL)"""
TOPS = MASS + f""",
tops AS (SELECT * FROM (SELECT data_run, topic_id, term, score, row_number() OVER (PARTITION BY data_run, topic_id ORDER BY score DESC, term) AS rank
  FROM (SELECT data_run, topic_id, term, {r6('mass')} AS score FROM mass WHERE mass > 0)) WHERE rank <= {TOP_N})"""
VECTORS = "vecs AS (SELECT vec_id, label AS topic_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
TRAIN = """tr AS (SELECT row_id, label, source, posted_at FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY label DESC NULLS LAST, source DESC NULLS LAST, posted_at DESC NULLS LAST) AS rn
  FROM (SELECT row_id, lower(trim(target_str)) AS label, lower(trim(source)) AS source, posted_at FROM train)) WHERE rn = 1)"""
RUNS = """runs AS (SELECT event_type AS model, 'set' || (user_id % 3) AS dataset, CASE WHEN user_id % 5 = 0 THEN 'all' ELSE 'cat' || (user_id % 5) END AS category,
  CAST(event_id % 4 AS INTEGER) AS iteration, ts AS started_at, event_id AS execution_id, value AS metric FROM events)"""
