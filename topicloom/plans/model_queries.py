"""Queries that train models or run streams; SQL states only the parts that are closed forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.functions.numeric import r6 as R
from topicloom.models import clustering, encoders, gibbs, words
from topicloom.operators import corpus, sampling, topics
from topicloom.plans.base import SENTS, SENT_TOPIC, TOPS, Base, r6
from topicloom.session import cut, scratch
from topicloom.sources import writers
from topicloom.streaming import cooccurrence

K = 10
TARGET_WORDS = ["adapter", "router", "server", "kernel", "orbit", "probe", "vaccine", "remedy", "market", "winter"]


def _units(b: Base):
    """The vectors as units of small documents: eight neighbouring ids are a document."""
    return b.vectors().select(F.floor(F.col("vec_id") / 8).cast("long").alias("doc_id"), F.col("vec_id").alias("unit"), "vec")


def _gibbs(kind: str, rounds: int):
    def run(b: Base):
        model, state = gibbs.train(cut(_units(b), "units"), "doc_id", "unit", "vec", K, kind, rounds)
        return state.select("doc_id", F.explode(F.arrays_zip("units", "z")).alias("c")).select("doc_id", F.col("c.units").alias("unit"), F.col("c.z").alias("topic_id"))

    return run


def _vmf_parameters(b: Base):
    model, _ = gibbs.train(cut(_units(b), "units"), "doc_id", "unit", "vec", K, "vmf", 3)
    return gibbs.parameters(model, b.spark).select("topic_id", "n", "alpha", "kappa")


def _component_topics(b: Base):
    """Topics of two components each: weight and concentration of every component."""
    model, _ = gibbs.train(cut(_units(b), "units"), "doc_id", "unit", "vec", 5, "vmf", 3, components=2)
    return gibbs.parameters(model, b.spark).select("topic_id", "component", "weight", "kappa")


def _encoded_documents(b: Base):
    """Sentences encoded, grouped by document and modelled: from text to topics in one plan."""
    sents = b.sentences().select("doc_id", "sent_id", F.array_join(corpus.usable("tokens"), " ").alias("text")).where("text <> ''")
    docs = encoders.document_vectors(encoders.encoded(sents, "text", encoders.HashEncoder(16)))
    units = docs.select("doc_id", F.explode(F.arrays_zip("units", "vecs")).alias("u")).select("doc_id", F.col("u.units").cast("long").alias("unit"), F.col("u.vecs").cast("array<double>").alias("vec"))
    _, state = gibbs.train(units, "doc_id", "unit", "vec", 8, "vmf", 2, 2, 1)
    return state.select("doc_id", F.explode(F.arrays_zip("units", "z")).alias("c")).select("doc_id", F.col("c.units").alias("sent_id"), F.col("c.z").alias("topic_id"))


def _cluster(kind: str):
    def run(b: Base):
        v = cut(b.vectors(), "vectors")
        return clustering.predict(v, "vec_id", "vec", clustering.fit(v, "vec_id", "vec", K, kind, starts=2), kind)

    return run


def _senclu(b: Base):
    return clustering.senclu(cut(_units(b), "units"), "doc_id", "unit", "vec", K)[1]


def _sentence_words(b: Base):
    kept = corpus.restrict(corpus.sentence_tokens(b.sentences()), b.vocab())
    return kept.groupBy("doc_id", "sent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("words"))


def _doc_words(b: Base):
    return b.docs("document_tokens").select("doc_id", corpus.usable("document_tokens").alias("words")).where(F.size("words") > 0)


def _mvtm(b: Base):
    """Words as vectors of their own training, one direction model over them: OOV words are dropped by the join."""
    docs = cut(_doc_words(b), "doc-words")
    vecs = words.word2vec(docs, size=32, rounds=3)
    toks = docs.select("doc_id", F.posexplode("words").alias("unit", "word")).join(vecs, "word")
    from topicloom.functions.numeric import unit_safe

    units = toks.select("doc_id", F.col("unit").cast("long").alias("unit"), unit_safe(F.col("vec")).alias("vec"))
    _, state = gibbs.train(units, "doc_id", "unit", "vec", 8, "vmf", 2, 2, 1)
    return state.select("doc_id", F.explode("z").alias("topic_id")).groupBy("doc_id", "topic_id").agg(F.count(F.lit(1)).alias("n"))


def _labelled_vectors(b: Base):
    rows = b.vectors().select("vec_id", "vec", F.col("topic_id").cast("string").alias("label"))
    return cut(sampling.stratified_split(rows, "label", "vec_id"), "split")


def _classify(b: Base):
    split = _labelled_vectors(b)
    guesses = words.logistic(split.where("split = 'train'"), split.where("split = 'test'"), "vec", "label", "vec_id")
    return topics.confusion_metrics(guesses, "truth", "guess")


def _classify_documents(b: Base):
    """The topic shares of the first run's documents as features of their source, by two classifiers."""
    theta = cut(b.theta(), "theta")
    one = theta.join(F.broadcast(theta.agg(F.min("data_run").alias("data_run"))), "data_run")  # one row
    k = one.agg(F.max("topic_id")).first()[0] + 1
    shares = one.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("topic_id", "theta"))).alias("m"))
    dense = shares.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("vec"))
    split = cut(sampling.stratified_split(dense.join(b.labels(), "doc_id"), "label", "doc_id"), "split")
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    out = None
    for name, classify in (("logistic", words.logistic), ("svm", words.linear_svm)):
        one = topics.confusion_metrics(classify(train, test, "vec", "label", "doc_id"), "truth", "guess").withColumn("classifier", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _limited_classify(b: Base):
    """Ratios and counts of training rows, each drawn twice, with another draw where only one class came out."""
    split = _labelled_vectors(b)
    train, test = split.where("split = 'train'").drop("split"), split.where("split = 'test'")
    out = None
    for mode, value in (("ratio", 0.25), ("ratio", 0.5), ("count", 50)):
        for repeat in range(2):
            size = {mode: value}
            small, tries = sampling.until_two_classes(lambda seed, size=size: sampling.limited_train(train, "label", "vec_id", seed=seed, **size), "label", [str(42 + repeat * 1000 + retry * 100_000) for retry in range(2)])
            one = topics.confusion_metrics(words.logistic(small, test, "vec", "label", "vec_id"), "truth", "guess")
            one = one.select(F.lit(mode).alias("mode"), F.lit(float(value)).alias("value"), F.lit(repeat).alias("repeat"), F.lit(tries).alias("tries"), "*")
            out = one if out is None else out.unionByName(one)
    return out


def _stream(b: Base, target: list[str] | None = None):
    """The stream reads the documents in several files; batch and stream must agree. It counts TARGET_WORDS or the words given."""
    base = scratch(b.spark, "stream")
    docs = b.docs("document_tokens").select("doc_id", "document_tokens")
    docs.repartition(4, "doc_id").write.parquet(f"{base}/in")
    return cooccurrence.stream_pairs(b.spark, f"{base}/in", docs.schema, TARGET_WORDS if target is None else target, f"{base}/out", f"{base}/checkpoint")


def _stream_topics(b: Base):
    """The stream over the top words of all topics of all runs; their number follows the topics, not the documents."""
    return _stream(b, sorted(r["term"] for r in b.top_words().select("term").distinct().collect()))


_LIST = ", ".join(f"'{w}'" for w in TARGET_WORDS)
STREAM_SQL = f"""WITH d AS (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(list_filter(document_tokens, lambda t: t IS NOT NULL AND trim(t) <> ''), lambda t: lower(trim(t))), lambda t: t IN ({_LIST})))) AS ws
 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prepared_at DESC NULLS LAST) AS rn FROM preprocessed_document) WHERE rn = 1), e AS (SELECT doc_id, unnest(ws) AS w FROM d)
SELECT w AS w1, '' AS w2, count(*) AS c FROM e GROUP BY w UNION ALL SELECT a.w, b.w, count(*) FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.w < b.w GROUP BY ALL"""

STREAM_TOPICS_SQL = f"""WITH {TOPS}, e AS (SELECT DISTINCT doc_id, term AS w FROM toks WHERE term IN (SELECT term FROM tops))
SELECT w AS w1, '' AS w2, count(*) AS c FROM e GROUP BY w UNION ALL SELECT a.w, b.w, count(*) FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.w < b.w GROUP BY ALL"""


def _usif(b: Base):
    return words.usif_weights(cut(corpus.sentence_tokens(b.sentences()), "sentence-tokens")).select("term", "cnt", R("probability").alias("probability"), R("weight").alias("weight"))


USIF_SQL = f"""WITH {SENTS}, t AS (SELECT doc_id, sent_id, lower(trim(t)) AS term FROM (SELECT doc_id, sent_id, unnest(tokens) AS t FROM sents) WHERE t IS NOT NULL AND trim(t) <> ''),
w AS (SELECT term, count(*) AS cnt FROM t GROUP BY term), k AS (SELECT sum(cnt)::DOUBLE AS n, count(*)::DOUBLE AS v FROM w), l AS (SELECT avg(c) AS len FROM (SELECT count(*) AS c FROM t GROUP BY doc_id, sent_id)),
p AS (SELECT term, cnt, cnt / n AS p, v, len FROM w, k, l), h AS (SELECT avg(CASE WHEN p > 1.0 - pow(1.0 - 1.0 / v, len) THEN 1.0::DOUBLE ELSE 0.0 END) AS h FROM p), a AS (SELECT CASE WHEN h > 0 THEN (1.0 - h) / (h * v / 2) ELSE 1.0 END AS a FROM h, k)
SELECT term, cnt, {r6('p')} AS probability, {r6('a / (p + a / 2)')} AS weight FROM p, a"""


def _usif_sentences(b: Base):
    toks = cut(corpus.sentence_tokens(b.sentences()), "sentence-tokens")
    vecs = words.word2vec(cut(_doc_words(b), "doc-words"), size=32, rounds=3)
    return words.usif_vectors(toks, words.usif_weights(toks), vecs)


def _jsonl_round_trip(b: Base):
    path = scratch(b.spark, "jsonl")
    writers.jsonl(topics.from_counts(topics.assignments(b.sentence_topic())).select("data_run", "doc_id", "topic_id", "n"), path)
    return b.spark.read.schema("data_run STRING, doc_id LONG, n LONG, topic_id INT").json(path)


def _topic_count_grid(b: Base):
    """Log perplexity of mixtures of directions over a grid of topic counts; one small fit for each."""
    v = cut(b.vectors(), "vectors")
    rows = []
    for k in (2, 5, 10, 20):
        p = clustering.fit(v, "vec_id", "vec", k, "movmf", 5)
        rows.append((k, len(p["history"]), -float(p["history"][-1]), -float(p["history"][-1]) > 709.0))
    return b.spark.createDataFrame(rows, "topics INT, rounds INT, log_perplexity DOUBLE, overflow BOOLEAN")


def _feature_importance(b: Base):
    """The dimensions of largest and smallest weight for each class of a multinomial classifier."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = b.vectors().select(F.col("topic_id").cast("double").alias("label"), array_to_vector(F.col("vec")).alias("features"))
    m = LogisticRegression(family="multinomial", maxIter=20, regParam=1e-3).fit(rows).coefficientMatrix.toArray()
    out = []
    for c in range(m.shape[0]):
        order = sorted(range(m.shape[1]), key=lambda d, c=c: (-m[c, d], d))
        for side, chosen in (("largest", order[:5]), ("smallest", order[::-1][:5])):
            out += [(c, side, rank, int(d), float(m[c, d])) for rank, d in enumerate(chosen, 1)]
    return b.spark.createDataFrame(out, "class INT, side STRING, rank INT, dimension INT, weight DOUBLE")


def _soft_inference(b: Base):
    model, _ = gibbs.train(cut(_units(b), "units"), "doc_id", "unit", "vec", K, "vmf", 2)
    return gibbs.infer(_units(b), "doc_id", "unit", "vec", model)


QUERIES = {
    "topic_count_grid": (_topic_count_grid, None),
    "feature_importance": (_feature_importance, None),
    "vmf_soft_inference": (_soft_inference, None),
    "vmf_sentence_topics": (_gibbs("vmf", 4), None),
    "vmf_topic_parameters": (_vmf_parameters, None),
    "vmf_component_topics": (_component_topics, None),
    "vmf_encoded_documents": (_encoded_documents, None),
    "euclidean_kmeans": (_cluster("kmeans"), None),
    "document_classification": (_classify_documents, None),
    "gaussian_sentence_topics": (_gibbs("gaussian", 2), None),
    "word_vector_topics": (_mvtm, None),
    "spherical_kmeans": (_cluster("skmeans"), None),
    "direction_mixture": (_cluster("movmf"), None),
    "diagonal_gaussian_mixture": (_cluster("gmm"), None),
    "spark_kmeans": (lambda b: clustering.spark_kmeans(cut(b.vectors(), "vectors"), "vec_id", "vec", K, cosine=False), None),
    "sentence_cluster_topics": (_senclu, None),
    "sentence_lda": (lambda b: words.sentence_lda(_sentence_words(b), K, 3)[0], None),
    "online_lda": (lambda b: words.online_lda(cut(_doc_words(b), "doc-words"), K)[0], None),
    "logistic_classification": (_classify, None),
    "limited_classification": (_limited_classify, None),
    "streaming_cooccurrence": (_stream, lambda: STREAM_SQL),
    "streaming_topic_cooccurrence": (_stream_topics, lambda: STREAM_TOPICS_SQL),
    "usif_word_weights": (_usif, lambda: USIF_SQL),
    "usif_sentence_vectors": (_usif_sentences, None),
    "jsonl_round_trip": (
        _jsonl_round_trip,
        lambda: f"WITH {SENT_TOPIC}, asg AS (SELECT data_run, doc_id, sent_id, topic_id FROM (SELECT *, row_number() OVER (PARTITION BY data_run, doc_id, sent_id ORDER BY p DESC, topic_id) AS r FROM st) WHERE r = 1) SELECT data_run, doc_id, topic_id, count(*) AS n FROM asg GROUP BY ALL",
    ),
}
