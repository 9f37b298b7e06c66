"""Queries from raw text to prepared documents, over sources by name and year, and over tables of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.functions import text as X
from topicloom.functions.numeric import r6 as R
from topicloom.operators import corpus, runs, sampling, topics, topicwords
from topicloom.plans.base import BOW, DOCS, LABELS, MASS, RUNS, SENT_TOPIC, THETA, TOPS, TRAIN, VOCAB, Base, r6
from topicloom.plans.corpus_queries import MD5, SELECT_SQL, _clean_sql, _judged_sql
from topicloom.plans.topic_queries import _proxy_sql
from topicloom.session import cut, scratch
from topicloom.sources import readers, writers

Q = lambda s: "'" + s.replace("'", "''") + "'"


def _split_sql(x: str) -> str:
    sql = f"trim(regexp_replace({x}, {Q(X.SPACES)}, ' ', 'g'))"
    for pattern, put in X.SENTENCE_RULES:
        sql = f"regexp_replace({sql}, {Q(pattern)}, {Q(put)}, 'g')"
    return f"list_filter(list_transform(string_split({sql}, {Q(X.ENDED)}), lambda s: trim(translate(s, {Q(X.HELD)}, '.'))), lambda s: s <> '')"


def _repair_sql(x: str) -> str:
    one = lambda y: f"regexp_replace({y}, '\\b([A-Za-z]{{2,}}[.!?][\"'']?)([A-Za-z]{{2,}})\\b', '\\1 \\2', 'g')"
    return one(one(x))


def _raw_sql(repair: bool = False) -> str:
    """sents (doc_id, sent_id, raw) split from raw_text, in the place of the stored lists."""
    text = "coalesce(raw_text, '')"
    return DOCS + f""",
parts AS (SELECT doc_id, {_split_sql(_repair_sql(text) if repair else text)} AS a FROM docs),
sents AS (SELECT doc_id, CAST(i AS INTEGER) AS sent_id, a[i + 1] AS raw FROM (SELECT *, unnest(range(0, len(a))) AS i FROM parts))"""


def _judged_raw(b: Base):
    return corpus.judged_sentences(corpus.raw_sentences(b.docs("raw_text"), repair=True), unicode=False)


def _lemmas(b: Base):
    """A lemma table made of the vocabulary: words in -s whose form without it is a word too."""
    v = b.vocab().select("term")
    return v.join(v.select(F.concat("term", F.lit("s")).alias("_p"), F.col("term").alias("lemma")), F.col("term") == F.col("_p")).select("term", "lemma")


def _topic_words_by_source(b: Base):
    """Learned words for the runs that have them, here those with an even digest, proxies for the others."""
    even = F.conv(F.substring(F.md5("data_run"), 1, 1), 16, 10).cast("int") % 2 == 0
    learned = b.top_words().where(even).select("data_run", "topic_id", "rank", "term", F.lit("learned").alias("origin"))
    scores = topicwords.proxy_scores(b.theta().where(~even), b.bow(), ["doc_id"], "theta").where("score is not null")
    return learned.unionByName(topicwords.top_words(scores, 10).select("data_run", "topic_id", "rank", "term", F.lit("proxy").alias("origin")))


def _dictionary(b: Base):
    return b.table("gaussian_lda_vocab").select(corpus.normal(F.col("word")).alias("term")).where("term <> ''")


def _mass(b: Base):
    return topicwords.joint_mass(b.theta(), b.bow(), ["doc_id"], "theta").where("mass > 0")


def _coverage(b: Base):
    ids = b.docs("sentences_raw", "sentences_tokenized", "document_tokens")
    kept = corpus.selection(ids)[0].select("doc_id").distinct()
    return runs.doc_coverage(ids, b.labels(), kept, b.theta().select("data_run", "doc_id").distinct(), "data_run", "doc_id")


def _limited_runs(b: Base):
    """Runs with a mode and value on every third, as limited training leaves them."""
    third = F.col("execution_id") % 3 == 0
    return b.runs().withColumn("mode", F.when(third, "ratio")).withColumn("value", F.when(third, F.lit(0.5)))


def _latest_pointer(b: Base):
    path = scratch(b.spark, "runs")
    for half in (0, 1):
        writers.append_runs(b.runs().where(F.col("execution_id") % 2 == half), path)
    return writers.latest_view(b.spark, path, ["model", "dataset", "category"]).select("model", "dataset", "category", "execution_id")


def _numbered(b: Base):
    rows = readers.numbered([b.table("region").select(F.col("r_name").alias("name")).coalesce(1).sortWithinPartitions("name"), b.table("nation").select(F.col("n_name").alias("name")).coalesce(1).sortWithinPartitions("name")])
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "name")


def _theta_pairs(b: Base, close: float = 0.05, far: float = 0.6):
    """Pairs of documents that the first run's shares hold close and the last run's hold apart, by cosine distance: every hundredth document against all."""
    pairs = topics.near_and_apart(b.theta(), close, far)
    return pairs.select("a", "b", R("close").alias("close"), R("far").alias("far"))


TOKEN_SQL = "list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[0-9]+(?:[.,][0-9]+)?'), lambda w: CASE WHEN regexp_matches(w, '^[0-9]') THEN '<NUM>' ELSE lower(w) END), lambda w: regexp_matches(w, '^[0-9<]') OR length(w) >= 2)"
YEARS = (2023, 2022, 2023)

QUERIES = {
    "raw_sentences": (
        lambda b: corpus.raw_sentences(b.docs("raw_text")).select("doc_id", "sent_id", F.col("raw").alias("sentence")),
        lambda: f"WITH {_raw_sql()} SELECT doc_id, sent_id, raw AS sentence FROM sents",
    ),
    "segmented_text": (lambda b: corpus.segmented(b.docs("raw_text")), lambda: f"WITH {_raw_sql()} SELECT doc_id, array_to_string(a, ' / ') AS text FROM parts"),
    "raw_sentence_quality": (
        lambda b: _judged_raw(b).select("doc_id", "sent_id", "cleaned", "reason", R(F.try_divide(F.col("alpha_count"), F.col("char_count"))).alias("alpha_ratio")),
        lambda: f"WITH {_judged_sql(_raw_sql(True))} SELECT doc_id, sent_id, cleaned, reason, {r6('alpha_count / nullif(char_count, 0)')} AS alpha_ratio FROM ju",
    ),
    "prepared_from_raw_text": (
        lambda b: corpus.prepared_texts(_judged_raw(b)),
        lambda: f"WITH {_judged_sql(_raw_sql(True))} SELECT doc_id, string_agg(cleaned, ' / ' ORDER BY sent_id) AS text FROM ju WHERE reason = 'kept' GROUP BY doc_id",
    ),
    "english_tokens_folded": (
        lambda b: b.docs("raw_text").where("raw_text is not null").select("doc_id", F.posexplode(X.english_tokens(F.col("raw_text"), fold=True)).alias("pos", "token")),
        None,  # SQL has no NFKC
    ),
    "lemma_frequency": (
        lambda b: corpus.document_frequency(corpus.lemmatised(b.tokens(), _lemmas(b))),
        lambda: f"""WITH {VOCAB}, le AS (SELECT a.term, b.term AS lemma FROM vocab a JOIN vocab b ON a.term = b.term || 's'), lt AS (SELECT doc_id, coalesce(lemma, t.term) AS term FROM toks t LEFT JOIN le ON le.term = t.term)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM lt GROUP BY term""",
    ),
    "prepared_dataset": (
        lambda b: _prepared_dataset(b),
        lambda: f"""WITH {_judged_sql()}, {LABELS}, tx AS (SELECT doc_id, string_agg(cleaned, ' / ' ORDER BY sent_id) AS text FROM ju WHERE reason = 'kept' GROUP BY doc_id),
r AS (SELECT doc_id, text, label, row_number() OVER (PARTITION BY label ORDER BY {MD5.format(seed=42, key='doc_id::VARCHAR')}, doc_id) AS i, count(*) OVER (PARTITION BY label) AS n FROM tx JOIN labels USING (doc_id))
SELECT CASE WHEN i <= ceil(0.6::DOUBLE * n - 1e-9) THEN 'train' ELSE 'test' END AS split, text, label FROM r""",
    ),
    "dataset_split_rows": (
        lambda b: readers.dataset_split(b.spark, b.dir, {"mail": ["train", "test"], "forum": ["documents"]}, "mail").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("row_ids")),
        lambda: "SELECT split, count(*) AS n, count(DISTINCT row_id) AS row_ids FROM (SELECT 'train' AS split, row_id FROM train UNION ALL SELECT split, row_id FROM test) GROUP BY split",
    ),
    "labelled_frame": (
        lambda b: readers.labelled_frame(b.table("documents"), "text", "target_str"),
        lambda: "SELECT text, target_str AS label FROM documents WHERE text IS NOT NULL AND target_str IS NOT NULL",
    ),
    "fiscal_year_documents": (
        lambda b: readers.fiscal_years(b.table("documents"), "published_at", list(YEARS)).groupBy("run", "fiscal_year").agg(F.count(F.lit(1)).alias("n")),
        lambda: f"""WITH y AS (SELECT CAST(year(CAST(published_at AT TIME ZONE 'UTC' AS DATE) - INTERVAL 3 MONTH) AS INTEGER) AS fiscal_year FROM documents)
SELECT CAST(fiscal_year AS VARCHAR) AS run, fiscal_year, count(*) AS n FROM y WHERE fiscal_year IN {tuple(sorted(set(YEARS)))} GROUP BY fiscal_year""",
    ),
    "numbered_rows": (
        _numbered,
        lambda: "SELECT row_number() OVER (ORDER BY f, name) - 1 AS doc_id, name FROM (SELECT 0 AS f, r_name AS name FROM region UNION ALL SELECT 1, n_name FROM nation)",
    ),
    "category_texts": (
        lambda b: corpus.category_texts(
            b.table("train").select("row_id", "data", F.lower(F.trim("target_str")).alias("label")), "data", "label", "sci", {"sci": ["sci.orbit", "sci.medix"], "comp": ["comp.shading"]}
        ).select("row_id", F.length("data").alias("size"), "label"),
        lambda: "SELECT row_id, CAST(length(coalesce(data, '')) AS INTEGER) AS size, lower(trim(target_str)) AS label FROM train WHERE lower(trim(target_str)) IN ('sci.orbit', 'sci.medix')",
    ),
    "word_shares": (
        lambda b: corpus.shares(b.bow(), ["doc_id"]).select("doc_id", "term", R("share").alias("share")),
        lambda: f"WITH {BOW} SELECT doc_id, term, {r6('cnt / sum(cnt) OVER (PARTITION BY doc_id)')} AS share FROM bow",
    ),
    "limited_train_by_count": (
        lambda b: sampling.limited_train(corpus.labels(b.train(), "label"), "label", "row_id", count=60).select("row_id", "label"),
        lambda: f"""WITH {TRAIN}, r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {MD5.format(seed=42, key='row_id::VARCHAR')}, row_id) AS i, count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS t FROM tr WHERE label <> '')
SELECT row_id, label FROM r WHERE t <= 60 OR i <= greatest(1, floor(60.0::DOUBLE * n / t + 1e-9))""",
    ),
    "limited_train_uniform": (
        lambda b: sampling.limited_train(corpus.labels(b.train(), "label"), "label", "row_id", 0.1, stratified=False).select("row_id", "label"),
        lambda: f"""WITH {TRAIN}, r AS (SELECT row_id, label, row_number() OVER (ORDER BY {MD5.format(seed=42, key='row_id::VARCHAR')}, row_id) AS i, count(*) OVER () AS t FROM tr WHERE label <> '')
SELECT row_id, label FROM r WHERE i <= greatest(1, floor(0.1::DOUBLE * t + 1e-9))""",
    ),
    "dictionary_top_words": (
        lambda b: topicwords.dictionary_top_words(_mass(b), _dictionary(b), 20, "mass").select("data_run", "topic_id", "rank", "term", "score"),
        lambda: f"""WITH {MASS}, di AS (SELECT DISTINCT lower(trim(word)) AS term FROM gaussian_lda_vocab WHERE trim(word) <> ''), po AS (SELECT * FROM mass WHERE mass > 0), ax AS (SELECT DISTINCT data_run, topic_id FROM po),
j AS (SELECT ax.data_run, ax.topic_id, di.term, {r6('mass')} AS score FROM ax CROSS JOIN di LEFT JOIN po ON po.data_run = ax.data_run AND po.topic_id = ax.topic_id AND po.term = di.term)
SELECT * FROM (SELECT data_run, topic_id, CAST(row_number() OVER (PARTITION BY data_run, topic_id ORDER BY score DESC NULLS LAST, term) AS INTEGER) AS rank, term, score FROM j) WHERE rank <= 20""",
    ),
    "matrix_diversity": (
        lambda b: topicwords.matrix_diversity(cut(b.top_words(), "top-words"), b.theta(), _mass(b), 5).select("data_run", R("diversity").alias("diversity"), "topics"),
        lambda: f"""WITH {TOPS}, u AS (SELECT data_run, count(DISTINCT term) / count(*) AS d FROM tops WHERE rank <= 5 GROUP BY 1), k AS (SELECT data_run, count(DISTINCT topic_id) AS k FROM mass WHERE mass > 0 GROUP BY 1)
SELECT r.data_run, {r6('coalesce(d, 0.0)')} AS diversity, coalesce(k, 0) AS topics FROM (SELECT DISTINCT data_run FROM theta) r LEFT JOIN u USING (data_run) LEFT JOIN k USING (data_run)""",
    ),
    "topic_words_by_source": (
        _topic_words_by_source,
        lambda: f"""SELECT data_run, topic_id, CAST(rank AS INTEGER) AS rank, term, 'learned' AS origin FROM (WITH {TOPS} SELECT * FROM tops) WHERE ('0x' || substr(md5(data_run), 1, 1))::INTEGER % 2 = 0
UNION ALL SELECT data_run, topic_id, CAST(rank AS INTEGER), term, 'proxy' FROM ({_proxy_sql('word_npmi', 'doc')}) WHERE ('0x' || substr(md5(data_run), 1, 1))::INTEGER % 2 = 1""",
    ),
    "doc_coverage": (
        _coverage,
        lambda: f"""WITH {SELECT_SQL}, {LABELS}, {THETA}, kept AS (SELECT DISTINCT doc_id FROM why WHERE reason IS NULL), co AS (SELECT doc_id FROM theta GROUP BY doc_id HAVING count(DISTINCT data_run) = (SELECT count(DISTINCT data_run) FROM theta))
SELECT (SELECT count(DISTINCT doc_id) FROM docs) AS raw, (SELECT count(DISTINCT doc_id) FROM labels) AS label_filtered, (SELECT count(*) FROM kept) AS selected, (SELECT count(*) FROM co WHERE doc_id IN (SELECT doc_id FROM kept)) AS common""",
    ),
    "feature_catalog": (
        lambda b: runs.catalog(b.runs(), "dataset", "model", "category"),
        lambda: f"WITH {RUNS} SELECT dataset, string_agg(f, ',' ORDER BY f) AS features FROM (SELECT DISTINCT dataset, model || '/' || category AS f FROM runs) GROUP BY dataset",
    ),
    "models_in_order": (
        lambda b: runs.in_order(b.runs().groupBy("model").agg(F.count(F.lit(1)).alias("n")), "model", ["view", "click"]),
        lambda: f"""WITH {RUNS}, c AS (SELECT model, count(*) AS n FROM runs GROUP BY model) SELECT model, n, CAST(row_number() OVER (ORDER BY CASE model WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, model) AS INTEGER) AS place FROM c""",
    ),
    "matching_full_runs": (
        lambda b: runs.matching(_limited_runs(b), {"dataset": "set1", "iteration": 2}).groupBy("model", "category").agg(F.count(F.lit(1)).alias("n")),
        lambda: f"WITH {RUNS} SELECT model, category, count(*) AS n FROM runs WHERE dataset = 'set1' AND iteration = 2 AND execution_id % 3 <> 0 GROUP BY ALL",
    ),
    "runs_not_evaluated": (
        lambda b: runs.not_done(b.runs().select("model", "dataset", "category", "iteration").distinct(), b.runs().where("execution_id % 97 = 0"), ["model", "dataset", "category", "iteration"]),
        lambda: f"WITH {RUNS} SELECT DISTINCT model, dataset, category, iteration FROM runs ANTI JOIN (SELECT * FROM runs WHERE execution_id % 97 = 0) d USING (model, dataset, category, iteration)",
    ),
    "resolved_artifacts": (
        lambda b: runs.resolved(_limited_runs(b).where("mode is null"), ["model", "dataset"]).select("model", "dataset", "execution_id", "candidates"),
        lambda: f"WITH {RUNS} SELECT model, dataset, execution_id, candidates FROM (SELECT *, count(*) OVER (PARTITION BY model, dataset) AS candidates, row_number() OVER (PARTITION BY model, dataset ORDER BY started_at DESC, execution_id DESC) AS r FROM runs WHERE execution_id % 3 <> 0) WHERE r = 1",
    ),
    "latest_pointer": (
        _latest_pointer,
        lambda: f"WITH {RUNS} SELECT model, dataset, category, execution_id FROM (SELECT *, row_number() OVER (PARTITION BY model, dataset, category ORDER BY started_at DESC, execution_id DESC) AS r FROM runs) WHERE r = 1",
    ),
    "condition_fingerprints": (
        lambda b: b.runs().select("model", "category", "iteration").distinct().select("*", X.fingerprint({"model": F.col("model"), "iteration": F.col("iteration"), "category": F.col("category")}).alias("fp")),
        lambda: f"""WITH {RUNS} SELECT DISTINCT model, category, iteration, substr(sha1('{{"category":"' || category || '","iteration":' || iteration || ',"model":"' || model || '"}}'), 1, 10) AS fp FROM runs""",
    ),
    "latex_best_marked": (
        lambda b: runs.marked(runs.mean_std(b.runs(), ["dataset", "model"], "metric").select("dataset", "model", R("mean").alias("mean")), ["dataset"], "mean").select("dataset", "model", writers.marked_cell(F.col("mean"), F.col("mark"), 3).alias("cell")),
        lambda: f"""WITH {RUNS}, m AS (SELECT dataset, model, {r6('avg(metric)')} AS mean FROM runs GROUP BY ALL), d AS (SELECT *, dense_rank() OVER (PARTITION BY dataset ORDER BY mean DESC) AS r FROM m)
SELECT dataset, model, CASE r WHEN 1 THEN '\\textbf{{' || printf('%.3f', mean) || '}}' WHEN 2 THEN '\\underline{{' || printf('%.3f', mean) || '}}' ELSE printf('%.3f', mean) END AS cell FROM d""",
    ),
    "cross_model_theta_pairs": (
        _theta_pairs,
        lambda: f"""WITH {THETA}, e AS (SELECT min(data_run) AS f, max(data_run) AS l FROM theta WHERE theta > 0), x AS (SELECT data_run, doc_id, topic_id, theta / sqrt(sum(theta * theta) OVER (PARTITION BY data_run, doc_id)) AS w FROM theta WHERE theta > 0),
s1 AS (SELECT q.doc_id AS q, d.doc_id, sum(q.w * d.w) AS s FROM x q JOIN x d ON q.data_run = d.data_run AND q.topic_id = d.topic_id AND q.doc_id <> d.doc_id JOIN e ON q.data_run = e.f WHERE q.doc_id % 100 = 0 GROUP BY ALL),
s2 AS (SELECT q.doc_id AS q, d.doc_id, sum(q.w * d.w) AS s FROM x q JOIN x d ON q.data_run = d.data_run AND q.topic_id = d.topic_id AND q.doc_id <> d.doc_id JOIN e ON q.data_run = e.l WHERE q.doc_id % 100 = 0 GROUP BY ALL),
h AS (SELECT DISTINCT doc_id FROM x JOIN e ON data_run = e.l)
SELECT DISTINCT least(s1.q, s1.doc_id) AS a, greatest(s1.q, s1.doc_id) AS b, {r6('1.0 - s1.s')} AS close, {r6('1.0 - coalesce(s2.s, 0.0)')} AS far FROM s1 LEFT JOIN s2 ON s1.q = s2.q AND s1.doc_id = s2.doc_id
WHERE 1.0 - s1.s <= 0.05 + 1e-9 AND 1.0 - coalesce(s2.s, 0.0) >= 0.6 - 1e-9 AND s1.q IN (SELECT doc_id FROM h) AND s1.doc_id IN (SELECT doc_id FROM h)""",
    ),
}


def _prepared_dataset(b: Base):
    """Cleaned documents, those without a kept sentence dropped, split by label and written as CSV with a manifest; read back."""
    judged = cut(corpus.judged_sentences(b.sentences(), unicode=False), "judged")
    texts = corpus.prepared_texts(judged).join(b.labels(), "doc_id")
    split = cut(sampling.stratified_split(texts, "label", "doc_id"), "split")
    base = scratch(b.spark, "prepared")
    stats = corpus.quality_stats(judged).first().asDict()
    out = None
    for part in ("train", "test"):
        writers.csv_dataset(split.where(F.col("split") == part).select("doc_id", F.col("text").alias("data"), F.col("label").alias("target_str")), f"{base}/{part}", {"split": part, "stats": stats})
        one = readers.csv_corpus(b.spark, f"{base}/{part}", "data", "target_str").select(F.lit(part).alias("split"), "text", "label")
        out = one if out is None else out.unionByName(one)
    return out
