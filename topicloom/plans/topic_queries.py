"""Queries over topic words, coherence, topic shares and label profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.functions.numeric import r6 as R
from topicloom.operators import corpus, topics, topicwords
from topicloom.plans.base import BOW, DOCS, LABELS, MASS, SENT_TOPIC, SENTS, THETA, TOPS, Base, r6
from topicloom.session import cut

ST = f"WITH {SENT_TOPIC}"


def _coherence(measure: str, window: int | None = None):
    def run(b: Base):
        toks, tops = b.tokens(), cut(b.top_words(), "top-words")
        found = topicwords.coherence_cv(toks, tops, window) if measure == "c_v" else topicwords.coherence(toks, tops, measure, window)
        return found.select("data_run", "topic_id", R("coherence").alias("coherence"))

    return run


def _counts_sql(window: int | None) -> str:
    wins = "[0]" if window is None else f"list_distinct(flatten(list_transform(ps, lambda p: range(greatest(p - {window - 1}, 0), least(p, greatest(n - {window}, 0)) + 1))))"
    each = "1" if window is None else f"greatest(n - {window} + 1, 1)"
    return TOPS + f""",
sz AS (SELECT doc_id, count(*) AS n FROM toks GROUP BY doc_id),
nw AS (SELECT CAST(sum({each}) AS DOUBLE) AS w FROM sz),
sp AS (SELECT doc_id, term, list(pos) AS ps FROM toks WHERE term IN (SELECT term FROM tops) GROUP BY doc_id, term),
oc AS MATERIALIZED (SELECT doc_id, term, {wins} AS wins FROM sp JOIN sz USING (doc_id)),
c1 AS (SELECT term, sum(len(wins)) AS c FROM oc GROUP BY term),
wp AS (SELECT a.data_run, a.topic_id, a.term AS w1, b.term AS w2 FROM tops a JOIN tops b ON a.data_run = b.data_run AND a.topic_id = b.topic_id AND a.term < b.term),
dp AS (SELECT DISTINCT w1, w2 FROM wp),
c2 AS (SELECT w1, w2, sum(len(list_intersect(x.wins, y.wins))) AS c FROM dp JOIN oc x ON x.term = w1 JOIN oc y ON y.term = w2 AND y.doc_id = x.doc_id GROUP BY w1, w2),
cp AS (SELECT wp.*, coalesce(a.c, 0)::DOUBLE AS ci, coalesce(b.c, 0)::DOUBLE AS cj, coalesce(p.c, 0)::DOUBLE AS cij, w FROM wp LEFT JOIN c1 a ON a.term = wp.w1 LEFT JOIN c1 b ON b.term = wp.w2 LEFT JOIN c2 p ON p.w1 = wp.w1 AND p.w2 = wp.w2, nw)"""


def _coherence_sql(measure: str, window: int | None) -> str:
    uci = "ln((cij / w + 1e-12) / ((ci / w) * (cj / w) + 1e-12))"
    score = {
        "doc_npmi": "CASE WHEN cij = 0 THEN -1.0 WHEN cij >= w THEN 1.0 ELSE ln((cij / w) / ((ci / w) * (cj / w))) / -ln(cij / w) END",
        "u_mass": "CASE WHEN ci = 0 THEN 0.0 ELSE ln((cij / w + 1e-12) / (ci / w)) END",
        "c_uci": f"CASE WHEN ci = 0 OR cj = 0 THEN -1.0 ELSE {uci} END",
        "c_npmi": f"CASE WHEN ci = 0 OR cj = 0 THEN -1.0 WHEN cij >= w THEN 1.0 ELSE {uci} / -ln(cij / w + 1e-12) END",
    }[measure]
    return f"WITH {_counts_sql(window)}, s AS (SELECT data_run, topic_id, {score} AS s FROM cp) SELECT data_run, topic_id, {r6('avg(s)')} AS coherence FROM s GROUP BY ALL"


def _cv_sql(window: int) -> str:
    return f"""WITH {_counts_sql(window)},
ce AS (SELECT data_run, topic_id, w1, w2, ci, cj, cij, w FROM cp UNION ALL SELECT data_run, topic_id, w2, w1, cj, ci, cij, w FROM cp
  UNION ALL SELECT data_run, topic_id, t.term, t.term, coalesce(c, 0), coalesce(c, 0), coalesce(c, 0), w FROM tops t LEFT JOIN c1 ON c1.term = t.term, nw),
v AS (SELECT data_run, topic_id, w1, w2, CASE WHEN ci = 0 OR cj = 0 THEN 0.0 WHEN cij >= w THEN 1.0 ELSE ln((cij / w + 1e-12) / ((ci / w) * (cj / w))) / -ln(cij / w + 1e-12) END AS v FROM ce),
t AS (SELECT data_run, topic_id, w2, sum(v) AS t FROM v GROUP BY ALL),
d AS (SELECT data_run, topic_id, w1, sum(v * t) AS d, sqrt(sum(v * v)) AS a, sqrt(sum(t * t)) AS b FROM v JOIN t USING (data_run, topic_id, w2) GROUP BY ALL)
SELECT data_run, topic_id, {r6('avg(CASE WHEN a * b = 0 THEN 0.0 ELSE d / (a * b) END)')} AS coherence FROM d GROUP BY ALL"""


def _sentence_bow(b: Base):
    return corpus.bag_of_words(corpus.restrict(corpus.sentence_tokens(b.sentences()), b.vocab()), ["doc_id", "sent_id"])


def _proxy(mode: str, level: str):
    def run(b: Base):
        if level == "doc":
            scores = topicwords.proxy_scores(b.theta(), b.bow(), ["doc_id"], "theta", mode)
        else:
            scores = topicwords.proxy_scores(b.sentence_topic(), _sentence_bow(b), ["doc_id", "sent_id"], "p", mode)
        return topicwords.top_words(scores.where("score is not null"), 10)

    return run


SBOW = BOW + ",\n" + SENTS.removeprefix(DOCS)[1:].strip() + """,
sbow AS (SELECT doc_id, sent_id, lower(trim(t)) AS term, count(*) AS cnt FROM (SELECT doc_id, sent_id, unnest(tokens) AS t FROM sents) WHERE t IS NOT NULL AND trim(t) <> '' AND lower(trim(t)) IN (SELECT term FROM vocab) GROUP BY ALL)"""


def _proxy_sql(mode: str, level: str) -> str:
    with_, th, bow, on, w = (f"WITH {BOW}, {THETA}", "theta", "bow", "doc_id", "theta") if level == "doc" else (f"WITH {SBOW}, {SENT_TOPIC}", "st", "sbow", "doc_id, sent_id", "p")
    below = "-ln(greatest(pwk, 1e-12))" if mode == "npmi" else "-ln(greatest(pw, 1e-12))"
    return f"""{with_},
m AS (SELECT data_run, topic_id, term, sum({w} * cnt) AS mass FROM {th} JOIN {bow} USING ({on}) GROUP BY ALL),
cv AS (SELECT data_run, term, cnt FROM (SELECT DISTINCT data_run, {on} FROM {th}) JOIN {bow} USING ({on})),
ws AS (SELECT data_run, term, sum(cnt)::DOUBLE AS w FROM cv GROUP BY ALL), ns AS (SELECT data_run, sum(cnt)::DOUBLE AS n FROM cv GROUP BY ALL), ks AS (SELECT data_run, topic_id, sum(mass) AS k FROM m GROUP BY ALL),
p AS (SELECT m.data_run, m.topic_id, m.term, mass / n AS pwk, w / n AS pw, k / n AS pk FROM m JOIN ks USING (data_run, topic_id) JOIN ws USING (data_run, term) JOIN ns USING (data_run)),
sc AS (SELECT data_run, topic_id, term, CASE WHEN pwk <= 0 THEN -1.0 ELSE ln(greatest(pwk, 1e-12) / greatest(pk * pw, 1e-12)) / nullif({below}, 0) END AS score FROM p),
ro AS (SELECT data_run, topic_id, term, {r6('score')} AS score FROM sc WHERE score IS NOT NULL)
SELECT * FROM (SELECT data_run, topic_id, term, score, CAST(row_number() OVER (PARTITION BY data_run, topic_id ORDER BY score DESC, term) AS INTEGER) AS rank FROM ro) WHERE rank <= 10"""


def _assigned_counts(b: Base):
    a = topics.assignments(b.sentence_topic())
    return a.join(_sentence_bow(b), ["doc_id", "sent_id"]).groupBy("data_run", "topic_id", "term").agg(F.sum("cnt").alias("occ"))


ASSIGNED = f"""{SENT_TOPIC}, asg AS (SELECT data_run, doc_id, sent_id, topic_id FROM (SELECT *, row_number() OVER (PARTITION BY data_run, doc_id, sent_id ORDER BY p DESC, topic_id) AS r FROM st) WHERE r = 1)"""
OCC = f"WITH {SBOW}, {ASSIGNED}, occ AS (SELECT data_run, topic_id, term, sum(cnt)::BIGINT AS occ FROM asg JOIN sbow USING (doc_id, sent_id) GROUP BY ALL)"


def _profile(sort_by: str):
    def run(b: Base):
        rows = topics.label_profile(b.theta(), b.labels(), 3, sort_by)
        out = topics.ranked(rows, ["data_run", "label"], "score", ["topic_id"], 5)
        return out.select("data_run", "label", "docs", "topic_id", R("mean_weight").alias("mean_weight"), R("global_mean").alias("global_mean"), R("score").alias("score"), "rank")

    return run


def _profile_sql(sort_by: str) -> str:
    score = "m" if sort_by == "ratio" else "ln((m + 1e-12) / (g + 1e-12))"
    return f"""WITH {DOCS}, {LABELS}, {THETA}, r AS (SELECT * FROM theta JOIN labels USING (doc_id)),
pl AS (SELECT data_run, label, count(DISTINCT doc_id) AS docs FROM r GROUP BY ALL), al AS (SELECT data_run, count(DISTINCT doc_id) AS n FROM r GROUP BY ALL),
ms AS (SELECT data_run, label, topic_id, sum(theta) AS s FROM r GROUP BY ALL), gs AS (SELECT data_run, topic_id, sum(theta) AS s FROM r GROUP BY ALL),
x AS (SELECT ms.data_run, ms.label, docs, ms.topic_id, ms.s / docs AS m, gs.s / n AS g FROM ms JOIN pl USING (data_run, label) JOIN gs ON gs.data_run = ms.data_run AND gs.topic_id = ms.topic_id JOIN al ON al.data_run = ms.data_run WHERE docs >= 3),
y AS (SELECT *, {r6(score)} AS score FROM x)
SELECT * FROM (SELECT data_run, label, docs, topic_id, {r6('m')} AS mean_weight, {r6('g')} AS global_mean, score, CAST(row_number() OVER (PARTITION BY data_run, label ORDER BY score DESC, topic_id) AS INTEGER) AS rank FROM y) WHERE rank <= 5"""


def _window_counts(b: Base):
    singles, pairs = topicwords.cooccurrence(b.tokens(), cut(b.top_words(), "top-words"), 10)
    one = singles.select(F.col("term").alias("w1"), F.lit("").alias("w2"), "c")
    return one.unionByName(pairs.select("w1", "w2", "c"))


def _doc_counts(b: Base):
    singles, pairs = topicwords.cooccurrence(b.tokens(), cut(b.top_words(), "top-words"), None)
    return singles.select(F.col("term").alias("w1"), F.lit("").alias("w2"), "c").unionByName(pairs.select("w1", "w2", "c"))


COUNTS = "SELECT term AS w1, '' AS w2, CAST(c AS BIGINT) AS c FROM c1 UNION ALL SELECT w1, w2, CAST(c AS BIGINT) FROM c2 WHERE c > 0"
KEYS = ["data_run", "doc_id", "topic_id"]

QUERIES = {
    "coherence_doc_npmi": (_coherence("doc_npmi"), lambda: _coherence_sql("doc_npmi", None)),
    "coherence_u_mass": (_coherence("u_mass"), lambda: _coherence_sql("u_mass", None)),
    "coherence_c_uci": (_coherence("c_uci", 10), lambda: _coherence_sql("c_uci", 10)),
    "coherence_c_npmi": (_coherence("c_npmi", 10), lambda: _coherence_sql("c_npmi", 10)),
    "coherence_c_v": (_coherence("c_v", 110), lambda: _cv_sql(110)),
    "sliding_window_counts": (_window_counts, lambda: f"WITH {_counts_sql(10)} {COUNTS}"),
    "doc_cooccurrence": (_doc_counts, lambda: f"WITH {_counts_sql(None)} {COUNTS}"),
    "weighted_tf_words": (lambda b: b.top_words(), lambda: f"WITH {TOPS} SELECT data_run, topic_id, term, score, CAST(rank AS INTEGER) AS rank FROM tops"),
    "topic_diversity": (
        lambda b: topicwords.diversity(b.top_words()).select("data_run", R("diversity").alias("diversity")),
        lambda: f"WITH {TOPS} SELECT data_run, {r6('count(DISTINCT term) / count(*)')} AS diversity FROM tops GROUP BY data_run",
    ),
    "topic_word_matrix": (
        lambda b: topicwords.row_normal(topicwords.joint_mass(b.theta(), b.bow(), ["doc_id"], "theta"), ["data_run", "topic_id"], "mass", "share").select("data_run", "topic_id", "term", R("share").alias("share")),
        lambda: f"WITH {MASS} SELECT data_run, topic_id, term, {r6('coalesce(mass / nullif(sum(mass) OVER (PARTITION BY data_run, topic_id), 0), 0.0)')} AS share FROM mass",
    ),
    "proxy_npmi_words": (_proxy("npmi", "doc"), lambda: _proxy_sql("npmi", "doc")),
    "proxy_word_npmi_words": (_proxy("word_npmi", "doc"), lambda: _proxy_sql("word_npmi", "doc")),
    "sentence_proxy_words": (_proxy("word_npmi", "sentence"), lambda: _proxy_sql("word_npmi", "sentence")),
    "assignment_word_scores": (
        lambda b: topicwords.top_words(topicwords.word_scores_by_assignment(cut(_assigned_counts(b), "assigned")), 10),
        lambda: f"""{OCC}, k AS (SELECT data_run, count(DISTINCT topic_id)::DOUBLE AS k FROM occ GROUP BY data_run), t AS (SELECT data_run, term, sum(occ)::DOUBLE AS tot FROM occ GROUP BY ALL),
s AS (SELECT data_run, topic_id, term, {r6('sqrt(greatest(occ - tot / k, 0.0)) * least(greatest(occ / tot - 1.0 / k, 0.0), 1.0)')} AS score FROM occ JOIN t USING (data_run, term) JOIN k USING (data_run))
SELECT * FROM (SELECT data_run, topic_id, term, score, CAST(row_number() OVER (PARTITION BY data_run, topic_id ORDER BY score DESC, term) AS INTEGER) AS rank FROM s) WHERE rank <= 10""",
    ),
    "class_tfidf_words": (
        lambda b: topicwords.top_words(topicwords.class_tfidf(cut(_assigned_counts(b), "assigned")), 10),
        lambda: f"""{OCC}, a AS (SELECT data_run, sum(occ)::DOUBLE / count(DISTINCT topic_id) AS a FROM occ GROUP BY data_run), t AS (SELECT data_run, term, sum(occ)::DOUBLE AS f FROM occ GROUP BY ALL), n AS (SELECT data_run, topic_id, sum(occ)::DOUBLE AS n FROM occ GROUP BY ALL),
s AS (SELECT data_run, topic_id, term, {r6('occ / n * ln(1 + a / f)')} AS score FROM occ JOIN t USING (data_run, term) JOIN n USING (data_run, topic_id) JOIN a USING (data_run))
SELECT * FROM (SELECT data_run, topic_id, term, score, CAST(row_number() OVER (PARTITION BY data_run, topic_id ORDER BY score DESC, term) AS INTEGER) AS rank FROM s) WHERE rank <= 10""",
    ),
    "doc_topic_from_posteriors": (
        lambda b: topics.from_posteriors(b.sentence_topic()).select(*KEYS, R("theta").alias("theta")),
        lambda: f"{ST}, m AS (SELECT data_run, doc_id, topic_id, sum(p) AS m FROM st GROUP BY ALL) SELECT data_run, doc_id, topic_id, {r6('coalesce(m / nullif(sum(m) OVER (PARTITION BY data_run, doc_id), 0), 0.0)')} AS theta FROM m",
    ),
    "doc_topic_from_means": (
        lambda b: topics.from_means(b.sentence_topic()).select(*KEYS, R("theta").alias("theta")),
        lambda: f"""{ST}, n AS (SELECT data_run, doc_id, count(DISTINCT sent_id) AS n FROM st GROUP BY ALL), m AS (SELECT data_run, doc_id, topic_id, sum(p) / any_value(n) AS m FROM st JOIN n USING (data_run, doc_id) GROUP BY ALL),
w AS (SELECT *, sum(m) OVER (PARTITION BY data_run, doc_id) AS s, count(*) OVER (PARTITION BY data_run, doc_id) AS k FROM m) SELECT data_run, doc_id, topic_id, {r6('CASE WHEN s > 0 THEN m / s ELSE 1.0 / k END')} AS theta FROM w""",
    ),
    "hard_assignments": (lambda b: topics.assignments(b.sentence_topic()), lambda: f"WITH {ASSIGNED} SELECT data_run, doc_id, sent_id, topic_id FROM asg"),
    "doc_topic_from_counts": (
        lambda b: topics.from_counts(topics.assignments(b.sentence_topic())).select(*KEYS, "n", R("theta").alias("theta")),
        lambda: f"WITH {ASSIGNED}, c AS (SELECT data_run, doc_id, topic_id, count(*) AS n FROM asg GROUP BY ALL) SELECT data_run, doc_id, topic_id, n, {r6('n / sum(n) OVER (PARTITION BY data_run, doc_id)')} AS theta FROM c",
    ),
    "sentence_given_topic": (
        lambda b: topics.given_topic(b.sentence_topic()).select("data_run", "topic_id", "doc_id", "sent_id", R("share").alias("share")),
        lambda: f"{ST}, q AS (SELECT *, greatest(p, 0.0) AS q FROM st), w AS (SELECT *, sum(q) OVER (PARTITION BY data_run, topic_id) AS s, count(*) OVER (PARTITION BY data_run, topic_id) AS n FROM q) SELECT data_run, topic_id, doc_id, sent_id, {r6('CASE WHEN s > 0 THEN q / s ELSE 1.0 / n END')} AS share FROM w",
    ),
    "top_documents_per_topic": (
        lambda b: topics.ranked(b.theta(), ["data_run", "topic_id"], "theta", ["doc_id"], 10).select("data_run", "topic_id", "doc_id", "rank"),
        lambda: f"WITH {THETA} SELECT * FROM (SELECT data_run, topic_id, doc_id, CAST(row_number() OVER (PARTITION BY data_run, topic_id ORDER BY {r6('theta')} DESC, doc_id) AS INTEGER) AS rank FROM theta) WHERE rank <= 10",
    ),
    "label_topic_profile_ratio": (_profile("ratio"), lambda: _profile_sql("ratio")),
    "label_topic_profile_pmi": (_profile("pmi"), lambda: _profile_sql("pmi")),
    "topic_word_table": (
        lambda b: b.top_words().groupBy("data_run", "topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ").alias("words")),
        lambda: f"WITH {TOPS} SELECT data_run, topic_id, string_agg(term, ' ' ORDER BY rank) AS words FROM tops GROUP BY ALL",
    ),
    "empty_topics": (
        lambda b: _empty_topics(b),
        lambda: f"WITH {ASSIGNED}, k AS (SELECT data_run, max(topic_id) AS k FROM st GROUP BY 1), g AS (SELECT data_run, CAST(unnest(range(0, k + 1)) AS INTEGER) AS topic_id FROM k) SELECT data_run, topic_id FROM g ANTI JOIN (SELECT data_run, topic_id FROM asg GROUP BY ALL HAVING count(*) >= 5) h USING (data_run, topic_id)",
    ),
}


def _empty_topics(b: Base):
    st = b.sentence_topic()
    grid = st.groupBy("data_run").agg(F.max("topic_id").alias("k")).select("data_run", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("topic_id"))
    full = topics.assignments(st).groupBy("data_run", "topic_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    return grid.join(full, ["data_run", "topic_id"], "left_anti")
