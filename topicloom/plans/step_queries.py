"""Single steps of the models, run by the code that trains them, each beside the SQL of its closed form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from topicloom.functions import numeric as N
from topicloom.functions.numeric import r6 as R
from topicloom.models import clustering, encoders, gibbs, words
from topicloom.operators import corpus, topics
from topicloom.plans.base import SENTS, VOCAB, Base, r6
from topicloom.plans.topic_queries import ASSIGNED, SBOW
from topicloom.plans.vector_queries import DIM, LOG_C, R4, SCORES, VECTORS, r4
from topicloom.session import cut

ALPHA, BETA = 0.1, 0.01


def _by_label(b: Base, components: int = 1):
    """(topic numbers in order, n, sums) of the vectors of each label, parted by the parity of their ids if there are two components."""
    rows = b.vectors().withColumn("g", F.col("topic_id") * components + F.col("vec_id") % components)
    got = {r["g"]: r for r in topics.mean_vectors(rows, "g").collect()}  # K x C rows
    k = max(g // components for g in got) + 1
    n, total = np.zeros((k, components)), np.zeros((k, components, DIM))
    for g, r in got.items():
        n[g // components, g % components], total[g // components, g % components] = r["n"], r["total"]
    return n, total


def _two_components(b: Base) -> gibbs.Topics:
    n, total = _by_label(b, 2)
    mean, kappa = gibbs.directions(n, total)
    return gibbs.Topics("vmf", np.full(len(n), ALPHA), mean, kappa, weights=n / n.sum(1, keepdims=True))


def _mixture_density(b: Base):
    rows = gibbs.log_densities(b.vectors(), "vec_id", "vec", _two_components(b))
    return rows.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"), R4(F.avg("ll")).alias("mean_ll"))


def _component_shares(b: Base):
    rows = gibbs.component_shares(b.vectors(), "vec_id", "vec", "topic_id", _two_components(b))
    return rows.select("vec_id", "component", R("p").alias("p"))


#: Densities of two components per label.
TWO = f"""{VECTORS},
e2 AS (SELECT topic_id, vec_id % 2 AS c, unnest(vec) AS x, unnest(range(0, len(vec))) AS i FROM vecs),
s2 AS (SELECT topic_id, c, i, sum(x) AS s, count(*) AS n FROM e2 GROUP BY ALL),
p2 AS (SELECT topic_id, c, any_value(n) AS n, list(s ORDER BY i) AS total, sqrt(sum(s * s)) AS len FROM s2 GROUP BY topic_id, c),
m2 AS (SELECT topic_id, c, n, n / sum(n) OVER (PARTITION BY topic_id) AS w, list_transform(total, lambda x: x / greatest(len, 1e-12)) AS mean, least(greatest(len / n, 1e-6), 1.0::DOUBLE - 1e-6) AS r FROM p2),
k2 AS (SELECT *, CASE WHEN n <= 1 THEN 10.0 ELSE r * ({DIM} - r * r) / (1.0 - r * r) END AS kappa FROM m2),
t2 AS (SELECT topic_id, c, kappa, (2 * m + {DIM // 2 - 1}) * ln(kappa / 2) - lgamma(m + 1) - lgamma(m + {DIM // 2}) AS t FROM k2, range(0, 600) x(m)),
x2 AS (SELECT topic_id, c, any_value(kappa) AS kappa, max(t) AS m FROM t2 GROUP BY topic_id, c),
i2 AS (SELECT t2.topic_id, t2.c, any_value(m) + ln(sum(exp(t - m))) AS li FROM t2 JOIN x2 USING (topic_id, c) GROUP BY t2.topic_id, t2.c),
c2 AS (SELECT topic_id, c, {DIM // 2 - 1} * ln(kappa) - {DIM // 2} * ln(2 * pi()) - (greatest(li - kappa, ln(1e-300)) + kappa) AS log_c FROM x2 JOIN i2 USING (topic_id, c)),
d2 AS (SELECT vec_id, vecs.topic_id AS own, k2.topic_id, c, ln(w) + log_c + kappa * list_inner_product(vec, mean) AS j FROM vecs, k2 JOIN c2 USING (topic_id, c))"""


def _distance_softmax(b: Base, temperature: float = 0.5):
    """Soft maximum of minus the Euclidean distance to the labels' means."""
    n, total = _by_label(b)
    means = total[:, 0] / n
    rows = b.spark.createDataFrame([(t, means[t].tolist(), 1.0) for t in range(len(means)) if n[t, 0]], "topic_id INT, mean ARRAY<DOUBLE>, kappa DOUBLE")
    v = b.vectors().select("vec_id", "vec").crossJoin(F.broadcast(rows))  # K rows
    gap = F.zip_with("vec", "mean", lambda x, y: x - y)
    scores = v.select("vec_id", "topic_id", gap.alias("g")).select("vec_id", "topic_id", (-N.norm("g")).alias("s"))
    return topics.soft_topics(scores, "vec_id", "s", temperature).select("vec_id", "topic_id", R("p").alias("p"))


def _start(b: Base, kind: str) -> dict:
    """Parameters from the labels' moments: one pass with every label as a cluster."""
    moments = topics.mean_vectors(b.vectors(), "topic_id")
    squares = topics.mean_vectors(b.vectors().select("topic_id", F.transform("vec", lambda x: x * x).alias("vec")), "topic_id")
    k = {r["topic_id"]: r for r in moments.collect()}  # K rows
    q = {r["topic_id"]: r for r in squares.collect()}
    order = sorted(k)
    n, s = np.array([k[t]["n"] for t in order], float), np.array([k[t]["total"] for t in order])
    return clustering.updated({}, n, s, np.array([q[t]["total"] for t in order]), kind)


def _cluster_step(b: Base, kind: str):
    """One step of the clustering from the labels' moments: new weights, lengths of the means, mean variances."""
    p = _start(b, kind)
    score, seen, n, s, q = clustering.sums(cut(b.vectors(), "vectors"), "vec", p, kind)
    new = clustering.updated(p, n, s, q, kind)
    rows = [(t, float(n[t]), float(np.linalg.norm(new["mean"][t])), float(new["var"][t].mean()), float(score / seen)) for t in range(len(n))]
    out = b.spark.createDataFrame(rows, "topic_id INT, mass DOUBLE, length DOUBLE, variance DOUBLE, score DOUBLE")
    return out.select("topic_id", R4(F.col("mass")).alias("mass"), R("length").alias("length"), R("variance").alias("variance"), R4(F.col("score")).alias("score"))


MOMENTS = f"""{VECTORS}, el AS (SELECT vec_id, topic_id, unnest(vec) AS x, unnest(range(0, len(vec))) AS i FROM vecs),
mo AS (SELECT topic_id, i, count(*) AS n, sum(x) / count(*) AS m, greatest(sum(x * x) / count(*) - (sum(x) / count(*)) * (sum(x) / count(*)), 1e-6) AS v FROM el GROUP BY ALL),
wt AS (SELECT topic_id, any_value(n) AS n, any_value(n) / (SELECT count(*) FROM vecs) AS w FROM mo GROUP BY topic_id)"""
NEW = """, nm AS (SELECT q.topic_id, i, sum(p * x) / sum(p) AS m, greatest(sum(p * x * x) / sum(p) - (sum(p * x) / sum(p)) * (sum(p * x) / sum(p)), 1e-6) AS v FROM q JOIN el USING (vec_id) GROUP BY q.topic_id, i),
ms AS (SELECT topic_id, sum(p) AS mass FROM q GROUP BY topic_id), ln AS (SELECT topic_id, sqrt(sum(m * m)) AS length, avg(v) AS variance FROM nm GROUP BY topic_id)"""


def _alpha_step(b: Base):
    """One step of the fixed point of each run's prior, from histograms that executors make."""
    z = topics.assignments(b.sentence_topic())
    per = cut(z.groupBy("data_run", "doc_id", "topic_id").agg(F.count(F.lit(1)).alias("c")), "counts")
    lengths: dict[str, dict[int, int]] = {}
    table: dict[str, dict[int, dict[int, int]]] = {}
    for r in per.groupBy("data_run", "topic_id", "c").agg(F.count(F.lit(1)).alias("n")).collect():  # as many rows as counts occur
        table.setdefault(r["data_run"], {}).setdefault(r["topic_id"], {})[r["c"]] = r["n"]
    for r in per.groupBy("data_run", "doc_id").agg(F.sum("c").alias("c")).groupBy("data_run", "c").agg(F.count(F.lit(1)).alias("n")).collect():
        lengths.setdefault(r["data_run"], {})[r["c"]] = r["n"]
    rows = []
    for run, hist in sorted(table.items()):
        order = sorted(hist)
        alpha = gibbs.minka_alpha({i: hist[t] for i, t in enumerate(order)}, lengths[run], np.full(len(order), ALPHA), rounds=1)
        rows += [(run, t, float(a)) for t, a in zip(order, alpha, strict=True)]
    return b.spark.createDataFrame(rows, "data_run STRING, topic_id INT, alpha DOUBLE").select("data_run", "topic_id", R("alpha").alias("alpha"))


def _gaussian_posterior(b: Base):
    """The Student distribution of each label's vectors: degrees of freedom, length of the mean, trace of the scale matrix."""
    rows = b.vectors()
    n, total = _by_label(b)
    pairs = rows.select("topic_id", F.flatten(F.transform("vec", lambda x: F.transform("vec", lambda y: x * y))).alias("vec"))
    squares = np.zeros((len(n), DIM, DIM))
    for r in topics.mean_vectors(pairs, "topic_id").collect():  # K rows of D^2 numbers
        squares[r["topic_id"]] = np.array(r["total"]).reshape(DIM, DIM)
    mean, cov, freedom = gibbs.gaussian_posterior(n[:, 0], total[:, 0], squares, np.zeros(DIM))
    out = b.spark.createDataFrame([(t, float(freedom[t]), float(np.linalg.norm(mean[t])), float(np.trace(cov[t]))) for t in range(len(n))], "topic_id INT, freedom DOUBLE, length DOUBLE, trace DOUBLE")
    return out.select("topic_id", "freedom", R("length").alias("length"), R("trace").alias("trace"))


def _conditionals(b: Base):
    n, total = _by_label(b)
    mean, kappa = gibbs.directions(n[:, 0], total[:, 0])
    units = b.vectors().withColumn("doc_id", F.floor(F.col("vec_id") / 8).cast("long"))
    return gibbs.conditionals(units, "doc_id", "vec_id", "vec", "topic_id", gibbs.Topics("vmf", np.full(len(n), ALPHA), mean, kappa)).select("doc_id", F.col("unit").alias("vec_id"), "topic_id", R("p").alias("p"))


def _senclu(b: Base):
    n, total = _by_label(b)
    mean, _ = gibbs.directions(n[:, 0], total[:, 0])
    units = b.vectors().withColumn("doc_id", F.floor(F.col("vec_id") / 8).cast("long"))
    rows = clustering.senclu_shares(units.select("doc_id", "vec_id", "vec"), "doc_id", "vec", mean, b.vectors().select("vec_id", "topic_id"), "vec_id", 8.0)
    return rows.select("doc_id", F.col("unit").alias("vec_id"), "topic_id", R("p").alias("p"))


def _sentence_inference(b: Base):
    """Topic weights of the sentences of the first run, under the counts that its own assignments give."""
    assigned = cut(topics.assignments(b.sentence_topic()), "assigned")
    first = assigned.agg(F.min("data_run").alias("data_run"))
    mine = cut(assigned.join(F.broadcast(first), "data_run"), "first")  # one row
    k = mine.agg(F.max("topic_id")).first()[0] + 1
    toks = corpus.restrict(corpus.sentence_tokens(b.sentences()), b.vocab()).join(mine, ["doc_id", "sent_id"])
    kept = cut(toks.groupBy("doc_id", "sent_id").agg(F.sort_array(F.collect_list("term")).alias("words"), F.first("topic_id").alias("z")), "words")
    counts = cut(kept.select(F.col("z").alias("topic_id"), F.explode("words").alias("term")).groupBy("topic_id", "term").agg(F.count(F.lit(1)).alias("cnt")), "counts")
    per_doc = mine.groupBy("doc_id", "topic_id").agg(F.count(F.lit(1)).alias("n"))
    size = counts.select("term").distinct().count()
    p = words.infer_sentences(kept.select("doc_id", "sent_id", "words"), counts, per_doc, k, size, ALPHA, BETA)
    return p.select("doc_id", "sent_id", F.posexplode("p").alias("topic_id", "p")).select("doc_id", "sent_id", "topic_id", R("p").alias("p"))


def _weighted_means(b: Base):
    """Weighted means of word vectors that digests give; words of three, six, ... letters have none."""
    toks = cut(corpus.sentence_tokens(b.sentences()), "sentence-tokens")
    counts = toks.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    digest = lambda i: F.conv(F.substring(F.md5(F.concat(F.lit(f"w|{i}|"), "term")), 1, 8), 16, 10).cast("double") / F.lit(2147483648.0) - F.lit(1.0)
    vectors = counts.where(F.length("term") % 3 != 0).select(F.col("term").alias("word"), F.array(*[digest(i) for i in range(4)]).alias("vec"))
    weights = counts.select("term", (F.lit(1.0) / F.sqrt("n")).alias("weight"))
    rows = words.weighted_means(toks, weights, vectors)
    return rows.select("doc_id", "sent_id", F.posexplode("vec").alias("i", "x")).select("doc_id", "sent_id", "i", R("x").alias("x"))


def _embedding_topic_words(b: Base):
    """The ten likeliest words of topics in an embedding space: words and four topics as vectors that digests give."""
    digest = lambda i, key: (F.conv(F.substring(F.md5(F.concat(F.lit(f"e|{i}|"), key)), 1, 8), 16, 10).cast("double") / F.lit(2147483648.0) - F.lit(1.0)) * F.lit(2.0)
    rows = b.vocab().select("term", F.array(*[digest(i, F.col("term")) for i in range(4)]).alias("vec"))
    centres = b.spark.range(4).select(F.col("id").cast("int").alias("topic_id")).select("topic_id", F.array(*[digest(i, F.concat(F.lit("t"), F.col("topic_id").cast("string"))) for i in range(4)]).alias("vec"))
    p = topics.word_distributions(rows, centres).select("topic_id", "term", R("p").alias("p"))
    return topics.ranked(p, ["topic_id"], "p", ["term"], 10).select("topic_id", "rank", "term", "p")


def _training_curve(b: Base):
    """Mean log likelihood of the units after each iteration of the direction model."""
    units = b.vectors().select(F.floor(F.col("vec_id") / 8).cast("long").alias("doc_id"), F.col("vec_id").alias("unit"), "vec")
    model, _ = gibbs.train(cut(units, "units"), "doc_id", "unit", "vec", 10, "vmf", 5)
    return b.spark.createDataFrame([(h["iteration"], float(h["units"]), float(h["mean_log_likelihood"])) for h in model.history], "iteration INT, units DOUBLE, mean_log_likelihood DOUBLE")


def _points(b: Base):
    """Every vector on the two directions of largest variance, as a scatter plot shows them; each direction points to where its largest number is positive."""
    v = cut(b.vectors(), "vectors")
    directions, _ = words.principal(v.select(F.col("vec_id").alias("sent_id"), "vec"), 2)
    directions = directions * np.sign(directions[np.arange(2), np.abs(directions).argmax(1)])[:, None]
    x, y = (N.dot("vec", F.array(*[F.lit(float(c)) for c in d])) for d in directions)
    return v.select("vec_id", "topic_id", R(x).alias("x"), R(y).alias("y"))


def _encoded(b: Base):
    """Sentences of the prepared documents as vectors of their words' digests."""
    sents = b.sentences().select("doc_id", "sent_id", F.array_join(corpus.usable("tokens"), " ").alias("text"))
    rows = encoders.encoded(sents, "text", encoders.HashEncoder(4), normalise=True)
    return rows.select("doc_id", "sent_id", F.posexplode("vec").alias("i", "x")).select("doc_id", "sent_id", "i", R("x").alias("x"))


QUERIES = {
    "training_curve": (_training_curve, None),
    "scatter_points": (_points, None),
    "embedding_topic_words": (
        _embedding_topic_words,
        lambda: f"""WITH {VOCAB}, d AS (SELECT term, i, (('0x' || substr(md5('e|' || i || '|' || term), 1, 8))::BIGINT / 2147483648.0::DOUBLE - 1.0) * 2.0 AS x FROM vocab, range(0, 4) r(i)),
t AS (SELECT k, i, (('0x' || substr(md5('e|' || i || '|t' || k), 1, 8))::BIGINT / 2147483648.0::DOUBLE - 1.0) * 2.0 AS y FROM range(0, 4) q(k), range(0, 4) r(i)),
s AS (SELECT k, term, sum(x * y) AS s FROM d JOIN t USING (i) GROUP BY ALL), e AS (SELECT k, term, exp(s - max(s) OVER (PARTITION BY k)) AS e FROM s),
p AS (SELECT CAST(k AS INTEGER) AS topic_id, term, {r6('e / sum(e) OVER (PARTITION BY k)')} AS p FROM e)
SELECT * FROM (SELECT topic_id, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY p DESC, term) AS INTEGER) AS rank, term, p FROM p) WHERE rank <= 10""",
    ),
    "encoded_sentences": (
        _encoded,
        lambda: f"""WITH {SENTS}, w AS (SELECT doc_id, sent_id, unnest(list_filter(list_transform(tokens, lambda t: lower(trim(t))), lambda t: t <> '')) AS t FROM sents),
y AS (SELECT doc_id, sent_id, i, avg(('0x' || substr(md5('0|' || i || '|' || p), 1, 8))::BIGINT / 2147483648.0::DOUBLE - 1.0) AS x FROM (SELECT doc_id, sent_id, unnest(list_filter(string_split(t, ' '), lambda p: p <> '')) AS p FROM w), range(0, 4) r(i) GROUP BY ALL),
z AS (SELECT doc_id, sent_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id, sent_id)) AS x FROM y)
SELECT s.doc_id, CAST(s.sent_id AS INTEGER) AS sent_id, CAST(r.i AS INTEGER) AS i, {r6('coalesce(z.x, 0.0)')} AS x FROM sents s CROSS JOIN range(0, 4) r(i) LEFT JOIN z ON z.doc_id = s.doc_id AND z.sent_id = s.sent_id AND z.i = r.i""",
    ),
    "weighted_word_means": (
        _weighted_means,
        lambda: f"""WITH {SENTS}, t AS (SELECT doc_id, sent_id, lower(trim(t)) AS term FROM (SELECT doc_id, sent_id, unnest(tokens) AS t FROM sents) WHERE t IS NOT NULL AND trim(t) <> ''),
d AS (SELECT term, i, ('0x' || substr(md5('w|' || i || '|' || term), 1, 8))::BIGINT / 2147483648.0::DOUBLE - 1.0 AS x FROM (SELECT DISTINCT term FROM t WHERE length(term) % 3 <> 0), range(0, 4) r(i)),
u AS (SELECT term, i, x / sqrt(sum(x * x) OVER (PARTITION BY term)) AS x FROM d), c AS (SELECT term, 1.0::DOUBLE / sqrt(count(*)) AS w FROM t GROUP BY term),
m AS (SELECT doc_id, sent_id, i, avg(w * x) AS x FROM t JOIN u USING (term) JOIN c USING (term) GROUP BY ALL), k AS (SELECT DISTINCT doc_id, sent_id FROM t)
SELECT k.doc_id, CAST(k.sent_id AS INTEGER) AS sent_id, CAST(r.i AS INTEGER) AS i, {r6('coalesce(m.x, 0.0)')} AS x FROM k CROSS JOIN range(0, 4) r(i) LEFT JOIN m ON m.doc_id = k.doc_id AND m.sent_id = k.sent_id AND m.i = r.i""",
    ),
    "mixture_log_density": (
        _mixture_density,
        lambda: f"WITH {TWO}, l AS (SELECT vec_id, topic_id, max(j) AS m FROM d2 GROUP BY ALL), y AS (SELECT d2.topic_id, d2.vec_id, any_value(m) + ln(sum(exp(j - m))) AS ll FROM d2 JOIN l USING (vec_id, topic_id) GROUP BY d2.topic_id, d2.vec_id) SELECT topic_id, count(*) AS n, {r4.format('avg(ll)')} AS mean_ll FROM y GROUP BY topic_id",
    ),
    "component_responsibilities": (
        _component_shares,
        lambda: f"WITH {TWO}, e AS (SELECT vec_id, c, exp(j - max(j) OVER (PARTITION BY vec_id)) AS e FROM d2 WHERE own = topic_id) SELECT vec_id, CAST(c AS INTEGER) AS component, {r6('e / sum(e) OVER (PARTITION BY vec_id)')} AS p FROM e",
    ),
    "distance_softmax": (
        _distance_softmax,
        lambda: f"""WITH {MOMENTS}, d AS (SELECT vec_id, mo.topic_id, -sqrt(sum((x - m) * (x - m))) / 0.5 AS s FROM el JOIN mo USING (i) GROUP BY ALL), e AS (SELECT vec_id, topic_id, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM d)
SELECT vec_id, topic_id, {r6('e / sum(e) OVER (PARTITION BY vec_id)')} AS p FROM e""",
    ),
    "gaussian_mixture_step": (
        lambda b: _cluster_step(b, "gmm"),
        lambda: f"""WITH {MOMENTS}, l AS (SELECT vec_id, mo.topic_id, ln(any_value(w)) - 0.5 * sum((x - m) * (x - m) / v + ln(2 * pi() * v)) AS l FROM el JOIN mo USING (i) JOIN wt ON wt.topic_id = mo.topic_id GROUP BY ALL),
a AS (SELECT *, max(l) OVER (PARTITION BY vec_id) AS t FROM l), q AS (SELECT vec_id, topic_id, exp(l - t) / sum(exp(l - t)) OVER (PARTITION BY vec_id) AS p FROM a),
sc AS (SELECT avg(s) AS score FROM (SELECT vec_id, any_value(t) + ln(sum(exp(l - t))) AS s FROM a GROUP BY vec_id)){NEW}
SELECT topic_id, {r4.format('mass')} AS mass, {r6('length')} AS length, {r6('variance')} AS variance, {r4.format('score')} AS score FROM ms JOIN ln USING (topic_id), sc""",
    ),
    "euclidean_kmeans_step": (
        lambda b: _cluster_step(b, "kmeans"),
        lambda: f"""WITH {MOMENTS}, l AS (SELECT vec_id, mo.topic_id, sum((x - m) * (x - m)) AS d FROM el JOIN mo USING (i) GROUP BY ALL),
q AS (SELECT vec_id, topic_id, d, 1.0::DOUBLE AS p FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), topic_id) AS r FROM l) WHERE r = 1),
sc AS (SELECT -avg(d) AS score FROM q){NEW}
SELECT topic_id, {r4.format('mass')} AS mass, {r6('length')} AS length, {r6('variance')} AS variance, {r4.format('score')} AS score FROM ms JOIN ln USING (topic_id), sc""",
    ),
    "alpha_step": (
        _alpha_step,
        lambda: f"""WITH {ASSIGNED}, c AS (SELECT data_run, doc_id, topic_id, count(*) AS c FROM asg GROUP BY ALL), k AS (SELECT data_run, count(DISTINCT topic_id) * {ALPHA}::DOUBLE AS s FROM c GROUP BY 1),
a AS (SELECT data_run, topic_id, sum(list_sum(list_transform(range(0, c), lambda j: 1.0::DOUBLE / ({ALPHA} + j)))) AS a FROM c GROUP BY ALL),
b AS (SELECT data_run, sum(list_sum(list_transform(range(0, n::BIGINT), lambda j: 1.0::DOUBLE / (s + j)))) AS b FROM (SELECT data_run, doc_id, sum(c) AS n FROM c GROUP BY ALL) JOIN k USING (data_run) GROUP BY data_run)
SELECT data_run, topic_id, {r6(f'greatest({ALPHA} * a / b, 1e-3)')} AS alpha FROM a JOIN b USING (data_run)""",
    ),
    "gaussian_posterior": (
        _gaussian_posterior,
        lambda: f"""WITH {VECTORS}, el AS (SELECT topic_id, unnest(vec) AS x, unnest(range(0, len(vec))) AS i FROM vecs), g AS (SELECT topic_id, i, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM el GROUP BY ALL),
h AS (SELECT topic_id, any_value(n) AS n, sum(s * s) AS ss, sum(q) AS q FROM g GROUP BY topic_id)
SELECT topic_id, n + 1.0::DOUBLE AS freedom, {r6('sqrt(ss) / (0.1 + n)')} AS length, {r6(f'(0.1 + n + 1) / ((0.1 + n) * (n + 1)) * (0.1 * {DIM} * {DIM} + q - ss / n + 0.1 * n / (0.1 + n) * ss / (n * n))')} AS trace FROM h""",
    ),
    "sampler_conditionals": (
        _conditionals,
        lambda: f"""WITH {LOG_C}, u AS (SELECT vec_id, vec_id // 8 AS doc_id, topic_id FROM vecs), n AS (SELECT doc_id, topic_id, count(*) AS n FROM u GROUP BY ALL),
w AS (SELECT ld.vec_id, ld.vec_id // 8 AS doc_id, ld.topic_id, ll + ln(coalesce(n, 0) - (own = ld.topic_id)::INTEGER + {ALPHA}) AS w FROM ld LEFT JOIN n ON n.doc_id = ld.vec_id // 8 AND n.topic_id = ld.topic_id),
e AS (SELECT *, exp(w - max(w) OVER (PARTITION BY vec_id)) AS e FROM w) SELECT doc_id, vec_id, topic_id, {r6('e / sum(e) OVER (PARTITION BY vec_id)')} AS p FROM e""",
    ),
    "share_cluster_step": (
        _senclu,
        lambda: f"""WITH {SCORES}, u AS (SELECT vec_id // 8 AS doc_id, topic_id, count(*) AS n FROM vecs GROUP BY ALL), d AS (SELECT vec_id // 8 AS doc_id, count(*) AS m FROM vecs GROUP BY 1),
w AS (SELECT sc.vec_id, sc.vec_id // 8 AS doc_id, sc.topic_id, greatest(dot, 0) * (coalesce(n, 0) / m + 8.0) AS w FROM sc JOIN d ON d.doc_id = sc.vec_id // 8 LEFT JOIN u ON u.doc_id = sc.vec_id // 8 AND u.topic_id = sc.topic_id),
r AS (SELECT *, coalesce(w / nullif(sum(w) OVER (PARTITION BY vec_id), 0), 0.0) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY round(w, 9) DESC, topic_id) AS r FROM w) SELECT doc_id, vec_id, topic_id, {r6('p')} AS p FROM r WHERE r = 1""",
    ),
    "sentence_topic_weights": (
        _sentence_inference,
        lambda: f"""WITH {SBOW}, {ASSIGNED}, a AS (SELECT doc_id, sent_id, topic_id AS k FROM asg WHERE data_run = (SELECT min(data_run) FROM asg)), kt AS (SELECT unnest(range(0, (SELECT max(k) + 1 FROM a))) AS k),
ct AS (SELECT k, term, sum(cnt) AS c FROM a JOIN sbow USING (doc_id, sent_id) GROUP BY ALL), nk AS (SELECT k, coalesce(sum(c), 0) AS n FROM kt LEFT JOIN ct USING (k) GROUP BY k), dc AS (SELECT doc_id, k, count(*) AS n FROM a GROUP BY ALL),
v AS (SELECT count(DISTINCT term) * {BETA}::DOUBLE AS vb FROM ct), sl AS (SELECT doc_id, sent_id, sum(cnt) AS len FROM sbow GROUP BY ALL),
w AS (SELECT s.doc_id, s.sent_id, kt.k, sum(lgamma(coalesce(c, 0) + {BETA} + cnt) - lgamma(coalesce(c, 0) + {BETA})) AS e FROM sbow s JOIN a USING (doc_id, sent_id) CROSS JOIN kt LEFT JOIN ct ON ct.k = kt.k AND ct.term = s.term GROUP BY ALL),
z AS (SELECT w.doc_id, w.sent_id, w.k, ln(coalesce(dc.n, 0) + {ALPHA}) + e - (lgamma(nk.n + vb + len) - lgamma(nk.n + vb)) AS l FROM w JOIN nk ON nk.k = w.k JOIN sl ON sl.doc_id = w.doc_id AND sl.sent_id = w.sent_id LEFT JOIN dc ON dc.doc_id = w.doc_id AND dc.k = w.k, v),
e AS (SELECT *, exp(l - max(l) OVER (PARTITION BY doc_id, sent_id)) AS e FROM z)
SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, CAST(k AS INTEGER) AS topic_id, {r6('e / sum(e) OVER (PARTITION BY doc_id, sent_id)')} AS p FROM e""",
    ),
}
