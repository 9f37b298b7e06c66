"""Queries over vectors: topic parameters, scores, geometry, clustering steps, likelihoods, neighbours."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicloom.functions import numeric as N
from topicloom.functions.numeric import r6 as R
from topicloom.operators import topics
from topicloom.plans.base import VECTORS, Base, r6
from topicloom.session import cut

DIM = 64


def _params(b: Base):
    return topics.topic_parameters(b.vectors())


PARAMS = f"""{VECTORS},
el AS (SELECT vec_id, topic_id, unnest(vec) AS x, unnest(range(0, len(vec))) AS i FROM vecs),
su AS (SELECT topic_id, i, sum(x) AS s, count(*) AS n FROM el GROUP BY ALL),
pa AS (SELECT topic_id, any_value(n) AS n, list(s ORDER BY i) AS total, sqrt(sum(s * s)) AS resultant FROM su GROUP BY topic_id),
pm AS (SELECT topic_id, n, resultant, list_transform(total, lambda x: x / CASE WHEN resultant > 0 THEN resultant ELSE 1.0 END) AS mean,
  least(greatest(resultant / n, 1e-6), 1.0::DOUBLE - 1e-6) AS r FROM pa),
pk AS (SELECT *, CASE WHEN n <= 1 THEN 10.0 ELSE r * ({DIM} - r * r) / (1.0 - r * r) END AS kappa FROM pm)"""
SCORES = PARAMS + ", sc AS (SELECT vec_id, pk.topic_id, list_inner_product(vec, mean) AS dot, kappa FROM vecs, pk)"


def _scores(b: Base):
    return cut(topics.scored_against(b.vectors(), cut(_params(b), "params"), "vec_id"), "scores")


def _similarity(b: Base):
    return topics.topic_similarity(cut(_params(b), "params"))


SIM = PARAMS + ", si AS (SELECT x.topic_id AS a, y.topic_id AS b, list_cosine_similarity(x.mean, y.mean) AS cosine FROM pk x JOIN pk y ON x.topic_id < y.topic_id)"


def _log_densities(b: Base):
    """Log density of every vector under every topic, with the normaliser computed on the driver for K topics."""
    params = cut(_params(b), "params")
    norms = [(r["topic_id"], N.vmf_log_normaliser(r["kappa"], DIM)) for r in params.select("topic_id", "kappa").collect()]
    const = b.spark.createDataFrame(norms, "topic_id INT, log_c DOUBLE")
    rows = topics.scored_against(b.vectors(), params, "vec_id").join(F.broadcast(const), "topic_id")  # K rows
    return rows.withColumn("ll", F.col("log_c") + F.col("kappa") * F.col("dot"))


#: log I_v(k) by its series; v = D / 2 - 1
LOG_C = PARAMS + f""",
se AS (SELECT topic_id, kappa, (2 * m + {DIM // 2 - 1}) * ln(kappa / 2) - lgamma(m + 1) - lgamma(m + {DIM // 2}) AS t FROM pk, range(0, 400) x(m)),
mx AS (SELECT topic_id, any_value(kappa) AS kappa, max(t) AS m FROM se GROUP BY topic_id),
ib AS (SELECT se.topic_id, any_value(m) + ln(sum(exp(t - m))) AS li FROM se JOIN mx USING (topic_id) GROUP BY se.topic_id),
lc AS (SELECT topic_id, {DIM // 2 - 1} * ln(kappa) - {DIM // 2} * ln(2 * pi()) - (greatest(li - kappa, ln(1e-300)) + kappa) AS log_c FROM mx JOIN ib USING (topic_id)),
ld AS (SELECT vec_id, vecs.topic_id AS own, pk.topic_id, log_c + kappa * list_inner_product(vec, mean) AS ll FROM vecs, pk JOIN lc USING (topic_id))"""
r4 = "floor(({}) * 1e4 + 0.5001) / 1e4"


def R4(x):
    return F.floor(x * 1e4 + 0.5001) / 1e4


def _perplexity(b: Base):
    """Predictive log perplexity of the vectors with theta from their label: mean of -ln sum_k theta_k exp(ll_k)."""
    theta = b.vectors().groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))
    total = theta.agg(F.sum("n").alias("all"))
    theta = theta.crossJoin(F.broadcast(total)).select("topic_id", (F.col("n") / F.col("all")).alias("theta"))  # one row
    rows = _log_densities(b).join(F.broadcast(theta), "topic_id")  # K rows
    w = W.partitionBy("vec_id")
    rows = rows.withColumn("j", F.col("ll") + F.ln(F.col("theta") + N.EPS)).withColumn("m", F.max("j").over(w))
    each = rows.groupBy("vec_id").agg((F.max("m") + F.ln(F.sum(F.exp(F.col("j") - F.col("m"))))).alias("l"))
    lp = each.agg((-F.avg("l")).alias("lp"), F.count(F.lit(1)).alias("vectors"))
    return lp.select("vectors", R4(F.col("lp")).alias("log_perplexity"), (F.col("lp") > 709.0).alias("overflow"), (F.col("lp") < -745.0).alias("underflow"))


def _kmeans_step(b: Base):
    """One step of spherical k-means from the mean of each label: assign by cosine, new mean directions."""
    scores = _scores(b)
    hard = topics.hard_topic(scores, "vec_id", "dot").select("vec_id", F.col("topic_id").alias("cluster"))
    rows = b.vectors().select("vec_id", "vec").join(hard, "vec_id").select(F.col("cluster").alias("topic_id"), "vec")
    step = topics.topic_parameters(rows)
    return step.select("topic_id", "n", R("resultant").alias("resultant"), R4(F.col("kappa")).alias("kappa"))


def _em_step(b: Base):
    """Responsibilities of one soft step and their sums."""
    rows = topics.soft_topics(_log_densities(b), "vec_id", "ll")
    return rows.groupBy("topic_id").agg(R(F.sum("p")).alias("mass"), R4(F.avg("p")).alias("weight"))


def _neighbours(b: Base):
    v = b.vectors()
    return topics.nearest(v, v.where("vec_id % 100 = 0"), "vec_id", 10).select("query", "neighbour", "rank")


def _pairs(b: Base):
    """Pairs close among all dimensions and far by the first half: query rows against all rows, ranked by the gap."""
    v = cut(b.vectors(), "vectors")
    near = topics.nearest(v, v.where("vec_id % 100 = 0"), "vec_id", 30).where("query <> neighbour")
    left = v.select(F.col("vec_id").alias("query"), F.slice("vec", 1, DIM // 2).alias("x"))
    right = v.select(F.col("vec_id").alias("neighbour"), F.slice("vec", 1, DIM // 2).alias("y"))
    rows = near.join(left, "query").join(right, "neighbour")
    da, db = F.lit(1.0) - F.col("similarity"), F.lit(1.0) - N.cosine("x", "y")
    rows = rows.select(F.least("query", "neighbour").alias("a"), F.greatest("query", "neighbour").alias("b"), R(da).alias("close"), R(db).alias("far")).distinct()
    return rows


def _greedy_pairs(b: Base):
    rows = _pairs(b).withColumn("gap", F.col("far") - F.col("close"))
    return topics.greedy_unique(rows, [-F.col("gap"), -F.col("far"), F.col("a"), F.col("b")])


def _whitened(b: Base):
    """Vectors centred and whitened by the moments of all of them: D^2 numbers on the driver, the rest in place."""
    import numpy as np

    v = b.vectors()
    cells = topics.moments(v, "vec_id").collect()  # D (D + 1) / 2 rows
    d = max(c["j"] for c in cells) + 1 if cells else 0
    mean, cov = np.zeros(d), np.zeros((d, d))
    for c in cells:
        mean[c["i"]] = c["mean_i"]
        cov[c["i"], c["j"]] = cov[c["j"], c["i"]] = c["covariance"]
    values, vectors = np.linalg.eigh(cov)
    matrix = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0) + 1e-5)) @ vectors.T
    sent = b.spark.sparkContext.broadcast((mean, matrix))

    def apply(batches):
        for pdf in batches:
            m, w = sent.value
            pdf["vec"] = list((np.vstack(pdf["vec"].to_numpy()) - m) @ w) if len(pdf) else pdf["vec"]
            yield pdf

    return v.select("vec_id", "vec").mapInPandas(apply, "vec_id LONG, vec ARRAY<DOUBLE>")


_PAIRS_SQL = f"""WITH {VECTORS}, p AS (SELECT q.vec_id AS query, v.vec_id AS neighbour, round(list_cosine_similarity(q.vec, v.vec), 9) AS s, list_cosine_similarity(q.vec[1:{DIM // 2}], v.vec[1:{DIM // 2}]) AS h FROM vecs q JOIN vecs v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) AS r FROM p)
SELECT DISTINCT least(query, neighbour) AS a, greatest(query, neighbour) AS b, {r6('1.0 - s')} AS close, {r6('1.0 - h')} AS far FROM k WHERE r <= 30"""

QUERIES = {
    "vmf_sufficient_stats": (
        lambda b: _params(b).select("topic_id", "n", R("resultant").alias("resultant"), R4(F.col("kappa")).alias("kappa")),
        lambda: f"WITH {PARAMS} SELECT topic_id, n, {r6('resultant')} AS resultant, {r4.format('kappa')} AS kappa FROM pk",
    ),
    "topic_cosine_matrix": (lambda b: _similarity(b).select("a", "b", R("cosine").alias("cosine")), lambda: f"WITH {SIM} SELECT a, b, {r6('cosine')} AS cosine FROM si"),
    "overlap_metrics": (
        lambda b: topics.overlap_metrics(_similarity(b), 0.1).select("pairs", *[R(c).alias(c) for c in ("mean_cosine", "max_cosine", "diversity")], "pairs_above"),
        lambda: f"WITH {SIM} SELECT count(*) AS pairs, {r6('avg(cosine)')} AS mean_cosine, {r6('max(cosine)')} AS max_cosine, {r6('1.0 - avg(cosine)')} AS diversity, count(*) FILTER (cosine >= 0.1) AS pairs_above FROM si",
    ),
    "hard_inference": (
        lambda b: topics.hard_topic(_scores(b), "vec_id", "dot").select("vec_id", "topic_id"),
        lambda: f"WITH {SCORES} SELECT vec_id, topic_id FROM (SELECT vec_id, topic_id, row_number() OVER (PARTITION BY vec_id ORDER BY {r6('dot')} DESC, topic_id) AS r FROM sc) WHERE r = 1",
    ),
    "soft_inference": (
        lambda b: topics.soft_topics(_scores(b), "vec_id", "dot", 0.5).select("vec_id", "topic_id", R("p").alias("p")),
        lambda: f"WITH {SCORES}, e AS (SELECT vec_id, topic_id, exp(dot / 0.5 - max(dot / 0.5) OVER (PARTITION BY vec_id)) AS e FROM sc) SELECT vec_id, topic_id, {r6('e / sum(e) OVER (PARTITION BY vec_id)')} AS p FROM e",
    ),
    "unnormalised_scores": (
        lambda b: topics.ranked(_scores(b).withColumn("s", F.col("kappa") * F.col("dot")), ["topic_id"], "s", ["vec_id"], 10).select("topic_id", "vec_id", "rank", R4(F.col("s")).alias("score")),
        lambda: f"WITH {SCORES} SELECT * FROM (SELECT topic_id, vec_id, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY {r6('kappa * dot')} DESC, vec_id) AS INTEGER) AS rank, {r4.format('kappa * dot')} AS score FROM sc) WHERE rank <= 10",
    ),
    "classification_metrics": (
        lambda b: topics.confusion_metrics(topics.hard_topic(_scores(b), "vec_id", "dot").select("vec_id", F.col("topic_id").alias("guess")).join(b.vectors().select("vec_id", F.col("topic_id").alias("truth")), "vec_id"), "truth", "guess"),
        lambda: f"""WITH {SCORES}, h AS (SELECT vec_id, topic_id AS guess FROM (SELECT vec_id, topic_id, row_number() OVER (PARTITION BY vec_id ORDER BY {r6('dot')} DESC, topic_id) AS r FROM sc) WHERE r = 1),
x AS (SELECT vecs.topic_id AS truth, guess FROM vecs JOIN h USING (vec_id)), c AS (SELECT truth AS c FROM x UNION SELECT guess FROM x),
f AS (SELECT c, (SELECT count(*) FROM x WHERE truth = c AND guess = c) AS tp, (SELECT count(*) FROM x WHERE truth = c) AS s, (SELECT count(*) FROM x WHERE guess = c) AS p FROM c)
SELECT floor(sum(tp) / sum(s) * 10000 + 0.5001) / 100 AS accuracy, floor(avg(CASE WHEN s + p > 0 THEN 2.0::DOUBLE * tp / (s + p) ELSE 0 END) * 10000 + 0.5001) / 100 AS macro_f1, floor(sum(tp) / sum(s) * 10000 + 0.5001) / 100 AS micro_f1 FROM f""",
    ),
    "average_log_likelihood": (
        lambda b: _log_densities(b).join(b.vectors().select("vec_id", "topic_id"), ["vec_id", "topic_id"]).groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"), R4(F.avg("ll")).alias("mean_ll")),
        lambda: f"WITH {LOG_C} SELECT topic_id, count(*) AS n, {r4.format('avg(ll)')} AS mean_ll FROM ld WHERE own = topic_id GROUP BY topic_id",
    ),
    "predictive_perplexity": (
        _perplexity,
        lambda: f"""WITH {LOG_C}, th AS (SELECT topic_id, count(*)::DOUBLE / (SELECT count(*) FROM vecs) AS theta FROM vecs GROUP BY topic_id),
j AS (SELECT vec_id, ll + ln(theta + 1e-12) AS j FROM ld JOIN th USING (topic_id)), m AS (SELECT *, max(j) OVER (PARTITION BY vec_id) AS m FROM j), l AS (SELECT vec_id, any_value(m) + ln(sum(exp(j - m))) AS l FROM m GROUP BY vec_id)
SELECT count(*) AS vectors, {r4.format('-avg(l)')} AS log_perplexity, -avg(l) > 709.0 AS overflow, -avg(l) < -745.0 AS underflow FROM l""",
    ),
    "spherical_kmeans_step": (
        _kmeans_step,
        lambda: f"""WITH {SCORES}, h AS (SELECT vec_id, topic_id AS c FROM (SELECT vec_id, topic_id, row_number() OVER (PARTITION BY vec_id ORDER BY {r6('dot')} DESC, topic_id) AS r FROM sc) WHERE r = 1),
e2 AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM el JOIN h USING (vec_id) GROUP BY ALL), q AS (SELECT c AS topic_id, any_value(n) AS n, sqrt(sum(s * s)) AS resultant FROM e2 GROUP BY c),
w AS (SELECT *, least(greatest(resultant / n, 1e-6), 1.0::DOUBLE - 1e-6) AS r FROM q)
SELECT topic_id, n, {r6('resultant')} AS resultant, {r4.format(f'CASE WHEN n <= 1 THEN 10.0 ELSE r * ({DIM} - r * r) / (1.0 - r * r) END')} AS kappa FROM w""",
    ),
    "movmf_em_step": (
        _em_step,
        lambda: f"WITH {LOG_C}, e AS (SELECT vec_id, topic_id, exp(ll - max(ll) OVER (PARTITION BY vec_id)) AS e FROM ld), p AS (SELECT topic_id, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e) SELECT topic_id, {r6('sum(p)')} AS mass, {r4.format('avg(p)')} AS weight FROM p GROUP BY topic_id",
    ),
    "whitening_moments": (
        lambda b: topics.moments(b.vectors(), "vec_id").select("i", "j", R("mean_i").alias("mean_i"), R("covariance").alias("covariance")),
        lambda: f"WITH {VECTORS}, el AS (SELECT vec_id, unnest(vec) AS x, unnest(range(0, len(vec))) AS i FROM vecs) SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, {r6('sum(a.x) / count(*)')} AS mean_i, {r6('(sum(a.x * b.x) - sum(a.x) * sum(b.x) / count(*)) / (count(*) - 1)')} AS covariance FROM el a JOIN el b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL",
    ),
    "whitened_vectors": (_whitened, None),
    "whitened_covariance": (
        lambda b: topics.moments(cut(_whitened(b), "whitened"), "vec_id").select("i", "j", (F.floor(F.abs("mean_i") * 100 + 0.5) / 100).alias("mean_i"), (F.floor(F.abs("covariance") * 100 + 0.5) / 100).alias("covariance")),
        lambda: f"SELECT CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, 0.0::DOUBLE AS mean_i, CASE WHEN a.i = b.j THEN 1.0 ELSE 0.0 END::DOUBLE AS covariance FROM range(0, {DIM}) a(i), range(0, {DIM}) b(j) WHERE a.i <= b.j",
    ),
    "unit_interval_scores": (
        lambda b: _scores(b).groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("topic_id", "dot"))), lambda x: x["dot"]).alias("s")).select("vec_id", F.posexplode(N.unit_interval("s")).alias("topic_no", "u")).select("vec_id", "topic_no", R("u").alias("u")),
        lambda: f"WITH {SCORES} SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY topic_id) - 1 AS INTEGER) AS topic_no, {r6('least(greatest((dot - min(dot) OVER (PARTITION BY vec_id)) / (max(dot) OVER (PARTITION BY vec_id) - min(dot) OVER (PARTITION BY vec_id) + 1e-12), 0.0), 1.0)')} AS u FROM sc",
    ),
    "nearest_vectors": (
        _neighbours,
        lambda: f"""WITH {VECTORS}, p AS (SELECT q.vec_id AS query, v.vec_id AS neighbour, round(list_cosine_similarity(q.vec, v.vec), 9) AS s FROM vecs q JOIN vecs v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT * FROM (SELECT query, neighbour, CAST(row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) AS INTEGER) AS rank FROM p) WHERE rank <= 10""",
    ),
    "cross_model_pairs": (
        _pairs,
        lambda: _PAIRS_SQL,
    ),
    "greedy_unique_pairs": (
        _greedy_pairs,
        lambda: f"""WITH RECURSIVE base AS ({_PAIRS_SQL}), o AS (SELECT *, far - close AS gap, row_number() OVER (ORDER BY far - close DESC, far DESC, a, b) AS r FROM base),
g AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS used, false AS taken UNION ALL
  SELECT o.r, CASE WHEN list_contains(used, a) OR list_contains(used, b) THEN used ELSE used || [a, b] END, NOT (list_contains(used, a) OR list_contains(used, b)) FROM g JOIN o ON o.r = g.r + 1)
SELECT a, b, close, far, gap FROM g JOIN o USING (r) WHERE taken""",
    ),
}
