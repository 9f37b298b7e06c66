"""Topic models whose units are vectors, sampled document by document with the topics' parameters held fixed.

One Spark job per iteration: every document runs its sweeps in the task that holds it, under the
broadcast parameters, and hands back its assignments and its share of the sufficient statistics,
which are added up by position. Only K x D (or K x D x D) sums reach the driver. The uniform numbers
are hashes of seed, iteration, sweep, document and unit, so partitioning and retries change nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.numeric import digamma, vmf_log_normaliser
from topicloom.session import cut


def hash_uniforms(seed: int, iteration: int, sweep: int, doc: int, n: int) -> np.ndarray:
    x = np.arange(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for part in (seed, iteration, sweep, doc):
            x = (x ^ np.uint64(part & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def cholesky_update(low: np.ndarray, x: np.ndarray, sign: float = 1.0) -> np.ndarray:
    """The lower Cholesky factor of A + sign x x' from that of A, in D^2 steps; a ValueError if nothing positive is left."""
    low, x = low.copy(), x.astype(float).copy()
    for k in range(len(x)):
        square = low[k, k] ** 2 + sign * x[k] ** 2
        if square <= 0:
            raise ValueError("the matrix would not be positive definite")
        r = math.sqrt(square)
        c, s = r / low[k, k], x[k] / low[k, k]
        low[k, k] = r
        low[k + 1 :, k] = (low[k + 1 :, k] + sign * s * x[k + 1 :]) / c
        x[k + 1 :] = c * x[k + 1 :] - s * low[k + 1 :, k]
    return low


def gibbs_sweep(z: np.ndarray, log_density: np.ndarray, alpha: np.ndarray, uniforms: np.ndarray) -> np.ndarray:
    """One pass over a document: each unit leaves its topic and draws one in proportion to density times (count + alpha)."""
    counts = np.bincount(z[z >= 0], minlength=len(alpha)).astype(float)
    z = z.copy()
    for i in range(len(z)):
        if z[i] >= 0:
            counts[z[i]] -= 1
        w = log_density[i] + np.log(counts + alpha)
        w = np.cumsum(np.exp(w - w.max()))
        z[i] = min(int(np.searchsorted(w, uniforms[i] * w[-1], side="right")), len(alpha) - 1)
        counts[z[i]] += 1
    return z


@dataclass
class Topics:
    """Parameters of K topics: directions and concentrations, or Gaussian moments. A topic of C components has K x C x D means, K x C concentrations and weights."""

    kind: str
    alpha: np.ndarray
    mean: np.ndarray
    kappa: np.ndarray | None = None
    cov: np.ndarray | None = None
    freedom: np.ndarray | None = None
    counts: np.ndarray | None = None
    weights: np.ndarray | None = None
    history: list[dict] = field(default_factory=list)

    @property
    def components(self) -> int:
        return self.mean.shape[1] if self.mean.ndim == 3 else 1

    def _components(self, x: np.ndarray) -> np.ndarray:
        """len(x) x K x C: the logarithm of each component's weight times its density."""
        const = np.array([[vmf_log_normaliser(v, x.shape[1]) for v in row] for row in self.kappa])
        return np.log(np.maximum(self.weights, 1e-300)) + const + self.kappa * np.einsum("nd,kcd->nkc", x, self.mean)

    def responsibilities(self, x: np.ndarray, topic: int) -> np.ndarray:
        """len(x) x C: which component of a topic each vector belongs to; uniform where none is finite."""
        if self.components == 1:
            return np.ones((len(x), 1))
        joint = self._components(x)[:, topic]
        e = np.exp(joint - joint.max(1, keepdims=True))
        mass = e.sum(1, keepdims=True)
        return np.where(np.isfinite(mass) & (mass > 0), e / np.where(mass > 0, mass, 1.0), 1.0 / joint.shape[1])

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """len(x) x K log densities."""
        k, d = len(self.mean), self.mean.shape[-1]
        if self.kind == "vmf" and self.mean.ndim == 3:
            joint = self._components(x)
            top = joint.max(2, keepdims=True)
            return (top + np.log(np.exp(joint - top).sum(2, keepdims=True)))[:, :, 0]
        if self.kind == "vmf":
            const = np.array([vmf_log_normaliser(v, d) for v in self.kappa])
            return const + self.kappa * (x @ self.mean.T)
        out = np.empty((len(x), k))
        for t in range(k):
            low = np.linalg.cholesky(self.cov[t])
            maha = (np.linalg.solve(low, (x - self.mean[t]).T) ** 2).sum(0)
            log_det = 2 * np.log(np.diag(low)).sum()
            nu = self.freedom[t] if self.freedom is not None else None
            if nu is None:
                out[:, t] = -0.5 * (maha + log_det + d * math.log(2 * math.pi))
            else:
                out[:, t] = math.lgamma((nu + d) / 2) - math.lgamma(nu / 2) - 0.5 * (d * math.log(nu * math.pi) + log_det) - (nu + d) / 2 * np.log1p(maha / nu)
        return out


def minka_alpha(histogram: dict[int, dict[int, int]], totals: dict[int, int], alpha: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Fixed point for a Dirichlet prior from histograms: topic -> count in a document -> documents, and document length -> documents."""
    alpha = alpha.copy()
    for _ in range(rounds):
        s = alpha.sum()
        below = sum(n * (digamma(length + s) - digamma(s)) for length, n in totals.items())
        new = alpha.copy()
        for k, hist in histogram.items():
            above = sum(n * (digamma(c + alpha[k]) - digamma(alpha[k])) for c, n in hist.items() if c)
            new[k] = max(alpha[k] * above / below, 1e-3) if below > 0 else alpha[k]
        if np.max(np.abs(new - alpha) / alpha) < 1e-5:
            return new
        alpha = new
    return alpha


def as_documents(units: DataFrame, doc: str, unit: str, vec: str) -> DataFrame:
    """(doc_id, units, vecs): the units of each document in order. A document is one row, so it must fit a task."""
    packed = units.groupBy(F.col(doc).alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(F.col(unit).alias("u"), F.col(vec).alias("v")))).alias("s"))
    return packed.select("doc_id", F.transform("s", lambda x: x["u"]).alias("units"), F.transform("s", lambda x: x["v"]).alias("vecs"))


def _step(docs: DataFrame, topics: Topics, seed: int, iteration: int, sweeps: int, samples: int, second: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(topics)
    k, c, d = len(topics.mean), topics.components, topics.mean.shape[-1]
    width = 2 + k * c + k * c * d + (k * d * d if second else 0)

    def run(batches):
        import pandas as pd

        model = sent.value
        total = np.zeros(width)
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                x = np.vstack(row.vecs).astype(np.float64)
                ll = model.log_density(x)
                z = np.asarray(row.z, dtype=np.int64) if row.z is not None and len(row.z) == len(x) else np.full(len(x), -1)
                for s in range(sweeps):
                    z = gibbs_sweep(z, ll, model.alpha, hash_uniforms(seed, iteration, s, int(row.doc_id), len(x)))
                    if s >= sweeps - samples:
                        share = 1.0 / samples
                        for t in np.unique(z):
                            mine = x[z == t]
                            part = share * model.responsibilities(mine, t)
                            total[2 + t * c : 2 + (t + 1) * c] += part.sum(0)
                            a = 2 + k * c + t * c * d
                            total[a : a + c * d] += (part.T @ mine).ravel()
                            if second:
                                a = 2 + k * c + k * c * d + t * d * d
                                total[a : a + d * d] += share * (mine.T @ mine).ravel()
                total[0] += ll[np.arange(len(x)), z].sum()
                total[1] += len(x)
                out.append((row.doc_id, [int(t) for t in z], None))
            yield pd.DataFrame(out, columns=["doc_id", "z", "stats"])
        yield pd.DataFrame([(None, None, total.tolist())], columns=["doc_id", "z", "stats"])

    return docs.mapInPandas(run, "doc_id LONG, z ARRAY<INT>, stats ARRAY<DOUBLE>")


def train(units: DataFrame, doc: str, unit: str, vec: str, n_topics: int, kind: str = "vmf", iterations: int = 5, sweeps: int = 3, samples: int = 2, seed: int = 0, default_kappa: float = 10.0, components: int = 1) -> tuple[Topics, DataFrame]:
    """(topics, (doc_id, units, z)) of a mixture of directions ('vmf'; of several components per topic if asked) or of Gaussians with a weak inverse-Wishart prior ('gaussian').

    Each iteration samples all documents, revives topics without units from the units of the largest
    one, re-estimates the topics, then (vmf) the prior of the shares.
    """
    docs = cut(as_documents(units, doc, unit, vec), "documents")
    spark = docs.sparkSession
    first = docs.select("vecs").limit(1).collect()
    if not first:
        empty = spark.createDataFrame([], "doc_id LONG, units ARRAY<INT>, z ARRAY<INT>")
        return Topics(kind, np.full(n_topics, 0.1), np.zeros((n_topics, 1)), np.full(n_topics, default_kappa)), empty
    d = len(first[0]["vecs"][0])
    start = _start(docs, n_topics * components, seed)
    topics = Topics(kind, np.full(n_topics, 50.0 / n_topics if kind != "vmf" else 0.1), start, np.full(n_topics, default_kappa))
    second = kind == "gaussian"
    if components > 1:
        topics.mean, topics.kappa = start.reshape(n_topics, components, d), np.full((n_topics, components), default_kappa)
        topics.weights = np.full((n_topics, components), 1.0 / components)
    if second:
        topics.cov = np.repeat(np.eye(d)[None] * 0.5, n_topics, 0)
        topics.kappa = None
    state = docs.withColumn("z", F.lit(None).cast("array<int>"))
    prior_mean = start.mean(0)
    for it in range(iterations):
        out = cut(_step(state, topics, seed, it, sweeps, samples, second), f"sweep{it}")
        sums = out.where("stats is not null").select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
        k, c = n_topics, components
        flat = np.zeros(2 + k * c + k * c * d + (k * d * d if second else 0))
        for r in sums.collect():  # K x D numbers
            flat[r["i"]] = r["x"]
        nkc, totals = flat[2 : 2 + k * c].reshape(k, c), flat[2 + k * c : 2 + k * c + k * c * d].reshape(k, c, d)
        nk, total = nkc.sum(1), totals.sum(1)
        for t in np.flatnonzero(nk < 0.5):
            donor = _donor(docs, out, int(np.argmax(nk)), seed + it * 1000 + int(t))
            if donor is not None:
                nk[t], total[t], nkc[t], totals[t] = 1.0, donor, 1.0 / c, donor / c
        if kind == "vmf":
            topics.mean, topics.kappa = directions(nkc, totals, default_kappa)
            if c == 1:
                topics.mean, topics.kappa = topics.mean[:, 0], topics.kappa[:, 0]
            else:
                topics.weights = np.where(nk[:, None] > 0, nkc / np.maximum(nk, 1e-12)[:, None], 1.0 / c)
            topics.alpha = _alpha(out, topics.alpha)
        else:
            sq = flat[2 + k + k * d :].reshape(k, d, d)
            topics.mean, topics.cov, topics.freedom = gaussian_posterior(nk, total, sq, prior_mean)
        topics.counts = nk
        topics.history.append({"iteration": it, "units": flat[1], "mean_log_likelihood": flat[0] / max(flat[1], 1)})
        state = docs.join(out.where("doc_id is not null").select("doc_id", "z"), "doc_id")
    return topics, state.select("doc_id", "units", "z")


def directions(n: np.ndarray, total: np.ndarray, default_kappa: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """(mean directions, concentrations) of groups of n unit vectors with the given sums."""
    d, length = total.shape[-1], np.linalg.norm(total, axis=-1)
    r = np.clip(length / np.maximum(n, 1e-12), 1e-6, 1 - 1e-6)
    return total / np.maximum(length, 1e-12)[..., None], np.where(n <= 1, default_kappa, r * (d - r**2) / (1 - r**2))


def gaussian_posterior(n: np.ndarray, total: np.ndarray, squares: np.ndarray, prior_mean: np.ndarray, k0: float = 0.1, scale: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scale matrices, degrees of freedom) of the Student distributions of topics of n vectors with the given sums and sums of products, under a weak normal and inverse-Wishart prior of D degrees."""
    k, d = total.shape
    kn, nun = k0 + n, d + n
    mean, cov = (k0 * prior_mean + total) / kn[:, None], np.empty((k, d, d))
    for t in range(k):
        own = total[t] / max(n[t], 1e-12)
        scatter = squares[t] - n[t] * np.outer(own, own) if n[t] > 0 else np.zeros((d, d))
        gap = own - prior_mean if n[t] > 0 else np.zeros(d)
        psi = scale * np.eye(d) * d + scatter + k0 * n[t] / kn[t] * np.outer(gap, gap)
        cov[t] = (kn[t] + 1) / (kn[t] * (nun[t] - d + 1)) * (psi + psi.T) / 2
    return mean, cov, nun - d + 1


def log_densities(units: DataFrame, key: str, vec: str, topics: Topics) -> DataFrame:
    """(key, topic_id, ll) of every unit under every topic."""
    sent = units.sparkSession.sparkContext.broadcast(topics)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                ll = sent.value.log_density(np.vstack(pdf[vec].to_numpy()).astype(float))
                yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), ll.shape[1]), "topic_id": np.tile(np.arange(ll.shape[1]), len(pdf)), "ll": ll.ravel()})

    return units.select(key, vec).mapInPandas(run, f"{key} LONG, topic_id INT, ll DOUBLE")


def component_shares(units: DataFrame, key: str, vec: str, topic: str, topics: Topics) -> DataFrame:
    """(key, component, p): to which component of its topic each unit belongs."""
    sent = units.sparkSession.sparkContext.broadcast(topics)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for t in sorted(set(pdf[topic])):
                mine = pdf[pdf[topic] == t]
                p = sent.value.responsibilities(np.vstack(mine[vec].to_numpy()).astype(float), int(t))
                yield pd.DataFrame({key: np.repeat(mine[key].to_numpy(), p.shape[1]), "component": np.tile(np.arange(p.shape[1]), len(mine)), "p": p.ravel()})

    return units.select(key, topic, vec).mapInPandas(run, f"{key} LONG, component INT, p DOUBLE")


def conditionals(units: DataFrame, doc: str, unit: str, vec: str, topic: str, topics: Topics) -> DataFrame:
    """(doc_id, unit, topic_id, p): the sampler's weights of every unit given the topics of the others of its document."""
    docs = units.groupBy(F.col(doc).alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(F.col(unit).alias("u"), F.col(topic).alias("z"), F.col(vec).alias("v")))).alias("s"))
    docs = docs.select("doc_id", F.transform("s", lambda x: x["u"]).alias("u"), F.transform("s", lambda x: x["z"]).alias("z"), F.transform("s", lambda x: x["v"]).alias("v"))
    sent = units.sparkSession.sparkContext.broadcast(topics)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                z, ll = np.asarray(row.z), sent.value.log_density(np.vstack(row.v).astype(float))
                k = ll.shape[1]
                others = np.bincount(z, minlength=k) - np.eye(k)[z]
                w = ll + np.log(others + sent.value.alpha)
                p = np.exp(w - w.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                yield pd.DataFrame({"doc_id": row.doc_id, "unit": np.repeat(row.u, k), "topic_id": np.tile(np.arange(k), len(z)), "p": p.ravel()})

    return docs.mapInPandas(run, "doc_id LONG, unit LONG, topic_id INT, p DOUBLE")


def _start(docs: DataFrame, k: int, seed: int, most: int = 5000) -> np.ndarray:
    """Starting means: far-apart units of a bounded hash sample of documents, the first by hash."""
    rows = docs.orderBy(F.xxhash64(F.lit(seed), "doc_id")).limit(max(k, min(most, 20 * k))).select("doc_id", "vecs").collect()
    x = np.vstack([v for r in sorted(rows, key=lambda r: r["doc_id"]) for v in r["vecs"]]).astype(float)[:most]
    chosen = [0]
    gap = 1 - x @ x[0]
    for i in range(1, k):
        u = hash_uniforms(seed, i, 0, 0, 1)[0]
        weight = np.cumsum(np.maximum(gap, 0) ** 2 + 1e-12)
        chosen.append(int(np.searchsorted(weight, u * weight[-1])))
        gap = np.minimum(gap, 1 - x @ x[chosen[-1]])
    return x[chosen]


def _donor(docs: DataFrame, out: DataFrame, topic: int, seed: int) -> np.ndarray | None:
    """The vector of one unit of a topic, the first by hash."""
    rows = out.where(F.array_contains("z", topic)).orderBy(F.xxhash64(F.lit(seed), "doc_id")).limit(1).select("doc_id", "z").collect()
    if not rows:
        return None
    vecs = docs.where(F.col("doc_id") == rows[0]["doc_id"]).select("vecs").first()["vecs"]
    return np.asarray(vecs[rows[0]["z"].index(topic)], dtype=float)


def _alpha(out: DataFrame, alpha: np.ndarray) -> np.ndarray:
    """One Minka update from histograms made by executors; they have as many rows as document lengths occur."""
    per = out.where("doc_id is not null").select("doc_id", F.explode("z").alias("t")).groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("c"))
    hist = per.groupBy("t", "c").agg(F.count(F.lit(1)).alias("n")).collect()
    lengths = per.groupBy("doc_id").agg(F.sum("c").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()
    table: dict[int, dict[int, int]] = {}
    for r in hist:
        table.setdefault(r["t"], {})[r["c"]] = r["n"]
    return minka_alpha(table, {r["c"]: r["n"] for r in lengths}, alpha)


def parameters(topics: Topics, spark) -> DataFrame:
    if topics.components > 1:
        per = [(t, c, float(topics.weights[t, c]), float(topics.alpha[t]), float(topics.kappa[t, c]), topics.mean[t, c].tolist()) for t in range(len(topics.mean)) for c in range(topics.components)]
        return spark.createDataFrame(per, "topic_id INT, component INT, weight DOUBLE, alpha DOUBLE, kappa DOUBLE, mean ARRAY<DOUBLE>")
    rows = [(t, float(topics.counts[t]) if topics.counts is not None else 0.0, float(topics.alpha[t]), float(topics.kappa[t]) if topics.kappa is not None else None, topics.mean[t].tolist()) for t in range(len(topics.alpha))]
    return spark.createDataFrame(rows, "topic_id INT, n DOUBLE, alpha DOUBLE, kappa DOUBLE, mean ARRAY<DOUBLE>")


def infer(units: DataFrame, doc: str, unit: str, vec: str, topics: Topics, temperature: float = 1.0) -> DataFrame:
    """(doc_id, unit, topic_id, p): soft maximum of the log likelihoods of each unit, without the documents' prior."""
    sent = units.sparkSession.sparkContext.broadcast(topics)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            if not len(pdf):
                continue
            ll = sent.value.log_density(np.vstack(pdf[vec].to_numpy()).astype(float)) / temperature
            p = np.exp(ll - ll.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            k = p.shape[1]
            yield pd.DataFrame({"doc_id": np.repeat(pdf[doc].to_numpy(), k), "unit": np.repeat(pdf[unit].to_numpy(), k), "topic_id": np.tile(np.arange(k), len(pdf)), "p": p.ravel()})

    return units.select(doc, unit, vec).mapInPandas(run, "doc_id LONG, unit LONG, topic_id INT, p DOUBLE")
