"""Clusterings of vectors: spherical k-means, mixtures of directions, diagonal Gaussians, and Spark's own k-means."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.numeric import vmf_log_normaliser
from topicloom.models.gibbs import hash_uniforms
from topicloom.operators.topics import matrix


def _sample(vectors: DataFrame, key: str, vec: str, seed: int, n: int = 5000) -> np.ndarray:
    rows = vectors.select(key, vec).orderBy(F.xxhash64(F.lit(seed), key), key).limit(n).collect()
    return np.array([r[vec] for r in rows], dtype=float)


def _seeds(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ on squared cosine distances."""
    chosen, gap = [0], 1 - x @ x[0]
    for i in range(1, k):
        weight = np.cumsum(np.maximum(gap, 0) ** 2 + 1e-15)
        chosen.append(int(np.searchsorted(weight, hash_uniforms(seed, i, 0, 0, 1)[0] * weight[-1])))
        gap = np.minimum(gap, 1 - x @ x[chosen[-1]])
    return x[chosen].copy()


def _responsibilities(kind: str, x: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """(weights n x K, log score of each row); for kmeans the score is minus the squared distance."""
    if kind == "skmeans":
        s = x @ p["mean"].T
        best = s.argmax(1)
        return np.eye(len(p["mean"]))[best], s.max(1)
    if kind == "kmeans":
        d = (x**2).sum(1, keepdims=True) - 2 * x @ p["mean"].T + (p["mean"] ** 2).sum(1)
        best = np.round(d, 9).argmin(1)
        return np.eye(len(p["mean"]))[best], -np.maximum(d.min(1), 0)
    if kind == "movmf":
        ll = np.log(p["weight"]) + p["const"] + p["kappa"] * (x @ p["mean"].T)
    else:  # sums of squares by products, so no n x K x D array is made
        square = (x**2) @ (1 / p["var"]).T - 2 * x @ (p["mean"] / p["var"]).T + (p["mean"] ** 2 / p["var"]).sum(1)
        ll = np.log(p["weight"]) - 0.5 * (square + np.log(2 * np.pi * p["var"]).sum(1))
    top = ll.max(1, keepdims=True)
    e = np.exp(ll - top)
    mass = e.sum(1, keepdims=True)
    return e / mass, (top + np.log(mass))[:, 0]


def sums(vectors: DataFrame, vec: str, p: dict, kind: str) -> tuple[float, int, np.ndarray, np.ndarray, np.ndarray]:
    """(total score, vectors, weight of each cluster, weighted sums, weighted sums of squares): one pass in which every partition makes K x D sums."""
    k, d = p["mean"].shape
    sent = vectors.sparkSession.sparkContext.broadcast(p)

    def run(batches):
        import pyarrow as pa

        total = np.zeros(2 + k + 2 * k * d)
        for batch in batches:
            if len(batch):
                v = matrix(batch.column(0))
                w, score = _responsibilities(kind, v, sent.value)
                total[0] += score.sum()
                total[1] += len(v)
                total[2 : 2 + k] += w.sum(0)
                total[2 + k : 2 + k + k * d] += (w.T @ v).ravel()
                total[2 + k + k * d :] += (w.T @ v**2).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "x"])

    flat = np.zeros(2 + k + 2 * k * d)
    rows = vectors.select(F.col(vec).cast("array<double>").alias("vec")).where(F.col("vec").isNotNull())
    for r in rows.mapInArrow(run, "i INT, x DOUBLE").groupBy("i").agg(F.sum("x").alias("x")).collect():  # K x D numbers
        flat[r["i"]] = r["x"]
    return flat[0], int(flat[1]), flat[2 : 2 + k], flat[2 + k : 2 + k + k * d].reshape(k, d), flat[2 + k + k * d :].reshape(k, d)


def updated(p: dict, n: np.ndarray, s: np.ndarray, q: np.ndarray, kind: str) -> dict:
    """The parameters that follow from the weights, sums and sums of squares of the clusters."""
    d = s.shape[1]
    p = dict(p)
    p["weight"] = n / n.sum()
    if kind in ("gmm", "kmeans"):
        p["mean"] = s / n[:, None]
        p["var"] = np.maximum(q / n[:, None] - p["mean"] ** 2, 1e-6)
        return p
    length = np.linalg.norm(s, axis=1)
    p["mean"] = s / np.maximum(length, 1e-12)[:, None]
    r = np.clip(length / n, 1e-8, 1 - 1e-8)
    p["kappa"] = np.clip(np.where(n <= 1, 10.0, r * (d - r**2) / (1 - r**2)), 1e-3, 1e4)
    p["const"] = np.array([vmf_log_normaliser(v, d) for v in p["kappa"]])
    return p


def fit(vectors: DataFrame, key: str, vec: str, k: int, kind: str = "skmeans", rounds: int = 10, tol: float = 1e-4, seed: int = 0, starts: int = 1) -> dict:
    """Parameters after up to rounds steps from each of several starts, those with the best mean score; each step is one pass in which executors add up K x D sums. kind is skmeans (cosine), kmeans (Euclidean), movmf or gmm."""
    best = None
    for start in range(starts):
        p = _fit(vectors, key, vec, k, kind, rounds, tol, seed + start)
        if best is None or p["history"][-1] > best["history"][-1]:
            best = p
    return best


def _fit(vectors: DataFrame, key: str, vec: str, k: int, kind: str, rounds: int, tol: float, seed: int) -> dict:
    x = _sample(vectors, key, vec, seed)
    d = x.shape[1]
    p = {"mean": _seeds(x, k, seed), "weight": np.full(k, 1.0 / k), "kappa": np.full(k, 10.0), "const": np.zeros(k), "var": np.full((k, d), max(x.var(), 1e-6))}
    p["const"] = np.array([vmf_log_normaliser(v, d) for v in p["kappa"]])
    last, history = None, []
    for _ in range(rounds):
        score, seen, n, s, q = sums(vectors, vec, p, kind)
        for t in np.flatnonzero(n < 1e-9):  # an empty cluster restarts at the sampled vector that fits worst
            worst = x[int(np.argmin((x @ p["mean"].T).max(1)))]
            n[t], s[t], q[t] = 1.0, worst, worst**2
        p = updated(p, n, s, q, kind)
        score /= max(seen, 1)
        history.append(score)
        if last is not None and abs(score - last) <= tol * max(abs(last), 1e-12):
            break
        last = score
    return p | {"history": history}


def predict(vectors: DataFrame, key: str, vec: str, p: dict, kind: str) -> DataFrame:
    """(key, topic_id, p): the likeliest cluster of each vector and its probability."""
    sent = vectors.sparkSession.sparkContext.broadcast(p)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                w, _ = _responsibilities(kind, np.vstack(pdf[vec].to_numpy()).astype(float), sent.value)
                yield pd.DataFrame({key: pdf[key].to_numpy(), "topic_id": w.argmax(1).astype(np.int32), "p": w.max(1)})

    return vectors.select(key, vec).mapInPandas(run, f"{key} LONG, topic_id INT, p DOUBLE")


def spark_kmeans(vectors: DataFrame, key: str, vec: str, k: int, cosine: bool = True, seed: int = 0) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(key, array_to_vector(F.col(vec)).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=10, distanceMeasure="cosine" if cosine else "euclidean").fit(rows)
    return model.transform(rows).select(key, F.col("prediction").alias("topic_id"))


def senclu_choice(x: np.ndarray, topics: np.ndarray, share: np.ndarray, offset: float) -> np.ndarray:
    """The topic of each vector of a document: highest similarity, negative ones as 0, times its share in the document plus an offset."""
    return np.round(np.maximum(x @ topics.T, 0) * (share + offset), 9).argmax(1)


def senclu_shares(units: DataFrame, doc: str, vec: str, topics: np.ndarray, assigned: DataFrame, unit: str, offset: float) -> DataFrame:
    """(doc_id, unit, topic_id, p): one choice from given assignments (doc, unit, topic_id), with the soft weight of the chosen topic: 0, and the first topic, for a unit that no topic is similar to."""
    k = len(topics)
    rows = units.join(assigned.select(unit, "topic_id"), unit)
    docs = rows.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(unit, "topic_id", vec))).alias("s"))
    docs = docs.select(F.col(doc).alias("doc_id"), F.transform("s", lambda x: x[unit]).alias("units"), F.transform("s", lambda x: x["topic_id"]).alias("z"), F.transform("s", lambda x: x[vec]).alias("vecs"))
    sent = units.sparkSession.sparkContext.broadcast(topics)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                x = np.vstack(row.vecs).astype(float)
                share = np.bincount(np.asarray(row.z), minlength=k) / len(row.z)
                w = np.maximum(x @ sent.value.T, 0) * (share + offset)
                z = senclu_choice(x, sent.value, share, offset)
                mass = np.maximum(w.sum(1), 1e-300)
                out += [(row.doc_id, u, int(t), float(w[i, t] / mass[i])) for i, (u, t) in enumerate(zip(row.units, z, strict=True))]
            yield pd.DataFrame(out, columns=["doc_id", "unit", "topic_id", "p"])

    return docs.mapInPandas(run, "doc_id LONG, unit LONG, topic_id INT, p DOUBLE")


def senclu(units: DataFrame, doc: str, unit: str, vec: str, k: int, epochs: int = 6, alpha: float = 1.0, seed: int = 0) -> tuple[np.ndarray, DataFrame]:
    """(topic vectors, (doc_id, unit, topic_id)): each unit takes the topic of highest similarity times (share in its document + offset).

    The offset starts at 8 and halves down to alpha; topics become means weighted by their share in each document.
    """
    from topicloom.models.gibbs import as_documents
    from topicloom.session import cut

    docs = cut(as_documents(units, doc, unit, vec), "documents")
    topics = _seeds(_sample(units, unit, vec, seed), k, seed)
    offset, out = 8.0, None
    for _ in range(epochs):
        sent = docs.sparkSession.sparkContext.broadcast((topics, offset))

        def run(batches, sent=sent):
            import pandas as pd

            t, off = sent.value
            total = np.zeros(k + t.size)
            for pdf in batches:
                rows = []
                for row in pdf.itertuples(index=False):
                    x = np.vstack(row.vecs).astype(float)
                    share = np.full(k, 1.0 / k)
                    for _ in range(3):
                        z = senclu_choice(x, t, share, off)
                        share = np.bincount(z, minlength=k) / len(z)
                    for c in np.unique(z):
                        total[c] += share[c] * (z == c).sum()
                        total[k + c * t.shape[1] : k + (c + 1) * t.shape[1]] += share[c] * x[z == c].sum(0)
                    rows.append((row.doc_id, z.tolist(), None))
                yield pd.DataFrame(rows, columns=["doc_id", "z", "stats"])
            yield pd.DataFrame([(None, None, total.tolist())], columns=["doc_id", "z", "stats"])

        out = cut(docs.mapInPandas(run, "doc_id LONG, z ARRAY<INT>, stats ARRAY<DOUBLE>"), "epoch")
        flat = np.zeros(k + topics.size)
        for r in out.where("stats is not null").select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():  # K x D numbers
            flat[r["i"]] = r["x"]
        weight, sums = flat[:k], flat[k:].reshape(topics.shape)
        new = np.where(weight[:, None] > 0, sums / np.maximum(weight, 1e-12)[:, None], topics)
        moved, topics = np.abs(new - topics).max(), new
        offset = max(offset / 2, alpha)
        if moved < 1e-6:
            break
    assigned = docs.join(out.where("doc_id is not null").select("doc_id", "z"), "doc_id").select("doc_id", F.explode(F.arrays_zip("units", "z")).alias("u"))
    return topics, assigned.select("doc_id", F.col("u.units").alias("unit"), F.col("u.z").alias("topic_id"))
