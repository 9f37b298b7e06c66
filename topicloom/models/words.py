"""Models over words: one topic per sentence, online variational LDA, word vectors, weighted sentence vectors, classifiers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.models.gibbs import hash_uniforms
from topicloom.operators.topics import matrix, moments
from topicloom.session import cut

#: Documents that a task of the sentence model works on with the counts of their own words.
BLOCK_DOCS = 2_000
#: Bytes of word vectors up to which they are broadcast; beyond, tokens and vectors are joined by shuffle.
VECTOR_BYTES = 256 << 20


def _sentence_evidence(rows: np.ndarray, seen: np.ndarray, totals: np.ndarray, beta: float, size: int) -> np.ndarray:
    """Log Polya likelihood of a sentence's words under every topic: rows has the counts of each word, seen how often it stood before in the sentence."""
    return np.log(rows + beta + seen[:, None]).sum(0) - np.log(totals + beta * size + np.arange(len(rows))[:, None]).sum(0)


def sentence_factors(rows: np.ndarray, seen: np.ndarray, totals: np.ndarray, beta: float, size: int, doc: np.ndarray, alpha: float) -> np.ndarray:
    """p(topic | sentence, counts): document counts doc plus alpha times the Polya likelihood, normalised."""
    w = np.log(doc + alpha) + _sentence_evidence(rows, seen, totals, beta, size)
    w = np.exp(w - w.max())
    return w / w.sum()


def _seen(ids: np.ndarray) -> np.ndarray:
    """How often each word stood before at an earlier place."""
    order = np.argsort(ids, kind="stable")
    first = np.append(True, np.diff(ids[order]) != 0)
    out = np.empty(len(ids), np.int64)
    out[order] = np.arange(len(ids)) - np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
    return out


def sentence_lda(sentence_words: DataFrame, n_topics: int, iterations: int = 5, seed: int = 0, block_docs: int = BLOCK_DOCS, soft: bool = False) -> tuple[DataFrame, DataFrame]:
    """((doc_id, sent_id, topic_id), (topic_id, term, cnt)) of a model with one topic per sentence and a Polya likelihood of its words.

    Input: (doc_id, sent_id, words ARRAY<STRING>). The topic-word counts are fixed within a sweep and
    merged after it, as distributed samplers of this model do; the sampler that updates them sentence
    by sentence on one thread is approximated, not repeated. Documents go in blocks, each beside the
    counts of the words it holds, so no task and no broadcast has the whole vocabulary. With soft,
    the first frame has p ARRAY<DOUBLE> as well: the topic weights of the last sweep, from which the
    sentence's own words were taken out.
    """
    alpha = beta = 1.0 / n_topics
    docs = sentence_words.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", "words"))).alias("s"))
    docs = cut(docs.select("doc_id", F.transform("s", lambda x: x["sent_id"]).alias("units"), F.transform("s", lambda x: x["words"]).alias("ws")), "documents")
    blocks = max(1, -(-docs.count() // block_docs))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    named = cut(docs.select("block", F.explode(F.flatten("ws")).alias("term")).distinct(), "block-words")
    vocab = named.select("term").distinct().count()
    state, counts = docs.withColumn("z", F.lit(None).cast("array<int>")), None
    for it in range(iterations):
        totals = np.zeros(n_topics)
        if counts is None:
            rows = named.withColumn("row", F.array().cast("array<struct<topic_id:int,cnt:bigint>>"))
        else:
            for r in counts.groupBy("topic_id").agg(F.sum("cnt").alias("n")).collect():  # K rows
                totals[r["topic_id"]] = r["n"]
            rows = named.join(counts.groupBy("term").agg(F.collect_list(F.struct("topic_id", "cnt")).alias("row")), "term", "left")

        def one(docs_, words, it, totals):
            import pandas as pd

            at = {t: i for i, t in enumerate(words["term"])}
            table = np.zeros((len(at), n_topics))
            for i, row in enumerate(words["row"]):
                for cell in row if row is not None else ():
                    table[i, cell["topic_id"]] = cell["cnt"]
            out = []
            for doc_id, ws, old in zip(docs_["doc_id"], docs_["ws"], docs_["z"], strict=True):
                u = hash_uniforms(seed, it, 0, int(doc_id), len(ws))
                first = old is None
                old = np.full(len(ws), -1) if first else np.asarray(old)
                nd = np.bincount(old[old >= 0], minlength=n_topics).astype(float)
                z, p = [], []
                for i, words_ in enumerate(ws):
                    ids = np.array([at[w] for w in words_], dtype=np.int64)
                    base, total, seen = table[ids], totals, _seen(ids)
                    if not first:
                        k = old[i]
                        nd[k] -= 1
                        _, inverse, n = np.unique(ids, return_inverse=True, return_counts=True)
                        base[:, k] = np.maximum(base[:, k] - n[inverse], 0)
                        total = totals.copy()
                        total[k] = max(total[k] - len(ids), 0)
                    w = sentence_factors(base, seen, total, beta, vocab, nd, alpha)
                    t = min(int(np.searchsorted(np.cumsum(w), u[i], side="right")), n_topics - 1)
                    nd[t] += 1
                    z.append(t)
                    p.append(w.tolist())
                out.append((doc_id, z, p if soft else []))
            return pd.DataFrame(out, columns=["doc_id", "z", "p"])

        def bound(it, totals):
            return lambda docs_, words: one(docs_, words, it, totals)

        done = state.groupBy("block").cogroup(rows.groupBy("block")).applyInPandas(bound(it, totals), "doc_id LONG, z ARRAY<INT>, p ARRAY<ARRAY<DOUBLE>>")
        state = docs.join(cut(done, f"sweep{it}"), "doc_id")
        cells = state.select(F.explode(F.arrays_zip("ws", "z")).alias("c")).select(F.col("c.z").alias("topic_id"), F.explode("c.ws").alias("term"))
        counts = cut(cells.groupBy("topic_id", "term").agg(F.count(F.lit(1)).alias("cnt")), "counts")
    kept = [F.col("units"), F.col("z")] + ([F.col("p")] if soft else [])
    assigned = state.select("doc_id", F.explode(F.arrays_zip(*kept)).alias("c")).select("doc_id", F.col("c.units").alias("sent_id"), F.col("c.z").alias("topic_id"), *([F.col("c.p").alias("p")] if soft else []))
    return assigned, counts


def infer_sentences(sentence_words: DataFrame, counts: DataFrame, doc_counts: DataFrame, n_topics: int, vocab: int, alpha: float, beta: float, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(doc_id, sent_id, p ARRAY<DOUBLE>): topic weights of sentences under given counts (topic_id, term, cnt) and (doc_id, topic_id, n), from which nothing is taken out. Blocks of documents lie beside the counts of their own words."""
    docs = doc_counts.groupBy("doc_id").agg(F.collect_list(F.struct("topic_id", "n")).alias("nd"))
    rows = sentence_words.join(docs, "doc_id", "left")
    blocks = max(1, -(-sentence_words.agg(F.count_distinct("doc_id")).first()[0] // block_docs))
    rows = cut(rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks))), "sentences")
    named = rows.select("block", F.explode("words").alias("term")).distinct()
    named = cut(named.join(counts.groupBy("term").agg(F.collect_list(F.struct("topic_id", "cnt")).alias("row")), "term", "left"), "block-words")
    totals = np.zeros(n_topics)
    for r in counts.groupBy("topic_id").agg(F.sum("cnt").alias("n")).collect():  # K rows
        totals[r["topic_id"]] = r["n"]

    def one(sents, words):
        import pandas as pd

        at = {t: i for i, t in enumerate(words["term"])}
        table = np.zeros((len(at), n_topics))
        for i, row in enumerate(words["row"]):
            for cell in row if row is not None else ():
                table[i, cell["topic_id"]] = cell["cnt"]
        out = []
        for doc_id, sent_id, ws, nd in zip(sents["doc_id"], sents["sent_id"], sents["words"], sents["nd"], strict=True):
            doc = np.zeros(n_topics)
            for cell in nd if nd is not None else ():
                doc[cell["topic_id"]] = cell["n"]
            ids = np.array([at[w] for w in ws], dtype=np.int64)
            out.append((doc_id, sent_id, sentence_factors(table[ids], _seen(ids), totals, beta, vocab, doc, alpha).tolist()))
        return pd.DataFrame(out, columns=["doc_id", "sent_id", "p"])

    return rows.groupBy("block").cogroup(named.groupBy("block")).applyInPandas(one, "doc_id LONG, sent_id INT, p ARRAY<DOUBLE>")


def _count_vectors(docs: DataFrame, words: str, most: int):
    """Counts of every term of the documents, rare ones too; an error if there are more than most."""
    from pyspark.ml.feature import CountVectorizer

    size = docs.select(F.explode(words).alias("term")).distinct().count()
    if size > most:
        raise ValueError(f"{size} terms are more than the {most} that the model is made for; restrict the documents to a vocabulary")
    model = CountVectorizer(inputCol=words, outputCol="features", vocabSize=max(size, 1), minDF=1.0).fit(docs)
    return model, model.transform(docs)


def online_lda(docs: DataFrame, n_topics: int, words: str = "words", rounds: int = 10, seed: int = 0, vocab: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """((doc_id, topic_id, theta), (topic_id, term, weight)) of online variational LDA over all terms; an error if there are more than vocab."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.functions import vector_to_array

    cv, rows = _count_vectors(docs, words, vocab)
    model = LDA(k=n_topics, maxIter=rounds, seed=seed, optimizer="online", subsamplingRate=0.2).fit(rows)
    theta = model.transform(rows).select("doc_id", F.posexplode(vector_to_array("topicDistribution")).alias("topic_id", "theta"))
    names = cv.vocabulary
    top = [(r["topic"], names[i], float(w)) for r in model.describeTopics(10).collect() for i, w in zip(r["termIndices"], r["termWeights"], strict=True)]  # K times 10
    return theta, docs.sparkSession.createDataFrame(top, "topic_id INT, term STRING, weight DOUBLE")


def word2vec(docs: DataFrame, words: str = "words", size: int = 100, seed: int = 0, rounds: int = 20) -> DataFrame:
    """(word, vec) of skip-gram vectors with window 5, every word kept."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=size, minCount=1, windowSize=5, maxIter=rounds, seed=seed, inputCol=words, outputCol="v").fit(docs)
    return model.getVectors().select("word", vector_to_array("vector").alias("vec"))


def usif_weights(sentence_tokens: DataFrame, min_count: int = 1) -> DataFrame:
    """(term, cnt, probability, weight) with weight a / (p + a / 2).

    a = (1 - h) / (h V / 2), where h is the share of the V words more likely than 1 - (1 - 1/V)^L, L the mean sentence length.
    """
    words = sentence_tokens.groupBy("term").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= min_count)
    totals = words.agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("v"))
    lengths = sentence_tokens.groupBy("doc_id", "sent_id").agg(F.count(F.lit(1)).alias("l")).agg(F.avg("l").alias("len"))
    rows = words.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(lengths))  # one row each
    rows = rows.withColumn("p", F.col("cnt") / F.col("n"))
    limit = F.lit(1.0) - F.pow(F.lit(1.0) - F.lit(1.0) / F.col("v"), F.col("len"))
    share = rows.agg(F.avg((F.col("p") > limit).cast("double")).alias("h"))
    rows = rows.crossJoin(F.broadcast(share))  # one row
    a = F.when(F.col("h") > 0, (F.lit(1.0) - F.col("h")) / (F.col("h") * F.col("v") / 2)).otherwise(F.lit(1.0))
    return rows.select("term", "cnt", F.col("p").alias("probability"), (a / (F.col("p") + a / 2)).alias("weight"))


def weighted_means(sentence_tokens: DataFrame, weights: DataFrame, vectors: DataFrame) -> DataFrame:
    """(doc_id, sent_id, vec): the mean of weight times unit vector over the words of a sentence that have both; zeros for a sentence of which none has.

    Vectors of bounded size are broadcast and each sentence is read in place. More are joined with the
    tokens, and the vectors of a sentence are added up where it lies.
    """
    from topicloom.functions.numeric import unit_safe

    scaled = vectors.select(F.col("word").alias("term"), unit_safe(F.col("vec").cast("array<double>")).alias("u")).join(weights.select("term", "weight"), "term")
    scaled = cut(scaled.select("term", F.transform("u", lambda x: x * F.col("weight")).alias("v")), "weighted")
    size = scaled.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    n, d = size["n"], size["d"] or 1
    sents = sentence_tokens.groupBy("doc_id", "sent_id")
    if n * d * 8 <= VECTOR_BYTES:
        held = scaled.toArrow()
        given = sentence_tokens.sparkSession.sparkContext.broadcast(({t: i for i, t in enumerate(held["term"].to_pylist())}, matrix(held["v"].combine_chunks()) if n else np.zeros((0, d))))

        def mean(batches):
            import pyarrow as pa

            at, table = given.value
            for batch in batches:
                out = []
                for terms in batch.column(2).to_pylist():
                    ids = [at[t] for t in terms if t in at]
                    out.append((table[ids].sum(0) / len(ids) if ids else np.zeros(d)).tolist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], names=["doc_id", "sent_id", "vec"])

        lists = sents.agg(F.sort_array(F.collect_list("term")).alias("terms"))
        schema = lists.select("doc_id", "sent_id").schema.add("vec", "double")
        kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields[:2])
        return lists.mapInArrow(mean, f"{kind}, vec ARRAY<DOUBLE>")
    rows = sentence_tokens.join(scaled, "term", "left").groupBy("doc_id", "sent_id").agg(F.collect_list("v").alias("vs"))
    zero = F.array_repeat(F.lit(0.0), d)
    summed = F.aggregate("vs", zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return rows.select("doc_id", "sent_id", F.transform(summed, lambda x: x / F.greatest(F.size("vs"), F.lit(1))).alias("vec"))


def principal(sentence_vectors: DataFrame, n_components: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(directions, weights) of the first components of the centred vectors: from D^2 sums that executors add up; weights are squared singular values over the sum of those kept."""
    cells = moments(sentence_vectors, "sent_id").collect()  # D (D + 1) / 2 rows
    if not cells or cells[0]["covariance"] is None:
        return np.zeros((0, 0)), np.zeros(0)
    d = max(c["j"] for c in cells) + 1
    cov = np.zeros((d, d))
    for c in cells:
        cov[c["i"], c["j"]] = cov[c["j"], c["i"]] = c["covariance"]
    values, directions = np.linalg.eigh(cov)
    order = np.argsort(-values)[:n_components]
    kept = np.maximum(values[order], 0)
    return directions[:, order].T, kept / kept.sum() if kept.sum() > 0 else np.zeros(len(kept))


def without_components(sentence_vectors: DataFrame, directions: np.ndarray, weights: np.ndarray) -> DataFrame:
    """The vectors less their weighted projections on the directions, taken off one after the other; zero vectors stay zero."""
    if not len(directions):
        return sentence_vectors
    given = sentence_vectors.sparkSession.sparkContext.broadcast((directions, weights))  # D numbers per component
    at = sentence_vectors.columns.index("vec")

    def take(batches):
        import pyarrow as pa

        for batch in batches:
            x = matrix(batch.column(at)).copy() if len(batch) else np.zeros((0, 1))
            for direction, weight in zip(*given.value, strict=True) if len(batch) else ():
                x -= weight * np.outer(x @ direction, direction)
            columns = list(batch.columns)
            columns[at] = pa.array(x.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return sentence_vectors.mapInArrow(take, sentence_vectors.schema)


def usif_vectors(sentence_tokens: DataFrame, weights: DataFrame, vectors: DataFrame, n_components: int = 5) -> DataFrame:
    """(doc_id, sent_id, vec): weighted means of unit word vectors less their first common components; a sentence without a known word has a zero vector."""
    means = cut(weighted_means(sentence_tokens, weights, vectors), "means")
    return without_components(means, *principal(means, n_components))


def logistic(train: DataFrame, test: DataFrame, features: str, label: str, key: str) -> DataFrame:
    """(key, truth, guess) of a multinomial logistic classifier of arrays of doubles."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    index = StringIndexer(inputCol=label, outputCol="_y", handleInvalid="skip", stringOrderType="alphabetAsc").fit(train)
    ready = lambda df: index.transform(df).withColumn("_x", array_to_vector(F.col(features)))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial", maxIter=30, regParam=1e-4).fit(ready(train))
    names = F.array(*[F.lit(x) for x in index.labels])
    return model.transform(ready(test)).select(key, F.col(label).alias("truth"), F.get(names, F.col("prediction").cast("int")).alias("guess"))


def linear_svm(train: DataFrame, test: DataFrame, features: str, label: str, key: str) -> DataFrame:
    """(key, truth, guess) of linear support vector machines, one class against the rest."""
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    index = StringIndexer(inputCol=label, outputCol="_y", handleInvalid="skip", stringOrderType="alphabetAsc").fit(train)
    ready = lambda df: index.transform(df).withColumn("_x", array_to_vector(F.col(features)))
    model = OneVsRest(classifier=LinearSVC(maxIter=20, regParam=1e-3), featuresCol="_x", labelCol="_y", parallelism=2).fit(ready(train))
    names = F.array(*[F.lit(x) for x in index.labels])
    return model.transform(ready(test)).select(key, F.col(label).alias("truth"), F.get(names, F.col("prediction").cast("int")).alias("guess"))


def perplexity(mean_log_likelihood: float) -> float:
    return math.inf if -mean_log_likelihood > 709 else math.exp(-mean_log_likelihood)
