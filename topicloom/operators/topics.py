"""Topic shares of documents and sentences, label profiles, geometry, likelihoods and clustering steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from topicloom.functions import numeric as N
from topicloom.session import cut

#: Topics that are broadcast at once; more are compared and scored by blocks of as many.
TOPIC_BLOCK = 10_000


def valid_latest(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key..., value) of the last load of each key, if its value is a number."""
    newest = F.max(F.struct("loaded_at", value)).alias("_l")
    rows = df.groupBy(*key).agg(newest).select(*key, F.col(f"_l.{value}").alias(value))
    return rows.where(F.col(value).isNotNull() & ~F.isnan(value))


def from_posteriors(sentence_topic: DataFrame) -> DataFrame:
    """theta of each document: its sentences' probabilities added up, over their sum; documents without any have no rows."""
    mass = sentence_topic.groupBy("data_run", "doc_id", "topic_id").agg(F.sum("p").alias("m"))
    whole = F.sum("m").over(W.partitionBy("data_run", "doc_id"))
    return mass.withColumn("theta", F.coalesce(F.try_divide(F.col("m"), F.when(whole != 0, whole)), F.lit(0.0))).drop("m")


def from_means(sentence_topic: DataFrame) -> DataFrame:
    """theta as the mean of the sentences' probabilities, normalised again; a topic that a sentence lacks counts as 0."""
    mass = sentence_topic.groupBy("data_run", "doc_id", "topic_id").agg(F.sum("p").alias("m"))
    n = sentence_topic.groupBy("data_run", "doc_id").agg(F.count_distinct("sent_id").alias("n"))
    rows = mass.join(n, ["data_run", "doc_id"]).withColumn("m", F.col("m") / F.col("n"))
    k = F.size(F.collect_set("topic_id").over(W.partitionBy("data_run", "doc_id")))
    whole = F.sum("m").over(W.partitionBy("data_run", "doc_id"))
    return rows.withColumn("theta", F.when(whole > 0, F.col("m") / F.when(whole > 0, whole)).otherwise(F.lit(1.0) / k)).drop("m", "n")


def assignments(sentence_topic: DataFrame) -> DataFrame:
    """(data_run, doc_id, sent_id, topic_id): the likeliest topic of each sentence, the smallest of several; folded on the map side."""
    best = F.max(F.struct(F.col("p"), (-F.col("topic_id")).alias("t"))).alias("_b")
    return sentence_topic.groupBy("data_run", "doc_id", "sent_id").agg(best).select("data_run", "doc_id", "sent_id", (-F.col("_b.t")).alias("topic_id"))


def from_counts(assigned: DataFrame) -> DataFrame:
    counts = assigned.groupBy("data_run", "doc_id", "topic_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("theta", F.col("n") / F.sum("n").over(W.partitionBy("data_run", "doc_id")))


def given_topic(sentence_topic: DataFrame) -> DataFrame:
    """p(sentence | topic): negative values count as 0; uniform over the sentences of a topic without mass.

    Sums per topic are made first and joined, so a topic that holds a third of all rows is no hot window.
    """
    rows = sentence_topic.withColumn("p", F.greatest("p", F.lit(0.0)))
    sums = rows.groupBy("data_run", "topic_id").agg(F.sum("p").alias("mass"), F.count(F.lit(1)).alias("n"))
    rows = rows.join(sums, ["data_run", "topic_id"])
    return rows.withColumn("share", F.when(F.col("mass") > 0, F.col("p") / F.when(F.col("mass") > 0, F.col("mass"))).otherwise(F.lit(1.0) / F.col("n"))).drop("mass", "n")


def label_profile(theta: DataFrame, labels: DataFrame, min_docs: int = 1, sort_by: str = "ratio", eps: float = 1e-12) -> DataFrame:
    """(data_run, label, docs, topic_id, mean_weight, global_mean, score): mean share of each topic in each label's documents.

    A document without a row for a topic counts as 0 there. score is the mean, or ln((mean + eps) / (global + eps)).
    """
    rows = theta.join(labels, "doc_id")
    docs = rows.select("data_run", "label", "doc_id").distinct()
    per_label = docs.groupBy("data_run", "label").agg(F.count(F.lit(1)).alias("docs"))
    everywhere = docs.groupBy("data_run").agg(F.count_distinct("doc_id").alias("all_docs"))
    means = rows.groupBy("data_run", "label", "topic_id").agg(F.sum("theta").alias("s")).join(per_label, ["data_run", "label"])
    totals = rows.groupBy("data_run", "topic_id").agg(F.sum("theta").alias("g"))
    out = means.join(totals, ["data_run", "topic_id"]).join(everywhere, "data_run").where(F.col("docs") >= min_docs)
    out = out.withColumn("mean_weight", F.col("s") / F.col("docs")).withColumn("global_mean", F.col("g") / F.col("all_docs"))
    score = F.col("mean_weight") if sort_by == "ratio" else F.ln((F.col("mean_weight") + eps) / (F.col("global_mean") + eps))
    return out.select("data_run", "label", "docs", "topic_id", "mean_weight", "global_mean", score.alias("score"))


def ranked(df: DataFrame, by: list[str], score: str, tie: list[str], n: int) -> DataFrame:
    """The n best rows of each group by rounded score, with rank."""
    order = W.partitionBy(*by).orderBy(F.col("_s").desc(), *tie)
    return df.withColumn("_s", N.r6(score)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("_s")


def matrix(column):
    """The NumPy matrix of an Arrow list column whose lists all have one length."""
    import numpy as np

    flat = np.asarray(column.flatten(), dtype=np.float64)
    if len(flat) % max(len(column), 1) or len(column) and set(np.unique(np.asarray(column.value_lengths()))) != {len(flat) // len(column)}:
        raise ValueError("vectors of unlike lengths")
    return flat.reshape(len(column), -1)


def mean_vectors(vectors: DataFrame, by: str, vec: str = "vec") -> DataFrame:
    """(by, n, total, dim): element-wise sums. Each partition adds up its vectors, so D numbers per group and partition are shuffled."""
    rows = vectors.select(by, F.col(vec).cast("array<double>").alias("vec")).where(F.col("vec").isNotNull())
    schema = rows.select(by).schema.add("n", "long").add("total", T.ArrayType(T.DoubleType()))

    def add(batches):
        import numpy as np
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            if not len(batch):
                continue
            x, coded = matrix(batch.column(1)), batch.column(0).dictionary_encode()
            codes = np.asarray(coded.indices.fill_null(len(coded.dictionary)))
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(codes[order]) != 0))
            counts = np.diff(np.append(starts, len(order)))
            keys = [*coded.dictionary.to_pylist(), None]
            for code, n, total in zip(codes[order[starts]], counts, np.add.reduceat(x[order], starts), strict=True):
                old = sums.get(keys[code], (0, 0.0))
                sums[keys[code]] = (old[0] + int(n), old[1] + total)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), kind_of), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([t.tolist() for _, t in sums.values()], pa.list_(pa.float64()))], names=[by, "n", "total"])

    kind_of = to_arrow_type(schema[by].dataType)
    parts = rows.mapInArrow(add, schema)
    counted = parts.groupBy(by).agg(F.sum("n").alias("n"))
    cells = parts.select(by, F.posexplode("total").alias("i", "x")).groupBy(by, "i").agg(F.sum("x").alias("s"))
    packed = cells.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("v"))
    packed = packed.join(counted, packed[by].eqNullSafe(counted[by])).drop(counted[by])
    return packed.select(by, "n", F.transform("v", lambda x: x["s"]).alias("total"), F.size("v").alias("dim"))


def topic_parameters(vectors: DataFrame, by: str = "topic_id", vec: str = "vec", default_kappa: float = 10.0) -> DataFrame:
    """(by, n, mean, resultant, kappa): direction and concentration of each topic's vectors."""
    s = mean_vectors(vectors, by, vec).withColumn("resultant", N.norm("total"))
    dims = F.col("dim")
    r = F.least(F.greatest(F.col("resultant") / F.col("n"), F.lit(1e-6)), F.lit(1.0 - 1e-6))
    k = F.when(F.col("n") <= 1, F.lit(default_kappa)).otherwise(r * (dims - r * r) / (F.lit(1.0) - r * r))
    return s.select(by, "n", N.unit_safe("total").alias("mean"), "resultant", k.alias("kappa"))


def topic_similarity(topics: DataFrame, by: str = "topic_id", mean: str = "mean", block: int = TOPIC_BLOCK) -> DataFrame:
    """(a, b, cosine) with a < b of all topics. Up to block topics are broadcast; of more, every pair of blocks meets once, in a join on the two blocks."""
    rows = topics.select(F.col(by).alias("id"), F.col(mean).alias("v"))
    n = rows.count()
    if n <= block:
        left, right = rows.toDF("a", "x"), F.broadcast(rows.toDF("b", "y"))
        return left.join(right, F.col("a") < F.col("b")).select("a", "b", N.cosine("x", "y").alias("cosine"))
    blocks = -(-n // block)
    own = rows.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    own = own.select("id", "v", "g", F.least("g", "h").alias("lo"), F.greatest("g", "h").alias("hi"))
    both = own.toDF("a", "x", "ga", "lo", "hi").join(own.toDF("b", "y", "gb", "lo", "hi"), ["lo", "hi"])
    once = (F.col("a") < F.col("b")) & ((F.col("lo") == F.col("hi")) | (F.col("ga") != F.col("gb")))
    return both.where(once).select("a", "b", N.cosine("x", "y").alias("cosine"))


def overlap_metrics(similarity: DataFrame, threshold: float = 0.5) -> DataFrame:
    return similarity.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg("cosine").alias("mean_cosine"),
        F.max("cosine").alias("max_cosine"),
        (F.lit(1.0) - F.avg("cosine")).alias("diversity"),
        F.sum((F.col("cosine") >= threshold).cast("long")).alias("pairs_above"),
    )


def scored_against(vectors: DataFrame, topics: DataFrame, key: str, vec: str = "vec", by: str = "topic_id", block: int = TOPIC_BLOCK) -> DataFrame:
    """(key, topic_id, dot, kappa) of every vector with every topic, vectors x K cells as the model asks. Topics are broadcast, in blocks of bounded size if there are many; nothing is shuffled."""
    rows, given = vectors.select(key, vec), topics.select(F.col(by).alias("topic_id"), "mean", "kappa")
    blocks = max(1, -(-given.count() // block))
    out = None
    for i in range(blocks):
        part = given if blocks == 1 else given.where(F.pmod(F.xxhash64("topic_id"), F.lit(blocks)) == i)
        one = rows.crossJoin(F.broadcast(part)).select(key, "topic_id", N.dot(vec, "mean").alias("dot"), "kappa")  # about block topics
        out = one if out is None else out.unionByName(one)
    return out


def word_distributions(words: DataFrame, topics: DataFrame, word: str = "term", vec: str = "vec", by: str = "topic_id") -> DataFrame:
    """(topic_id, term, p): soft maximum over all words of the products of word and topic vectors, as topic models in an embedding space have it.

    The largest product and the sum of exponentials are made per topic first, on the map side, and joined; no topic's words are gathered.
    """
    scores = scored_against(words, topics.select(by, F.col(vec).alias("mean"), F.lit(1.0).alias("kappa")), word, vec, by)
    top = scores.groupBy("topic_id").agg(F.max("dot").alias("_m"))
    raised = scores.join(top, "topic_id").withColumn("_e", F.exp(F.col("dot") - F.col("_m")))
    mass = raised.groupBy("topic_id").agg(F.sum("_e").alias("_s"))
    return raised.join(mass, "topic_id").select("topic_id", word, (F.col("_e") / F.col("_s")).alias("p"))


def hard_topic(scores: DataFrame, key: str, score: str) -> DataFrame:
    """The topic of highest rounded score of each key, the smallest of several."""
    best = F.max(F.struct(N.r6(score).alias("s"), (-F.col("topic_id")).alias("t"))).alias("_b")
    return scores.groupBy(key).agg(best).select(key, (-F.col("_b.t")).alias("topic_id"), F.col("_b.s").alias("score"))


def soft_topics(scores: DataFrame, key: str, score: str, temperature: float = 1.0) -> DataFrame:
    """Tempered soft maximum of the scores of each key; a key has K rows, so its window is small."""
    w = W.partitionBy(key)
    scaled = F.col(score) / F.lit(temperature)
    rows = scores.withColumn("_e", F.exp(scaled - F.max(scaled).over(w)))
    return rows.withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def confusion_metrics(pairs: DataFrame, truth: str, guess: str) -> DataFrame:
    """Accuracy, macro and micro F1 in percent with two decimals, from the counts of (truth, guess)."""
    cells = pairs.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    true = cells.groupBy(F.col("t").alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0)).alias("tp"))
    predicted = cells.groupBy(F.col("g").alias("c")).agg(F.sum("n").alias("predicted"))
    per = true.join(predicted, "c", "full_outer").na.fill(0, ["support", "tp", "predicted"])
    f1 = F.when(F.col("support") + F.col("predicted") > 0, F.lit(2.0) * F.col("tp") / F.greatest(F.col("support") + F.col("predicted"), F.lit(1))).otherwise(0.0)
    out = per.agg(F.sum("tp").alias("tp"), F.sum("support").alias("n"), F.avg(f1).alias("macro"))
    pct = lambda c: F.floor(c * 10000 + F.lit(0.5001)) / 100
    return out.select(pct(F.col("tp") / F.col("n")).alias("accuracy"), pct(F.col("macro")).alias("macro_f1"), pct(F.col("tp") / F.col("n")).alias("micro_f1"))


def moments(vectors: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """(i, j, mean_i, covariance) for i <= j. Each partition makes its sums and its matrix of products, D^2 numbers, which are then added up."""
    rows = vectors.select(F.col(vec).cast("array<double>").alias("vec")).where(F.col("vec").isNotNull())

    def add(batches):
        import numpy as np
        import pyarrow as pa

        n, sums, products = 0, 0.0, 0.0
        for batch in batches:
            if len(batch):
                x = matrix(batch.column(0))
                n, sums, products = n + len(x), sums + x.sum(0), products + x.T @ x
        if n:
            i, j = np.triu_indices(len(sums))
            columns = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(i), n)), pa.array(sums[i]), pa.array(sums[j]), pa.array(products[i, j])]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "n", "sx", "sy", "sxy"])

    parts = rows.mapInArrow(add, "i INT, j INT, n LONG, sx DOUBLE, sy DOUBLE, sxy DOUBLE")
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy")])
    return sums.select("i", "j", (F.col("sx") / F.col("n")).alias("mean_i"), ((F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("n") - 1)).alias("covariance"))


#: Queries compared at once, and the results that a task keeps before it puts them out.
QUERY_BLOCK, KEPT_RESULTS = 512, 5_000_000


def nearest(vectors: DataFrame, queries: DataFrame, key: str, k: int, vec: str = "vec", block: int = QUERY_BLOCK) -> DataFrame:
    """(query, neighbour, similarity, rank): the k most similar other rows of every query by cosine, exactly; ties by the smaller key.

    Queries are written once to the shared folder. In one scan of the vectors, every task reads them
    block by block beside each batch of its rows and keeps the k best of each query, so its memory
    is a block times a batch; what is shuffled is k rows per query and partition.
    """
    asked = cut(queries.select(key, F.col(vec).cast("array<double>").alias("vec")).where(F.col("vec").isNotNull()), "queries")
    files, n_queries = asked.inputFiles(), asked.count()
    spark = vectors.sparkSession
    keep_all = n_queries * k <= KEPT_RESULTS

    def blocks():
        import numpy as np
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        for name in files:
            system, inner = fs.FileSystem.from_uri(name)
            with system.open_input_file(inner) as handle:
                for batch in pq.ParquetFile(handle).iter_batches(block):
                    q = matrix(batch.column(1))
                    yield np.asarray(batch.column(0), dtype=np.int64), q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

    def best(batches):
        import numpy as np
        import pyarrow as pa

        def rows(state):
            for names, tops in state.values():
                flat = [(q, i, s) for q, top in zip(names.tolist(), tops, strict=True) for s, i in top]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int64()), pa.array([-x[2] for x in flat], pa.float64())], names=["query", "neighbour", "similarity"])

        held, state = None, {}
        for batch in batches:
            if not len(batch):
                continue
            x, ids = matrix(batch.column(1)), np.asarray(batch.column(0), dtype=np.int64)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            if keep_all and held is None:
                held = list(blocks())
            for number, (names, q) in enumerate(held if keep_all else blocks()):
                s = np.round(q @ x.T, 9)
                s[names[:, None] == ids[None, :]] = -np.inf
                _, tops = state.setdefault(number, (names, [[] for _ in names]))
                if s.shape[1] > k:
                    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                else:
                    least = np.full(len(s), -np.inf)
                least = np.maximum(least, [-t[-1][0] if len(t) == k else -np.inf for t in tops])
                for r in range(len(names)):  # about k rows pass
                    at = np.flatnonzero((s[r] >= least[r]) & (s[r] > -np.inf))
                    if len(at):
                        tops[r] = sorted([*tops[r], *zip((-s[r, at]).tolist(), ids[at].tolist(), strict=True)])[:k]
            if not keep_all:
                yield from rows(state)
                state = {}
        yield from rows(state)

    found = vectors.select(key, F.col(vec).cast("array<double>").alias("vec")).where(F.col("vec").isNotNull()).mapInArrow(best, "query LONG, neighbour LONG, similarity DOUBLE")
    order = W.partitionBy("query").orderBy(F.col("similarity").desc(), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) if files else spark.createDataFrame([], "query LONG, neighbour LONG, similarity DOUBLE, rank INT")


#: Numbers of a matrix of queries, documents and topics that is held at once.
CELLS = 1 << 22


class _Shares:
    """Sparse unit vectors: for every row its number, topic and weight."""

    def __init__(self, topics, values, lengths):
        import numpy as np

        sizes = np.asarray(topics.value_lengths()).astype(np.int64)
        self.n, self.starts = len(sizes), np.append(0, np.cumsum(sizes))
        self.row, self.topic = np.repeat(np.arange(len(sizes)), sizes), np.asarray(topics.flatten())
        with np.errstate(all="ignore"):
            self.weight = np.asarray(values.flatten()) / np.repeat(np.asarray(lengths), sizes)

    def cells(self, first: int, end: int, topics, weight):
        """The matrix of weight of the rows from first to end and the given sorted topics."""
        import numpy as np

        own = slice(self.starts[first], self.starts[end])
        at = np.minimum(np.searchsorted(topics, self.topic[own]), len(topics) - 1)
        ok = topics[at] == self.topic[own]
        out = np.zeros((end - first, len(topics)))
        out[self.row[own][ok] - first, at[ok]] = weight[own][ok]
        return out

    def products(self, other: _Shares, first: int, end: int):
        """Inner products with the rows from first to end of the other; what isn't finite counts where a topic is shared only."""
        import numpy as np

        out, topics = np.zeros((self.n, end - first)), np.unique(self.topic)
        odd = [~np.isfinite(x.weight) for x in (self, other)]
        parts = [np.where(o, 0.0, x.weight) for o, x in zip(odd, (self, other), strict=True)]
        step = max(1, CELLS // max(self.n, end - first))
        for k in range(0, len(topics), step):
            some = topics[k : k + step]
            out += self.cells(0, self.n, some, parts[0]) @ other.cells(first, end, some, parts[1]).T
            if odd[0].any() or odd[1].any():
                held = [self.cells(0, self.n, some, np.ones_like(parts[0])), other.cells(first, end, some, np.ones_like(parts[1]))]
                bad = self.cells(0, self.n, some, odd[0]) @ held[1].T + held[0] @ other.cells(first, end, some, odd[1]).T
                out[bad > 0] = np.nan
        return out


def near_and_apart(theta: DataFrame, close: float, far: float, every: int = 100, block: int = QUERY_BLOCK) -> DataFrame:
    """(a, b, close, far), a < b: pairs of documents whose shares in the first run are at most close apart by cosine distance, and at least far in the last run;
    one of each pair has an id that every divides. Both documents have shares in both runs, and a topic in common in the first.

    A document is one row, with its shares of both runs. Asked documents are written once to the shared
    folder; in one scan of all documents every task reads them block by block beside its batch and
    puts out the pairs that pass, so no pair is shuffled or written that isn't a result.
    """
    theta = cut(theta.where("theta > 0"), "theta")
    ends = theta.agg(F.min("data_run").alias("first"), F.max("data_run").alias("last"))
    rows = theta.join(F.broadcast(ends), F.col("data_run").isin(F.col("first"), F.col("last"))).where("doc_id is not null")  # one row
    sides = []
    for side in ("first", "last"):
        here = F.col("data_run") == F.col(side)
        sides += [
            F.collect_list(F.when(here & F.col("topic_id").isNotNull(), F.struct("topic_id", "theta"))).alias(side),
            F.sqrt(F.sum(F.when(here, F.col("theta") * F.col("theta")))).alias(f"{side}_length"),
        ]
    both = rows.groupBy("doc_id").agg(*sides).where("first_length is not null and last_length is not null and size(first) > 0")
    fields = [F.col("doc_id").cast("long").alias("doc_id")]
    for side in ("first", "last"):
        fields += [F.col(f"{side}.topic_id").cast("array<bigint>").alias(f"{side}_topics"), F.col(f"{side}.theta").alias(f"{side}_theta"), F.col(f"{side}_length")]
    docs = cut(both.select(*fields), "shares")
    asked = cut(docs.where(F.col("doc_id") % every == 0), "asked")
    files = asked.inputFiles()

    def parsed(batch):
        import numpy as np

        return np.asarray(batch.column(0), dtype=np.int64), _Shares(*batch.columns[1:4]), _Shares(*batch.columns[4:7])

    def blocks():
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        for name in files:
            system, inner = fs.FileSystem.from_uri(name)
            with system.open_input_file(inner) as handle:
                yield from map(parsed, pq.ParquetFile(handle).iter_batches(block))

    def pairs(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            ids, first, last = parsed(batch)
            for names, asked_first, asked_last in blocks():
                step = max(1, CELLS // len(names))
                for k in range(0, len(ids), step):
                    end = min(k + step, len(ids))
                    s = asked_first.products(first, k, end)
                    once = np.where(ids[None, k:end] % every == 0, names[:, None] < ids[None, k:end], True)  # of two asked documents the smaller one asks
                    q, d = np.nonzero((1.0 - s <= close + 1e-9) & (s > 0) & once)
                    if not len(q):
                        continue
                    t = asked_last.products(last, k, end)[q, d]
                    ok = ~(1.0 - t < far - 1e-9)  # as in SQL, NaN is above all numbers
                    a, b = names[q[ok]], ids[k:end][d[ok]]
                    columns = [np.minimum(a, b), np.maximum(a, b), s[q, d][ok], t[ok]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "s", "t"])

    found = docs.mapInArrow(pairs, "a LONG, b LONG, s DOUBLE, t DOUBLE")
    return found.select("a", "b", (F.lit(1.0) - F.col("s")).alias("close"), (F.lit(1.0) - F.col("t")).alias("far"))


def greedy_unique(pairs: DataFrame, order: list, a: str = "a", b: str = "b", most: int = 100_000) -> DataFrame:
    """Pairs in ascending order of the columns order, each taken unless one of its documents is taken already.

    Up to most pairs are walked on the driver. More go in rounds: a pair that comes first among all
    that touch either of its documents is taken, pairs that touch a taken document leave, until none
    is left. Both ways take the same pairs, since the order has no ties but of equal pairs.
    """
    spark = pairs.sparkSession
    rows = pairs.orderBy(*order).limit(most + 1).collect()
    if len(rows) <= most:
        used, out = set(), []
        for r in rows:
            if r[a] not in used and r[b] not in used:
                used |= {r[a], r[b]}
                out.append(r)
        return spark.createDataFrame(out, pairs.schema)
    left = cut(pairs.distinct().withColumn("_o", F.struct(*[c.alias(f"o{i}") for i, c in enumerate([*order, F.col(a), F.col(b)])])), "pairs")
    taken = []
    while not left.isEmpty():
        ends = left.select(F.col(a).alias("_d"), "_o").unionByName(left.select(F.col(b).alias("_d"), "_o"))
        first = ends.groupBy("_d").agg(F.min("_o").alias("_f"))
        now = left.join(first.toDF("_a", "_fa"), F.col(a) == F.col("_a")).where("_o = _fa").drop("_a", "_fa")
        now = cut(now.join(first.toDF("_b", "_fb"), F.col(b) == F.col("_b")).where("_o = _fb").drop("_b", "_fb"), "taken")
        taken.append(now)
        gone = now.select(F.explode(F.array(a, b)).alias("_d")).distinct()
        rest = left.join(gone.toDF("_a"), F.col(a) == F.col("_a"), "left_anti").join(gone.toDF("_b"), F.col(b) == F.col("_b"), "left_anti")
        left = cut(rest, "pairs")
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out.drop("_o")
