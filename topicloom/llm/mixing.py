"""Problem 8: mixing sources to target weights, in tokens of a public tokenizer."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicloom.llm.tokens import DEFAULT_TOKENIZER, encoded
from topicloom.session import cut

#: Mean number of documents in one block of a source's permutation; a block is ordered by one task.
BLOCK_DOCS = 10_000
#: Blocks of all sources and repeats up to which their table is broadcast (some 10 MB); beyond it is joined by shuffle.
BROADCAST_BLOCKS = 200_000


@dataclass
class Source:
    source: str
    target_share: float
    max_repeats: int
    docs: int
    tokens: int

    @property
    def most(self) -> int:
        return self.tokens * self.max_repeats


def tempered(sources: list[Source], exponent: float) -> list[float]:
    """Normalised weights: the share of the supply times (target share / share of the supply) to the exponent.

    Exponent 1 gives the targets, 0 the supply as it is. Sources without tokens or target weigh 0.
    """
    supply = sum(s.tokens for s in sources)
    raw = []
    for s in sources:
        held = s.tokens / supply if supply else 0.0
        raw.append(held * (s.target_share / held) ** exponent if held > 0 and s.target_share > 0 else 0.0)
    total = sum(raw)
    return [x / total if total else 0.0 for x in raw]


def largest_budget(sources: list[Source], weights: list[float]) -> int:
    """The most tokens a mix of these weights can have before a source exceeds its repeats."""
    bounds = [s.most / w for s, w in zip(sources, weights, strict=True) if w > 0]
    return math.floor(min(bounds) * (1 + 1e-12)) if bounds else 0


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def bisect_exponent(sources: list[Source], budget: int | None = None, target_entropy: float | None = None, steps: int = 60) -> float:
    """The exponent nearest 1 whose weights keep the repetition limit at the budget, or reach the target entropy.

    Without a budget and a target entropy it is 1: the targets themselves are met at the largest
    budget they allow. Both conditions are monotone between 0 and 1 for the cases that occur here;
    where even exponent 0 breaks the limit, 0 is returned and water_fill() takes over.
    """
    if budget is None and target_entropy is None:
        return 1.0

    def fits(x: float) -> bool:
        weights = tempered(sources, x)
        if target_entropy is not None:
            return (entropy(weights) - target_entropy) * sign >= 0
        return budget <= largest_budget(sources, weights)

    sign = 1.0
    if target_entropy is not None:
        sign = 1.0 if entropy(tempered(sources, 0.0)) >= target_entropy else -1.0
    if fits(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if fits(middle) else (low, middle)
    return low


def water_fill(sources: list[Source], weights: list[float], budget: int) -> list[float]:
    """Quotas in tokens that sum to the budget or all there is; what a source at its limit can't give goes to the others by weight."""
    quotas, open_ = [0.0] * len(sources), {i for i, w in enumerate(weights) if w > 0}
    left = float(budget)
    while open_ and left > 1e-9:
        share = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / share >= sources[i].most - quotas[i]}
        if not full:
            for i in open_:
                quotas[i] += left * weights[i] / share
            break
        for i in full:
            left -= sources[i].most - quotas[i]
            quotas[i] = float(sources[i].most)
        open_ -= full
    return quotas


def _name(column: str):
    return F.lower(F.trim(F.col(column)))


def sized_documents(documents: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of every document with at least one token; sources trimmed, in lower case."""
    sized = encoded(documents.select("doc_id", _name("source").alias("source"), "text"), ["doc_id", "source"], tokenizer, count_only=True)
    return sized.where("n_tokens > 0")


def supply(sized: DataFrame, targets: DataFrame) -> list[Source]:
    """One entry per source of the targets; the driver gets one row for each of them.

    A target without a name, share or repeats counts as 0; names that occur twice add their shares and take the larger limit.
    """
    want = targets.groupBy(_name("source").alias("source")).agg(
        F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("repeats")
    )
    have = sized.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    rows = want.where("source is not null").join(have, "source", "left").collect()
    return [Source(r["source"], float(r["share"]), max(0, int(r["repeats"])), r["docs"] or 0, r["tokens"] or 0) for r in sorted(rows, key=lambda r: r["source"])]


def plan(sources: list[Source], budget: int | float | None = None, target_entropy: float | None = None) -> tuple[float, list[float], list[float]]:
    """(exponent, weights, quotas in tokens) for a budget in tokens or, as a float, in parts of the supply of the target sources."""
    if isinstance(budget, float):
        budget = int(budget * sum(s.tokens for s in sources if s.target_share > 0 and s.max_repeats > 0))
    exponent = bisect_exponent(sources, budget, target_entropy)
    weights = tempered(sources, exponent)
    total = largest_budget(sources, weights) if budget is None else budget
    return exponent, weights, water_fill(sources, weights, total)


def _blocks(sized: DataFrame, sources: list[Source], seed: int) -> tuple[DataFrame, DataFrame]:
    """The documents with block and place in the permutation of each repeat they may take part in, and the blocks' sizes.

    Every repeat of a source orders its blocks, and the documents of a block, by a hash of seed, repeat and doc_id.
    """
    spark = sized.sparkSession
    many = [(s.source, max(1, -(-s.docs // BLOCK_DOCS))) for s in sources if s.docs]
    names = F.broadcast(spark.createDataFrame(many, "source STRING, n_blocks LONG"))  # one row per source of the targets
    docs = sized.join(names, "source").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), "n_blocks")).drop("n_blocks")
    return docs, docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"))


def mix(
    documents: DataFrame,
    targets: DataFrame,
    budget: int | float | None = None,
    target_entropy: float | None = None,
    tokenizer: str = DEFAULT_TOKENIZER,
    seed: int = 8,
) -> tuple[DataFrame, DataFrame]:
    """(the mix, the report of its shares).

    The mix has one row (source, repeat, position, doc_id, n_tokens) for each use of a document:
    repeat counts from 0 and stays below max_repeats; sorting by position shuffles the sources into
    each other. Without a budget, the mix is the largest in which every source that has documents
    stands in exact proportion to its target. With one (an int in tokens, a float in parts of the supply), the weights are tempered until no source
    exceeds its repeats. The quota of each source is then filled by permutations of its documents,
    block by block: whole blocks as far as they fit, and of the block that the quota ends in, the
    documents whose running sum keeps closest to it. Only the sums of blocks, never a source's
    documents, are ordered as a whole, and no task gets more than a block.

    Documents of null or other sources, and those without tokens, take no part. Rows that share a
    doc_id are used one by one. A target without documents gets no tokens and stands in the report.
    """
    spark = documents.sparkSession
    sized = cut(sized_documents(documents, tokenizer), "sized")
    sources = supply(sized, targets)
    exponent, weights, quotas = plan(sources, budget, target_entropy)
    docs, blocks = _blocks(sized, sources, seed)
    uses = []
    for s, quota in zip(sources, quotas, strict=True):
        for r in range(s.max_repeats if s.tokens else 0):
            if (left := quota - r * s.tokens) > 0:
                uses.append((s.source, r, min(left, float(s.tokens))))
    # repeats are few: a row for each source and repeat that the quota reaches
    used = F.broadcast(spark.createDataFrame(uses, "source STRING, repeat INT, quota DOUBLE"))
    by_block = W.partitionBy("source", "repeat").orderBy(F.xxhash64(F.lit(seed), "repeat", "block"), "block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.join(used, "source").withColumn("before", F.coalesce(F.sum("tokens").over(by_block), F.lit(0)))
    starts = starts.where(F.col("before") < F.col("quota")).withColumn("cut", F.col("before") + F.col("tokens") > F.col("quota"))
    starts = starts.drop("tokens")
    n_blocks = sum(-(-s.docs // BLOCK_DOCS) * s.max_repeats for s in sources)  # counted before: one row per BLOCK_DOCS documents and repeat at most
    placed = docs.join(F.broadcast(starts) if n_blocks <= BROADCAST_BLOCKS else starts, ["source", "block"])
    order = F.xxhash64(F.lit(seed), "repeat", "doc_id")
    whole = placed.where(~F.col("cut"))
    inside = W.partitionBy("source", "repeat", "block").orderBy(order, "doc_id").rowsBetween(W.unboundedPreceding, -1)
    part = placed.where("cut").withColumn("upto", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    part = part.where(F.col("upto") + F.col("n_tokens") / 2 <= F.col("quota")).drop("upto")
    position = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "source", "repeat", "doc_id"), 1)
    mixed = whole.unionByName(part).select("source", "repeat", position.alias("position"), "doc_id", "n_tokens")
    mixed = cut(mixed, "mix")
    return mixed, report(mixed, sources, exponent, weights, quotas)


def report(mixed: DataFrame, sources: list[Source], exponent: float, weights: list[float], quotas: list[float]) -> DataFrame:
    """A row per source of the targets: target, supply, weight, quota, and the tokens and share that the mix reached."""
    rows = [
        (s.source, s.target_share, s.max_repeats, s.docs, s.tokens, exponent, w, round(q))
        for s, w, q in zip(sources, weights, quotas, strict=True)
    ]
    schema = "source STRING, target_share DOUBLE, max_repeats INT, supply_docs LONG, supply_tokens LONG, exponent DOUBLE, weight DOUBLE, quota_tokens LONG"
    reached = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("mix_rows"), F.sum("n_tokens").alias("mix_tokens"), (F.max("repeat") + 1).alias("repeats_used")
    )
    full = F.broadcast(mixed.sparkSession.createDataFrame(rows, schema)).join(reached, "source", "left")
    zero = F.lit(0).cast("long")
    full = full.withColumn("mix_rows", F.coalesce("mix_rows", zero)).withColumn("mix_tokens", F.coalesce("mix_tokens", zero))
    total = F.sum("mix_tokens").over(W.partitionBy())  # one row per source
    share = F.coalesce(F.try_divide(F.col("mix_tokens").cast("double"), total), F.lit(0.0))
    return full.withColumn("repeats_used", F.coalesce("repeats_used", F.lit(0))).withColumn("actual_share", share)
