"""Co-occurrence counts of a growing file source, equal to the batch counts of all files seen so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators.corpus import usable


def document_pairs(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """(w1, w2, c): documents with both words, w2 = '' for a word alone; per-document lists are formed in place."""
    kept = usable("document_tokens")
    if words is not None:
        kept = F.filter(kept, lambda t: t.isin(words))
    rows = docs.select(F.array_sort(F.array_distinct(kept)).alias("ws"))
    singles = rows.select(F.explode("ws").alias("w1")).withColumn("w2", F.lit(""))
    left = rows.select("ws", F.posexplode("ws").alias("i", "w1"))
    pairs = left.select("w1", F.explode(F.slice("ws", F.col("i") + 2, F.size("ws"))).alias("w2"))
    return singles.unionByName(pairs).groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c"))


def stream_pairs(spark: SparkSession, path: str, schema, words: list[str] | None, out: str, checkpoint: str, files_per_batch: int = 1) -> DataFrame:
    """Runs the counts over all files there are, as a stream that can be resumed, and returns their table.

    Each micro-batch is counted by itself and written under its own number, so a batch that runs again
    after a failure replaces its own counts; no state is kept, and the table is the sum over batches.
    """
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)

    def add(batch: DataFrame, number: int) -> None:
        document_pairs(batch, words).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    parts = spark.read.schema("w1 STRING, w2 STRING, c LONG, batch LONG").parquet(out)
    return parts.groupBy("w1", "w2").agg(F.sum("c").alias("c"))
