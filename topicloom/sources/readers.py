"""Readers of corpora, reference collections, vectors and run results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicloom.session import cut


def csv_corpus(spark: SparkSession, paths: str | list[str], text_column: str = "data", target_column: str | None = None, targets: list[str] | None = None, strip: bool = True) -> DataFrame:
    """(path, text[, label]) of the rows of CSV files with a header whose text is not blank; a missing column is an error."""
    rows = spark.read.csv(paths, header=True, multiLine=True, escape='"', encoding="UTF-8").withColumn("path", F.input_file_name())
    for name in filter(None, (text_column, target_column)):
        if name not in rows.columns:
            raise ValueError(f"no column {name!r} in {paths}; there are {rows.columns}")
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = rows.where(F.trim(F.regexp_replace(text, r"\s+", " ")) != "")
    if targets is not None and target_column:
        rows = rows.where(F.col(target_column).isin(targets))
    label = [F.trim(target_column).alias("label")] if target_column else []
    return rows.select("path", (F.regexp_replace(text, r"^\s+|\s+$", "") if strip else text).alias("text"), *label)


def text_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One document per line that is not blank."""
    return spark.read.text(paths).where(F.trim("value") != "").select(F.trim("value").alias("text"))


def numbered(files: list[DataFrame], name: str = "doc_id") -> DataFrame:
    """The union of frames with numbers, doc_id, from 0 in the order of the list and of their rows. Rows are counted per partition, and each partition's rows count on from those before: nothing is gathered or shuffled."""
    both = files[0]
    for df in files[1:]:
        both = both.unionByName(df, allowMissingColumns=True)
    rows = cut(both.withColumn("_i", F.monotonically_increasing_id()), "numbered")
    part, inside = F.shiftright("_i", 33), F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("_p", before.alias("_before")))  # one row per partition
    return rows.join(starts, part == F.col("_p")).select((F.col("_before") + inside).alias(name), *both.columns)


def dataset_split(spark: SparkSession, folder: str, catalog: dict[str, list[str]], name: str) -> DataFrame:
    """The rows of all tables of a data set by name, with the table's name as split where they have none; an unknown name is an error."""
    if name not in catalog:
        raise ValueError(f"unknown data set {name!r}; there are {sorted(catalog)}")
    out = None
    for part in catalog[name]:
        rows = spark.read.parquet(f"{folder}/{part}.parquet")
        rows = rows if "split" in rows.columns else rows.withColumn("split", F.lit(part))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def labelled_frame(rows: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """(text, label) of the rows that have both; a missing column is an error."""
    for name in (text, label):
        if name not in rows.columns:
            raise ValueError(f"no column {name!r}; there are {rows.columns}")
    return rows.select(F.col(text).alias("text"), F.col(label).alias("label")).na.drop()


def fiscal_years(rows: DataFrame, at: str, years: list[int], first_month: int = 4, per_year: bool = True) -> DataFrame:
    """Rows of the fiscal years named, each year once, with a column run: one per year, or one for all together."""
    years = list(dict.fromkeys(years))
    year = F.year(F.add_months(F.col(at).cast("date"), 1 - first_month))
    found = rows.withColumn("fiscal_year", year).where(F.col("fiscal_year").isin(years))
    joined = "-".join(map(str, years))
    return found.withColumn("run", F.col("fiscal_year").cast("string") if per_year else F.lit(joined))


def stopwords(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a text file, once each: blank lines and those that start with # are skipped, NFKC."""
    import unicodedata

    compat = F.udf(lambda w: unicodedata.normalize("NFKC", w).strip(), "string", useArrow=True)
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return lines.select(compat("value").alias("word")).where("word <> ''").distinct()


def tokenized_jsonl(lines: DataFrame, column: str = "value", min_tokens: int = 1, max_docs: int | None = None, strict: bool = False) -> DataFrame:
    """tokens of each JSON line that is an object with tokens or a bare list; tokens are trimmed and empty ones dropped, short documents too.

    strict raises an error for a line that is neither, with its number if the frame has a column line_no; else such lines are left out.
    """
    whole = F.col(column).rlike(r"^\s*(\{[\s\S]*\}|\[[\s\S]*\])\s*$")
    given = F.coalesce(F.from_json(column, "tokens ARRAY<STRING>")["tokens"], F.from_json(column, "ARRAY<STRING>"))
    tokens = F.filter(F.transform(given, lambda t: F.trim(t)), lambda t: t != "")
    rows = lines.withColumn("tokens", F.when(whole, tokens))
    if strict:
        rows = rows.withColumn("tokens", F.when(F.col("tokens").isNull(), F.raise_error(F.concat(F.lit("not a tokenized document"), F.concat(F.lit(" in line "), F.col("line_no").cast("string")) if "line_no" in lines.columns else F.lit(""), F.lit(": "), F.coalesce(column, F.lit("null"))))).otherwise(F.col("tokens")))
    rows = rows.where(F.size("tokens") >= min_tokens)
    return rows if max_docs is None else rows.limit(max_docs)


def wiki_xml(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, text) of the articles of a dump: namespace 0, markup stripped, blank ones dropped; bz2 files are split."""
    schema = "id LONG, ns INT, title STRING, revision STRUCT<text: STRING>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path).where("ns = 0")
    text = F.col("revision.text")
    for pattern, put in ((r"(?s)<!--.*?-->", ""), (r"(?s)\{\{[^{}]*\}\}", ""), (r"(?s)<ref[^>]*>.*?</ref>|<[^>]+>", ""), (r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1"), (r"'{2,}", ""), (r"(?m)^=+\s*(.*?)\s*=+$", "$1"), (r"[ \t]+", " ")):
        text = F.regexp_replace(text, pattern, put)
    return pages.select("id", "title", F.trim(text).alias("text")).where("text <> ''")


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) of a word2vec text file; its first line with the two sizes is skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") > 2)
    return rows.select(F.col("p")[0].alias("word"), F.slice("p", 2, F.size("p") - 1).cast("array<float>").alias("vec"))


def word_vectors_binary(spark: SparkSession, path: str, name: str = "word") -> DataFrame:
    """(word, vec) of word2vec binary files, plain or compressed by gzip: a line with two sizes, then each word, a blank and its numbers in single precision. A file is read by one task."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def read(batches):
        import gzip

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0).to_pylist():
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                head, at = data.index(b"\n"), 0
                n, d = map(int, data[:head].split())
                at, words, rows = head + 1, [], []
                for _ in range(n):
                    end = data.index(b" ", at)
                    words.append(data[at:end].lstrip(b"\n").decode("utf-8", "replace"))
                    rows.append(np.frombuffer(data, "<f4", d, end + 1).tolist())
                    at = end + 1 + 4 * d
                    if len(words) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(rows, pa.list_(pa.float32()))], names=[name, "vec"])
                        words, rows = [], []
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(rows, pa.list_(pa.float32()))], names=[name, "vec"])

    return files.mapInArrow(read, f"{name} STRING, vec ARRAY<FLOAT>")


def entity_vectors(spark: SparkSession, path: str, prefix: str = "ENTITY/") -> DataFrame:
    """(name, is_entity, vec) of a text file of word and entity vectors: entities begin with a prefix and have _ for blanks. Bz2 and gzip files are read as they are."""
    rows = word_vectors(spark, path)
    entity = F.startswith("word", F.lit(prefix))
    return rows.select(F.when(entity, F.translate(F.substring("word", len(prefix) + 1, 10_000), "_", " ")).otherwise(F.col("word")).alias("name"), entity.alias("is_entity"), "vec")


def latest_per_key(runs: DataFrame, key: list[str], at: str = "started_at", tie: str = "execution_id") -> DataFrame:
    """The last run of every key by start, then by execution."""
    order = W.partitionBy(*key).orderBy(F.col(at).desc_nulls_last(), F.col(tie).desc_nulls_last())
    return runs.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def axes_of_name(df: DataFrame, name: str) -> DataFrame:
    """Columns metric, dataset, topics, mode and value read from names such as accuracy_news_k20_ratio0.5; a full run counts as ratio 1."""
    pattern = r"^([a-z0-9]+)_(.+)_k(\d+)(?:_(ratio|count)([0-9.]+?))?(?:\.json)?$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    full = part(4) == ""
    return df.select("*", part(1).alias("metric"), part(2).alias("dataset"), part(3).cast("int").alias("topics"), F.when(full, "ratio").otherwise(part(4)).alias("mode"), F.when(full, F.lit(1.0)).otherwise(F.when(~full, part(5)).cast("double")).alias("value"))
