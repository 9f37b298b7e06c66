"""Writers of data sets, results and tables."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _put(spark, path: str, text: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(conf).create(target, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()


def csv_dataset(df: DataFrame, path: str, manifest: dict | None = None) -> None:
    """CSV files with a header, all fields quoted, and manifest.json beside them."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', emptyValue="")
    if manifest is not None:
        _put(df.sparkSession, f"{path}.manifest.json", json.dumps(manifest, sort_keys=True, indent=2))


def jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with their keys in order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def result_table(df: DataFrame, path: str, partition: list[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition).parquet(path)


def evaluation_json(df: DataFrame, path: str, meta: dict) -> None:
    """{"_meta", "results"} of a small result; it refuses more than 10,000 rows."""
    rows = df.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("an evaluation result of more than 10,000 rows is a table, not a JSON file")
    payload = {"_meta": meta | {"written_at": datetime.now(timezone.utc).isoformat()}, "results": [r.asDict(recursive=True) for r in rows]}
    _put(df.sparkSession, path, json.dumps(payload, sort_keys=True, default=str))


def append_runs(runs: DataFrame, path: str) -> None:
    """Adds run results to the table of all runs; what is latest is a view over it, latest_view()."""
    runs.write.mode("append").parquet(path)


def latest_view(spark, path: str, key: list[str]) -> DataFrame:
    """The last run of every key of a table of runs."""
    from topicloom.sources.readers import latest_per_key

    return latest_per_key(spark.read.parquet(path), key)


def marked_cell(value, mark, digits: int = 2):
    """A number with digits decimals, bold if it is best and underlined if second, '--' for null."""
    text = F.format_string(f"%.{digits}f", value)
    shown = F.when(mark == "best", F.concat(F.lit("\\textbf{"), text, F.lit("}"))).when(mark == "second", F.concat(F.lit("\\underline{"), text, F.lit("}"))).otherwise(text)
    return F.when(value.isNull(), "--").otherwise(shown)


def latex_rows(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """One LaTeX table row per row, in a column latex, with the sort columns."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("--")) for c in columns]
    return df.select(*order, F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\")).alias("latex")).orderBy(*order)
