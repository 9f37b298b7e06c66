"""Session defaults and the few helpers that every operator shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, list[str]] = {}


def get_session(cores: str = "*", app: str = "topicloom", **conf) -> SparkSession:
    """A local session with the settings the library is tuned for; on a cluster use the cluster's own session."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the checkpoint folder that was set.

    Where neither is set, a local session gets a folder of its own; a cluster has no folder that could
    be guessed, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="topicloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there is deleted with the session, or by release()."""
    path = f"{shared_dir(spark).rstrip('/')}/topicloom/{label}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame, label: str = "step", **options: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder, with options of the writer, and reads it back.

    It ends the lineage, survives the loss of executors, and lets several consumers read a result
    that was made once. The tables of a session are deleted when it ends, or by release().
    """
    path = scratch(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables that cut() wrote for this application; returns their number."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _WRITTEN:
        try:
            release(spark)
        except Exception:  # the JVM may be gone already
            pass


def spread(df: DataFrame, *keys) -> DataFrame:
    """Deals rows to all cores before a step that computes much per row, if there are too few partitions for them.

    A scan of as many splits as cores is left alone, and so is the result of a shuffle that is large
    enough for adaptive execution to keep a partition for every core; large inputs are never shuffled
    for this. The plan is looked at, not run.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    if re.search(r"^[\s:+|-]*(?:Aggregate|Join|Window|Distinct|Deduplicate|Repartition|Sort)", plan.toString(), re.M):
        per_core = spark._jsparkSession.sessionState().conf().getConf(spark._jvm.org.apache.spark.sql.internal.SQLConf.ADVISORY_PARTITION_SIZE_IN_BYTES())
        small = int(str(plan.stats().sizeInBytes())) < cores * int(per_core)
    else:
        small = df.rdd.getNumPartitions() < cores
    return df.repartition(2 * cores, *keys) if small else df


#: Bytes up to which a side may be broadcast by its plan's statistics.
BROADCAST_BYTES = 64 << 20


def bounded_broadcast(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is known to be small, else without one.

    The plan's own upper bound of its bytes is asked first, which runs nothing; only if that is too
    large is df written once, counted and measured, and read back by the join.
    """
    from pyspark.sql import functions as F

    size = lambda x: int(str(x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size(df) <= max_bytes:
        return F.broadcast(df)
    df = cut(df, "side")
    return F.broadcast(df) if size(df) <= max_bytes and df.count() <= max_rows else df
