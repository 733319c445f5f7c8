"""Session defaults, table loading and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}

#: Shuffle files of a written table go as soon as it is written, not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app: str = "kinfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; anything already set by spark-submit wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map={**DEFAULTS, **conf}).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only where none is set and the master is local."""
    sc = spark.sparkContext
    already = sc._jsc.sc().getCheckpointDir()
    if already.isDefined():
        return already.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc.master.startswith("local[") or sc.master == "local":
        return os.path.join(tempfile.gettempdir(), "kinfold-checkpoints")
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut_counted(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """Write a frame once as a table in the shared folder and read it back: lineage ends there, an executor can be lost afterwards.

    The measures (aggregates over the written rows) come from the same job, so that knowing a count costs no second pass."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kinfold-{uuid.uuid4().hex}"
    seen = Observation()
    watched = df.observe(seen, *[m.alias(k) for k, m in measures.items()]) if measures else df
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        watched.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table, dict(seen.get) if measures else {}


def cut(df: DataFrame) -> DataFrame:
    return cut_counted(df)[0]


def drop(*tables: DataFrame) -> None:
    """Remove tables that `cut` wrote, once all that is made of them is written itself: a frame that still reads one fails."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.cut_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
