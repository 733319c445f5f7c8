"""Linking staged touchpoints as they arrive: a file stream whose micro-batches are linked against the identities of the moment."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import touchpoints
from kinfold.session import shared_folder


def run_available(spark: SparkSession, path: str, identities: DataFrame, target: str | None = None) -> DataFrame:
    """Link everything that is there now and return the result table.

    Each micro-batch writes to a folder of its own number, replaced when a batch is retried, so a lost executor or a restart neither
    loses nor repeats rows. Orphans stay in the result and link when they are delivered again; no watermark is needed, as recency
    compares the moments of touchpoints, not their arrival.
    """
    work = target or f"{shared_folder(spark)}/backfill-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema

    def step(batch: DataFrame, number: int) -> None:
        linked = touchpoints.link(batch, identities)
        done = batch.join(linked, "id").withColumn("match_status", F.when(F.col("contact_id").isNull(), "orphaned").otherwise("linked"))
        done.select("id", "source", "source_external_id", "contact_id", "match_status", "imported_at").write.mode("overwrite").parquet(f"{work}/out/batch={number}")

    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
    # a stream reads folders: a table of one file is its folder narrowed to the file's name
    stream = reader.option("pathGlobFilter", place.getName()).parquet(str(place.getParent())) if status.isFile() else reader.parquet(path)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{work}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{work}/out").drop("batch")
