"""Snapshots of tables: versioned Parquet folders with a manifest, keyed merges and invariants. One writer at a time."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class SnapshotStore:
    """table/v=N folders under a root; _CURRENT names the version to read and is swapped by a rename, so readers see whole versions.

    The root is a folder that the driver can reach as a file system path; executors write the Parquet files there."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _manifest(self, name: str) -> str:
        return os.path.join(self.root, name, "_CURRENT")

    def version(self, name: str) -> int:
        try:
            with open(self._manifest(name)) as f:
                return json.load(f)["version"]
        except FileNotFoundError:
            return 0

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.root, name, f"v={self.version(name)}"))

    def commit(self, name: str, df: DataFrame) -> int:
        """Write the next version and make it current; the version being read is never overwritten."""
        n = self.version(name) + 1
        df.write.mode("overwrite").parquet(os.path.join(self.root, name, f"v={n}"))
        draft = f"{self._manifest(name)}.{uuid.uuid4().hex}"
        with open(draft, "w") as f:
            json.dump({"version": n}, f)
        os.replace(draft, self._manifest(name))
        return n


def merge_on_key(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Upsert: rows of `new` replace rows of `old` with the same key, columns that `new` lacks keep their old value; rows without a
    key are appended. Of repeated new rows the last by `order` counts."""
    keyed = new.dropna(subset=key)
    if order:
        keyed = keyed.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).filter("_k = 1").drop("_k")
    else:
        keyed = keyed.dropDuplicates(key)
    fresh = keyed.select(*key, *[F.col(c).alias("_n_" + c) for c in new.columns if c not in key], F.lit(True).alias("_hit"))
    joined = old.join(fresh, key, "left")
    kept = joined.select(*[F.when(F.col("_hit"), F.col("_n_" + c)).otherwise(F.col(c)).alias(c) if c in new.columns and c not in key else F.col(c) for c in old.columns])
    added = keyed.join(old.select(*key).dropna(), key, "left_anti").unionByName(new.filter(" or ".join(f"{k} is null" for k in key)), allowMissingColumns=True)
    return kept.unionByName(added, allowMissingColumns=True).select(*old.columns)


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Append the rows of `new` whose key is neither in `old` nor earlier in `new`; rows without a key are always appended."""
    keyed = new.dropna(subset=key).dropDuplicates(key).join(old.select(*key).dropna(), key, "left_anti")
    return old.unionByName(keyed, allowMissingColumns=True).unionByName(new.filter(" or ".join(f"{k} is null" for k in key)), allowMissingColumns=True)


def violations(df: DataFrame, key: list[str], where: str = "true") -> DataFrame:
    """Keys that occur more than once among the rows where they must be unique."""
    return df.filter(where).dropna(subset=key).groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1")


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON object a row, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def to_json_array(df: DataFrame, most: int = 10_000) -> str:
    """The rows as one JSON array, for results of bounded size; more rows than `most` are an error, not a cut."""
    rows = [r["value"] for r in to_json_lines(df).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them as lines")
    return "[" + ",".join(rows) + "]"


def to_table(df: DataFrame, most: int = 1000) -> str:
    """The rows as padded text columns under their names, nulls blank, for results of bounded size."""
    rows = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them as lines")
    cells = [df.columns, *[list(r) for r in rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in cells)
