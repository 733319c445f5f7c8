"""References to records that do not exist.

References are pre-aggregated per key and period, which combines map-side. Keys that hold a large share of the rows are judged
against a broadcast of the bounded set of heavy keys, the others by a shuffle join against the first arrival of each target; both
parts are unioned. A reference is an orphan when no target of its key had arrived at or before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.skew import lookup_join
from kinfold.session import cut


def first_arrivals(targets: DataFrame, key: str, arrived: str) -> DataFrame:
    """(key, first_at): the earliest arrival of each target key. Null keys name nothing and are left out."""
    return targets.select(F.expr(key).alias("key"), F.col(arrived).alias("at")).filter("key is not null").groupBy("key").agg(F.min("at").alias("first_at"))


def references(df: DataFrame, table_name: str, field: str, key: str, row_id: str, at: str) -> DataFrame:
    """(table_name, ref_field, row_id, key, at): one row per usable reference; rows whose key is null refer to nothing."""
    return df.select(F.lit(table_name).alias("table_name"), F.lit(field).alias("ref_field"), F.col(row_id).alias("row_id"), F.expr(key).alias("key"), F.col(at).alias("at")).filter("key is not null")


def orphan_rows(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """The references without a target that was there in time.

    refs: as made by references(). targets: (key, first_at), unique in key. A null moment on either side counts as "not there in
    time". Empty tables give an empty result or, for empty targets, every reference.
    """
    counts = refs.groupBy("key").agg(F.count("*").alias("_n"))
    judged = lookup_join(refs, targets, "key", counts)
    return judged.filter("not coalesce(first_at <= at, false)").drop("first_at")


def orphan_report(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """(table_name, ref_field, period, orphans, orphan_keys): references are aggregated per key and month before the join, so a hot key
    costs one row per month; a month is decided by its first and last moment. Only where the target arrived between the two are the
    references themselves looked at. Null moments are orphans and their months report as null."""
    by = ["table_name", "ref_field", "key", "period"]
    dated = refs.withColumn("period", F.date_format("at", "yyyy-MM"))
    shrunk = dated.groupBy(*by).agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))
    counts = shrunk.groupBy("key").agg(F.count("*").alias("_n"))
    judged = cut(lookup_join(shrunk, targets, "key", counts))
    whole = judged.filter("first_at is null or high is null or high < first_at").select(*by, "n")
    split = judged.filter("low < first_at and high >= first_at").select(*by, "first_at")
    part = dated.join(split, by).filter("at < first_at").groupBy(*by).agg(F.count("*").alias("n"))
    return whole.unionByName(part).groupBy("table_name", "ref_field", "period").agg(F.sum("n").alias("orphans"), F.count("*").alias("orphan_keys"))
