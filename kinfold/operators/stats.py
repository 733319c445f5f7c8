"""Coverage counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _long(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(F.concat(F.lit(name + "="), F.col(column)).alias("metric")).agg(F.count("*").alias("count"))


def coverage(contacts: DataFrame, staging: DataFrame, touchpoints: DataFrame) -> DataFrame:
    """(metric, count) by connection status, tier and match status, and the total; values that do not occur have no row."""
    total = contacts.agg(F.count("*").alias("count")).select(F.lit("contacts_total").alias("metric"), "count")
    return _long(contacts, "connection_status", "connection_status").unionByName(_long(contacts, "closeness_tier", "closeness_tier")).unionByName(_long(staging, "match_status", "staging")).unionByName(_long(touchpoints, "match_status", "touchpoints")).unionByName(total)


#: (metric, table, column, value) of the coverage report, in its order.
BUCKETS = (
    *(("connection_status", "contacts", "connection_status", v) for v in ("in_network", "contact_on_file")),
    *(("closeness_tier", "contacts", "closeness_tier", v) for v in ("t1_irl_messaging", "t2_dm", "t3_community", "t4_public", "none")),
    *(("staging", "staging", "match_status", v) for v in ("pending", "auto_matched", "needs_review", "merged", "rejected")),
    *(("touchpoints", "staging_interactions", "match_status", v) for v in ("pending", "linked", "orphaned")),
)


def fixed_buckets(tables: dict[str, DataFrame]) -> DataFrame:
    """(ordinal, metric, count): the coverage report in its fixed order, empty buckets left out, the total of contacts always there. One
    pass over each table."""
    spark = next(iter(tables.values())).sparkSession
    wanted = F.broadcast(spark.createDataFrame([(i, f"{n}={v}", t, c, v) for i, (n, t, c, v) in enumerate(BUCKETS)], "ordinal int, metric string, t string, c string, v string"))
    counted = None
    for name, df in tables.items():
        columns = sorted({c for _, t, c, _ in BUCKETS if t == name})
        long = df.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("c", "v")).groupBy("c", "v").agg(F.count("*").alias("count")).withColumn("t", F.lit(name))
        counted = long if counted is None else counted.unionByName(long)
    total = tables["contacts"].agg(F.count("*").alias("count")).select(F.lit(len(BUCKETS)).alias("ordinal"), F.lit("contacts_total").alias("metric"), "count")
    return counted.join(wanted, ["t", "c", "v"]).select("ordinal", "metric", "count").unionByName(total).orderBy("ordinal")


def enrichment_coverage(log: DataFrame, as_of: str, reviews: DataFrame | None = None, waiting: DataFrame | None = None) -> DataFrame:
    """(metric, count): stale current rows and current rows by source; with review items and waiting identifiers, also how many are
    open. Counts of zero are left out."""
    current = log.filter("is_current")

    def single(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("count")).select(F.lit(name).alias("metric"), "count").filter("count > 0")

    out = _long(current, "source", "current_by_source").unionByName(single(current.filter(F.col("refresh_after") < F.lit(as_of).cast("date")), "stale"))
    if reviews is not None:
        out = out.unionByName(single(reviews.filter("status = 'open'"), "in_review"))
    if waiting is not None:
        out = out.unionByName(single(waiting, "pending_identities"))
    return out


def missing_functions(spark: SparkSession, names: tuple[str, ...]) -> DataFrame:
    """(name): functions of a list that the session's catalogue lacks."""
    there = spark.sql("show functions").select(F.col("function").alias("name"))
    return spark.createDataFrame([(n,) for n in names], "name string").join(there, "name", "left_anti")


def head_counts(**tables: DataFrame) -> DataFrame:
    parts = [df.agg(F.count("*").alias("count")).select(F.lit(name).alias("metric"), "count") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
