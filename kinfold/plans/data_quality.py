"""Queries p1 to p3 over whole tables, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import keys as K
from kinfold.operators import orphans, records, timestamps
from kinfold.session import table


def _contact_key(expr: str, dialect: str = "spark") -> str:
    return f"(case when {K.is_blank(expr, dialect)} then null else lower({K.trimmed(expr, dialect)}) end)"


def _references(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, DataFrame]]:
    """(references, first arrivals of their targets) of each referring field."""
    contacts = table(spark, sf_dir, "contacts")
    live = contacts.select(F.lower(F.expr(K.trimmed("id"))).alias("owner")).distinct()
    identities = table(spark, sf_dir, "contact_identities").withColumn("owner", F.lower(F.expr(K.trimmed("contact_id")))).join(live, "owner", "left_semi")
    interactions, staged = table(spark, sf_dir, "interactions"), table(spark, sf_dir, "staging_interactions")
    return [
        (orphans.references(interactions, "interactions", "contact_id", _contact_key("contact_id"), "id", "created_at"), orphans.first_arrivals(contacts, _contact_key("id"), "created_at")),
        (orphans.references(staged, "staging_interactions", "email", K.email_key("email"), "id", "imported_at"), orphans.first_arrivals(identities, K.email_key("email"), "imported_at")),
        (orphans.references(staged, "staging_interactions", "handle", K.handle_key("handle"), "id", "imported_at"), orphans.first_arrivals(identities, K.handle_key("handle"), "imported_at")),
    ]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference without a target that was there in time, one row a reference."""
    parts = [orphans.orphan_rows(r, t).select("table_name", "ref_field", "row_id") for r, t in _references(spark, sf_dir)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans and distinct orphan keys per table, field and month."""
    parts = [orphans.orphan_report(r, t) for r, t in _references(spark, sf_dir)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The UTC time of every readable moment."""
    df = timestamps.normalise(table(spark, sf_dir, "staging_interactions"), table(spark, sf_dir, "feed_sources"), "id", "source", "occurred_at")
    return df.filter("occurred_utc is not null").select("row_id", "occurred_utc")


def p2_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source's values were read: notation, and read, ambiguous or unreadable."""
    return timestamps.status_report(table(spark, sf_dir, "staging_interactions"), table(spark, sf_dir, "feed_sources"), "source", "occurred_at")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.judge_records(table(spark, sf_dir, "staging"), table(spark, sf_dir, "feed_sources"), "id", "source", "raw_json")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered records that cannot be loaded, with the first reason that holds."""
    return _judged(spark, sf_dir).filter("reason is not null").select("row_id", "reason")


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose record loads, and those broken as JSON that are sound delimited records."""
    return _judged(spark, sf_dir).filter("reason is null or loads_as is not null").select("row_id", "source", F.coalesce("loads_as", F.lit("json")).alias("dialect"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_status, p3_found, p3_loaded)}


def _sql_orphans() -> str:
    d = "duckdb"
    owner = f"lower({K.trimmed('contact_id', d)})"
    live = f"{owner} in (select lower({K.trimmed('id', d)}) from contacts)"
    parts = [("interactions", "contact_id", _contact_key("contact_id", d), "created_at", f"select {_contact_key('id', d)} as key, min(created_at) as first_at from contacts group by 1")]
    for field, build in (("email", K.email_key), ("handle", K.handle_key)):
        parts.append(("staging_interactions", field, build(field, d), "imported_at", f"select {build(field, d)} as key, min(imported_at) as first_at from contact_identities where {live} group by 1"))
    return " union all ".join(
        f"select '{t}' as table_name, '{f}' as ref_field, r.id as row_id, r.key, r.moment from (select id, {k} as key, {at} as moment from {t}) r left join ({first}) t on t.key = r.key where r.key is not null and not coalesce(t.first_at <= r.moment, false)"
        for t, f, k, at, first in parts
    )


ORACLE = {
    "p1_found": f"select table_name, ref_field, row_id from ({_sql_orphans()})",
    "p1_report": f"select table_name, ref_field, strftime(moment at time zone 'UTC', '%Y-%m') as period, count(*)::bigint as orphans, count(distinct key)::bigint as orphan_keys from ({_sql_orphans()}) group by all",
}
