"""Edits of many contacts at once, merges and splits, as previews and as changed frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import normalize as N


class CohortError(ValueError):
    """A bulk edit without a cohort, or with two."""


def cohort(contacts: DataFrame, where: Column | None = None, everyone: bool = False) -> DataFrame:
    """Distinct ids of the contacts an edit applies to; exactly one of a filter and `everyone` must be given."""
    if (where is None) == (not everyone):
        raise CohortError("give a filter, or everyone, not both")
    return (contacts if everyone else contacts.filter(where)).select("id").distinct()


def add_tag(contacts: DataFrame, ids: DataFrame, tag: str) -> DataFrame:
    """(id, tags): contacts of the cohort that did not have the tag, tags sorted."""
    return contacts.join(ids, "id", "left_semi").filter(~F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), tag)).select("id", F.array_sort(F.array_append(F.coalesce("tags", F.array().cast("array<string>")), tag)).alias("tags"))


def set_preview(contacts: DataFrame, ids: DataFrame, column: str, value: str) -> DataFrame:
    """(id, old, new, changes) of setting a column on a cohort."""
    return contacts.join(ids, "id", "left_semi").select("id", F.col(column).alias("old"), F.lit(value).alias("new"), (~F.col(column).eqNullSafe(F.lit(value))).alias("changes"))


def promotable(contacts: DataFrame, tiers: tuple[str, ...] = ("t1_irl_messaging", "t2_dm")) -> DataFrame:
    """Contacts on file that were met closely enough to count as network."""
    return contacts.filter((F.col("connection_status") == "contact_on_file") & F.col("closeness_tier").isin(*tiers)).select("id", "full_name", "closeness_tier")


def merge_pairs(contacts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The kept record of each (keep_id, drop_id): gaps filled, arrays united, notes appended, the closer tier and the stronger
    status kept."""
    fill = ("current_position", "current_company", "location", "origin_context")
    cols = ("full_name", *fill, "tags", "affiliations", "notes", "closeness_tier", "connection_status")
    keep = contacts.select(F.col("id").alias("keep_id"), *[F.col(c).alias("k_" + c) for c in cols])
    drop = contacts.select(F.col("id").alias("drop_id"), *[F.col(c).alias("d_" + c) for c in cols])
    empty = F.array().cast("array<string>")
    joined = pairs.join(keep, "keep_id").join(drop, "drop_id").filter("keep_id <> drop_id")
    return joined.select(
        "keep_id", "drop_id",
        *[F.coalesce(F.expr(f"nullif(k_{c}, '')"), F.expr(f"nullif(d_{c}, '')"), F.col("k_" + c)).alias(c) for c in fill],
        *[F.array_join(F.array_sort(F.array_union(F.coalesce("k_" + c, empty), F.coalesce("d_" + c, empty))), "|").alias(c) for c in ("tags", "affiliations")],
        F.when(F.coalesce("d_notes", F.lit("")) == "", F.col("k_notes")).otherwise(F.concat(F.coalesce("k_notes", F.lit("")), F.when(F.coalesce("k_notes", F.lit("")) == "", "").otherwise("\n"), F.lit("[merged from "), F.coalesce("d_full_name", F.lit("")), F.lit("] "), F.col("d_notes"))).alias("notes"),
        F.when(F.expr(N.rank_of("d_closeness_tier") + " > " + N.rank_of("k_closeness_tier")), F.col("d_closeness_tier")).otherwise(F.col("k_closeness_tier")).alias("closeness_tier"),
        F.when(F.col("d_connection_status") == "in_network", "in_network").otherwise(F.col("k_connection_status")).alias("connection_status"),
    )


def rekey(child: DataFrame, pairs: DataFrame, column: str = "contact_id") -> DataFrame:
    """A child table whose rows of dropped contacts point to the kept ones."""
    to = pairs.select(F.col("drop_id").alias(column), "keep_id")
    return child.join(to, column, "left").withColumn(column, F.coalesce("keep_id", column)).select(*child.columns)


def delete_cascade(child: DataFrame, dropped: DataFrame, column: str = "contact_id") -> DataFrame:
    """A child table without the rows of deleted contacts (dropped: id)."""
    return child.join(dropped.select(F.col("id").alias(column)), column, "left_anti").select(*child.columns)


def clear_references(child: DataFrame, dropped: DataFrame, column: str) -> DataFrame:
    """A child table whose references to deleted contacts are null."""
    gone = dropped.select(F.col("id").alias(column)).distinct().withColumn("_gone", F.lit(True))
    return child.join(gone, column, "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*child.columns)


def split_identities(identities: DataFrame, names: DataFrame, which: DataFrame) -> DataFrame:
    """(identity_id, old_contact_id, new_contact_id, full_name): each named identity on a contact of its own; the id follows from the
    identity, the name from its record. names: (source, source_external_id, full_name)."""
    named = names.filter("source_external_id is not null").groupBy("source", "source_external_id").agg(F.min("full_name").alias("full_name"))
    return identities.join(which.select(F.col("identity_id").alias("id")), "id", "left_semi").join(named, ["source", "source_external_id"], "left").select(F.col("id").alias("identity_id"), F.col("contact_id").alias("old_contact_id"), F.sha2(F.concat(F.lit("split|"), F.col("id")), 256).alias("new_contact_id"), F.coalesce("full_name", F.lit("UNKNOWN")).alias("full_name"))
