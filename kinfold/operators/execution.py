"""Carrying out a resolution plan: new contacts, identities, log rows and outcomes of the staged rows, as frames to append or merge.

A plan has one row per staged row: (id, cluster_id, match_status, ref, score, method), ref being an existing contact or the key of one
the plan creates. Ids of new contacts follow from that key, so that a repeated run makes the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators import matching
from kinfold.operators.skew import lookup_join

KEY_FIELDS = ("email", "phone", "linkedin_url", "handle")
CONTACT_FIELDS = {"full_name": "full_name", **matching.FILL}


def pending(staging: DataFrame) -> DataFrame:
    """Staged rows that wait for a resolution run."""
    return staging.filter("match_status = 'pending'")


def new_id(key: Column) -> Column:
    return F.sha2(F.concat(F.lit("contact|"), key), 256)


def created(plan: DataFrame, staging: DataFrame) -> DataFrame:
    """(create_key, contact_id, golden columns ..) of the contacts a plan creates, one per key."""
    born = plan.filter("match_status = 'merged'").select("id", F.col("ref").alias("create_key"))
    return born.join(staging, "id").select("create_key", new_id(F.col("create_key")).alias("contact_id"), *[F.col(s).alias(g) for g, s in CONTACT_FIELDS.items()])


def resolved(plan: DataFrame) -> DataFrame:
    """The plan with `contact_id`: keys of created contacts replaced by their ids."""
    born = plan.filter("match_status = 'merged'").select("ref", new_id(F.col("ref")).alias("_new")).distinct()
    return plan.join(born, "ref", "left").withColumn("contact_id", F.coalesce("_new", "ref")).drop("_new")


def attachments(plan: DataFrame, staging: DataFrame, identities: DataFrame) -> DataFrame:
    """(id, contact_id, match_status, outcome, fresh) of the rows that are created or matched. A record belongs to the contact that
    holds it already, else to the one created from it, else to the first matched row by import: a matched row whose record belongs to
    another contact is a `rerun_conflict`, all others are `attached`; fresh tells whether the row writes an identity."""
    rows = resolved(plan).filter("match_status in ('merged', 'auto_matched')").join(staging.select("id", "source", "source_external_id", "imported_at"), "id")
    record = ["source", "source_external_id"]
    held = identities.filter("source_external_id is not null").groupBy(*record).agg(F.min("contact_id").alias("holder"))
    rows = lookup_join(rows, held, record)
    order = F.struct((F.col("match_status") != "merged").alias("later"), F.col("imported_at"), F.col("id"))
    first = rows.filter("holder is null and source_external_id is not null").groupBy(*record).agg(F.min_by(F.struct("id", "contact_id"), order).alias("first"))
    rows = lookup_join(rows, first, record)
    owner = F.coalesce("holder", F.col("first.contact_id"), F.col("contact_id"))
    outcome = F.when((F.col("match_status") == "merged") | (owner == F.col("contact_id")), "attached").otherwise("rerun_conflict")
    fresh = F.when(F.col("source_external_id").isNull(), F.col("match_status") == "merged").otherwise(F.coalesce(F.col("first.id") == F.col("id"), F.lit(False)))
    return rows.select("id", "contact_id", "match_status", outcome.alias("outcome"), fresh.alias("fresh"))


def new_identities(plan: DataFrame, staging: DataFrame, identities: DataFrame) -> DataFrame:
    """(contact_id, source, source_external_id, keys ..): the identities a plan adds."""
    fresh = attachments(plan, staging, identities).filter("outcome = 'attached' and fresh").select("id", "contact_id")
    return fresh.join(staging.select("id", "source", "source_external_id", *KEY_FIELDS), "id").drop("id")


def patches(plan: DataFrame, staging: DataFrame, identities: DataFrame) -> DataFrame:
    """(id, match_status, matched_contact_id, match_confidence, match_method, resolved) of every planned row."""
    at = attachments(plan, staging, identities).select("id", "outcome")
    rows = resolved(plan).join(at, "id", "left")
    clash = F.coalesce(F.col("outcome") == "rerun_conflict", F.lit(False)) & (F.col("match_status") == "auto_matched")
    status = F.when(clash, "needs_review").otherwise(F.col("match_status"))
    return rows.select(
        "id", status.alias("match_status"), F.when(F.col("match_status") != "rejected", F.col("contact_id")).alias("matched_contact_id"), F.when(~clash & F.col("match_status").isin("auto_matched", "needs_review"), F.col("score")).alias("match_confidence"),
        F.when(clash, "rerun_conflict").when(F.col("match_status") == "rejected", "no_name").when(F.col("match_status") == "merged", "new_contact").otherwise(F.col("method")).alias("match_method"), (~clash & (F.col("match_status") != "needs_review")).alias("resolved"),
    )


def log_rows(plan: DataFrame, staging: DataFrame, contacts: DataFrame, identities: DataFrame, elected: DataFrame) -> DataFrame:
    """(contact_id, field, old_value, new_value, source, detail, is_current): the births of created contacts, the fills and conflicts
    of the rows that attach to them or to existing ones, in order of import, and names that differ from the contact's."""
    born = created(plan, staging)
    births = plan.filter("match_status = 'merged'").select("id", F.col("ref").alias("create_key")).join(staging, "id")
    births = births.select(new_id(F.col("create_key")).alias("contact_id"), "source", "source_external_id", F.explode(F.create_map(*[x for g, s in CONTACT_FIELDS.items() for x in (F.lit(g), F.col(s))])).alias("field", "new_value")).filter("new_value is not null and new_value <> ''")
    births = births.select("contact_id", "field", F.lit(None).cast("string").alias("old_value"), "new_value", "source", pointer("source", "source_external_id").alias("detail"), F.lit(True).alias("is_current"))
    now = contacts.select("id", *matching.FILL).unionByName(born.select(F.col("contact_id").alias("id"), *matching.FILL))
    matched = attachments(plan, staging, identities).filter("outcome = 'attached' and match_status = 'auto_matched'").select("id", "contact_id")
    folded = matching.fold(matched.join(staging, "id").withColumn("seq", F.unix_micros("imported_at")), now, elected, keep_old=True)
    rows = folded.join(staging.select("id", "source", "source_external_id"), "id")
    changes = rows.select("contact_id", "field", F.col("stands").alias("old_value"), F.col("value").alias("new_value"), "source", pointer("source", "source_external_id").alias("detail"), (F.col("kind") == "fill").alias("is_current"))
    names = contacts.select(F.col("id").alias("contact_id"), F.col("full_name").alias("old_value")).unionByName(born.select("contact_id", F.col("full_name").alias("old_value")))
    spelled = matched.join(staging.filter("full_name <> ''"), "id").join(names, "contact_id").filter("not (full_name <=> old_value)")
    spelled = spelled.select("contact_id", F.lit("full_name").alias("field"), "old_value", F.col("full_name").alias("new_value"), "source", pointer("source", "source_external_id").alias("detail"), F.lit(False).alias("is_current"))
    return births.unionByName(changes).unionByName(spelled)


def pointer(source: str, record: str) -> Column:
    """Where a staged value came from, as text."""
    return F.concat(F.lit("staging "), F.coalesce(F.col(source), F.lit("")), F.lit("/"), F.coalesce(F.col(record), F.lit("")))
