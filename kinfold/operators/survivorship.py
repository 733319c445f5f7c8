"""Competing facts in an append-only log: election of the current value, arbitration of batches, array facts and due dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import normalize as N
from kinfold.operators.skew import lookup_join

ACCEPT = 0.7
UNKNOWN_CONFIDENCE = 0.4
ARRAY_FIELDS = ("tags", "affiliations", "expertise", "interests")
PAIR = ["contact_id", "field"]


def live_rows(log: DataFrame) -> DataFrame:
    """Log rows that may win: not disputed, and their value not disputed for the same contact and field (null equals null)."""
    dead = log.filter("verification_status = 'disputed'").select(*PAIR, F.col("new_value").alias("d_value")).distinct()
    rows = log.filter("not (verification_status <=> 'disputed')")
    same = [rows[k] == dead[k] for k in PAIR] + [rows["new_value"].eqNullSafe(dead["d_value"])]
    return rows.join(dead, same, "left_anti")


def elect(log: DataFrame) -> DataFrame:
    """(contact_id, field, winner_id, value): manual rows first, then the newest, then the most confident; ties to the larger id.

    The winner is the largest of one ordered struct, so a pair of any size combines map-side; pairs without a live row are left out."""
    order = F.struct((F.col("method") == "manual_set").alias("m"), "created_at", F.coalesce("confidence", F.lit(UNKNOWN_CONFIDENCE)).alias("c"), "id")
    return live_rows(log).groupBy(*PAIR).agg(F.max_by(F.struct("id", "new_value"), order).alias("w")).select(*PAIR, F.col("w.id").alias("winner_id"), F.col("w.new_value").alias("value"))


def arbitrate(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """(id, outcome) of a batch of candidates, each judged as if those before it had been applied.

    candidates: (id, contact_id, field, value, source, method, confidence, seq). Outcomes: noop for array fields and for a value and
    source the log or an earlier candidate already has; losing for a disputed value unless set by hand; golden for values set by hand
    and for confident ones; review where a value set by hand is current or confidence is low.
    """
    disputed = log.filter("verification_status = 'disputed'").select(*PAIR, F.coalesce("new_value", F.lit("\u0000")).alias("v")).distinct().withColumn("disputed", F.lit(True))
    known = log.select(*PAIR, F.coalesce("new_value", F.lit("\u0000")).alias("v"), "source").filter("source is not null").distinct().withColumn("known", F.lit(True))
    manual = log.filter("is_current and method = 'manual_set'").select(*PAIR).distinct().withColumn("manual_before", F.lit(True))
    c = candidates.withColumn("v", F.coalesce("value", F.lit("\u0000"))).join(disputed, [*PAIR, "v"], "left").join(known, [*PAIR, "v", "source"], "left").join(manual, PAIR, "left")
    by_hand = F.col("method") == "manual_set"
    lost = F.coalesce("disputed", F.lit(False)) & ~by_hand
    seen = F.row_number().over(Window.partitionBy(*PAIR, "v", "source", lost).orderBy("seq")) > 1
    repeat = F.coalesce("known", F.lit(False)) | (seen & F.col("source").isNotNull())
    c = c.withColumns({"by_hand": by_hand, "lost": lost, "repeat": repeat})
    before = Window.partitionBy(*PAIR).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    manual_now = F.coalesce("manual_before", F.lit(False)) | F.coalesce(F.max(F.col("by_hand") & ~F.col("repeat") & ~F.coalesce("disputed", F.lit(False))).over(before), F.lit(False))
    outcome = (
        F.when(F.col("field").isin(*ARRAY_FIELDS), "noop").when(F.col("lost"), "losing").when(F.col("repeat"), "noop").when(F.col("by_hand"), "golden").when(manual_now, "review")
        .when(F.coalesce("confidence", F.lit(0.0)) >= ACCEPT, "golden").otherwise("review")
    )
    return c.select("id", outcome.alias("outcome"))


def apply_array(candidates: DataFrame, contacts: DataFrame, log: DataFrame, field: str) -> DataFrame:
    """(contact_id, value, outcome) of adding values to an array field: noop for blank, tombstoned, already or added; the first of
    repeated candidates is added, the others find it there."""
    dead = log.filter((F.col("field") == field) & (F.col("verification_status") == "disputed")).select("contact_id", F.col("new_value").alias("value")).distinct().withColumn("dead", F.lit(True))
    have = contacts.select(F.col("id").alias("contact_id"), F.coalesce(F.col(field), F.array().cast("array<string>")).alias("have"))
    c = candidates.join(dead, ["contact_id", "value"], "left").join(have, "contact_id")
    k = F.row_number().over(Window.partitionBy("contact_id", "value").orderBy("id"))
    outcome = F.when(F.col("value").isNull() | (F.trim("value") == ""), "noop").when(F.col("dead"), "tombstoned").when(F.array_contains("have", F.col("value")) | (k > 1), "already").otherwise("added")
    return c.select("id", "contact_id", "value", outcome.alias("outcome"))


def reject_array(contacts: DataFrame, rejected: DataFrame, field: str) -> DataFrame:
    """(id, values): the array without the rejected values."""
    gone = rejected.groupBy(F.col("contact_id").alias("id")).agg(F.collect_set("value").alias("gone"))
    return contacts.join(gone, "id", "left").select("id", F.array_except(F.coalesce(F.col(field), F.array().cast("array<string>")), F.coalesce("gone", F.array().cast("array<string>"))).alias("values"))


def seed(contacts: DataFrame, log: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(contact_id, field, new_value, source, confidence, method): a first log row for each golden value that no current row explains.
    columns: field -> column of contacts."""
    long = contacts.select(F.col("id").alias("contact_id"), F.explode(F.create_map(*[x for f, c in columns.items() for x in (F.lit(f), F.col(c))])).alias("field", "new_value")).filter("new_value is not null")
    state = log.groupBy(*PAIR).agg(F.max(F.coalesce("is_current", F.lit(False))).alias("current"), F.max(F.col("method") == "manual_set").alias("manual"))
    left = long.join(state, PAIR, "left").filter("not coalesce(current, false)")
    manual = F.coalesce("manual", F.lit(False))
    return left.select(*PAIR, "new_value", F.when(manual, "owner").otherwise("legacy").alias("source"), F.when(manual, 1.0).otherwise(0.8).alias("confidence"), F.when(manual, "manual_set").otherwise("legacy_import").alias("method"))


def route_identifiers(candidates: DataFrame, identities: DataFrame, kind: str, key_sql: str) -> DataFrame:
    """(id, outcome) of found identifiers: noop without a key or when the contact alone holds it, quarantine when nobody does, review
    otherwise. candidates: (id, contact_id, value)."""
    held = identities.select("contact_id", F.expr(key_sql.replace("value", kind)).alias("key")).filter("key is not null").groupBy("key").agg(F.countDistinct("contact_id").alias("n"), F.min("contact_id").alias("owner"))
    keyed = candidates.withColumn("key", F.expr(key_sql))
    outcome = F.when(F.col("key").isNull(), "noop").when(F.col("n").isNull(), "quarantine").when((F.col("n") == 1) & (F.col("owner") == F.col("contact_id")), "noop").otherwise("review")
    return lookup_join(keyed, held, "key").select("id", outcome.alias("outcome"))


def due_dates(log: DataFrame) -> DataFrame:
    """(id, due): when a log row's value falls due, counted from the day it was written."""
    return log.select("id", F.expr(N.refresh_after("field", "method", "cast(created_at as date)")).alias("due"))
