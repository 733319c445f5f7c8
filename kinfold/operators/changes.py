"""Changes of the fact log and of the golden records it decides: each a pure function from snapshots to snapshots.

A pair is a contact and a field. Applying, rejecting, undoing and approving append or mark log rows and settle the pairs they touch:
the winner is elected anew, flagged, and written to the golden column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators import survivorship
from kinfold.operators.survivorship import PAIR


def settle(log: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log with the winner of each touched pair flagged and no other row of it, (contact_id, field, winner_id, value) of every touched
    pair; both null where nothing survives). pairs: (contact_id, field)."""
    touched = pairs.select(*PAIR).distinct()
    won = touched.join(survivorship.elect(log.join(touched, PAIR, "left_semi")), PAIR, "left")
    marked = log.join(won.select(*PAIR, "winner_id", F.lit(True).alias("_t")), PAIR, "left")
    flagged = F.when(F.col("_t"), F.coalesce(F.col("id") == F.col("winner_id"), F.lit(False))).otherwise(F.col("is_current"))
    return marked.withColumn("is_current", flagged).select(*log.columns), won


def materialise(contacts: DataFrame, won: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Contacts with the golden columns of touched pairs set to the winner's value, cast to the column's type; null where a pair has no
    winner or the value does not cast. columns: field -> column of contacts; other fields have no golden column."""
    known = won.filter(F.col("field").isin(*columns))
    by = known.groupBy(F.col("contact_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_v"))
    joined = contacts.join(by, "id", "left")
    types = dict(contacts.dtypes)
    new = {c: F.when(F.coalesce(F.map_contains_key("_v", f), F.lit(False)), F.col("_v")[f].try_cast(types[c])).otherwise(F.col(c)) for f, c in columns.items()}
    return joined.withColumns(new).select(*contacts.columns)


def _extended(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with further rows; columns they lack are null."""
    return log.unionByName(rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in log.dtypes]))


def apply_candidates(log: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(outcomes, new log, won pairs, review items) of a batch of candidates in order of seq = (created_at, id).

    Golden and review candidates are logged with the value that stood before them; a pair is settled as of its last golden candidate, so
    that later review candidates wait for their review. candidates: as for survivorship.arbitrate, with created_at.
    """
    judged = candidates.join(survivorship.arbitrate(candidates, log), "id")
    kept = judged.filter(F.col("outcome").isin("golden", "review"))
    stood = log.filter("is_current").groupBy(*PAIR).agg(F.max_by("new_value", F.struct("created_at", "id")).alias("stood"), F.max(F.col("method") == "manual_set").alias("by_hand"))
    before = Window.partitionBy(*PAIR).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    golden, manual = F.col("outcome") == "golden", F.col("method") == "manual_set"
    every = Window.partitionBy(*PAIR)
    last_hand = F.last(F.when(golden & manual, F.struct("value")), ignorenulls=True).over(before)
    last_any = F.last(F.when(golden, F.struct("value")), ignorenulls=True).over(before)
    rows = kept.join(stood, PAIR, "left").withColumns({"_hand": last_hand, "_any": last_any, "_until": F.max(F.when(golden, F.col("seq"))).over(every)})
    old = F.when(F.col("_hand").isNotNull(), F.col("_hand.value")).when(F.coalesce("by_hand", F.lit(False)), F.col("stood")).when(F.col("_any").isNotNull(), F.col("_any.value")).otherwise(F.col("stood"))
    logged = rows.select("id", *PAIR, old.alias("old_value"), F.col("value").alias("new_value"), "source", "confidence", "method", "created_at", F.lit(False).alias("is_current"), (F.col("seq") > F.col("_until")).alias("_waits"), "outcome", F.coalesce("by_hand", F.lit(False)).alias("_by_hand"), F.col("_hand").isNotNull().alias("_after_hand"))
    now, waiting = _extended(log, logged.filter("not coalesce(_waits, true)")), logged.filter("coalesce(_waits, true)")
    settled, won = settle(now, logged.filter("outcome = 'golden'"))
    reviews = logged.filter("outcome = 'review'").select("id", *PAIR, F.col("new_value").alias("candidate_value"), "source", "confidence", F.when(F.col("_by_hand") | F.col("_after_hand"), "value_conflict").otherwise("low_confidence").alias("reason"), F.lit("open").alias("status"))
    return judged.select("id", "outcome"), _extended(settled, waiting), won, reviews


def approve(log: DataFrame, items: DataFrame, agent: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(new log, won pairs): review items (id, contact_id, field, candidate_value) become values set by hand, the last of a pair wins."""
    rows = items.select(F.sha2(F.concat(F.lit("approve|"), "id"), 256).alias("id"), *PAIR, F.col("candidate_value").alias("new_value"), F.lit(agent).alias("source"), F.lit(1.0).alias("confidence"), F.lit("manual_set").alias("method"), at.alias("created_at"), F.lit(False).alias("is_current"))
    return settle(_extended(log, rows), items)


def reject(log: DataFrame, items: DataFrame, agent: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(new log, won pairs): the candidate value of each item is disputed for its pair and cannot win again."""
    rows = items.select(F.sha2(F.concat(F.lit("reject|"), "id"), 256).alias("id"), *PAIR, F.col("candidate_value").alias("new_value"), F.lit(agent).alias("source"), F.lit("enrich_reject").alias("method"), F.lit("disputed").alias("verification_status"), at.alias("created_at"), F.lit(False).alias("is_current"))
    return settle(_extended(log, rows), items)


def close_items(reviews: DataFrame, decided: DataFrame) -> DataFrame:
    """Review items with their decisions (id, decision): approved and rejected ones are resolved, skipped ones skipped, the rest open."""
    status = F.when(F.col("decision").isin("approve", "reject"), "resolved").when(F.col("decision") == "skip", "skipped").otherwise(F.col("status"))
    return reviews.join(decided, "id", "left").withColumn("status", status).select(*reviews.columns)


def undo(log: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new log, won pairs): the current row of each pair is disputed and the best of the others elected. Pairs without a current row
    are left alone."""
    hit = log.join(pairs.select(*PAIR).distinct(), PAIR, "left_semi").filter("is_current").select("id").withColumn("_hit", F.lit(True))
    marked = log.join(hit, "id", "left").withColumns({"verification_status": F.when(F.col("_hit"), "disputed").otherwise(F.col("verification_status")), "is_current": F.when(F.col("_hit"), F.lit(False)).otherwise(F.col("is_current"))})
    touched = log.join(hit, "id", "left_semi")
    return settle(marked.select(*log.columns), touched)


def forget(log: DataFrame, contacts: DataFrame, at: Column) -> DataFrame:
    """The log with the values of the contacts (id) wiped and the rows kept for audit."""
    gone = contacts.select(F.col("id").alias("contact_id")).distinct().withColumn("_gone", F.lit(True))
    wiped = {c: F.when(F.col("_gone").isNull(), F.col(c)) for c in ("old_value", "new_value")}
    return log.join(gone, "contact_id", "left").withColumns({**wiped, "redacted_at": F.when(F.col("_gone"), at).otherwise(F.col("redacted_at"))}).select(*log.columns)


def promote(identities: DataFrame, candidates: DataFrame) -> DataFrame:
    """New identities (contact_id, source, source_external_id, kind, value) of quarantined identifiers; one that exists or repeats is
    made once. candidates: (id, contact_id, kind, value, source)."""
    named = candidates.filter("value is not null").select("id", "contact_id", F.concat(F.lit("enrich:"), "source").alias("source"), F.sha2("value", 256).alias("source_external_id"), "kind", "value")
    first = named.groupBy("source", "source_external_id").agg(F.min_by(F.struct("contact_id", "kind", "value"), "id").alias("f"))
    fresh = first.join(identities.filter("source_external_id is not null").select("source", "source_external_id"), ["source", "source_external_id"], "left_anti")
    return fresh.select("f.contact_id", "source", "source_external_id", "f.kind", "f.value")
