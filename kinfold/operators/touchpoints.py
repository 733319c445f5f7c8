"""Linking dated touchpoints to people and deriving recency and closeness from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import keys as K
from kinfold.functions import normalize as N
from kinfold.operators.skew import lookup_join

#: Keys in order of priority; shared mailboxes count here.
MATCH_KEYS = ("email", "phone", "handle", "linkedin_url")


def key_owners(identities: DataFrame, kinds: tuple[str, ...] = MATCH_KEYS) -> DataFrame:
    """(key, owner): the contact whose identity carried a key first; keys are canonical and marked with their kind."""
    keyed = identities.select("contact_id", "imported_at", "id", F.explode(F.array(*[F.concat(F.lit(k + ":"), F.expr(K.KEY_BUILDERS[k](k))) for k in kinds])).alias("key")).filter("key is not null")
    return keyed.groupBy("key").agg(F.min_by("contact_id", F.struct("imported_at", "id")).alias("owner"))


def link(staged: DataFrame, identities: DataFrame) -> DataFrame:
    """(id, contact_id) of every staged touchpoint: the owner of its first key, by priority, that has one; null for orphans."""
    owners = key_owners(identities)
    long = staged.select("id", F.posexplode(F.array(*[F.concat(F.lit(k + ":"), F.expr(K.KEY_BUILDERS[k](k))) for k in MATCH_KEYS])).alias("rank", "key")).filter("key is not null")
    found = lookup_join(long, owners, "key").filter("owner is not null").groupBy("id").agg(F.min_by("owner", "rank").alias("contact_id"))
    return staged.select("id").join(found, "id", "left")


def outcomes(staged: DataFrame, linked: DataFrame) -> DataFrame:
    """(source, outcome, rows) of a linking run."""
    judged = staged.select("id", "source").join(linked, "id", "left").withColumn("outcome", F.when(F.col("contact_id").isNull(), "orphaned").otherwise("linked"))
    return judged.groupBy("source", "outcome").agg(F.count("*").alias("rows"))


def occasions_of(staged: DataFrame) -> DataFrame:
    """(name, day, location): one occasion per name and day; the location of the row imported first."""
    named = staged.filter("event_name is not null")
    return named.groupBy(F.col("event_name").alias("name"), F.to_date(F.col("imported_at")).alias("day")).agg(F.min_by("event_location", F.struct("imported_at", "id")).alias("location"))


def latest_touch(interactions: DataFrame) -> DataFrame:
    """(contact_id, occurred_at, channel, summary) of the latest dated touchpoint; ties by creation, then id."""
    dated = interactions.filter("occurred_at is not null and contact_id is not null")
    return dated.groupBy("contact_id").agg(F.max_by(F.struct("occurred_at", "channel", "summary"), F.struct("occurred_at", "created_at", "id")).alias("t")).select("contact_id", "t.occurred_at", "t.channel", "t.summary")


def best_tier(interactions: DataFrame) -> DataFrame:
    """(contact_id, rank) of the closest channel a contact was met on."""
    return interactions.filter("contact_id is not null").groupBy("contact_id").agg(F.max(F.expr(N.rank_of(N.tier_of("channel")))).alias("rank"))


def recompute(contacts: DataFrame, interactions: DataFrame) -> DataFrame:
    """Contacts with the last touchpoint and tier their interactions give: contacts without interactions lose theirs, those with only
    undated ones keep what they had, and a tier never falls."""
    last = latest_touch(interactions).select(F.col("contact_id").alias("id"), F.col("occurred_at").alias("l_at"), F.col("channel").alias("l_channel"), F.col("summary").alias("l_topic"))
    tier = best_tier(interactions).withColumnRenamed("contact_id", "id")
    joined = contacts.join(last, "id", "left").join(tier, "id", "left")
    any_, dated = F.col("rank").isNotNull(), F.col("l_at").isNotNull()
    tiers = F.expr("case " + " ".join(f"when rank = {r} then '{t}'" for t, r in N.TIER_RANK.items()) + " end")
    out = joined.withColumns(
        {
            "last_touchpoint_at": F.when(dated, F.col("l_at")).when(any_, F.col("last_touchpoint_at")),
            "last_touchpoint_channel": F.when(dated, F.col("l_channel")).when(any_, F.col("last_touchpoint_channel")),
            "last_touchpoint_topic": F.when(dated, F.col("l_topic")).when(any_, F.col("last_touchpoint_topic")),
            "closeness_tier": F.when(F.col("rank") > F.expr(N.rank_of("closeness_tier")), tiers).otherwise(F.col("closeness_tier")),
        }
    )
    return out.select(*contacts.columns)


def upsert_interactions(existing: DataFrame, payload: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the merged table, contacts that lost a row). A payload row with the (source, source_external_id) of an existing row refreshes
    its date, summary, event and contact and nothing else; the last of repeated payload rows counts."""
    key = ["source", "source_external_id"]
    newest = Window.partitionBy(*key).orderBy(F.desc("created_at"), F.desc("id"))
    fresh = payload.withColumn("k", F.row_number().over(newest)).filter("k = 1 or source_external_id is null").drop("k")
    refresh = fresh.filter("source_external_id is not null").select(*key, F.lit(True).alias("hit"), *[F.col(c).alias("n_" + c) for c in ("contact_id", "event_id", "occurred_at", "summary", "updated_at")])
    joined = existing.join(refresh, key, "left")
    kept = joined.select(*[F.when(F.col("hit"), F.col("n_" + c)).otherwise(F.col(c)).alias(c) if c in ("contact_id", "event_id", "occurred_at", "summary", "updated_at") else F.col(c) for c in existing.columns])
    added = fresh.join(existing.filter("source_external_id is not null").select(*key), key, "left_anti").select(*existing.columns)
    moved = joined.filter("hit and not (contact_id <=> n_contact_id)").select(F.col("contact_id")).filter("contact_id is not null").distinct()
    return kept.unionByName(added), moved


def bump(contacts: DataFrame, touched: DataFrame) -> DataFrame:
    """(id, last_touchpoint_at, channel, bumped): a later touchpoint moves the date, an equal or earlier one does not."""
    new = touched.select(F.col("contact_id").alias("id"), F.col("occurred_at").alias("n_at"), F.col("channel").alias("n_channel"))
    later = F.col("n_at").isNotNull() & (F.col("last_touchpoint_at").isNull() | (F.col("last_touchpoint_at") < F.col("n_at")))
    return contacts.join(new, "id", "left").select("id", F.when(later, F.col("n_at")).otherwise(F.col("last_touchpoint_at")).alias("last_touchpoint_at"), F.when(later, F.col("n_channel")).otherwise(F.col("last_touchpoint_channel")).alias("channel"), F.coalesce(later, F.lit(False)).alias("bumped"))


def message_rollup(messages: DataFrame, handle: str, day: str) -> DataFrame:
    """(handle, messages, last_day): counts per handle."""
    return messages.filter(F.col(handle).isNotNull()).groupBy(F.col(handle).alias("handle")).agg(F.count("*").alias("messages"), F.max(day).alias("last_day"))


def backfill(staged: DataFrame, identities: DataFrame, interactions: DataFrame, contacts: DataFrame) -> dict[str, DataFrame]:
    """One run over all staged touchpoints that are pending or were left orphaned: `staged` (id, match_status, matched_contact_id),
    `interactions` with the linked ones merged in, `touched` (contact_id) that gained or lost one, and `contacts` with the recency and
    tier of the touched ones recomputed. A repeated run changes nothing."""
    waiting = staged.filter("match_status in ('pending', 'orphaned')")
    linked = link(waiting, identities)
    outcome = linked.select("id", F.when(F.col("contact_id").isNull(), "orphaned").otherwise("linked").alias("match_status"), F.col("contact_id").alias("matched_contact_id"))
    rows = waiting.join(linked.filter("contact_id is not null"), "id")
    payload = rows.select("id", "contact_id", F.lit(None).cast("string").alias("event_id"), "kind", "channel", F.expr("try_cast(occurred_at as date)").alias("occurred_at"), "summary", F.lit("importer").alias("logged_by"), F.col("imported_at").alias("created_at"), F.col("imported_at").alias("updated_at"), "source", "source_external_id")
    merged, moved = upsert_interactions(interactions, payload)
    touched = payload.select("contact_id").unionByName(moved).distinct()
    named = touched.withColumnRenamed("contact_id", "id")
    fresh = recompute(contacts.join(named, "id", "left_semi"), merged.join(touched, "contact_id", "left_semi"))
    return {"staged": outcome, "interactions": merged, "touched": touched, "contacts": contacts.join(named, "id", "left_anti").unionByName(fresh)}
