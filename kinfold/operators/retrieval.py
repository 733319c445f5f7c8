"""Structured, fuzzy and keyword retrieval over golden records, and the views built on them.

All functions take and return frames; filters reach the scan, side tables are aggregated before they are joined. Null never matches a
filter; ties end with the id.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import normalize as N

# Role words that stand for each other, and words of a query that say nothing.
ROLE_SYNONYMS = {"founder": ("founder", "co-founder", "cofounder", "founding"), "ceo": ("ceo", "chief executive")}
ROLE_SYNONYMS |= {"cofounder": ROLE_SYNONYMS["founder"], "co-founder": ROLE_SYNONYMS["founder"]}
STOP_WORDS = frozenset((
    "a", "an", "and", "any", "are", "as", "at", "be", "by", "can", "do", "for", "from", "has", "have", "i", "in", "is", "it", "me", "my", "of", "on", "or", "she", "he", "that", "the", "to", "who", "whom", "with", "you", "your",
    "someone", "people", "person", "know", "find", "good", "need", "want", "looking", "leader", "expert",
))
# Bundles of role words by class.
ROLE_CLASSES = {"founder": ("founder", "co-founder", "cofounder", "founding")}
CONTACT_COLUMNS = ("id", "full_name", "current_position", "current_company", "company_category", "location", "connection_status", "closeness_tier", "last_touchpoint_at")
TEXT_COLUMNS = ("company_category", "notes", "current_position", "current_company")
ARRAY_COLUMNS = ("expertise", "tags")


def plain(term: str) -> str:
    """A search term without the characters that have a meaning in patterns, except the one-letter wildcard."""
    return re.sub(r'[,().*"%]', " ", term).strip()


def role_terms(*roles: str) -> list[str]:
    """Comma-separated role words in lower case, synonyms added, each once."""
    words = [w.strip().lower() for r in roles for w in r.split(",") if w.strip()]
    return list(dict.fromkeys(plain(s) for w in words for s in ROLE_SYNONYMS.get(w, (w,)) if plain(s)))


def role_class(name: str) -> tuple[str, ...]:
    """The role words of a class; an unknown class is a word itself."""
    return ROLE_CLASSES.get(name.strip().lower(), (name,))


def capped(pool: DataFrame, most: int) -> DataFrame:
    """(id, matched, truncated): the first ids of a pool, how many it has and whether some were left out."""
    total = pool.agg(F.count("*").alias("matched"))
    return pool.select("id").orderBy("id").limit(most).join(F.broadcast(total)).withColumn("truncated", F.col("matched") > most)


def contains(column: str, term: str) -> Column:
    return F.col(column).ilike(f"%{term}%")


def contact_filter(status: str | None = None, tier: str | None = None, tag: str | None = None, affiliation: str | None = None, cold_months: int | None = None, as_of: str | None = None, role: str | None = None, category: str | None = None, location: str | None = None, role_class: str | None = None) -> Column:
    """All given conditions joined by AND; a contact without a touchpoint counts as cold."""
    parts = [F.lit(True)]
    if status:
        parts.append(F.col("connection_status") == status)
    if tier:
        parts.append(F.col("closeness_tier") == tier)
    if tag:
        parts.append(F.array_contains("tags", tag))
    if affiliation:
        parts.append(F.array_contains("affiliations", affiliation))
    if cold_months is not None:
        parts.append((F.col("last_touchpoint_at") <= F.date_sub(F.lit(as_of).cast("date"), 30 * cold_months)) | F.col("last_touchpoint_at").isNull())
    roles = [*([role] if role else []), *(ROLE_CLASSES.get(role_class.strip().lower(), (role_class,)) if role_class else ())]
    if terms := role_terms(*roles):
        parts.append(reduce(lambda a, b: a | b, [contains("current_position", t) for t in terms]))
    if category and plain(category):
        parts.append(contains("company_category", plain(category)))
    if location and plain(location):
        parts.append(contains("location", plain(location)))
    return reduce(lambda a, b: a & b, parts)


def list_contacts(contacts: DataFrame, where: Column, limit: int = 100) -> DataFrame:
    """Matching contacts, the longest untouched first; never touched ones lead."""
    return contacts.filter(where).select(*CONTACT_COLUMNS).orderBy(F.col("last_touchpoint_at").asc_nulls_first(), "id").limit(min(limit, 1000))


def resolve_names(contacts: DataFrame, refs: DataFrame, ref: str) -> DataFrame:
    """(ref, outcome, contact_id): a reference by id, else by the whole name without regard to case; found, ambiguous or missing."""
    asked = refs.select(F.col(ref).alias("ref")).filter("ref is not null").distinct()
    by_id = contacts.select(F.col("id").alias("ref"), F.col("id").alias("by_id"))
    by_name = contacts.filter("full_name is not null").groupBy(F.lower("full_name").alias("low")).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    both = asked.join(by_id, "ref", "left").withColumn("low", F.lower("ref")).join(by_name, "low", "left")
    outcome = F.when(F.col("by_id").isNotNull() | (F.col("n") == 1), "found").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return both.select("ref", outcome.alias("outcome"), F.coalesce("by_id", F.when(F.col("n") == 1, F.col("first"))).alias("contact_id"))


def keyword_hits(contacts: DataFrame, interactions: DataFrame, intent: str, where: Column | None = None) -> DataFrame:
    """Ids of contacts that match the filter, a keyword in their texts or arrays, or a keyword in a touchpoint's summary."""
    tokens = N.intent_tokens(intent, STOP_WORDS)
    texts = [contains(c, plain(t)) for t in tokens for c in TEXT_COLUMNS] + [F.array_contains(c, t) for t in tokens for c in ARRAY_COLUMNS]
    own = [F.coalesce(x, F.lit(False)) for x in texts + ([where] if where is not None else [])]
    hit = reduce(lambda a, b: a | b, own, F.lit(False))
    topics = reduce(lambda a, b: a | b, [contains("summary", plain(t)) for t in tokens], F.lit(False))
    told = interactions.filter(topics).select(F.col("contact_id").alias("id")).distinct()
    return contacts.filter(hit).select("id").unionByName(contacts.select("id").join(told, "id", "left_semi")).distinct()


def topics(interactions: DataFrame, most: int = 2) -> DataFrame:
    """(contact_id, topics): the newest summaries that are not empty, undated ones last."""
    newest = Window.partitionBy("contact_id").orderBy(F.col("occurred_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), "id")
    ranked = interactions.filter("contact_id is not null and trim(summary) <> ''").withColumn("k", F.row_number().over(newest)).filter(F.col("k") <= most)
    return ranked.groupBy("contact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.trim("summary").alias("s")))), lambda x: x["s"]).alias("topics"))


def stale_contacts(log: DataFrame, as_of: str) -> DataFrame:
    """(contact_id, stale): whether a current value is past its date."""
    return log.filter("is_current and refresh_after is not null").groupBy("contact_id").agg(F.max(F.col("refresh_after") < F.lit(as_of).cast("date")).alias("stale"))


def capsules(contacts: DataFrame, interactions: DataFrame, log: DataFrame, as_of: str) -> DataFrame:
    """One short row a contact: who, where, a note of 140 characters, the last two topics and whether values are stale."""
    base = contacts.select("id", F.col("full_name").alias("name"), F.col("current_position").alias("role"), F.col("current_company").alias("company"), "company_category", F.array_join("expertise", "|").alias("expertise"), F.array_join("tags", "|").alias("tags"), F.expr(N.truncated("notes")).alias("note"), "location", F.col("closeness_tier").alias("tier"), F.col("last_touchpoint_at").alias("last"))
    told = topics(interactions).select(F.col("contact_id").alias("id"), F.array_join("topics", " | ").alias("topics"))
    stale = stale_contacts(log, as_of).withColumnRenamed("contact_id", "id")
    return base.join(told, "id", "left").join(stale, "id", "left").withColumn("topics", F.coalesce("topics", F.lit(""))).withColumn("stale", F.coalesce("stale", F.lit(False)))


def dossier(contacts: DataFrame, identities: DataFrame, interactions: DataFrame, log: DataFrame, most: int = 20) -> DataFrame:
    """Per contact: its identities, its newest touchpoints and log rows (up to `most` each) as counts and id lists."""

    def newest(df: DataFrame, *order: Column) -> DataFrame:
        w = Window.partitionBy("contact_id").orderBy(*order, "id")
        return df.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).groupBy("contact_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]), ",").alias("ids"))

    touched = newest(interactions, F.col("occurred_at").desc_nulls_last(), F.col("created_at").desc_nulls_last()).select(F.col("contact_id").alias("id"), F.col("ids").alias("interactions"))
    logged = newest(log, F.col("created_at").desc_nulls_last()).select(F.col("contact_id").alias("id"), F.col("ids").alias("log_rows"))
    held = identities.groupBy("contact_id").agg(F.count("*").alias("identities")).withColumnRenamed("contact_id", "id")
    empty = F.lit("")
    return contacts.select("id", "full_name").join(held, "id", "left").join(touched, "id", "left").join(logged, "id", "left").select("id", "full_name", F.coalesce("identities", F.lit(0)).alias("identities"), F.coalesce("interactions", empty).alias("interactions"), F.coalesce("log_rows", empty).alias("log_rows"))


def primary_emails(identities: DataFrame) -> DataFrame:
    """(contact_id, email): the address imported first."""
    return identities.filter("email is not null and contact_id is not null").groupBy("contact_id").agg(F.min_by("email", F.struct("imported_at", "id")).alias("email"))


def provenance(log: DataFrame) -> DataFrame:
    """(contact_id, field, new_value, source, method): where each current value came from; the newest where several are flagged."""
    w = Window.partitionBy("contact_id", "field").orderBy(F.desc("created_at"), "id")
    return log.filter("is_current").withColumn("k", F.row_number().over(w)).filter("k = 1").select("contact_id", "field", "new_value", "source", "method")


def due_contacts(contacts: DataFrame, log: DataFrame, as_of: str) -> DataFrame:
    """Contacts with a current value past its date, closest first."""
    stale = log.filter("is_current").filter(F.col("refresh_after") < F.lit(as_of).cast("date")).select(F.col("contact_id").alias("id")).distinct()
    return contacts.join(stale, "id", "left_semi").select("id", "full_name", "closeness_tier", "current_company", (4 - F.expr(N.rank_of("closeness_tier"))).alias("priority")).orderBy("priority", F.col("full_name").asc_nulls_first(), "id")


def run_queue(contacts: DataFrame, status: str = "in_network") -> DataFrame:
    """Contacts that an enrichment run should visit: not enriched yet and with a gap it could fill, closest first."""
    gap = F.col("github_username").isNull() | F.col("twitter_username").isNull() | F.col("website_url").isNull() | F.col("location").isNull()
    return contacts.filter((F.col("connection_status") == status) & F.col("last_enriched_at").isNull() & gap).select("id", "full_name", "closeness_tier", (4 - F.expr(N.rank_of("closeness_tier"))).alias("priority")).orderBy("priority", F.col("full_name").asc_nulls_first(), "id")


def job_changes(log: DataFrame, since: str) -> DataFrame:
    """Changes of company or role since a moment: an old value that is not missing and differs from the new one."""
    changed = log.filter(F.col("field").isin("current_company", "current_role") & (F.col("created_at") >= F.lit(since).cast("timestamp")) & (F.col("old_value") != "None"))
    return changed.filter("not (old_value <=> new_value)").select("id", "contact_id", "field", F.col("old_value").alias("old"), F.col("new_value").alias("new")).orderBy("id")
