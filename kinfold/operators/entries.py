"""Entries by hand: touchpoints, events, contacts, assignments, notes, agents and tags, for one contact or a cohort.

Each function gives the rows to append or the changed rows; ids are digests of what is entered, so that a repeated entry is the same one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.cohort import CohortError, cohort

# Kinds of touchpoints, fields that can be set, and the values of those with a closed set.
KINDS = ("origin", "event", "email", "message", "call", "meeting")
ENUMS = {
    "connection_status": ("in_network", "contact_on_file"),
    "closeness_tier": ("t1_irl_messaging", "t2_dm", "t3_community", "t4_public", "none"),
    "email_status": ("verified", "risky", "invalid", "unknown"),
}
SCALARS = ("full_name", "first_name", "last_name", "current_role", "current_company", "location", "connection_status", "closeness_tier", "origin_context", "email_status", "company_category", "company_domain", "github_username", "twitter_username", "website_url")
ARRAYS = ("tags", "affiliations", "expertise")


class EntryError(ValueError):
    """An entry that names an unknown kind, field, value, contact, agent or tag; nothing is written."""


def parse_assignment(text: str) -> tuple[str, str | None]:
    """(field, value) of field=value; a blank value clears the field."""
    field, eq, value = text.partition("=")
    if not eq:
        raise EntryError("expected field=value")
    if field not in SCALARS + ARRAYS:
        raise EntryError(f"{field!r} cannot be set")
    if field in ENUMS and value not in ENUMS[field]:
        raise EntryError(f"{value!r} is no {field}")
    return field, value or None


def assignment_verdict(field: str, value: str) -> str:
    """SQL of what parse_assignment says about a field and a value: ok, unknown_field or bad_value. Runs in both dialects."""

    def listed(words: tuple[str, ...]) -> str:
        return ", ".join(f"'{w}'" for w in words)

    bad = " or ".join(f"({field} = '{f}' and coalesce({value}, '') not in ({listed(v)}))" for f, v in ENUMS.items())
    return f"(case when {field} is null or {field} not in ({listed(SCALARS + ARRAYS)}) then 'unknown_field' when {bad} then 'bad_value' else 'ok' end)"


def require_agent(agents: DataFrame, agent: str, now: Column) -> DataFrame:
    """Agents with the time of their last act; an unknown agent is an error."""
    if not agents.filter(F.col("id") == agent).limit(1).count():
        raise EntryError(f"unknown agent {agent!r}")
    return agents.withColumn("last_active", F.when(F.col("id") == agent, now).otherwise(F.col("last_active")))


def register(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A registry with further rows; the description of a known key is renewed, its other columns stay."""
    new = rows.select(F.col(key), F.col("description").alias("_d")).dropDuplicates([key])
    kept = table.join(new, key, "left").withColumn("description", F.coalesce("_d", "description")).select(*table.columns)
    fresh = rows.dropDuplicates([key]).join(table.select(key), key, "left_anti")
    return kept.unionByName(fresh.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in table.dtypes]))


def touchpoints(contacts: DataFrame, kind: str, channel: str | None, day: str, summary: str | None, agent: str, event: str | None = None) -> DataFrame:
    """Interaction rows, one a contact (id) of a cohort."""
    if kind not in KINDS:
        raise EntryError(f"{kind!r} is no kind of touchpoint")
    told = [F.lit(x) for x in (kind, channel or "", day, summary or "", agent, event or "")]
    return contacts.select(F.sha2(F.concat_ws("|", F.lit("log"), "id", *told), 256).alias("id"), F.col("id").alias("contact_id"), F.lit(event).cast("string").alias("event_id"), F.lit(kind).alias("kind"), F.lit(channel).cast("string").alias("channel"), F.lit(day).cast("date").alias("occurred_at"), F.lit(summary).cast("string").alias("summary"), F.lit(agent).alias("logged_by"))


def bumped(contacts: DataFrame, ids: DataFrame, day: str, channel: str | None, topic: str | None) -> DataFrame:
    """(id, last_touchpoint_at, last_touchpoint_channel, last_touchpoint_topic) of the contacts of a cohort whose last touchpoint lies
    before the day or is missing."""
    hit = contacts.join(ids, "id", "left_semi").filter(F.col("last_touchpoint_at").isNull() | (F.col("last_touchpoint_at") < F.lit(day).cast("date")))
    return hit.select("id", F.lit(day).cast("date").alias("last_touchpoint_at"), F.lit(channel).cast("string").alias("last_touchpoint_channel"), F.lit(topic).cast("string").alias("last_touchpoint_topic"))


def add_event(occasions: DataFrame, contacts: DataFrame, name: str, day: str, location: str | None, refs: list[str], agent: str) -> tuple[DataFrame, DataFrame]:
    """(the event's row, a touchpoint for each participant). Every reference, an id or a whole name, must lead to one contact before
    anything is made."""
    spark = contacts.sparkSession
    from kinfold.operators.retrieval import resolve_names

    asked = resolve_names(contacts, spark.createDataFrame([(r,) for r in refs], "ref string"), "ref").collect()
    if bad := sorted(f"{r['ref']}: {r['outcome']}" for r in asked if r["outcome"] != "found"):
        raise EntryError("; ".join(bad))
    event = spark.range(1).select(F.sha2(F.concat_ws("|", F.lit("event"), F.lit(name), F.lit(day)), 256).alias("id"), F.lit(name).alias("name"), F.lit(day).cast("date").alias("occurred_at"), F.lit(location).cast("string").alias("location"), F.lit("manual").alias("source"), F.lit(agent).alias("created_by"))
    made = event.first()["id"]
    people = spark.createDataFrame([(r["contact_id"],) for r in asked], "id string").distinct()
    return event, touchpoints(people, "event", "irl", day, None, agent, made)


def note_participants(interactions: DataFrame, notes: DataFrame) -> DataFrame:
    """Interactions with the summary of a participant's first row of an event replaced. notes: (event_id, contact_id, text)."""
    first = interactions.join(notes, ["event_id", "contact_id"]).groupBy("event_id", "contact_id", "text").agg(F.min("id").alias("id")).select("id", "text")
    return interactions.join(first, "id", "left").withColumn("summary", F.coalesce("text", "summary")).select(*interactions.columns)


def add_contacts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contacts, identities) of people entered by hand; both come from one frame, so that neither can be written without the other.
    rows: (full_name, email, phone, linkedin_url, handle, ..). Nameless rows make nothing; equal rows make one contact."""
    named = rows.filter("trim(coalesce(full_name, '')) <> ''").distinct()
    keys = ("email", "phone", "linkedin_url", "handle")
    told = named.withColumn("contact_id", F.sha2(F.concat_ws("|", F.lit("add"), *[F.coalesce(F.col(c), F.lit("")) for c in ("full_name", *keys)]), 256)).dropDuplicates(["contact_id"])
    held = told.filter(F.coalesce(*keys).isNotNull()).select("contact_id", F.lit("manual").alias("source"), *keys)
    return told.select(F.col("contact_id").alias("id"), *[c for c in rows.columns if c not in keys]), held


def append_note(contacts: DataFrame, ids: DataFrame, text: str, day: str, agent: str) -> DataFrame:
    """(id, notes) of a cohort with a dated, signed line appended."""
    stamped = F.lit(f"[{day} {agent}] {text}")
    return contacts.join(ids, "id", "left_semi").select("id", F.when(F.coalesce("notes", F.lit("")) == "", stamped).otherwise(F.concat("notes", F.lit("\n"), stamped)).alias("notes"))


def set_candidates(ids: DataFrame, assignment: str, agent: str, now: Column, tags: DataFrame | None = None) -> DataFrame:
    """Candidates set by hand for a cohort: (id, contact_id, field, value, source, method, confidence, created_at, seq). A tag must be
    registered (tags: tag)."""
    field, value = parse_assignment(assignment)
    if field == "tags" and (tags is None or not tags.filter(F.col("tag") == value).limit(1).count()):
        raise EntryError(f"tag {value!r} is not registered")
    rows = ids.select(F.sha2(F.concat_ws("|", F.lit("set"), "id", F.lit(field), F.lit(value or "")), 256).alias("cid"), F.col("id").alias("contact_id"))
    return rows.select(F.col("cid").alias("id"), "contact_id", F.lit(field).alias("field"), F.lit(value).cast("string").alias("value"), F.lit(agent).alias("source"), F.lit("manual_set").alias("method"), F.lit(1.0).alias("confidence"), now.alias("created_at"), F.struct(now.alias("created_at"), F.col("cid").alias("id")).alias("seq"))


def gate(contacts: DataFrame, where: Column | None = None, everyone: bool = False, dry_run: bool = False, yes: bool = False, sample: int = 10) -> tuple[DataFrame | None, dict]:
    """(cohort or None, report) of an edit of many contacts: a dry run and an empty cohort give no cohort, a write needs `yes`.

    The report counts the cohort and, for a dry run, names its first ten by name."""
    ids = cohort(contacts, where, everyone)
    n = ids.count()
    if dry_run:
        names = contacts.join(ids, "id", "left_semi").orderBy(F.col("full_name").asc_nulls_last(), "id").limit(sample)
        return None, {"cohort": n, "dry_run": True, "sample": [r["full_name"] for r in names.select("full_name").collect()]}
    if not n:
        return None, {"cohort": 0, "dry_run": False, "changed": 0}
    if not yes:
        raise CohortError("confirm the write")
    return ids, {"cohort": n, "dry_run": False}
