"""Queries of the write side over whole tables: carrying out a resolution plan, applying and taking back facts, entries by hand; and the
reports with a fixed order. Each has the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import keys as K
from kinfold.functions import normalize as N
from kinfold.operators import changes, cohort, entries, execution, matching, retrieval, stats, touchpoints
from kinfold.plans import catalog
from kinfold.plans.catalog import AS_OF, D, SEEDED, Tables
from kinfold.sources.profiles import SOCIAL_HOSTS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- a resolution plan carried out -------------------------------------------------------------------------------------------------
def exact_plan(t: Tables) -> DataFrame:
    """What exact keys alone decide about every staged row: attach to the one contact they lead to, review where they lead to several,
    reject nameless rows and create a contact otherwise."""
    found = matching.resolve_exact(matching.exact_hits(t.staging, t.contact_identities)).withColumnRenamed("method", "by")
    rows = t.staging.select("id", "full_name").join(found, "id", "left")
    nameless = F.coalesce("full_name", F.lit("")) == ""
    status = F.when(nameless, "rejected").when(F.col("score") == 1.0, "auto_matched").when(F.col("score").isNotNull(), "needs_review").otherwise("merged")
    ref = F.when(~nameless, F.coalesce("contact_id", "id"))
    return rows.select("id", F.col("id").alias("cluster_id"), status.alias("match_status"), ref.alias("ref"), F.when(~nameless, F.col("score")).alias("score"), F.when(~nameless, F.coalesce("by", F.lit("new_contact"))).otherwise("no_name").alias("method"))


_PLAN = (
    f"plan as (select s.id, case when coalesce(s.full_name, '') = '' then 'rejected' when h.n = 1 then 'auto_matched' when h.n > 1 then 'needs_review' else 'merged' end as match_status, "
    f"case when coalesce(s.full_name, '') <> '' then coalesce(h.c, s.id) end as ref, case when h.n = 1 then 1.0 when h.n > 1 then 0.75 end::double as score, case when h.n = 1 then h.m else 'conflicting_keys' end as method "
    f"from staging s left join (select id, count(*) as n, arg_min(contact_id, (rank, contact_id)) as c, arg_min(method, (rank, contact_id)) as m from ({catalog._HITS}) group by 1) h on h.id = s.id), "
    "att0 as (select p.id, p.match_status, p.score, p.method, case when p.match_status = 'merged' then sha256('contact|' || p.ref) else p.ref end as contact_id, s.source, s.source_external_id as sx, s.imported_at from plan p join staging s on s.id = p.id where p.match_status in ('merged', 'auto_matched')), "
    "held as (select source, source_external_id as sx, min(contact_id) as holder from contact_identities where source_external_id is not null group by 1, 2), "
    "att1 as (select a.*, h.holder from att0 a left join held h on h.source = a.source and h.sx = a.sx), "
    "firsts as (select source, sx, id as first_id, contact_id as first_contact from (select *, row_number() over (partition by source, sx order by match_status <> 'merged', imported_at, id) as k from att1 where holder is null and sx is not null) where k = 1), "
    "att as (select a.id, a.contact_id, a.match_status, case when a.match_status = 'merged' or coalesce(a.holder, f.first_contact, a.contact_id) = a.contact_id then 'attached' else 'rerun_conflict' end as outcome, case when a.sx is null then a.match_status = 'merged' else coalesce(f.first_id = a.id, false) end as fresh from att1 a left join firsts f on f.source = a.source and f.sx = a.sx)"
)


@query("select id, source, full_name from staging where match_status = 'pending'")
def pending_rows(spark, d):
    return execution.pending(Tables(spark, d).staging).select("id", "source", "full_name")


@query(f"with {_PLAN} select p.id as create_key, sha256('contact|' || p.id) as contact_id, s.full_name, s.role as current_position, s.company as current_company, s.location, s.twitter_username, s.github_username, s.website_url from plan p join staging s on s.id = p.id where p.match_status = 'merged'")
def run_created(spark, d):
    t = Tables(spark, d)
    return execution.created(exact_plan(t), t.staging)


@query(f"with {_PLAN} select id, contact_id, match_status, outcome, fresh from att")
def run_attachments(spark, d):
    t = Tables(spark, d)
    return execution.attachments(exact_plan(t), t.staging, t.contact_identities)


@query(f"with {_PLAN} select a.contact_id, s.source, s.source_external_id, s.email, s.phone, s.linkedin_url, s.handle from att a join staging s on s.id = a.id where a.outcome = 'attached' and a.fresh")
def run_identities(spark, d):
    t = Tables(spark, d)
    return execution.new_identities(exact_plan(t), t.staging, t.contact_identities)


@query(
    f"with {_PLAN} select p.id, case when a.outcome = 'rerun_conflict' then 'needs_review' else p.match_status end as match_status, coalesce(a.contact_id, p.ref) as matched_contact_id, case when coalesce(a.outcome, '') <> 'rerun_conflict' and p.match_status in ('auto_matched', 'needs_review') then p.score end as match_confidence, "
    "case when a.outcome = 'rerun_conflict' then 'rerun_conflict' when p.match_status = 'rejected' then 'no_name' when p.match_status = 'merged' then 'new_contact' else p.method end as match_method, p.match_status <> 'needs_review' and coalesce(a.outcome, '') <> 'rerun_conflict' as resolved from plan p left join att a on a.id = p.id"
)
def run_patches(spark, d):
    t = Tables(spark, d)
    return execution.patches(exact_plan(t), t.staging, t.contact_identities)


_BORN = " union all ".join(f"select sha256('contact|' || p.id) as contact_id, '{g}' as field, null as old_value, s.{c} as new_value, s.source, s.source_external_id as sx, true as is_current from plan p join staging s on s.id = p.id where p.match_status = 'merged'" for g, c in execution.CONTACT_FIELDS.items())
_TOLD = " union all ".join(f"select a.id, a.contact_id, s.imported_at, s.source, s.source_external_id as sx, '{g}' as field, s.{c} as value, nullif(c.{g}, '') as golden from att a join staging s on s.id = a.id join contacts c on c.id = a.contact_id where a.match_status = 'auto_matched' and a.outcome = 'attached' and s.{c} <> ''" for g, c in matching.FILL.items())


@query(
    f"with {_PLAN}, born as ({_BORN}), elected as (select distinct contact_id, field, true as cleared from enrichment_log where is_current), told as ({_TOLD}), "
    "r as (select l.*, coalesce(e.cleared, false) as cleared, first_value(value) over (partition by l.contact_id, l.field order by l.imported_at, l.id) as f, row_number() over (partition by l.contact_id, l.field order by l.imported_at, l.id) as k from told l left join elected e on e.contact_id = l.contact_id and e.field = l.field), "
    "s as (select *, coalesce(golden, case when not cleared and k > 1 then f end) as stands from r), "
    "rows as (select contact_id, field, old_value, new_value, source, sx, is_current from born where new_value <> '' union all select contact_id, field, stands, value, source, sx, stands is null and not cleared from s where stands is null or stands <> value "
    "union all select a.contact_id, 'full_name', c.full_name, s.full_name, s.source, s.source_external_id, false from att a join staging s on s.id = a.id join contacts c on c.id = a.contact_id where a.match_status = 'auto_matched' and a.outcome = 'attached' and s.full_name <> '' and s.full_name is distinct from c.full_name) "
    "select contact_id, field, old_value, new_value, source, 'staging ' || coalesce(source, '') || '/' || coalesce(sx, '') as detail, is_current from rows"
)
def run_log(spark, d):
    t = Tables(spark, d)
    return execution.log_rows(exact_plan(t), t.staging, t.contacts, t.contact_identities, t.enrichment_log.filter("is_current"))


# --- facts applied and taken back --------------------------------------------------------------------------------------------------
def _elected(rows: str) -> str:
    return (
        f"select contact_id, field, id as winner_id, new_value as value from (select *, row_number() over (partition by contact_id, field order by case when method = 'manual_set' then 0 else 1 end, created_at desc, coalesce(confidence, 0.4) desc, id desc) as k from {rows} e "
        f"where verification_status is distinct from 'disputed' and not exists (select 1 from {rows} d where d.contact_id = e.contact_id and d.field = e.field and d.verification_status = 'disputed' and d.new_value is not distinct from e.new_value)) where k = 1"
    )


_LOG = "id, contact_id, field, new_value, source, confidence, method, created_at, verification_status, is_current"
_APPLIED = (
    f"old as (select {_LOG} from enrichment_log where created_at < timestamptz '2025-06-01 00:00:00+00'), outcomes as ({catalog.ORACLE['arbitrate_batch']}), "
    "c as (select e.id, e.contact_id, e.field, e.new_value, e.source, e.confidence, e.method, e.created_at, null::varchar as verification_status, false as is_current, o.outcome from enrichment_log e join outcomes o on o.id = e.id where o.outcome in ('golden', 'review')), "
    "until as (select contact_id, field, created_at as u_at, id as u_id from (select *, row_number() over (partition by contact_id, field order by created_at desc, id desc) as k from c where outcome = 'golden') where k = 1), "
    f"rows as (select {_LOG} from old union all select {', '.join('c.' + x.strip() for x in _LOG.split(','))} from c join until u on u.contact_id = c.contact_id and u.field = c.field where (c.created_at, c.id) <= (u.u_at, u.u_id)), winners as ({_elected('rows')}), "
    "won as (select u.contact_id, u.field, w.winner_id, w.value from until u left join winners w on w.contact_id = u.contact_id and w.field = u.field)"
)


def _applied(t: Tables):
    return changes.apply_candidates(t.enrichment_log.filter("created_at < timestamp'2025-06-01 00:00:00'"), catalog._candidates(t).withColumn("created_at", F.col("seq.created_at")))


@query(f"with {_APPLIED} select o.id, case when w.contact_id is not null then coalesce(o.id = w.winner_id, false) else o.is_current end as is_current from old o left join won w on w.contact_id = o.contact_id and w.field = o.field union all select c.id, coalesce(c.id = w.winner_id, false) from c left join won w on w.contact_id = c.contact_id and w.field = c.field")
def apply_log(spark, d):
    return _applied(Tables(spark, d))[1].select("id", "is_current")


@query(f"with {_APPLIED} select id, " + ", ".join(f"case when exists (select 1 from won w where w.contact_id = g.id and w.field = '{f}') then (select value from won w where w.contact_id = g.id and w.field = '{f}') else {c} end as {c}" for f, c in SEEDED.items()) + " from contacts g")
def apply_golden(spark, d):
    t = Tables(spark, d)
    return changes.materialise(t.contacts, _applied(t)[2], SEEDED).select("id", *SEEDED.values())


@query(
    f"with {_APPLIED} select c.id, c.contact_id, c.field, c.new_value as candidate_value, case when exists (select 1 from old o where o.contact_id = c.contact_id and o.field = c.field and o.is_current and o.method = 'manual_set') or exists (select 1 from c m where m.contact_id = c.contact_id and m.field = c.field and m.outcome = 'golden' and m.method = 'manual_set' and (m.created_at, m.id) < (c.created_at, c.id)) "
    "then 'value_conflict' else 'low_confidence' end as reason, 'open' as status from c where outcome = 'review'"
)
def apply_reviews(spark, d):
    return _applied(Tables(spark, d))[3].select("id", "contact_id", "field", "candidate_value", "reason", "status")


_ITEMS = "items as (select id, contact_id, field, new_value as candidate_value from enrichment_log where contact_id is not null and field in ('location', 'current_company') and method is distinct from 'manual_set' and coalesce(confidence, 0) < 0.7)"
_TOUCHED = "select u.contact_id, u.field, w.winner_id, w.value from (select distinct contact_id, field from items) u left join winners w on w.contact_id = u.contact_id and w.field = u.field"
LATER = "2027-01-01 00:00:00"


def _items(t: Tables) -> DataFrame:
    return t.enrichment_log.filter("contact_id is not null and field in ('location', 'current_company') and not (method <=> 'manual_set') and coalesce(confidence, 0) < 0.7").select("id", "contact_id", "field", F.col("new_value").alias("candidate_value"))


def _after(method: str, prefix: str, confidence: str, status: str) -> str:
    return f"rows as (select {_LOG} from enrichment_log union all select sha256('{prefix}|' || id), contact_id, field, candidate_value, 'keeper', {confidence}, '{method}', timestamptz '{LATER}+00', {status}, false from items), winners as ({_elected('rows')})"


@query(f"with {_ITEMS}, {_after('manual_set', 'approve', '1.0', 'null')} {_TOUCHED}")
def review_approve(spark, d):
    t = Tables(spark, d)
    return changes.approve(t.enrichment_log, _items(t), "keeper", F.lit(LATER).cast("timestamp"))[1]


@query(f"with {_ITEMS}, {_after('enrich_reject', 'reject', 'null', chr(39) + 'disputed' + chr(39))} {_TOUCHED}")
def review_reject(spark, d):
    t = Tables(spark, d)
    return changes.reject(t.enrichment_log, _items(t), "keeper", F.lit(LATER).cast("timestamp"))[1]


@query(f"with {_ITEMS} select id, case when candidate_value is null then 'skipped' when length(candidate_value) % 3 = 0 then 'resolved' else 'open' end as status from items")
def review_closed(spark, d):
    items = _items(Tables(spark, d)).withColumn("status", F.lit("open"))
    decided = items.select("id", F.expr("case when candidate_value is null then 'skip' when length(candidate_value) % 3 = 0 then 'approve' end").alias("decision")).filter("decision is not null")
    return changes.close_items(items, decided).select("id", "status")


@query(
    "with items as (select contact_id, field from enrichment_log where is_current and field = 'location' and contact_id is not null), rows as (select id, contact_id, field, new_value, source, confidence, method, created_at, case when is_current and field = 'location' then 'disputed' else verification_status end as verification_status from enrichment_log), "
    f"winners as ({_elected('rows')}) {_TOUCHED}"
)
def undo_location(spark, d):
    log = Tables(spark, d).enrichment_log
    return changes.undo(log, log.filter("field = 'location' and contact_id is not null"))[1]


@query("select l.id, case when c.id is null then l.old_value end as old_value, case when c.id is null then l.new_value end as new_value, c.id is not null or l.redacted_at is not null as redacted from enrichment_log l left join contacts c on c.id = l.contact_id and c.connection_status = 'contact_on_file'")
def forget_contacts(spark, d):
    t = Tables(spark, d)
    gone = t.contacts.filter("connection_status = 'contact_on_file'").select("id")
    return changes.forget(t.enrichment_log, gone, F.lit(LATER).cast("timestamp")).select("id", "old_value", "new_value", F.col("redacted_at").isNotNull().alias("redacted"))


@query(
    "with named as (select id, matched_contact_id as contact_id, 'enrich:' || source as source, sha256(email) as sx, email from staging where email is not null and matched_contact_id is not null and source is not null), f as (select *, row_number() over (partition by source, sx order by id) as k from named) "
    "select contact_id, source, sx as source_external_id, 'email' as kind, email as value from f where k = 1 and not exists (select 1 from contact_identities i where i.source = f.source and i.source_external_id = f.sx)"
)
def promote_identities(spark, d):
    t = Tables(spark, d)
    found = t.staging.filter("matched_contact_id is not null and source is not null").select("id", F.col("matched_contact_id").alias("contact_id"), F.lit("email").alias("kind"), F.col("email").alias("value"), "source")
    return changes.promote(t.contact_identities, found)


# --- entries by hand ---------------------------------------------------------------------------------------------------------------
@query(f"select id, field, {entries.assignment_verdict('field', 'new_value')} as verdict from enrichment_log")
def validate_assignments(spark, d):
    return Tables(spark, d).enrichment_log.select("id", "field", F.expr(entries.assignment_verdict("field", "new_value")).alias("verdict"))


_T2 = "closeness_tier = 't2_dm'"


@query(f"select id as contact_id, 'call' as kind, 'signal' as channel, date '{AS_OF}' as occurred_at, 'catching up' as summary, 'keeper' as logged_by from contacts where {_T2}")
def bulk_log(spark, d):
    ids, _ = entries.gate(Tables(spark, d).contacts, F.expr(_T2), yes=True)
    return entries.touchpoints(ids, "call", "signal", AS_OF, "catching up", "keeper").select("contact_id", "kind", "channel", "occurred_at", "summary", "logged_by")


@query(f"select id, date '{AS_OF}' as last_touchpoint_at, 'signal' as last_touchpoint_channel, 'catching up' as last_touchpoint_topic from contacts where {_T2} and (last_touchpoint_at is null or last_touchpoint_at < date '{AS_OF}')")
def bulk_bump(spark, d):
    t = Tables(spark, d)
    return entries.bumped(t.contacts, cohort.cohort(t.contacts, F.expr(_T2)), AS_OF, "signal", "catching up")


@query(f"select (select count(distinct id) from contacts where {_T2})::bigint as cohort, full_name as sample from (select * from contacts where {_T2} order by full_name nulls last, id limit 10)")
def gate_preview(spark, d):
    t = Tables(spark, d)
    _, report = entries.gate(t.contacts, F.expr(_T2), dry_run=True)
    return spark.createDataFrame([(report["cohort"], n) for n in report["sample"]], "cohort long, sample string")


@query(f"select id, case when coalesce(notes, '') = '' then '' else notes || chr(10) end || '[{AS_OF} keeper] met again' as notes from contacts where {_T2}")
def note_append(spark, d):
    t = Tables(spark, d)
    return entries.append_note(t.contacts, cohort.cohort(t.contacts, F.expr(_T2)), "met again", AS_OF, "keeper")


@query(
    f"with items as (select id as contact_id, 'location' as field, sha256('set|' || id || '|location|Port Ellaway') as cid from contacts where {_T2} and not exists (select 1 from enrichment_log l where l.contact_id = contacts.id and l.field = 'location' and l.new_value = 'Port Ellaway' and l.source = 'keeper')), "
    f"rows as (select {_LOG} from enrichment_log union all select cid, contact_id, field, 'Port Ellaway', 'keeper', 1.0, 'manual_set', timestamptz '{LATER}+00', null, false from items), winners as ({_elected('rows')}) {_TOUCHED}"
)
def bulk_set_location(spark, d):
    t = Tables(spark, d)
    ids, _ = entries.gate(t.contacts, F.expr(_T2), yes=True)
    return changes.apply_candidates(t.enrichment_log, entries.set_candidates(ids, "location=Port Ellaway", "keeper", F.lit(LATER).cast("timestamp")))[2]


@query(f"select id as contact_id, 'event' as kind, 'irl' as channel, date '{AS_OF}' as occurred_at, sha256('event|Summer dinner|{AS_OF}') as event_id from contacts where id in (select id from contacts order by id limit 3)")
def event_add(spark, d):
    t = Tables(spark, d)
    refs = [r["id"] for r in t.contacts.orderBy("id").limit(3).collect()]
    return entries.add_event(t.occasions, t.contacts, "Summer dinner", AS_OF, None, refs, "keeper")[1].select("contact_id", "kind", "channel", "occurred_at", "event_id")


@query("select i.id, case when f.id is not null then 'noted' else i.summary end as summary from interactions i left join (select min(id) as id from interactions where event_id is not null and contact_id is not null group by event_id, contact_id) f on f.id = i.id")
def event_note(spark, d):
    rows = Tables(spark, d).interactions
    notes = rows.filter("event_id is not null and contact_id is not null").select("event_id", "contact_id", F.lit("noted").alias("text")).distinct()
    return entries.note_participants(rows, notes).select("id", "summary")


_ADD = "sha256('add|' || full_name || '|' || coalesce(email, '') || '|' || coalesce(phone, '') || '|' || coalesce(linkedin_url, '') || '|' || coalesce(handle, ''))"


@query(f"select distinct {_ADD} as id, full_name from staging where source = 'csv_rolodex' and trim(coalesce(full_name, '')) <> ''")
def contact_add(spark, d):
    rows = Tables(spark, d).staging.filter("source = 'csv_rolodex'").select("full_name", "email", "phone", "linkedin_url", "handle")
    return entries.add_contacts(rows)[0]


@query("select a.id, coalesce(n.description, a.description) as description from agents a left join (select distinct logged_by as id, 'seen' as description from interactions where logged_by is not null) n on n.id = a.id union all select distinct logged_by, 'seen' from interactions where logged_by is not null and logged_by not in (select id from agents)")
def agents_register(spark, d):
    t = Tables(spark, d)
    seen = t.interactions.filter("logged_by is not null").select(F.col("logged_by").alias("id"), F.lit("seen").alias("description")).distinct()
    return entries.register(t.agents, seen, "id").select("id", "description")


# --- touchpoints in one job --------------------------------------------------------------------------------------------------------
_OPEN = "match_status in ('pending', 'orphaned')"


@query(f"select s.id, case when l.contact_id is null then 'orphaned' else 'linked' end as match_status, l.contact_id as matched_contact_id from staging_interactions s join ({catalog._LINK}) l on l.id = s.id where s.{_OPEN}")
def backfill_status(spark, d):
    t = Tables(spark, d)
    return touchpoints.backfill(t.staging_interactions, t.contact_identities, t.interactions, t.contacts)["staged"]


_KEYED = "(select source, source_external_id, arg_max(contact_id, (created_at, id)) as contact_id from interactions where source_external_id is not null group by 1, 2)"


@query(f"with l as ({catalog._LINK}) select distinct l.contact_id from staging_interactions s join l on l.id = s.id where s.{_OPEN} and l.contact_id is not null union select i.contact_id from interactions i join (select * from (select s.source, s.source_external_id, l.contact_id, row_number() over (partition by s.source, s.source_external_id order by s.imported_at desc, s.id desc) as k from staging_interactions s join l on l.id = s.id where s.{_OPEN} and l.contact_id is not null) where k = 1) f on f.source = i.source and f.source_external_id = i.source_external_id where i.contact_id is distinct from f.contact_id and i.contact_id is not null")
def touched_contacts(spark, d):
    t = Tables(spark, d)
    return touchpoints.backfill(t.staging_interactions, t.contact_identities, t.interactions, t.contacts)["touched"]


# --- reports in a fixed order ------------------------------------------------------------------------------------------------------
_BUCKETS = stats.BUCKETS


@query(
    "with c as (" + " union all ".join(f"select {i} as ordinal, '{n}={v}' as metric, (select count(*) from {t} where {c} = '{v}')::bigint as count" for i, (n, t, c, v) in enumerate(_BUCKETS)) + f" union all select {len(_BUCKETS)}, 'contacts_total', (select count(*) from contacts)::bigint) select * from c where count > 0 or metric = 'contacts_total'"
)
def stats_buckets(spark, d):
    t = Tables(spark, d)
    return stats.fixed_buckets({"contacts": t.contacts, "staging": t.staging, "staging_interactions": t.staging_interactions})


@query(f"with {_APPLIED}, m as (select 'in_review' as metric, (select count(*) from c where outcome = 'review')::bigint as count union all select 'pending_identities', (select count(*) from staging where email is not null and matched_contact_id is null)::bigint union all select * from ({catalog.ORACLE['enrich_stats']})) select * from m where count > 0")
def enrich_stats_full(spark, d):
    t = Tables(spark, d)
    waiting = t.staging.filter("email is not null and matched_contact_id is null")
    return stats.enrichment_coverage(t.enrichment_log, AS_OF, _applied(t)[3], waiting)


@query("select id, full_name, match_confidence, row_number() over (order by match_confidence desc nulls first, id) as place from staging where match_status = 'needs_review' order by place limit 1000")
def review_queue(spark, d):
    return matching.review_queue(Tables(spark, d).staging, 1000)


@query(f"with pool as ({catalog.ORACLE['find_pool']}) select id, (select count(*) from pool)::bigint as matched, (select count(*) from pool) > 300 as truncated from pool order by id limit 300")
def find_capped(spark, d):
    t = Tables(spark, d)
    return retrieval.capped(retrieval.keyword_hits(t.contacts, t.interactions, catalog.INTENT), 300)


@query(
    f"with {catalog.ORACLE['resolve_name'].removeprefix('with ').replace('select a.ref, case', ', r as (select a.ref, case', 1)}), s as ({catalog._gram_rows('staging')}), c as ({catalog._gram_rows('contacts')}), i as (select s.name as a, c.name as b, any_value(s.n) as n, any_value(c.n) as m, count(*) as k from s join c on s.gram = c.gram group by 1, 2), "
    "p as (select a, b, k / (n + m - k) as score from i where k / (n + m - k) >= 0.55) select ref, b as hint, place from (select r.ref, p.b, row_number() over (partition by r.ref order by p.score desc, p.b) as place from r join p on p.a = r.ref where r.outcome = 'missing') where place <= 3"
)
def resolve_hints(spark, d):
    t = Tables(spark, d)
    asked = retrieval.resolve_names(t.contacts, t.staging, "full_name").filter("outcome = 'missing'")
    return matching.hints(asked.select("ref"), t.contacts)


@query(f"select {catalog.CC} from contacts where " + " or ".join(f"current_position ilike '%{x}%'" for x in retrieval.role_terms(*retrieval.role_class("founder"), "engineer")) + " order by last_touchpoint_at asc nulls first, id limit 1000")
def list_role_class(spark, d):
    return retrieval.list_contacts(Tables(spark, d).contacts, retrieval.contact_filter(role="engineer", role_class="founder"), 1000)


# --- scalar functions --------------------------------------------------------------------------------------------------------------
def _scalar(name: str, source: str, **build: Callable[[str], str]) -> None:
    def run(spark, d, build=build, source=source):
        return catalog.table(spark, d, source).select("id", *[F.expr(b("spark")).alias(k) for k, b in build.items()])

    QUERIES[name] = run
    ORACLE[name] = f"select id, {', '.join(f'{b(D)} as {k}' for k, b in build.items())} from {source}"


_scalar("plain_names", "staging", plain=lambda d: N.plain_name("full_name", d))
_scalar("confidence_classes", "staging", outcome=lambda d: N.confidence_class("match_confidence"))
_scalar("social_links", "staging", social=lambda d: N.is_social("website_url", SOCIAL_HOSTS), profile=lambda d: N.is_social("linkedin_url", ("linkedin.example",)))
_scalar("evidence_lines", "enrichment_log", line=lambda d: N.evidence("source_detail", "old_value"))
_scalar("identifier_forms", "staging", email=lambda d: N.canonical_identifier("'email'", "email", d), handle=lambda d: N.canonical_identifier("'handle'", "handle", d), other=lambda d: N.canonical_identifier("source", "email", d))
_scalar("decoded_profiles", "staging", profile=lambda d: N.linkedin_profile("concat('https://www.linkedin.example/in/', replace(lower(coalesce(full_name, 'x')), ' ', '%20'), '-%C3%A9?x=1')", d))


@query("select l.id, try_cast(case when field = 'location' then '2026-0' || (1 + length(new_value) % 9) || '-15' else new_value end as date) as as_date from enrichment_log l")
def dynamic_cast(spark, d):
    """Logged values read as the type of the golden column last_enriched_at."""
    t = Tables(spark, d)
    kind = dict(t.contacts.dtypes)["last_enriched_at"]
    value = F.expr("case when field = 'location' then concat('2026-0', cast(1 + length(new_value) % 9 as string), '-15') else new_value end")
    return t.enrichment_log.select("id", value.try_cast(kind).alias("as_date"))


@query()
def missing_functions(spark, d):
    """Functions the engine needs that the session does not offer."""
    return stats.missing_functions(spark, ("array_intersect", "levenshtein", "max_by", "min_by", "posexplode", "sha2", "try_url_decode", "xxhash64"))
