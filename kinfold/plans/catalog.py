"""Queries of the golden-record engine over whole tables, each with the DuckDB SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import keys as K
from kinfold.functions import normalize as N
from kinfold.operators import cohort, matching, retrieval, stats, survivorship, touchpoints
from kinfold.operators.skew import lookup_join
from kinfold.session import table

D = "duckdb"
AS_OF = "2026-07-01"
SINCE = "2025-01-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


class Tables:
    """The tables of one folder by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._at = (spark, sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        return table(*self._at, name)


def cols(*names: str) -> str:
    return ", ".join(names)


CC = cols(*retrieval.CONTACT_COLUMNS)
COLD = f"(last_touchpoint_at <= date '{AS_OF}' - interval 180 day or last_touchpoint_at is null)"


# --- retrieval ---------------------------------------------------------------------------------------------------------------------
@query(f"select {CC} from contacts where connection_status = 'in_network' and {COLD} order by last_touchpoint_at asc nulls first, id limit 100")
def list_cold(spark, d):
    t = Tables(spark, d)
    return retrieval.list_contacts(t.contacts, retrieval.contact_filter(status="in_network", cold_months=6, as_of=AS_OF))


@query(f"select {CC} from contacts where connection_status = 'contact_on_file' and closeness_tier = 't2_dm' and company_category ilike '%media%' and location ilike '%port%' order by last_touchpoint_at asc nulls first, id limit 1000")
def list_filters_and(spark, d):
    t = Tables(spark, d)
    return retrieval.list_contacts(t.contacts, retrieval.contact_filter(status="contact_on_file", tier="t2_dm", category="media", location="port"), 1000)


@query(f"select {CC} from contacts where " + " or ".join(f"current_position ilike '%{x}%'" for x in retrieval.role_terms("founder, CEO")) + " order by last_touchpoint_at asc nulls first, id limit 1000")
def list_role_synonym(spark, d):
    t = Tables(spark, d)
    return retrieval.list_contacts(t.contacts, retrieval.contact_filter(role="founder, CEO"), 1000)


@query(f"select {CC} from contacts where list_contains(tags, 'mentor') and list_contains(affiliations, 'Delta Circle') order by last_touchpoint_at asc nulls first, id limit 1000")
def list_tag_affil(spark, d):
    t = Tables(spark, d)
    return retrieval.list_contacts(t.contacts, retrieval.contact_filter(tag="mentor", affiliation="Delta Circle"), 1000)


@query(
    "with asked as (select distinct full_name as ref from staging where full_name is not null), names as (select lower(full_name) as low, count(*) as n, min(id) as first from contacts where full_name is not null group by 1) "
    "select a.ref, case when c.id is not null or n.n = 1 then 'found' when n.n > 1 then 'ambiguous' else 'missing' end as outcome, coalesce(c.id, case when n.n = 1 then n.first end) as contact_id "
    "from asked a left join contacts c on c.id = a.ref left join names n on n.low = lower(a.ref)"
)
def resolve_name(spark, d):
    t = Tables(spark, d)
    return retrieval.resolve_names(t.contacts, t.staging, "full_name")


INTENT = "Who can help with climate hiring or fintech pricing?"
TOKENS = N.intent_tokens(INTENT, retrieval.STOP_WORDS)
_OWN = " or ".join([f"coalesce({c} ilike '%{w}%', false)" for w in TOKENS for c in retrieval.TEXT_COLUMNS] + [f"coalesce(list_contains({c}, '{w}'), false)" for w in TOKENS for c in retrieval.ARRAY_COLUMNS])
_TOPIC = "id in (select contact_id from interactions where " + " or ".join(f"summary ilike '%{w}%'" for w in TOKENS) + ")"


@query(f"select id from contacts where {_OWN} or {_TOPIC}")
def find_pool(spark, d):
    t = Tables(spark, d)
    return retrieval.keyword_hits(t.contacts, t.interactions, INTENT)


@query(f"select id from contacts where closeness_tier = 't1_irl_messaging' or {_OWN} or {_TOPIC}")
def find_struct_union(spark, d):
    t = Tables(spark, d)
    return retrieval.keyword_hits(t.contacts, t.interactions, INTENT, retrieval.contact_filter(tier="t1_irl_messaging"))


_TOPICS = "select contact_id, string_agg(trim(summary), ' | ' order by k) as topics from (select *, row_number() over (partition by contact_id order by occurred_at desc nulls last, created_at desc nulls last, id) as k from interactions where contact_id is not null and trim(summary) <> '') where k <= 2 group by 1"
_STALE = f"select contact_id, bool_or(refresh_after < date '{AS_OF}') as stale from enrichment_log where is_current and refresh_after is not null group by 1"


@query(_TOPICS)
def topics_top2(spark, d):
    return retrieval.topics(Tables(spark, d).interactions).select("contact_id", F.array_join("topics", " | ").alias("topics"))


@query(
    f"select id, full_name as name, current_position as role, current_company as company, company_category, array_to_string(expertise, '|') as expertise, array_to_string(tags, '|') as tags, {N.truncated('notes')} as note, location, closeness_tier as tier, last_touchpoint_at as last, "
    f"coalesce(t.topics, '') as topics, coalesce(s.stale, false) as stale from contacts c left join ({_TOPICS}) t on t.contact_id = c.id left join ({_STALE}) s on s.contact_id = c.id"
)
def capsules(spark, d):
    t = Tables(spark, d)
    return retrieval.capsules(t.contacts, t.interactions, t.enrichment_log, AS_OF)


def _newest(table_: str, order: str) -> str:
    return f"select contact_id, string_agg(id, ',' order by k) as ids from (select *, row_number() over (partition by contact_id order by {order}, id) as k from {table_}) where k <= 20 group by 1"


@query(
    f"select c.id, c.full_name, coalesce(i.n, 0)::bigint as identities, coalesce(x.ids, '') as interactions, coalesce(l.ids, '') as log_rows from contacts c left join (select contact_id, count(*) as n from contact_identities group by 1) i on i.contact_id = c.id "
    f"left join ({_newest('interactions', 'occurred_at desc nulls last, created_at desc nulls last')}) x on x.contact_id = c.id left join ({_newest('enrichment_log', 'created_at desc nulls last')}) l on l.contact_id = c.id"
)
def dossier(spark, d):
    t = Tables(spark, d)
    return retrieval.dossier(t.contacts, t.contact_identities, t.interactions, t.enrichment_log)


@query("select contact_id, email from (select *, row_number() over (partition by contact_id order by imported_at, id) as k from contact_identities where email is not null and contact_id is not null) where k = 1")
def primary_email(spark, d):
    return retrieval.primary_emails(Tables(spark, d).contact_identities)


@query("select contact_id, field, new_value, source, method from (select *, row_number() over (partition by contact_id, field order by created_at desc, id) as k from enrichment_log where is_current) where k = 1")
def provenance_map(spark, d):
    return retrieval.provenance(Tables(spark, d).enrichment_log)


@query(f"select id, full_name, closeness_tier, current_company, (4 - {N.rank_of('closeness_tier')})::int as priority from contacts where id in (select contact_id from enrichment_log where is_current and refresh_after < date '{AS_OF}')")
def due_contacts(spark, d):
    t = Tables(spark, d)
    return retrieval.due_contacts(t.contacts, t.enrichment_log, AS_OF)


@query(f"select id, full_name, closeness_tier, (4 - {N.rank_of('closeness_tier')})::int as priority from contacts where connection_status = 'in_network' and last_enriched_at is null and (github_username is null or twitter_username is null or website_url is null or location is null)")
def enrich_run_queue(spark, d):
    return retrieval.run_queue(Tables(spark, d).contacts)


@query(f"select id, contact_id, field, old_value as old, new_value as new from enrichment_log where field in ('current_company', 'current_role') and created_at >= timestamptz '{SINCE} 00:00:00+00' and old_value <> 'None' and old_value is distinct from new_value")
def job_changes(spark, d):
    return retrieval.job_changes(Tables(spark, d).enrichment_log, SINCE)


_GRAMS = "select name, {g} as grams from (select distinct full_name as name from {t} where full_name is not null)"
SEARCH = "Friederike"
_SIM = "(len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))))"


@query(f"with q as (select {N.trigrams(repr(SEARCH), D)} as q), s as (select id, {N.trigrams('full_name', D)} as g from contacts), r as (select id, {_SIM.format(a='g', b='q')} as score from s, q where len(g) > 0) select id, score from r where score >= 0.3 order by score desc, id limit 10")
def fuzzy_by_name(spark, d):
    return matching.search_name(Tables(spark, d).contacts, SEARCH)


@query(f"with q as (select {N.trigrams(repr(SEARCH), D)} as q), s as (select id, {N.trigrams('full_name', D)} as g from contacts), r as (select id, {_SIM.format(a='g', b='q')} as score from s, q where len(g) > 0), f as (select id from r where score >= 0.3 order by score desc, id limit 10), sub as (select id from contacts where current_company ilike '%{SEARCH}%' or notes ilike '%{SEARCH}%' order by id limit 10) select id from f union select id from sub")
def search(spark, d):
    t = Tables(spark, d)
    texts = t.contacts.filter(retrieval.contains("current_company", SEARCH) | retrieval.contains("notes", SEARCH)).select("id").orderBy("id").limit(10)
    return matching.search_name(t.contacts, SEARCH).select("id").unionByName(texts).distinct()


# --- counts ------------------------------------------------------------------------------------------------------------------------
@query(
    "select 'connection_status=' || connection_status as metric, count(*)::bigint as count from contacts where connection_status is not null group by 1 union all select 'closeness_tier=' || closeness_tier, count(*)::bigint from contacts where closeness_tier is not null group by 1 "
    "union all select 'staging=' || match_status, count(*)::bigint from staging where match_status is not null group by 1 union all select 'touchpoints=' || match_status, count(*)::bigint from staging_interactions where match_status is not null group by 1 union all select 'contacts_total', count(*)::bigint from contacts"
)
def stats_long(spark, d):
    t = Tables(spark, d)
    return stats.coverage(t.contacts, t.staging, t.staging_interactions)


@query(f"select 'current_by_source=' || source as metric, count(*)::bigint as count from enrichment_log where is_current and source is not null group by 1 union all select 'stale', count(*)::bigint from enrichment_log where is_current and refresh_after < date '{AS_OF}' having count(*) > 0")
def enrich_stats(spark, d):
    return stats.enrichment_coverage(Tables(spark, d).enrichment_log, AS_OF)


@query("select 'contacts' as metric, count(*)::bigint as count from contacts union all select 'staging', count(*)::bigint from staging union all select 'interactions', count(*)::bigint from interactions")
def head_counts(spark, d):
    t = Tables(spark, d)
    return stats.head_counts(contacts=t.contacts, staging=t.staging, interactions=t.interactions)


@query("select id, full_name, closeness_tier from contacts where connection_status = 'contact_on_file' and closeness_tier in ('t1_irl_messaging', 't2_dm')")
def sync_status_preview(spark, d):
    return cohort.promotable(Tables(spark, d).contacts)


# --- scalar functions --------------------------------------------------------------------------------------------------------------
def _scalar(name: str, source: str, **build: Callable[[str], str]) -> None:
    """A query of expressions over one table, the same text in both dialects."""

    def run(spark, d, build=build, source=source):
        return table(spark, d, source).select("id", *[F.expr(b("spark")).alias(k) for k, b in build.items()])

    QUERIES[name] = run
    ORACLE[name] = f"select id, {', '.join(f'{b(D)} as {k}' for k, b in build.items())} from {source}"


_scalar("norm_email", "staging", email=lambda d: K.email_key("email", d))
_scalar("norm_phone", "staging", phone=lambda d: N.e164("phone", d))
_scalar("norm_url", "staging", profile=lambda d: N.linkedin_profile("linkedin_url", d), link=lambda d: K.linkedin_key("linkedin_url", d))
_scalar("norm_social", "staging", twitter=lambda d: N.twitter_handle("twitter_username", d), github=lambda d: N.github_handle("github_username", d), handle=lambda d: K.handle_key("handle", d))
_scalar("compose_name", "contacts", composed=lambda d: N.full_name("first_name", "last_name"))
_scalar("unaccent_fold", "staging", folded=lambda d: N.unaccent_lower("full_name", d))
_scalar("trigrams", "contacts", grams=lambda d: ("array_join(array_sort(%s), '|')" if d == "spark" else "array_to_string(list_sort(%s), '|')") % N.trigrams("full_name", d))
_scalar("truncate_notes", "contacts", note=lambda d: N.truncated("notes"))
_scalar("tier_lookup", "interactions", tier=lambda d: N.tier_of("channel"), rank=lambda d: f"cast({N.rank_of(N.tier_of('channel'))} as int)")
_scalar("refresh_after", "enrichment_log", due=lambda d: N.refresh_after("field", "method", "cast(created_at as date)" if d == "spark" else "cast(created_at at time zone 'UTC' as date)"))
_scalar("facet_gate", "enrichment_log", refused=lambda d: N.facet_gate("field", "new_value", "source_detail", d))
_scalar("noreply_login", "staging", login=lambda d: N.noreply_login("concat('17+', split_part(email, '@', 1), '@users.noreply.github.com')", d))
_scalar("hash_ids", "staging", gravatar=lambda d: ("sha2(lower(%s), 256)" if d == "spark" else "sha256(lower(%s))") % K.trimmed("email", d), digest=lambda d: f"substring({'sha2(%s, 256)' if d == 'spark' else 'sha256(%s)'}, 1, 32)" % "concat(source, ':', coalesce(full_name, ''), ':', coalesce(email, ''))")
_scalar("dates_misc", "interactions", apple=lambda d: N.apple_date("cast(date_diff('day', date '2001-01-01', occurred_at) * 86400 as bigint)" if d == D else "cast(datediff(occurred_at, date'2001-01-01') * 86400 as bigint)", d), cold=lambda d: f"occurred_at <= date '{AS_OF}' - interval '180' day", iso=lambda d: K.like("cast(occurred_at as string)" if d == "spark" else "cast(occurred_at as varchar)", "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", d))


@query(f"select id, array_to_string(list_filter(regexp_extract_all(lower(notes), '[a-z0-9][a-z0-9-]+'), lambda w: length(w) >= 3 and w not in ({', '.join(repr(w) for w in sorted(retrieval.STOP_WORDS))})), ' ') as tokens from contacts")
def tokenize(spark, d):
    """The words of every note that a search would look for, in order."""
    stop = ", ".join(repr(w) for w in sorted(retrieval.STOP_WORDS))
    words = F.expr(f"array_join(filter(regexp_extract_all(lower(notes), '[a-z0-9][a-z0-9-]+', 0), w -> length(w) >= 3 and w not in ({stop})), ' ')")
    return Tables(spark, d).contacts.select("id", words.alias("tokens"))


# --- resolution --------------------------------------------------------------------------------------------------------------------
def _pk(kind: str, column: str | None = None) -> str:
    k = K.KEY_BUILDERS[kind](column or kind, D)
    return f"(case when not {K.is_role_email(k, D)} then {k} end)" if kind == "email" else k


_HELD = " union all ".join(f"select {i} as rank, '{m}' as method, key, arg_min(contact_id, (imported_at, id)) as owner from (select *, {_pk(k)} as key from contact_identities) where key is not null group by key" for i, (k, m) in enumerate(matching.EXACT.items()))
_ASKED = " union all ".join(f"select {i} as rank, id, key from (select id, {_pk(k)} as key from staging) where key is not null" for i, k in enumerate(matching.EXACT))
_HITS = f"select a.id, h.owner as contact_id, min(a.rank)::int as rank, arg_min(h.method, a.rank) as method from ({_ASKED}) a join ({_HELD}) h on h.rank = a.rank and h.key = a.key group by 1, 2"


@query(_HITS)
def exact_hits(spark, d):
    t = Tables(spark, d)
    return matching.exact_hits(t.staging, t.contact_identities)


@query(f"select id, arg_min(contact_id, (rank, contact_id)) as contact_id, case when count(*) = 1 then 1.0 else 0.75 end::double as score, case when count(*) = 1 then arg_min(method, (rank, contact_id)) else 'conflicting_keys' end as method from ({_HITS}) group by 1")
def conflict_keys(spark, d):
    t = Tables(spark, d)
    return matching.resolve_exact(matching.exact_hits(t.staging, t.contact_identities))


def _gram_rows(t: str) -> str:
    return f"select name, len(grams) as n, unnest(grams) as gram from ({_GRAMS.format(g=N.trigrams('name', D), t=t)})"


@query(f"with s as ({_gram_rows('staging')}), c as ({_gram_rows('staging')}), i as (select s.name as a, c.name as b, any_value(s.n) as n, any_value(c.n) as m, count(*) as k from s join c on s.gram = c.gram and s.name < c.name group by 1, 2) select a, b, (k / (n + m - k))::double as score from i where k / (n + m - k) >= 0.55")
def name_edges(spark, d):
    return matching.similar_pairs(matching.trigram_table(Tables(spark, d).staging, "full_name"))


@query(
    f"with s as ({_gram_rows('staging')}), c as ({_gram_rows('contacts')}), i as (select s.name as a, c.name as b, any_value(s.n) as n, any_value(c.n) as m, count(*) as k from s join c on s.gram = c.gram group by 1, 2), "
    "p as (select a, b, (k / (n + m - k))::double as score from i where k / (n + m - k) >= 0.55), f as (select full_name as b, min(id) as contact_id from contacts where full_name is not null group by 1) "
    "select name, contact_id, score from (select p.a as name, f.contact_id, p.score, row_number() over (partition by p.a order by p.score desc, f.contact_id) as r from p join f on f.b = p.b) where r = 1"
)
def fuzzy_by_names(spark, d):
    t = Tables(spark, d)
    return matching.best_by_name(t.staging, t.contacts)


_KEY_EDGES = "with recursive links as (" + " union ".join(f"select '{k}:' || key as key, id from (select id, {_pk(k)} as key from staging) where key is not null" for k in ("email", "phone", "linkedin_url", "handle")) + ")"
_KEY_EDGES += ", hubs as (select key, min(id) as hub from links group by 1), e as (select distinct l.id as u, h.hub as v from links l join hubs h using (key) where l.id <> h.hub), b as (select u, v from e union select v, u from e), reach(id, label) as (select u, u from b union select b.v, r.label from reach r join b on b.u = r.id where r.label < b.v)"


@query(f"{_KEY_EDGES} select id, min(label) as label from reach group by 1")
def components(spark, d):
    from kinfold.operators.components import connected_components

    t = Tables(spark, d)
    keyed = matching.key_table(t.staging, "id", ("email", "phone", "linkedin_url", "handle")).select("id", "key")
    hubs = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("_n")).filter("_n > 1")
    linked = lookup_join(keyed, hubs.drop("_n"), "key", hubs.select("key", "_n")).filter("hub is not null")
    return connected_components(linked.select(F.col("id").alias("u"), F.col("hub").alias("v")))


@query()
def target_union(spark, d):
    """Clusters after rows that mean one existing contact are put together."""
    t = Tables(spark, d)
    exact = matching.exact_hits(t.staging, t.contact_identities)
    return matching.clusters(t.staging, exact, matching.best_by_name(t.staging, t.contacts))


@query()
def dedup_plan(spark, d):
    t = Tables(spark, d)
    return matching.plan(t.staging, t.contacts, t.contact_identities)


_ATT = f"select s.*, x.contact_id, row_number() over (order by s.imported_at, s.id) as seq from staging s join (select id, min(contact_id) as contact_id from ({_HITS}) group by 1 having count(*) = 1) x on x.id = s.id where s.match_status = 'pending' or s.match_status is not null"
_LONG = " union all ".join(f"select a.id, a.contact_id, a.imported_at, '{g}' as field, a.{s} as value, nullif(c.{g}, '') as golden from att a join contacts c on c.id = a.contact_id where a.{s} is not null and a.{s} <> ''" for g, s in matching.FILL.items())
_FOLD = (
    f"with att as ({_ATT}), elected as (select distinct contact_id, field, true as cleared from enrichment_log where is_current), l as ({_LONG}), r as (select l.*, coalesce(e.cleared, false) as cleared, first_value(value) over (partition by l.contact_id, l.field order by l.imported_at, l.id) as f, row_number() over (partition by l.contact_id, l.field order by l.imported_at, l.id) as k from l left join elected e on e.contact_id = l.contact_id and e.field = l.field), "
    "s as (select *, coalesce(golden, case when not cleared and k > 1 then f end) as stands from r) select id, contact_id, field, value, case when stands is null and not cleared then 'fill' when stands is null then 'conflict' when stands <> value then 'conflict' end as kind from s"
)


def _folded(spark, d) -> DataFrame:
    t = Tables(spark, d)
    one = matching.exact_hits(t.staging, t.contact_identities).groupBy("id").agg(F.count("*").alias("n"), F.min("contact_id").alias("contact_id")).filter("n = 1").drop("n")
    attached = t.staging.withColumn("seq", F.unix_micros("imported_at")).join(one, "id")
    return matching.fold(attached, t.contacts, t.enrichment_log.filter("is_current"))


@query(f"select * from ({_FOLD}) where kind = 'fill'")
def fold_fills(spark, d):
    return _folded(spark, d).filter("kind = 'fill'")


@query(f"select * from ({_FOLD}) where kind = 'conflict'")
def fold_conflicts(spark, d):
    return _folded(spark, d).filter("kind = 'conflict'")


@query("select id as create_key, field, value as new_value, source from (" + " union all ".join(f"select id, source, '{g}' as field, {s} as value from staging where match_status = 'merged'" for g, s in {"full_name": "full_name", **matching.FILL}.items()) + ") where value is not null and value <> ''")
def birth_rows(spark, d):
    t = Tables(spark, d)
    return matching.birth_rows(t.staging.select("id", "match_status", F.col("id").alias("ref")), t.staging.drop("match_status"))


# --- touchpoints -------------------------------------------------------------------------------------------------------------------
def _tk(kind: str) -> str:
    return K.KEY_BUILDERS[kind](kind, D)


_OWNERS = " union all ".join(f"select '{k}:' || key as key, arg_min(contact_id, (imported_at, id)) as owner from (select *, {_tk(k)} as key from contact_identities) where key is not null group by 1" for k in touchpoints.MATCH_KEYS)
_TASK = " union all ".join(f"select {i} as rank, id, '{k}:' || key as key from (select id, {_tk(k)} as key from staging_interactions) where key is not null" for i, k in enumerate(touchpoints.MATCH_KEYS))
_LINK = f"select s.id, m.contact_id from staging_interactions s left join (select a.id, arg_min(o.owner, a.rank) as contact_id from ({_TASK}) a join ({_OWNERS}) o on o.key = a.key where o.owner is not null group by 1) m on m.id = s.id"


@query(_LINK)
def backfill_match(spark, d):
    t = Tables(spark, d)
    return touchpoints.link(t.staging_interactions, t.contact_identities)


@query(f"select s.source, case when l.contact_id is null then 'orphaned' else 'linked' end as outcome, count(*)::bigint as rows from staging_interactions s join ({_LINK}) l on l.id = s.id group by 1, 2")
def backfill_outcomes(spark, d):
    t = Tables(spark, d)
    return touchpoints.outcomes(t.staging_interactions, touchpoints.link(t.staging_interactions, t.contact_identities))


@query("select event_name as name, cast(imported_at at time zone 'UTC' as date) as day, arg_min_null(event_location, (imported_at, id)) as location from staging_interactions where event_name is not null group by 1, 2")
def occasions(spark, d):
    return touchpoints.occasions_of(Tables(spark, d).staging_interactions)


_LAST = "select contact_id, occurred_at, channel, summary from (select *, row_number() over (partition by contact_id order by occurred_at desc, created_at desc, id desc) as k from interactions where occurred_at is not null and contact_id is not null) where k = 1"
_TIER = f"select contact_id, max({N.rank_of(N.tier_of('channel'))})::int as rank from interactions where contact_id is not null group by 1"


@query(_LAST)
def recompute_last(spark, d):
    return touchpoints.latest_touch(Tables(spark, d).interactions)


@query(_TIER)
def recompute_tier(spark, d):
    return touchpoints.best_tier(Tables(spark, d).interactions)


_TIERS = " ".join(f"when t.rank = {r} then '{x}'" for x, r in N.TIER_RANK.items())


@query(
    f"select c.id, case when l.contact_id is not null then l.occurred_at when t.rank is not null then c.last_touchpoint_at end as last_touchpoint_at, case when l.contact_id is not null then l.channel when t.rank is not null then c.last_touchpoint_channel end as last_touchpoint_channel, "
    f"case when l.contact_id is not null then l.summary when t.rank is not null then c.last_touchpoint_topic end as last_touchpoint_topic, case when t.rank > {N.rank_of('c.closeness_tier')} then case {_TIERS} end else c.closeness_tier end as closeness_tier from contacts c left join ({_LAST}) l on l.contact_id = c.id left join ({_TIER}) t on t.contact_id = c.id"
)
def recompute_contacts(spark, d):
    t = Tables(spark, d)
    return touchpoints.recompute(t.contacts, t.interactions).select("id", "last_touchpoint_at", "last_touchpoint_channel", "last_touchpoint_topic", "closeness_tier")


def _payload(t: Tables) -> DataFrame:
    """Staged touchpoints linked to their contacts, in the shape of interactions."""
    linked = touchpoints.link(t.staging_interactions, t.contact_identities).filter("contact_id is not null")
    s = t.staging_interactions.join(linked, "id")
    return s.select("id", "contact_id", F.lit(None).cast("string").alias("event_id"), "kind", "channel", F.to_date("imported_at").alias("occurred_at"), "summary", F.lit("importer").alias("logged_by"), F.col("imported_at").alias("created_at"), F.col("imported_at").alias("updated_at"), "source", "source_external_id")


_FRESH = f"select * from (select s.id, l.contact_id, s.kind, cast(s.imported_at at time zone 'UTC' as date) as occurred_at, s.summary, s.source, s.source_external_id, row_number() over (partition by s.source, s.source_external_id order by s.imported_at desc, s.id desc) as k from staging_interactions s join ({_LINK}) l on l.id = s.id where l.contact_id is not null) where k = 1 or source_external_id is null"


@query(
    f"with f as ({_FRESH}) select i.id, case when f.id is not null then f.contact_id else i.contact_id end as contact_id, i.kind, case when f.id is not null then f.occurred_at else i.occurred_at end as occurred_at, case when f.id is not null then f.summary else i.summary end as summary from interactions i left join f on f.source = i.source and f.source_external_id = i.source_external_id "
    "union all select f.id, f.contact_id, f.kind, f.occurred_at, f.summary from f where not exists (select 1 from interactions i where i.source = f.source and i.source_external_id = f.source_external_id)"
)
def upsert_interactions(spark, d):
    t = Tables(spark, d)
    return touchpoints.upsert_interactions(t.interactions, _payload(t))[0].select("id", "contact_id", "kind", "occurred_at", "summary")


@query("select distinct i.contact_id from interactions i join (select id, first_value(id) over (partition by lower(full_name) order by id) as first from contacts where full_name is not null) p on p.id = i.contact_id where p.id <> p.first and i.source is not null and i.source_external_id is not null and (i.source, i.source_external_id) in (select (source, source_external_id) from interactions where source is not null and source_external_id is not null)")
def moved_contacts(spark, d):
    """Contacts that lose touchpoints when those of namesakes are delivered again for the first of the name."""
    t = Tables(spark, d)
    again = cohort.rekey(t.interactions.filter("source is not null and source_external_id is not null"), _same_name(t))
    return touchpoints.upsert_interactions(t.interactions, again)[1]


@query(f"select c.id, case when l.occurred_at is not null and (c.last_touchpoint_at is null or c.last_touchpoint_at < l.occurred_at) then l.occurred_at else c.last_touchpoint_at end as last_touchpoint_at, case when l.occurred_at is not null and (c.last_touchpoint_at is null or c.last_touchpoint_at < l.occurred_at) then l.channel else c.last_touchpoint_channel end as channel, coalesce(l.occurred_at is not null and (c.last_touchpoint_at is null or c.last_touchpoint_at < l.occurred_at), false) as bumped from contacts c left join ({_LAST}) l on l.contact_id = c.id")
def bump_touchpoint(spark, d):
    t = Tables(spark, d)
    return touchpoints.bump(t.contacts, touchpoints.latest_touch(t.interactions))


@query(f"select {_tk('handle')} as handle, count(*)::bigint as messages, max(cast(imported_at at time zone 'UTC' as date)) as last_day from staging_interactions where {_tk('handle')} is not null group by 1")
def message_rollup(spark, d):
    staged = Tables(spark, d).staging_interactions.select(F.expr(K.handle_key("handle")).alias("handle"), F.to_date("imported_at").alias("day"))
    return touchpoints.message_rollup(staged, "handle", "day")


# --- survivorship ------------------------------------------------------------------------------------------------------------------
_LIVE = "select * from enrichment_log e where verification_status is distinct from 'disputed' and not exists (select 1 from enrichment_log d where d.contact_id = e.contact_id and d.field = e.field and d.verification_status = 'disputed' and d.new_value is not distinct from e.new_value)"


@query(f"select contact_id, field, id as winner_id, new_value as value from (select *, row_number() over (partition by contact_id, field order by case when method = 'manual_set' then 0 else 1 end, created_at desc, coalesce(confidence, 0.4) desc, id desc) as k from ({_LIVE})) where k = 1")
def elect_winner(spark, d):
    return survivorship.elect(Tables(spark, d).enrichment_log)


def _candidates(t: Tables) -> DataFrame:
    """Newer half of the log as a batch of candidates on the older half."""
    return t.enrichment_log.filter("field <> '_merge' and created_at >= timestamp'2025-06-01 00:00:00'").select("id", "contact_id", "field", F.col("new_value").alias("value"), "source", "method", "confidence", F.struct("created_at", "id").alias("seq"))


_OLD = "select * from enrichment_log where created_at < timestamptz '2025-06-01 00:00:00+00'"


@query(
    f"with old as ({_OLD}), c as (select *, new_value as value from enrichment_log where field <> '_merge' and created_at >= timestamptz '2025-06-01 00:00:00+00'), "
    "f as (select c.*, exists (select 1 from old o where o.contact_id = c.contact_id and o.field = c.field and o.verification_status = 'disputed' and o.new_value is not distinct from c.value) as disputed, exists (select 1 from old o where o.contact_id = c.contact_id and o.field = c.field and o.new_value is not distinct from c.value and o.source = c.source) as known, "
    "exists (select 1 from old o where o.contact_id = c.contact_id and o.field = c.field and o.is_current and o.method = 'manual_set') as manual_before from c), "
    "g as (select *, disputed and method is distinct from 'manual_set' as lost from f), h as (select *, known or (source is not null and row_number() over (partition by contact_id, field, value, source, lost order by created_at, id) > 1) as repeat from g), "
    "m as (select *, manual_before or coalesce(bool_or(method = 'manual_set' and not repeat and not disputed) over (partition by contact_id, field order by created_at, id rows between unbounded preceding and 1 preceding), false) as manual_now from h) "
    "select id, case when field in ('tags', 'affiliations', 'expertise', 'interests') then 'noop' when lost then 'losing' when repeat then 'noop' when method = 'manual_set' then 'golden' when manual_now then 'review' when coalesce(confidence, 0) >= 0.7 then 'golden' else 'review' end as outcome from m"
)
def arbitrate_batch(spark, d):
    t = Tables(spark, d)
    return survivorship.arbitrate(_candidates(t), t.enrichment_log.filter("created_at < timestamp'2025-06-01 00:00:00'"))


def _tag_candidates(t: Tables) -> DataFrame:
    return t.enrichment_log.filter("contact_id is not null").select("id", "contact_id", F.expr("case when field = 'current_role' then 'mentor' when field = 'location' then ' ' else field end").alias("value"))


@query(
    "with c as (select id, contact_id, case when field = 'current_role' then 'mentor' when field = 'location' then ' ' else field end as value from enrichment_log where contact_id is not null), j as (select c.*, g.tags, row_number() over (partition by c.contact_id, c.value order by c.id) as k from c join contacts g on g.id = c.contact_id) "
    "select id, contact_id, value, case when value is null or trim(value) = '' then 'noop' when exists (select 1 from enrichment_log d where d.contact_id = j.contact_id and d.field = 'tags' and d.verification_status = 'disputed' and d.new_value = j.value) then 'tombstoned' when list_contains(tags, value) or k > 1 then 'already' else 'added' end as outcome from j"
)
def array_apply(spark, d):
    t = Tables(spark, d)
    return survivorship.apply_array(_tag_candidates(t), t.contacts, t.enrichment_log, "tags")


@query("select id, array_to_string(list_sort(list_filter(list_distinct(coalesce(tags, [])), lambda x: x <> 'mentor' and x <> 'vip')), '|') as values from contacts")
def array_reject(spark, d):
    t = Tables(spark, d)
    rejected = t.contacts.select(F.col("id").alias("contact_id"), F.explode(F.array(F.lit("mentor"), F.lit("vip"))).alias("value"))
    return survivorship.reject_array(t.contacts, rejected, "tags").select("id", F.array_join(F.array_sort("values"), "|").alias("values"))


SEEDED = {"current_company": "current_company", "current_role": "current_position", "location": "location", "company_category": "company_category", "company_domain": "company_domain", "github_username": "github_username", "twitter_username": "twitter_username", "website_url": "website_url"}


@query(
    "with l as (" + " union all ".join(f"select id as contact_id, '{f}' as field, {c} as new_value from contacts" for f, c in SEEDED.items()) + "), s as (select contact_id, field, bool_or(coalesce(is_current, false)) as cur, bool_or(method = 'manual_set') as man from enrichment_log group by 1, 2) "
    "select l.contact_id, l.field, l.new_value, case when man then 'owner' else 'legacy' end as source, case when man then 1.0 else 0.8 end::double as confidence, case when man then 'manual_set' else 'legacy_import' end as method from l left join s on s.contact_id = l.contact_id and s.field = l.field where l.new_value is not null and not coalesce(cur, false)"
)
def seed_provenance(spark, d):
    t = Tables(spark, d)
    return survivorship.seed(t.contacts, t.enrichment_log, SEEDED)


@query(
    f"with h as (select {K.email_key('email', D)} as key, count(distinct contact_id) as n, min(contact_id) as owner from contact_identities group by 1), c as (select id, matched_contact_id as contact_id, {K.email_key('email', D)} as key from staging) "
    "select c.id, case when c.key is null then 'noop' when h.n is null then 'quarantine' when h.n = 1 and h.owner = c.contact_id then 'noop' else 'review' end as outcome from c left join h on h.key = c.key"
)
def identifier_route(spark, d):
    t = Tables(spark, d)
    asked = t.staging.select("id", F.col("matched_contact_id").alias("contact_id"), F.col("email").alias("value"))
    return survivorship.route_identifiers(asked, t.contact_identities, "email", K.email_key("value"))


# --- cohorts -----------------------------------------------------------------------------------------------------------------------
@query(f"select distinct id from contacts where connection_status = 'in_network' and {COLD}")
def cohort_ids(spark, d):
    return cohort.cohort(Tables(spark, d).contacts, retrieval.contact_filter(status="in_network", cold_months=6, as_of=AS_OF))


@query("select id, array_to_string(list_sort(list_append(coalesce(tags, []), 'mentor')), '|') as tags from contacts where closeness_tier = 't2_dm' and not list_contains(coalesce(tags, []), 'mentor')")
def bulk_add_tag(spark, d):
    t = Tables(spark, d)
    ids = cohort.cohort(t.contacts, retrieval.contact_filter(tier="t2_dm"))
    return cohort.add_tag(t.contacts, ids, "mentor").select("id", F.array_join("tags", "|").alias("tags"))


@query("select id, company_category as old, 'media' as new, company_category is distinct from 'media' as changes from contacts where connection_status = 'in_network'")
def bulk_set_preview(spark, d):
    t = Tables(spark, d)
    return cohort.set_preview(t.contacts, cohort.cohort(t.contacts, retrieval.contact_filter(status="in_network")), "company_category", "media")


_PAIRS = "select first as keep_id, id as drop_id from (select id, first_value(id) over (partition by lower(full_name) order by id) as first from contacts where full_name is not null) where id <> first"


def _same_name(t: Tables) -> DataFrame:
    """(keep_id, drop_id): of contacts of one name, the one with the smallest id and each other one."""
    named = t.contacts.filter("full_name is not null").select(F.lower("full_name").alias("low"), "id")
    kept = named.groupBy("low").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return named.join(kept, "low").filter("id <> keep_id").select("keep_id", F.col("id").alias("drop_id"))


def _union(c: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_concat(coalesce(k.{c}, []), coalesce(x.{c}, [])))), '|') as {c}"


@query(
    f"with p as ({_PAIRS}) select p.keep_id, p.drop_id, " + ", ".join(f"coalesce(nullif(k.{c}, ''), nullif(x.{c}, ''), k.{c}) as {c}" for c in ("current_position", "current_company", "location", "origin_context"))
    + f", {_union('tags')}, {_union('affiliations')}, case when coalesce(x.notes, '') = '' then k.notes else coalesce(k.notes, '') || case when coalesce(k.notes, '') = '' then '' else chr(10) end || '[merged from ' || coalesce(x.full_name, '') || '] ' || x.notes end as notes, "
    f"case when {N.rank_of('x.closeness_tier')} > {N.rank_of('k.closeness_tier')} then x.closeness_tier else k.closeness_tier end as closeness_tier, case when x.connection_status = 'in_network' then 'in_network' else k.connection_status end as connection_status from p join contacts k on k.id = p.keep_id join contacts x on x.id = p.drop_id"
)
def merge_pairs(spark, d):
    t = Tables(spark, d)
    return cohort.merge_pairs(t.contacts, _same_name(t))


@query(f"with p as ({_PAIRS}) select i.id, coalesce(p.keep_id, i.contact_id) as contact_id from interactions i left join p on p.drop_id = i.contact_id")
def merge_rekey(spark, d):
    t = Tables(spark, d)
    return cohort.rekey(t.interactions, _same_name(t)).select("id", "contact_id")


@query(f"select id, contact_id from contact_identities where not exists (select 1 from ({_PAIRS}) p where p.drop_id = contact_id)")
def delete_cascade(spark, d):
    t = Tables(spark, d)
    return cohort.delete_cascade(t.contact_identities, _same_name(t).select(F.col("drop_id").alias("id"))).select("id", "contact_id")


@query(
    "with w as (select max(id) as id from contact_identities group by contact_id having count(*) > 1), n as (select source, source_external_id, min(full_name) as full_name from staging where source_external_id is not null group by 1, 2) "
    "select i.id as identity_id, i.contact_id as old_contact_id, sha256('split|' || i.id) as new_contact_id, coalesce(n.full_name, 'UNKNOWN') as full_name from contact_identities i join w on w.id = i.id left join n on n.source = i.source and n.source_external_id = i.source_external_id"
)
def split_identity(spark, d):
    t = Tables(spark, d)
    which = t.contact_identities.groupBy("contact_id").agg(F.max("id").alias("identity_id"), F.count("*").alias("n")).filter("n > 1")
    return cohort.split_identities(t.contact_identities, t.staging, which.select("identity_id"))


@query("select s.id, s.full_name, s.match_method, s.match_confidence, coalesce(c.full_name, '') as target, coalesce(k.emails, '') as emails from staging s left join contacts c on c.id = s.matched_contact_id left join (select contact_id, string_agg(email, '|' order by email) as emails from (select distinct contact_id, email from contact_identities where email is not null) group by 1) k on k.contact_id = s.matched_contact_id where s.match_status in ('needs_review', 'auto_matched')")
def review_display(spark, d):
    t = Tables(spark, d)
    mails = t.contact_identities.filter("email is not null").groupBy(F.col("contact_id").alias("matched_contact_id")).agg(F.array_join(F.array_sort(F.collect_set("email")), "|").alias("emails"))
    names = t.contacts.select(F.col("id").alias("matched_contact_id"), F.col("full_name").alias("target"))
    queue = t.staging.filter(F.col("match_status").isin("needs_review", "auto_matched"))
    return queue.join(names, "matched_contact_id", "left").join(mails, "matched_contact_id", "left").select("id", "full_name", "match_method", "match_confidence", F.coalesce("target", F.lit("")).alias("target"), F.coalesce("emails", F.lit("")).alias("emails"))


# --- sources and streams -----------------------------------------------------------------------------------------------------------
@query("select id, field, value, confidence, case when field is null or field = '' then 'no_field' when confidence < 0 or confidence > 1 then 'bad_confidence' else 'ok' end as verdict, case when field in ('email', 'linkedin_url', 'phone', 'handle') then 'identifier' else 'attribute' end as kind from (select id, field, new_value as value, confidence from enrichment_log)")
def payload_validate(spark, d):
    from kinfold.sources.payload import parse_payloads

    log = Tables(spark, d).enrichment_log
    packed = log.select("id", F.to_json(F.struct("field", F.col("new_value").alias("value"), "confidence")).alias("payload"))
    return parse_payloads(packed, "id", "payload").select("id", "field", "value", "confidence", "verdict", "kind")


@query()
def csv_roundtrip(spark, d):
    """Staged people written as CSV and imported again through a header mapping."""
    from kinfold.sources.people import import_people
    from kinfold.session import shared_folder

    people = Tables(spark, d).staging.select(F.regexp_replace("full_name", r"[\r\n]", " ").alias("Name"), F.col("email").alias("Email"), F.col("company").alias("Firm"), F.col("phone").alias("Phone"))
    path = f"{shared_folder(spark)}/csv-roundtrip-{abs(hash(d))}"
    people.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return import_people(spark, path, "csv_roundtrip", {"full_name": "Name", "email": "Email", "company": "Firm", "phone": "Phone"}).select("source", "source_external_id", "full_name", "email", "phone", "company")


@query()
def stream_backfill(spark, d):
    """Staged touchpoints linked as a stream of micro-batches."""
    from kinfold.streaming.backfill import run_available

    return run_available(spark, f"{d}/staging_interactions.parquet", table(spark, d, "contact_identities")).select("id", "contact_id", "match_status")
