"""Queries p4 to p10 over whole tables, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import keys as K
from kinfold.llm import components, packing, people, reading, retrieval, survivors, tokenizer
from kinfold.operators.skew import lookup_join
from kinfold.session import cut, table

DUCK = "duckdb"


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every staging row linked to another one, with the smallest id of its group."""
    return components.card_groups(table(spark, sf_dir, "staging"))


FIELDS = ("role", "company", "location")


def _staging_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_key, field_name, value, rows, last, by trust rank ...) one row per distinct value of a group and field."""
    staging, feeds = table(spark, sf_dir, "staging"), table(spark, sf_dir, "feed_sources")
    ranks = feeds.groupBy("source").agg(F.min("trust_rank").alias("rank"))
    groups = components.card_groups(staging)
    ranked = staging.select(F.col("id").alias("row_id"), "source", "imported_at", *[F.expr(f"case when not {K.is_blank(f)} then {K.trimmed(f)} end").alias(f) for f in FIELDS]).join(F.broadcast(ranks), "source", "left").drop("source")
    rows = groups.join(ranked, "row_id")
    long = rows.select("row_id", F.col("group_id").alias("group_key"), F.coalesce("rank", F.lit(1 << 30)).alias("rank"), "imported_at", F.explode(F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.col(f))])).alias("field_name", "value")).filter("value is not null")
    return long.groupBy("group_key", "field_name", "value").agg(F.count("*").alias("n"), F.max(F.struct("imported_at", "row_id")).alias("last"), F.max_by(F.struct("rank", "imported_at", "row_id"), F.struct(-F.col("rank"), F.col("imported_at"), F.col("row_id"))).alias("t")).select("group_key", "field_name", "value", "n", "last", F.struct("t.rank", (-F.unix_micros("t.imported_at")).alias("back"), F.expr("translate(t.row_id, '0123456789abcdef', 'fedcba9876543210')").alias("tie")).alias("trusted"))


GF = ["group_key", "field_name"]


def _weighted(values: DataFrame, summary: DataFrame) -> DataFrame:
    """Values with weights: a value weighs its rows; being the newest adds half of all rows of the group, being the best trusted (in
    staging the newest of the most trusted source, in the log the most confident) as much. Only a value that is both outweighs any
    others; a value that is one of them can lose to what most rows say. summary: (group_key, field_name, rows, n_values, newest, best)."""
    keyed = lookup_join(values.select(*GF, "value", "n"), summary.select(*GF, "rows", "newest", "best"), GF, summary.select(*GF, F.col("n_values").alias("_n")))
    praise = (F.col("value") == F.col("newest")).cast("int") + F.coalesce(F.col("value") == F.col("best"), F.lit(False)).cast("int")
    return keyed.select(*GF, "value", (F.col("n") + praise * (F.col("rows") + 1) / 2).cast("double").alias("weight"))


def _staging_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Values of the groups, and (group_key, field_name, rows, n_values, newest, best)."""
    values = cut(_staging_values(spark, sf_dir))
    return values, values.groupBy(*GF).agg(F.sum("n").alias("rows"), F.count("*").alias("n_values"), F.max_by("value", "last").alias("newest"), F.min_by("value", "trusted").alias("best"))


def _log_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Values of the usable rows, and per pair what _staging_groups gives, the latest usable row, whether it leads alone in confidence
    and whether the flag is on it alone. Rows combine map-side per pair and value, so a hot pair costs one row per partition and value."""
    log = table(spark, sf_dir, "enrichment_log").filter("contact_id is not null and field is not null and field <> '_merge'")
    log = log.select(
        "id", F.col("contact_id").alias("group_key"), F.col("field").alias("field_name"), F.expr(K.trimmed("new_value")).alias("value"), "created_at", F.coalesce("confidence", F.lit(0.4)).alias("conf"),
        F.expr(f"not {K.is_blank('new_value')} and redacted_at is null and not (verification_status <=> 'disputed')").alias("usable"), F.coalesce("is_current", F.lit(False)).alias("cur"), F.xxhash64("id").alias("h"),
    )
    # the highest confidence is one row's alone where the largest and the smallest hash of its rows are the same
    per_value = cut(
        log.groupBy(*GF, F.when(F.col("usable"), F.col("value")).alias("value"), "usable").agg(
            F.count("*").alias("n"), F.max(F.struct("created_at", "conf", "id")).alias("last"), F.max(F.struct("conf", "h")).alias("top"), F.max(F.struct("conf", (-F.col("h")).alias("h"))).alias("top_low"),
            F.sum(F.col("cur").cast("int")).alias("current"), F.max(F.when(F.col("cur"), F.col("id"))).alias("current_id"),
        )
    )
    used = F.col("usable")
    pair = (
        per_value.groupBy(*GF).agg(
            F.max(F.when(used, F.col("last"))).alias("latest"), F.max(F.when(used, F.col("top"))).alias("top"), F.max(F.when(used, F.col("top_low"))).alias("top_low"), F.sum("current").alias("current"), F.max("current_id").alias("current_id"),
            F.sum(F.when(used, F.col("n"))).alias("rows"), F.count(F.when(used, 1)).alias("n_values"), F.max_by("value", F.when(used, F.col("last"))).alias("newest"), F.max_by("value", F.when(used, F.col("top"))).alias("best"),
        ).filter("latest is not null")
        .select(*GF, "rows", "n_values", "newest", "best", F.col("latest.id").alias("latest_id"),
                F.expr("top.conf = latest.conf and top.h = xxhash64(latest.id) and top.h = -top_low.h").alias("leads"), F.expr("current = 1 and current_id = latest.id").alias("flagged"))
    )
    return per_value.filter("usable"), pair


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors of the groups whose newest and most trusted values agree, and of the log pairs whose flag is not on their one good row.

    Both scopes go through one consensus, their group keys marked with the scope."""
    values, groups = _staging_groups(spark, sf_dir)
    logged, pairs = _log_pairs(spark, sf_dir)

    def scoped(df: DataFrame, scope: str) -> DataFrame:
        return df.withColumn("group_key", F.concat(F.lit(scope + "|"), "group_key"))

    every = scoped(values.select(*GF, "value", "n"), "staging").unionByName(scoped(logged.select(*GF, "value", "n"), "log"))
    summary = cut(scoped(groups, "staging").unionByName(scoped(pairs, "log"), allowMissingColumns=True))
    kept = survivors.consensus(_weighted(every, summary)).join(summary.drop("rows"), GF)
    good = kept.filter("survivor = newest and case when latest_id is null then n_values > 1 and newest = best else leads and not flagged end")
    return good.select(F.split_part("group_key", F.lit("|"), F.lit(1)).alias("scope"), F.expr("substring(group_key, instr(group_key, '|') + 1)").alias("group_key"), "field_name", F.coalesce("latest_id", "survivor").alias("survivor"))


def p7_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving value of every group and field of staging."""
    values, groups = _staging_groups(spark, sf_dir)
    return survivors.consensus(_weighted(values, cut(groups))).select("group_key", "field_name", "survivor", "distance")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return tokenizer.encode_corpus(table(spark, sf_dir, "documents"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staging rows and the contact their differently spelled name means."""
    staging, contacts = table(spark, sf_dir, "staging"), table(spark, sf_dir, "contacts")
    linked = people.link_variants(staging, contacts, table(spark, sf_dir, "contact_identities"))
    return linked.filter("not same").select("staging_id", "contact_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of staging rows of different sources that mean the same one without an identifier in common."""
    return p6_matches(spark, sf_dir).select("id_a", "id_b")


def p6_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of p6_found with their confidence."""
    return retrieval.match_sources(table(spark, sf_dir, "staging"))


#: Tokens a container of problem 9 holds.
CAPACITY = 2048


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, chunk, size, container_id): every document's tokens in containers of 2,048."""
    docs = table(spark, sf_dir, "documents").select("doc_id", tokenizer.size_column("text").alias("tokens"))
    return packing.fill_containers(docs, "doc_id", "tokens", CAPACITY).withColumnRenamed("item_id", "doc_id")


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, sentences, level, unfamiliar, sentence_words) of every document."""
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_samples"))


#: From here on a level is nearer to grade 4 than to grade 3.
DEMANDING = 3.5


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of three or more sentences of prose at grade 4 or 5."""
    return p10_levels(spark, sf_dir).filter((F.col("sentences") >= 3) & (F.col("level") >= DEMANDING)).select("doc_id")


QUERIES = {f.__name__: f for f in (p4_found, p5_found, p6_found, p6_matches, p7_found, p7_survivors, p8_ids, p9_containers, p10_found, p10_levels)}


def _sql_groups() -> str:
    email = K.email_key("email", DUCK)
    cols = f"select 'e:' || k as key, id from (select id, {email} as k from staging) where k is not null and not {K.is_role_email('k', DUCK)}"
    for c in ("phone", "linkedin_url", "handle"):
        cols += f" union all select '{c}:' || k as key, id from (select id, {K.KEY_BUILDERS[c](c, DUCK)} as k from staging) where k is not null"
    return f"""with recursive links as (select distinct key, id from ({cols})), hubs as (select key, min(id) as hub from links group by 1 having count(*) > 1),
 edges as (select distinct l.id as u, h.hub as v from links l join hubs h using (key) where l.id <> h.hub),
 both_ways as (select u, v from edges union select v, u from edges),
 reach(id, label) as (select u, u from both_ways union select b.v, r.label from reach r join both_ways b on b.u = r.id where r.label < b.v),
 least_labels as (select id, min(label) as group_id from reach group by 1)"""


def _sql_survivors() -> str:
    rows = " union all ".join(f"select l.group_id as group_key, '{f}' as field_name, {K.trimmed('s.' + f, DUCK)} as value, s.imported_at, s.id, coalesce(r.rank, {1 << 30}) as rank from staging s join least_labels l on l.id = s.id left join ranks r on r.source = s.source where not {K.is_blank('s.' + f, DUCK)}" for f in FIELDS)
    usable = f"not {K.is_blank('new_value', DUCK)} and redacted_at is null and verification_status is distinct from 'disputed'"
    return f"""{_sql_groups()}, ranks as (select source, min(trust_rank) as rank from feed_sources group by 1), vals as ({rows}),
 firsts as (select *, row_number() over (partition by group_key, field_name order by imported_at desc, id desc) as newest, row_number() over (partition by group_key, field_name order by rank, imported_at desc, id desc) as best from vals),
 agreed as (select group_key, field_name, max(case when newest = 1 then value end) as n, max(case when best = 1 then value end) as b from firsts group by 1, 2 having count(distinct value) > 1),
 logged as (select *, coalesce(confidence, 0.4) as conf, coalesce(is_current, false) as cur, {usable} as usable from enrichment_log where contact_id is not null and field is not null and field <> '_merge'),
 latest as (select *, row_number() over (partition by contact_id, field order by created_at desc, conf desc, id desc) as k from logged where usable)
 select 'staging' as scope, group_key, field_name, n as survivor from agreed where n = b
 union all select 'log', l.contact_id, l.field, l.id from latest l where k = 1 and not exists (select 1 from latest o where o.contact_id = l.contact_id and o.field = l.field and o.k > 1 and o.conf >= l.conf)
 and not (l.cur and (select count(*) from logged c where c.contact_id = l.contact_id and c.field = l.field and c.cur) = 1)"""


ORACLE = {
    "p4_found": f"{_sql_groups()} select id as row_id, group_id from least_labels",
    "p7_found": _sql_survivors(),
}
