"""Importers of people and dated touchpoints: CSV files, network exports, address books and message stores."""

from __future__ import annotations

import codecs
import io
import os
import sqlite3
import zipfile
from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.functions import keys as K
from kinfold.functions import normalize as N

MAPPABLE = ("full_name", "first_name", "last_name", "email", "phone", "linkedin_url", "handle", "role", "company", "location", "twitter_username", "github_username", "website_url")
TOUCH_FIELDS = ("email", "phone", "handle", "linkedin_url", "occurred_at", "summary", "event_name", "event_location", "kind", "channel")
# Kinds of touchpoints.
KINDS = ("event", "meeting", "call", "email", "message", "dm", "note", "origin")
#: Largest member of a zip that is unpacked.
MOST_UNPACKED = 200 << 20


class MappingError(ValueError):
    """A header mapping that is malformed or names unknown fields or headers."""


def parse_mapping(text: str, allowed: tuple[str, ...] = MAPPABLE) -> dict[str, str]:
    """field=Header pairs joined by commas."""
    out = {}
    for part in text.split(","):
        field, eq, header = part.partition("=")
        if not eq or not field.strip() or not header.strip():
            raise MappingError(f"not field=Header: {part!r}")
        out[field.strip()] = header.strip()
    if unknown := sorted(set(out) - set(allowed)):
        raise MappingError(f"unknown fields: {unknown}")
    return out


def encoding_of(path: str, block: int = 1 << 20) -> str:
    """UTF-8 when the whole of a local file reads as such, Latin-1 otherwise; folders and remote paths are UTF-8."""
    if not os.path.isfile(path):
        return "UTF-8"
    decoder = codecs.getincrementaldecoder("utf-8")("strict")
    try:
        with open(path, "rb") as f:
            while data := f.read(block):
                decoder.decode(data)
        decoder.decode(b"", True)
        return "UTF-8"
    except UnicodeDecodeError:
        return "ISO-8859-1"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; quotes may span lines; the byte-order mark is not part of the first header."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding_of(path)).csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def _first_of(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_k = 1").drop("_k")


def stage_people(df: DataFrame, source: str, mapping: dict[str, str]) -> DataFrame:
    """Rows in the shape of staging: values trimmed, keys canonical, the id a digest of the whole record; nameless rows and repeats
    of a record are left out."""
    if missing := sorted(set(mapping.values()) - set(df.columns)):
        raise MappingError(f"headers not found: {missing}")
    value = {f: F.expr(f"nullif({K.trimmed(f'`{h}`')}, '')") for f, h in mapping.items()}
    raw = df.select(*[F.col(f"`{c}`") for c in df.columns]).withColumn("raw_json", F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}))
    named = raw.select("raw_json", *[value.get(f, F.lit(None).cast("string")).alias(f) for f in MAPPABLE])
    named = named.withColumn("full_name", F.coalesce("full_name", F.expr(N.full_name("first_name", "last_name")))).filter("full_name is not null")
    out = named.select(
        F.lit(source).alias("source"), F.substring(F.sha2("raw_json", 256), 1, 32).alias("source_external_id"), "full_name", F.expr(K.email_key("email")).alias("email"), F.expr(N.e164("phone")).alias("phone"),
        F.expr(N.linkedin_profile("linkedin_url")).alias("linkedin_url"), "handle", "role", "company", "location", F.expr(N.twitter_handle("twitter_username")).alias("twitter_username"), F.expr(N.github_handle("github_username")).alias("github_username"), "website_url", "raw_json", F.lit("pending").alias("match_status"),
    )
    return out.dropDuplicates(["source", "source_external_id"])


def import_people(spark: SparkSession, path: str, source: str, mapping: dict[str, str]) -> DataFrame:
    return stage_people(read_csv(spark, path), source, mapping)


def stage_touchpoints(df: DataFrame, source: str, mapping: dict[str, str], kind: str = "note", channel: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(staged touchpoints, skipped rows with a reason): no usable key, a date that is no ISO date, or an unknown kind."""
    if missing := sorted(set(mapping.values()) - set(df.columns)):
        raise MappingError(f"headers not found: {missing}")
    raw = df.withColumn("raw_json", F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}))
    v = raw.select("raw_json", *[(F.expr(f"nullif({K.trimmed(f'`{mapping[f]}`')}, '')") if f in mapping else F.lit(None).cast("string")).alias(f) for f in TOUCH_FIELDS])
    v = v.withColumns({"email": F.expr(K.email_key("email")), "phone": F.expr(N.e164("phone")), "linkedin_url": F.expr(N.linkedin_profile("linkedin_url")), "handle": F.lower("handle"), "kind": F.coalesce("kind", F.lit(kind)), "channel": F.coalesce("channel", F.lit(channel))})
    keyless = F.coalesce("email", "phone", "linkedin_url", "handle").isNull()
    bad_date = F.col("occurred_at").isNotNull() & (~F.col("occurred_at").rlike(r"^\d{4}-\d{2}-\d{2}$") | F.expr("try_cast(occurred_at as date) is null"))
    judged = v.withColumn("reason", F.when(keyless, "no_key").when(bad_date, "bad_date").when(~F.col("kind").isin(*KINDS), "bad_kind"))
    good = judged.filter("reason is null").withColumns({"source": F.lit(source), "source_external_id": F.substring(F.sha2("raw_json", 256), 1, 32), "match_status": F.lit("pending")}).drop("reason")
    return good.dropDuplicates(["source", "source_external_id"]), judged.filter("reason is not null").select("raw_json", "reason")


def unpack_export(path: str, member: str, header: str, to: str) -> str:
    """Path of a CSV without the lines before its header: from a zip's member or a plain file, line by line, so that a file of any
    size passes whole. Zip members over the limit are refused, as they may unpack to anything; a missing header is an error."""
    with ExitStack() as stack:
        if zipfile.is_zipfile(path):
            z = stack.enter_context(zipfile.ZipFile(path))
            info = next((i for i in z.infolist() if os.path.basename(i.filename).lower() == member.lower()), None)
            if info is None:
                raise FileNotFoundError(member)
            if info.file_size > MOST_UNPACKED:
                raise ValueError(f"{member} unpacks to {info.file_size} bytes")
            raw = stack.enter_context(z.open(info))
        else:
            raw = stack.enter_context(open(path, "rb"))
        lines = io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace", newline="")
        out = stack.enter_context(open(to, "w", encoding="utf-8", newline=""))
        found = False
        for line in lines:
            found = found or line.startswith(header)
            if found:
                out.write(line)
    if not found:
        raise MappingError(f"no line starts with {header!r}")
    return to


NETWORK_MAP = {"first_name": "First Name", "last_name": "Last Name", "linkedin_url": "URL", "email": "Email Address", "company": "Company", "role": "Position"}


def import_network_export(spark: SparkSession, path: str, work: str, source: str = "linkedin_export") -> tuple[DataFrame, DataFrame]:
    """(people, origin touchpoints dated by the connection day) of a network's connections export, zipped or not."""
    df = read_csv(spark, unpack_export(path, "Connections.csv", "First Name,", os.path.join(work, "connections.csv")))
    people = stage_people(df, source, {f: h for f, h in NETWORK_MAP.items() if h in df.columns})
    day = F.try_to_date(F.trim("`Connected On`"), "dd MMM yyyy")
    touches = df.select(F.expr(N.linkedin_profile("`URL`")).alias("linkedin_url"), F.expr(K.email_key("`Email Address`")).alias("email"), day.alias("occurred_at")).filter("(linkedin_url is not null or email is not null) and occurred_at is not null")
    touches = touches.withColumns({"source": F.lit(source), "source_external_id": F.substring(F.sha2(F.concat(F.lit("linkedin:"), F.coalesce("linkedin_url", "email")), 256), 1, 32), "kind": F.lit("origin"), "channel": F.lit("linkedin"), "match_status": F.lit("pending")})
    return people, touches.dropDuplicates(["source", "source_external_id"])


def _sqlite(spark: SparkSession, path: str, sql: str, schema: str) -> DataFrame:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        return spark.createDataFrame(con.execute(sql).fetchall(), schema)


def import_address_book(spark: SparkSession, path: str, source: str = "apple_contacts") -> DataFrame:
    """One staged row per contact point of the people in an address book file; records that name an organisation only are left out."""
    people = _sqlite(spark, path, "select Z_PK, ZFIRSTNAME, ZLASTNAME, ZORGANIZATION from ZABCDRECORD", "pk long, first string, last string, company string")
    phones = _sqlite(spark, path, "select ZOWNER, ZFULLNUMBER from ZABCDPHONENUMBER", "pk long, raw string").select("pk", F.lit("phone").alias("kind"), F.expr(N.e164("raw")).alias("norm"))
    mails = _sqlite(spark, path, "select ZOWNER, ZADDRESS from ZABCDEMAILADDRESS", "pk long, raw string").select("pk", F.lit("email").alias("kind"), F.expr(K.email_key("raw")).alias("norm"))
    points = phones.unionByName(mails).filter("norm is not null").dropDuplicates(["pk", "kind", "norm"])
    named = people.withColumn("full_name", F.expr(N.full_name("first", "last"))).filter("full_name is not null")
    return named.join(points, "pk").select(F.lit(source).alias("source"), F.substring(F.sha2(F.concat_ws(":", F.col("pk").cast("string"), "kind", "norm"), 256), 1, 32).alias("source_external_id"), "full_name", F.when(F.col("kind") == "email", F.col("norm")).alias("email"), F.when(F.col("kind") == "phone", F.col("norm")).alias("phone"), "company", F.lit("pending").alias("match_status"))


def import_messages(spark: SparkSession, path: str, source: str = "imessage") -> DataFrame:
    """One staged touchpoint per handle of a message store: the number of messages and the day of the last one."""
    messages = _sqlite(spark, path, "select h.id, m.date from message m join handle h on h.ROWID = m.handle_id", "handle string, at long")
    rolled = messages.filter("handle is not null").groupBy("handle").agg(F.count("*").alias("n"), F.max("at").alias("at"))
    return rolled.select(F.lit(source).alias("source"), F.substring(F.sha2(F.concat(F.lit("imessage:"), F.col("handle")), 256), 1, 32).alias("source_external_id"), F.expr(K.email_key("handle")).alias("email"), F.expr(N.e164("handle")).alias("phone"), F.lit("imessage").alias("channel"), F.lit("message").alias("kind"), F.expr(N.apple_date("at")).alias("occurred_at"), F.concat(F.col("n").cast("string"), F.lit(" messages")).alias("summary"), F.lit("pending").alias("match_status"))
