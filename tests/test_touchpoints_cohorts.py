from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from kinfold.operators import cohort, retrieval, touchpoints

T0 = datetime(2025, 1, 1)
INT = "id string, contact_id string, event_id string, kind string, channel string, occurred_at date, summary string, logged_by string, created_at timestamp, updated_at timestamp, source string, source_external_id string"
CON = "id string, full_name string, last_touchpoint_at date, last_touchpoint_channel string, last_touchpoint_topic string, closeness_tier string"


def inter(i, c, channel, day, summary="x", ext=None):
    return (str(i), c, None, "note", channel, day, summary, "me", T0, T0, "s" if ext else None, ext)


def test_recompute(spark):
    contacts = spark.createDataFrame([("a", "A", None, None, None, "none"), ("b", "B", date(2024, 1, 1), "email", "old", "t1_irl_messaging"), ("c", "C", date(2024, 1, 1), "email", "keep", "none")], CON)
    rows = [inter(1, "a", "imessage", date(2026, 1, 1)), inter(2, "a", "twitter", date(2026, 5, 1), "last"), inter(3, "a", "email", None), inter(4, "c", "pigeon", None)]
    got = {r["id"]: (str(r["last_touchpoint_at"]), r["last_touchpoint_channel"], r["last_touchpoint_topic"], r["closeness_tier"]) for r in touchpoints.recompute(contacts, spark.createDataFrame(rows, INT)).collect()}
    assert got["a"] == ("2026-05-01", "twitter", "last", "t1_irl_messaging")
    assert got["b"] == ("None", None, None, "t1_irl_messaging")  # no interaction is left, the tier stays
    assert got["c"] == ("2024-01-01", "email", "keep", "none")  # undated ones only


def test_upsert_keeps_kind_and_reports_moves(spark):
    old = spark.createDataFrame([inter(1, "a", "email", date(2025, 1, 1), "old", "k1"), inter(2, "b", "email", None)], INT)
    new = spark.createDataFrame([("9", "c", None, "call", "irl", date(2025, 2, 2), "new", "x", T0, T0, "s", "k1"), ("8", "d", None, "call", "irl", None, "added", "x", T0, T0, "s", "k2")], INT)
    merged, moved = touchpoints.upsert_interactions(old, new)
    got = {r["id"]: (r["contact_id"], r["kind"], r["channel"], r["summary"]) for r in merged.collect()}
    assert got == {"1": ("c", "note", "email", "new"), "2": ("b", "note", "email", "x"), "8": ("d", "call", "irl", "added")}
    assert [r[0] for r in moved.collect()] == ["a"]


def test_bump_is_monotonic(spark):
    contacts = spark.createDataFrame([("a", "A", None, None, None, None), ("b", "B", date(2025, 1, 1), None, None, None), ("c", "C", date(2025, 2, 2), None, None, None)], CON)
    touched = spark.createDataFrame([(x, date(2025, 2, 2), "irl") for x in "abc"], "contact_id string, occurred_at date, channel string")
    assert {r["id"]: r["bumped"] for r in touchpoints.bump(contacts, touched).collect()} == {"a": True, "b": True, "c": False}


def test_link_by_priority(spark):
    ident = spark.createDataFrame([("i1", "p", None, "4155551234", None, None, T0), ("i2", "e", "info@x.y", None, None, None, T0)], "id string, contact_id string, email string, phone string, linkedin_url string, handle string, imported_at timestamp")
    rows = spark.createDataFrame([("1", "INFO@x.y", "415 555 1234"), ("2", None, "+1 415 555 1234"), ("3", "who@x.y", None)], "id string, email string, phone string").withColumns({"handle": F.lit(None).cast("string"), "linkedin_url": F.lit(None).cast("string")})
    assert {r["id"]: r["contact_id"] for r in touchpoints.link(rows, ident).collect()} == {"1": "e", "2": "p", "3": None}


def test_cohort_needs_exactly_one_choice(spark):
    df = spark.createDataFrame([("a",)], "id string")
    with pytest.raises(cohort.CohortError):
        cohort.cohort(df)
    with pytest.raises(cohort.CohortError):
        cohort.cohort(df, F.lit(True), everyone=True)
    assert cohort.cohort(df, everyone=True).count() == 1


def test_foreign_keys(spark):
    child = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None)], "id string, contact_id string")
    gone = spark.createDataFrame([("a",)], "id string")
    assert sorted(r["id"] for r in cohort.delete_cascade(child, gone).collect()) == ["2", "3"]
    assert {r["id"]: r["contact_id"] for r in cohort.clear_references(child, gone, "contact_id").collect()} == {"1": None, "2": "b", "3": None}


def test_role_terms_and_plain():
    assert retrieval.role_terms("Founder, ceo") == ["founder", "co-founder", "cofounder", "founding", "ceo", "chief executive"]
    assert retrieval.plain('a,b(c)."%') == "a b c"


def test_topics(spark):
    rows = [inter(1, "a", "x", date(2025, 1, 1), "oldest"), inter(2, "a", "x", date(2025, 3, 1), " newest "), inter(3, "a", "x", date(2025, 2, 1), "middle"), inter(4, "a", "x", None, "undated"), inter(5, "a", "x", date(2025, 4, 1), " ")]
    assert [r["topics"] for r in retrieval.topics(spark.createDataFrame(rows, INT)).collect()] == [["newest", "middle"]]
