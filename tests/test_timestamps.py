from datetime import datetime, timezone

import pytest

from kinfold.functions import moments
from kinfold.operators import timestamps

FEEDS = [("us", "America/New_York", False), ("de", "Europe/Berlin", True), ("imessage", "UTC", False), ("free", "UTC", None), ("lost", None, True), ("isle", "Australia/Lord_Howe", True)]
CASES = [
    ("us", "03/10/2024 02:30", "2024-03-10T07:30:00.000000Z"),  # skipped hour: the offset before the change
    ("us", "11/03/2024 1:30 AM", "2024-11-03T05:30:00.000000Z"),  # shown twice: the first
    ("us", "11/03/2024 12:05 a.m.", "2024-11-03T04:05:00.000000Z"),
    ("us", "25/12/2024", None),
    ("de", "25/12/2024", "2024-12-24T23:00:00.000000Z"),
    ("de", "1/2/25 03:04:05", "2025-02-01T02:04:05.000000Z"),
    ("de", "3. März 2025, 06:57", "2025-03-03T05:57:00.000000Z"),
    ("de", "16 de mayo de 2024 00:01", "2024-05-15T22:01:00.000000Z"),
    ("de", "2025-01-06T10:00:00 +05:45", "2025-01-06T04:15:00.000000Z"),
    ("de", "2025-01-06T10:00:00−03:30", "2025-01-06T13:30:00.000000Z"),
    ("de", "２０２５-０１-０６ １０:００", "2025-01-06T09:00:00.000000Z"),
    ("us", "2025-01-06 10:00:00 CET", "2025-01-06T09:00:00.000000Z"),
    ("us", "2025-01-06 10:00:00 Europe/Madrid", "2025-01-06T09:00:00.000000Z"),
    ("us", "2025-01-06T10:00:00Z[UTC]", "2025-01-06T10:00:00.000000Z"),
    ("us", "2025-01-06T10:00:00.1234567899Z", "2025-01-06T10:00:00.123456Z"),
    ("us", "20250106T100000Z", "2025-01-06T10:00:00.000000Z"),
    ("us", "2025-006T10:00:00Z", "2025-01-06T10:00:00.000000Z"),
    ("us", "2025-W02-1T10:00Z", "2025-01-06T10:00:00.000000Z"),
    ("us", "Mon, 06 Jan 2025 10:00:00 +0000", "2025-01-06T10:00:00.000000Z"),
    ("us", "Mon Jan  6 05:00:00 2025", "2025-01-06T10:00:00.000000Z"),
    ("us", "January 6, 2025 at 5:00 AM", "2025-01-06T10:00:00.000000Z"),
    ("us", "20250106", "2025-01-06T05:00:00.000000Z"),
    ("us", "1736157600", "2025-01-06T10:00:00.000000Z"),
    ("us", "1736157600123", "2025-01-06T10:00:00.123000Z"),
    ("us", "1736157600123456", "2025-01-06T10:00:00.123456Z"),
    ("us", "1736157600123456789", "2025-01-06T10:00:00.123456Z"),
    ("us", "1736157600.5", "2025-01-06T10:00:00.500000Z"),
    ("imessage", "757850400", "2025-01-06T10:00:00.000000Z"),
    ("imessage", "757850400000000000", "2025-01-06T10:00:00.000000Z"),
    ("isle", "2025-01-06 10:00", "2025-01-05T23:00:00.000000Z"),
    ("lost", "2025-01-06 10:00", None),
    ("lost", "2025-01-06 10:00Z", "2025-01-06T10:00:00.000000Z"),
]
UNREADABLE = ["", " ", "n/a", "2025-02-30", "2025-13-01", "2025-01-06 25:10", "2025-01-06T10:61:00Z", "Q1 2025", "2025-01", "April 2024", "19:24", "yesterday", "NaN", "00/00/00", "x" * 100_000, "2025-01-06 10:00 XYZQ"]


@pytest.fixture(scope="module")
def feeds(spark):
    return spark.createDataFrame(FEEDS, "source string, tz string, day_first boolean")


def read(spark, feeds, rows):
    df = spark.createDataFrame([(str(i), s, t, "clash") for i, (s, t) in enumerate(rows)], "id string, source string, occurred_at string, tz string")
    return {int(r["row_id"]): r["occurred_utc"] for r in timestamps.normalise(df, feeds, "id", "source", "occurred_at").collect()}


def test_cases(spark, feeds):
    got = read(spark, feeds, [(s, t) for s, t, _ in CASES])
    assert [(c[1], got[i]) for i, c in enumerate(CASES)] == [(c[1], c[2]) for c in CASES]


def test_unreadable_and_null(spark, feeds):
    rows = [("us", t) for t in UNREADABLE] + [("us", None), (None, "2025-01-06 10:00"), ("unknown", "2025-01-06 10:00")]
    assert set(read(spark, feeds, rows).values()) == {None}


def test_undeclared_order_is_learned_or_left_ambiguous(spark, feeds):
    clear = [("free", f"{d}/3/2025") for d in range(13, 29)] * 5
    got = read(spark, feeds, [*clear, ("free", "2/4/2025")])
    assert got[len(clear)] == "2025-04-02T00:00:00.000000Z"
    assert read(spark, feeds, [("free", "2/4/2025"), ("free", "5/6/2025")])[0] is None
    status = timestamps.status_report(spark.createDataFrame([("free", "2/4/2025")], "source string, t string"), feeds, "source", "t").collect()
    assert [r["status"] for r in status] == ["ambiguous"]


def test_empty_table(spark, feeds):
    assert read(spark, feeds, [("us", "2025-01-06")]) and timestamps.normalise(spark.createDataFrame([], "id string, source string, t string"), feeds, "id", "source", "t").count() == 0


def test_round_trip_of_one_moment():
    at = datetime(2025, 7, 4, 12, 34, 56, tzinfo=timezone.utc)
    for text in (at.isoformat(), at.strftime("%d %b %Y %H:%M:%S UTC"), at.strftime("%Y%m%dT%H%M%SZ"), at.strftime("%G-W%V-%uT%H:%M:%SZ"), at.strftime("%Y-%jT%H:%M:%SZ")):
        (family, wall, tz), *more = moments.readings(text)
        assert moments.to_utc(wall, tz) == at and not more, text


def test_a_source_that_mixes_both_orders_leaves_the_unsure_open(spark):
    from kinfold.operators import timestamps

    texts = ["13/04/2024"] * 60 + ["04/13/2024"] * 40 + ["03/04/2024"] * 30 + ["2024-03-04"] * 5 + [None, "", "  " * 150 + "2024-03-05" + " " * 200]
    df = spark.createDataFrame([(str(i), "mixed", t) for i, t in enumerate(texts)], "id string, source string, occurred_at string")
    feeds = spark.createDataFrame([("mixed", "UTC", None)], "source string, tz string, day_first boolean")
    got = {int(r["row_id"]): r["occurred_utc"] for r in timestamps.normalise(df, feeds, "id", "source", "occurred_at").collect()}
    assert {got[i] for i in range(100)} == {"2024-04-13T00:00:00.000000Z"}
    assert {got[i] for i in range(100, 130)} == {None} and got[130] == "2024-03-04T00:00:00.000000Z"
    assert got[135] is None and got[136] is None and got[137] == "2024-03-05T00:00:00.000000Z"
    status = {(r["status"], r["family"]): r["rows"] for r in timestamps.status_report(df, feeds, "source", "occurred_at").collect()}
    assert status[("ambiguous", "slash_dmy")] == 30
