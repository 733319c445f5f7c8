import pytest
from pyspark.sql import functions as F

from kinfold.functions import keys as K
from kinfold.functions import normalize as N


def values(spark, build, texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string").select("i", F.expr(build("v")).alias("k")).orderBy("i").select("k").collect()]


def test_email(spark):
    got = values(spark, K.email_key, [" ADA@Example.com\t", " a@b.c ", "no-at.example", "a b@c.d", "@c.d", "a@nodot", "a@b.", "", None, "a@b@c.d"])
    assert got == ["ada@example.com", "a@b.c", None, None, None, None, None, None, None, "a@b@c.d"]


def test_handle(spark):
    got = values(spark, K.handle_key, ["@Ada_1", "https://www.x.example/Ada_1/", "x.example/ada_1?x=y", "http://y.example/ada", "ada-1", " ", None, "@@ada"])
    assert got == ["ada_1", "ada_1", "ada_1", None, None, None, None, None]


def test_phone(spark):
    got = values(spark, K.phone_key, ["(415) 555-1234", "+1 415 555 1234 x12", "001 415 555 1234", "1-415-555-1234", "0049 30 123", "call me", None, "x5"])
    assert got == ["14155551234", "14155551234", "14155551234", "14155551234", "4930123", None, None, None]


def test_linkedin(spark):
    got = values(spark, K.linkedin_key, ["HTTPS://WWW.LinkedIn.example/in/Ada/", "m.linkedin.example/in/ada?trk=share", "linkedin.example/in/ada", "n/a", None])
    assert got == ["linkedin.example/in/ada"] * 3 + [None, None]


def test_blank(spark):
    got = values(spark, K.is_blank, [None, "", "  ", "--", "N/A", " TBD ", "Unknown", "n/a x", "é", "7"])
    assert got == [True] * 7 + [False] * 3


@pytest.mark.parametrize("texts, want", [(["Cat"], ["  c", " ca", "at ", "cat"]), ([""], []), ([None], [])])
def test_trigrams(spark, texts, want):
    assert sorted(values(spark, N.trigrams, texts)[0]) == want


def test_unaccent(spark):
    assert values(spark, N.unaccent_lower, ["Łukasz Øre É ß æ"]) == ["lukasz ore e ß ae"]


def test_social(spark):
    assert values(spark, N.twitter_handle, ["https://x.com/AdaLovelace", "@Ada", "home", "x.com/i/web", "a" * 16, None]) == ["adalovelace", "ada", None, None, None, None]
    assert values(spark, N.github_handle, ["github.com/Ada-L", "a--b", "-a", "features"]) == ["ada-l", None, None, None]


def test_profile(spark):
    assert values(spark, N.linkedin_profile, ["www.linkedin.example/in/Ada/?x", "linkedin.example/company/x", "linkedin.example/in/", "other.example/in/ada"]) == ["linkedin.example/in/ada", None, None, None]


def test_text(spark):
    assert values(spark, N.truncated, ["  a ", None, "x" * 141]) == ["a", "", "x" * 140 + "…"]
    assert values(spark, lambda v: N.noreply_login(v), ["12+Ada@users.noreply.github.com", "ada@users.noreply.github.com", "ada@x.y"]) == ["ada", "ada", None]
    assert N.intent_tokens("Who knows AI-safety or the Go?", frozenset({"who", "the", "or"})) == ["knows", "ai-safety"]


def test_apple_date(spark):
    df = spark.createDataFrame([(799286400,), (799286400 * 10**9,), (None,)], "v long")
    assert [str(r[0]) for r in df.select(F.expr(N.apple_date("v"))).collect()] == ["2026-05-01", "2026-05-01", "None"]
