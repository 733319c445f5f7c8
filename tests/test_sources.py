import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from kinfold.sources import payload, people, profiles, store


def test_people_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("﻿Name,Email,Firm,Phone\nAda Lovelace,ADA@example.com,Analytical,415 555 1234\n,x@y.z,,\nAda Lovelace,ADA@example.com,Analytical,415 555 1234\n\"Multi\nLine\",,,\n".encode())
    got = sorted((r["full_name"], r["email"], r["phone"], r["match_status"]) for r in people.import_people(spark, str(p), "s", people.parse_mapping("full_name=Name,email=Email,company=Firm,phone=Phone")).collect())
    assert got == [("Ada Lovelace", "ada@example.com", "+14155551234", "pending"), ("Multi\nLine", None, None, "pending")]


def test_split_names_and_latin1(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_bytes("First,Last\nZoë,Müller\n".encode("latin-1"))
    assert [r["full_name"] for r in people.import_people(spark, str(p), "s", {"first_name": "First", "last_name": "Last"}).collect()] == ["Zoë Müller"]


@pytest.mark.parametrize("text", ["full_name", "=Name", "planet=Name"])
def test_bad_mapping(text):
    with pytest.raises(people.MappingError):
        people.parse_mapping(text)


def test_touchpoints_csv(spark):
    df = spark.createDataFrame([("ADA@example.com", "2026-05-20", "talk", None), ("no key", "2026-05-20", "x", None), ("a@b.c", "2026-13-99", "x", None), ("a@b.c", "2026-01-01", "x", "odd")], "Email string, Date string, What string, Kind string")
    good, bad = people.stage_touchpoints(df, "tp", {"email": "Email", "occurred_at": "Date", "summary": "What", "kind": "Kind"}, "note", "email")
    assert [(r["email"], r["kind"], r["channel"]) for r in good.collect()] == [("ada@example.com", "note", "email")]
    assert sorted(r["reason"] for r in bad.collect()) == ["bad_date", "bad_kind", "no_key"]


def test_network_export(spark, tmp_path):
    z = tmp_path / "e.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("Connections.csv", "Notes:\n\"x\"\n\nFirst Name,Last Name,URL,Email Address,Company,Position,Connected On\nAda,Lovelace,https://www.linkedin.example/in/ada,,A,B,12 Jun 2024\nBo,Li,,bo@x.example,,,nonsense\n")
    who, touches = people.import_network_export(spark, str(z), str(tmp_path))
    assert sorted(r["full_name"] for r in who.collect()) == ["Ada Lovelace", "Bo Li"]
    assert [(str(r["occurred_at"]), r["kind"]) for r in touches.collect()] == [("2024-06-12", "origin")]


def test_address_book_and_messages(spark, tmp_path):
    a, m = str(tmp_path / "a.db"), str(tmp_path / "m.db")
    with sqlite3.connect(a) as c:
        c.executescript("create table ZABCDRECORD(Z_PK, ZFIRSTNAME, ZLASTNAME, ZORGANIZATION); create table ZABCDPHONENUMBER(Z_PK, ZFULLNUMBER, ZOWNER); create table ZABCDEMAILADDRESS(Z_PK, ZADDRESS, ZOWNER); insert into ZABCDRECORD values (1,'Ada','L',null),(2,null,null,'Org'); insert into ZABCDPHONENUMBER values (1,'(415) 555-1234',1),(2,'415-555-1234',1); insert into ZABCDEMAILADDRESS values (1,'A@x.y',1),(2,'b@x.y',2);")
    assert sorted((r["email"], r["phone"]) for r in people.import_address_book(spark, a).select(F.coalesce("email", F.lit("")).alias("email"), F.coalesce("phone", F.lit("")).alias("phone")).collect()) == [("", "+14155551234"), ("a@x.y", "")]
    with sqlite3.connect(m) as c:
        c.executescript("create table handle(ROWID integer primary key, id); create table message(ROWID, handle_id, date, is_from_me); insert into handle values (1,'+14155551234'),(2,'a@x.y'); insert into message values (1,1,799286400000000000,0),(2,1,799200000000000000,1),(3,2,799286400,0);")
    got = sorted((r["phone"] or "", r["email"] or "", str(r["occurred_at"]), r["summary"]) for r in people.import_messages(spark, m).collect())
    assert got == [("", "a@x.y", "2026-05-01", "1 messages"), ("+14155551234", "", "2026-05-01", "2 messages")]


def test_payloads(spark):
    rows = [("1", '{"field":"company","value":"A","confidence":0.9,"evidence":"seen"}'), ("2", '[{"field":"email","value":"a@b.c"},{"value":"x"},{"field":"x","confidence":2}]'), ("3", "nope"), ("4", None)]
    got = sorted((r["id"], r["field"] or "", r["kind"] or "", r["source_detail"] or "", r["verdict"]) for r in payload.parse_payloads(spark.createDataFrame(rows, "id string, p string"), "id", "p").collect())
    assert got[0] == ("1", "current_company", "attribute", "seen", "ok")
    assert sorted(g[4] for g in got if g[0] == "2") == ["bad_confidence", "no_field", "ok"]
    assert {g[4] for g in got if g[0] in "34"} <= {"bad_json", "no_field"}


def test_profile_sources_offline(spark):
    page = {"location": "Paris", "job_title": "CEO", "company": "A", "verified_accounts": [{"shortname": "github", "username": "ada"}, {"service_label": "Twitter", "username": "ada_t"}], "links": [{"url": "https://x.com/a"}, {"url": "https://ada.example"}]}
    calls, waits = [], []

    def transport(url, headers):
        calls.append(url)
        return (429, {"Retry-After": "90"}, b"") if len(calls) == 1 else (200, {}, json.dumps(page).encode())

    status, body = profiles.fetch(transport, "u", {}, sleep=waits.append)
    assert status == 200 and waits == [60.0]
    facts = {f: v for f, v, _ in profiles.ProfileSource().facts(" ADA@x.y ", transport)}
    assert facts.pop("avatar_url").startswith("https://gravatar.com/avatar/")
    assert facts == {"location": "Paris", "current_role": "CEO", "current_company": "A", "twitter_username": "ada_t", "website_url": "https://ada.example"}
    assert profiles.ProfileSource().facts("a@x.y", lambda u, h: (404, {}, b"")) == []
    user = json.dumps({"company": " Acme ", "location": "", "blog": "https://ada.example", "twitter_username": None}).encode()
    calls = []

    def code_host(url, headers):
        calls.append(url)
        found = json.dumps({"total_count": 1 if "one" in url else 2, "items": [{"login": "solo"}, {"login": "other"}]}).encode()
        return (200, {}, user if "/users/" in url and "search" not in url else found)

    facts = profiles.CodeHostSource().facts("12+Ada-L@users.noreply.github.com", code_host)
    assert facts == [("github_username", "ada-l", 0.85), ("avatar_url", "https://github.com/ada-l.png", 0.85), ("current_company", "Acme", 0.85), ("website_url", "https://ada.example", 0.85)]
    assert profiles.CodeHostSource().facts("one@x.y", code_host) == [] and profiles.CodeHostSource("t").facts("two@x.y", code_host) == []
    assert profiles.CodeHostSource("t").facts("one@x.y", code_host)[0] == ("github_username", "solo", 0.85)
    assert profiles.CodeHostSource("t").facts("one@x.y", lambda u, h: (200, {}, b"not json")) == []
    assert [s.name for s in profiles.select_sources(["github", "nope", "gravatar"])] == ["gravatar", "github"]
    rows = profiles.gather(spark.createDataFrame([("c", "a@x.y"), ("d", None)], "contact_id string, email string"), [profiles.CodeHostSource()], transport=lambda u, h: (0, {}, b""), pause=lambda s: None)
    assert rows.collect() == []


def test_store_and_merges(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path))
    old = spark.createDataFrame([("s", "1", "a", "keep"), ("s", None, "n", "keep")], "source string, ext string, v string, w string")
    s.commit("t", old)
    new = spark.createDataFrame([("s", "1", "b"), ("s", "2", "c"), ("s", None, "m")], "source string, ext string, v string")
    assert s.commit("t", store.merge_on_key(s.read("t"), new, ["source", "ext"])) == 2
    got = sorted((r["ext"] or "", r["v"], r["w"] or "") for r in s.read("t").collect())
    assert got == [("", "m", ""), ("", "n", "keep"), ("1", "b", "keep"), ("2", "c", "")]
    assert store.violations(s.read("t"), ["source", "ext"]).count() == 0
    assert store.insert_or_ignore(old, new, ["source", "ext"]).count() == 4
    assert json.loads(store.to_json_lines(old).first()[0])["ext"] in ("1", None)


def test_stream_equals_batch(spark, sf):
    from kinfold.operators import touchpoints
    from kinfold.session import table
    from kinfold.streaming.backfill import run_available

    staged, ident = table(spark, sf, "staging_interactions"), table(spark, sf, "contact_identities")
    got = {r["id"]: r["contact_id"] for r in run_available(spark, f"{sf}/staging_interactions.parquet", ident).collect()}
    assert got == {r["id"]: r["contact_id"] for r in touchpoints.link(staged, ident).collect()}


def test_encoding_is_judged_by_the_whole_file(tmp_path):
    late, cut, whole = tmp_path / "late.csv", tmp_path / "cut.csv", tmp_path / "whole.csv"
    late.write_bytes(b"name\n" + b"Ada Lovelace\n" * 100_000 + "Zoé\n".encode("latin-1"))
    cut.write_bytes("name\r\nZoé\r\n".encode())
    whole.write_bytes("é".encode() * (1 << 20))
    assert [people.encoding_of(str(p)) for p in (late, cut, whole)] == ["ISO-8859-1", "UTF-8", "UTF-8"]
    late.write_bytes("Zoé".encode()[:-1])
    assert people.encoding_of(str(late)) == "ISO-8859-1"


def test_a_plain_export_of_any_size_passes_whole(tmp_path, monkeypatch):
    monkeypatch.setattr(people, "MOST_UNPACKED", 1 << 10)
    path, to = tmp_path / "big.csv", tmp_path / "out.csv"
    rows = [f"Ada,{i}\n" for i in range(5000)]
    path.write_text("Notes:\n\nFirst Name,N\n" + "".join(rows), encoding="utf-8")
    people.unpack_export(str(path), "Connections.csv", "First Name,", str(to))
    assert to.read_text() == "First Name,N\n" + "".join(rows)
    path.write_text("nothing here\n")
    with pytest.raises(people.MappingError):
        people.unpack_export(str(path), "Connections.csv", "First Name,", str(to))


def test_rows_as_text(spark):
    df = spark.createDataFrame([("a", 1, None), ("bcd", None, "x")], "name string, n int, q string")
    assert json.loads(store.to_json_array(df)) == [{"name": "a", "n": 1, "q": None}, {"name": "bcd", "n": None, "q": "x"}]
    assert store.to_table(df).splitlines() == ["name  n  q", "a     1", "bcd      x"]
    with pytest.raises(ValueError):
        store.to_table(df, 1)
    assert store.to_json_array(df.filter("false")) == "[]"
