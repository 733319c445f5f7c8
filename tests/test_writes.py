from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kinfold.operators import changes, cohort, entries, execution, stats, touchpoints

LOG = "id string, contact_id string, field string, old_value string, new_value string, source string, confidence double, method string, created_at timestamp, source_detail string, verification_status string, is_current boolean, redacted_at timestamp, extra int"


def at(day):
    return datetime(2026, 1, day)


def log(spark, *rows):
    """rows: (id, contact, field, value, source, confidence, method, day, status, current)"""
    return spark.createDataFrame([(i, c, f, None, v, s, conf, m, at(d), None, st, cur, None, 7) for i, c, f, v, s, conf, m, d, st, cur in rows], LOG)


def candidates(spark, *rows):
    df = spark.createDataFrame([(i, c, f, v, s, m, conf, at(d)) for i, c, f, v, s, m, conf, d in rows], "id string, contact_id string, field string, value string, source string, method string, confidence double, created_at timestamp")
    return df.withColumn("seq", F.struct("created_at", "id"))


def current(df):
    return {(r["contact_id"], r["field"]): r["id"] for r in df.filter("is_current").collect()}


def test_candidates_are_applied_in_order(spark):
    old = log(spark, ("l1", "c", "location", "NYC", "a", 0.9, "api", 1, None, True), ("l2", "d", "location", "Rome", "a", 0.9, "manual_set", 1, None, True), ("l3", "e", "location", "Oslo", "a", 0.9, "api", 1, "disputed", False))
    new = candidates(
        spark, ("n1", "c", "location", "LA", "b", "api", 0.95, 5), ("n2", "c", "location", "SF", "b", "api", 0.5, 6), ("n3", "d", "location", "Bari", "b", "api", 0.95, 5), ("n4", "e", "location", "Oslo", "b", "api", 0.9, 5), ("n5", "c", "location", "LA", "b", "api", 0.9, 7),
        ("n6", "f", "location", None, "k", "manual_set", 1.0, 5), ("n7", "c", "tags", "x", "b", "api", 0.9, 5),
    )
    outcomes, now, won, reviews = changes.apply_candidates(old, new)
    assert {r["id"]: r["outcome"] for r in outcomes.collect()} == {"n1": "golden", "n2": "review", "n3": "review", "n4": "losing", "n5": "noop", "n6": "golden", "n7": "noop"}
    assert current(now) == {("c", "location"): "n1", ("d", "location"): "l2", ("f", "location"): "n6"}
    assert {r["id"]: r["old_value"] for r in now.filter("id like 'n%'").collect()} == {"n1": "NYC", "n2": "LA", "n3": "Rome", "n6": None}
    assert {r["id"]: r["reason"] for r in reviews.collect()} == {"n2": "low_confidence", "n3": "value_conflict"}
    contacts = spark.createDataFrame([("c", "x", None), ("d", "y", None), ("f", "gone", None)], "id string, location string, last_enriched_at date")
    assert {r["id"]: r["location"] for r in changes.materialise(contacts, won, {"location": "location"}).collect()} == {"c": "LA", "d": "y", "f": None}
    dated = spark.createDataFrame([("c", "when", "2026-02-03"), ("d", "when", "soon")], "contact_id string, field string, value string")
    assert [r["last_enriched_at"] is None for r in changes.materialise(contacts, dated, {"when": "last_enriched_at"}).orderBy("id").collect()] == [False, True, True]


def test_changes_of_nothing(spark):
    old = log(spark, ("l1", "c", "location", "NYC", "a", 0.9, "api", 1, None, True))
    none = old.filter("false")
    outcomes, now, won, reviews = changes.apply_candidates(old, candidates(spark, ("n", "c", "f", "v", "s", "api", 0.9, 1)).filter("false"))
    assert outcomes.count() == won.count() == reviews.count() == 0 and current(now) == {("c", "location"): "l1"}
    assert changes.undo(none, old)[0].count() == 0 and changes.forget(none, spark.createDataFrame([], "id string"), F.current_timestamp()).count() == 0


def test_undo_reject_approve_and_forget(spark):
    old = log(spark, ("l1", "c", "location", "NYC", "a", 0.9, "api", 1, None, False), ("l2", "c", "location", "LA", "b", 0.9, "api", 2, None, True), ("l3", "d", "location", "Oslo", "b", 0.9, "api", 2, None, True), ("l4", None, "location", "X", "b", 0.9, "api", 2, None, True))
    pairs = spark.createDataFrame([("c", "location"), ("d", "location"), ("q", "location")], "contact_id string, field string")
    now, won = changes.undo(old, pairs)
    assert {r["contact_id"]: r["value"] for r in won.collect()} == {"c": "NYC", "d": None} and current(now) == {("c", "location"): "l1", (None, "location"): "l4"}
    items = spark.createDataFrame([("r1", "c", "location", "LA")], "id string, contact_id string, field string, candidate_value string")
    assert [r["value"] for r in changes.reject(old, items, "me", F.lit(at(9)))[1].collect()] == ["NYC"]
    items = items.withColumn("candidate_value", F.lit("Bari"))
    now, won = changes.approve(old, items, "me", F.lit(at(9)))
    assert [r["value"] for r in won.collect()] == ["Bari"] and now.filter("method = 'manual_set' and is_current").count() == 1
    wiped = {r["id"]: (r["new_value"], r["redacted_at"]) for r in changes.forget(old, spark.createDataFrame([("c",)], "id string"), F.lit(at(9))).collect()}
    assert wiped["l1"] == (None, at(9)) and wiped["l3"] == ("Oslo", None)
    closed = changes.close_items(items.withColumn("status", F.lit("open")), spark.createDataFrame([("r1", "skip")], "id string, decision string"))
    assert [r["status"] for r in closed.collect()] == ["skipped"]


def test_promotion_is_made_once(spark):
    ident = spark.createDataFrame([("c", "x", None)], "contact_id string, source string, source_external_id string")
    found = spark.createDataFrame([("1", "c", "email", "a@b.c", "s"), ("2", "d", "email", "a@b.c", "s"), ("3", "d", "phone", None, "s")], "id string, contact_id string, kind string, value string, source string")
    made = changes.promote(ident, found).collect()
    assert [(r["contact_id"], r["source"], r["value"]) for r in made] == [("c", "enrich:s", "a@b.c")]
    again = ident.unionByName(changes.promote(ident, found).select("contact_id", "source", "source_external_id"))
    assert changes.promote(again, found).count() == 0


STAGED = "id string, source string, source_external_id string, full_name string, email string, phone string, linkedin_url string, handle string, role string, company string, location string, twitter_username string, github_username string, website_url string, imported_at timestamp"


def test_a_plan_is_carried_out(spark):
    rows = [("s1", "a", "1", "Ada", None, None, None, None, "Eng", "FirstCo", None, None, None, None, at(1)), ("s2", "a", "2", "Ada", None, None, None, None, None, "SecondCo", "Rome", None, None, None, at(2)), ("s3", "a", "2", "Bob", None, None, None, None, None, None, None, None, None, None, at(3)), ("s4", "a", None, "", None, None, None, None, None, None, None, None, None, None, at(4)), ("s5", None, None, "Cy", None, None, None, None, None, None, None, None, None, None, at(5)), ("s6", "a", "9", "Zed", None, None, None, None, None, None, None, None, None, None, at(6))]
    staging = spark.createDataFrame(rows, STAGED)
    contacts = spark.createDataFrame([("c1", "Bob", None, None, None, None, None, None)], "id string, full_name string, current_position string, current_company string, location string, twitter_username string, github_username string, website_url string")
    plan = spark.createDataFrame([("s1", "k", "merged", "k:s1", None, "new_contact"), ("s2", "k", "auto_matched", "k:s1", 1.0, "exact_email"), ("s3", "k", "auto_matched", "c1", 1.0, "exact_email"), ("s4", "k", "rejected", None, None, "no_name"), ("s5", "k", "needs_review", "c1", 0.75, "conflicting_keys"), ("s6", "k", "auto_matched", "c1", 0.95, "fuzzy_name")], "id string, cluster_id string, match_status string, ref string, score double, method string")
    idents = spark.createDataFrame([("zz", "a", "9")], "contact_id string, source string, source_external_id string")
    made = execution.created(plan, staging).collect()
    assert [(r["create_key"], r["full_name"], r["current_company"]) for r in made] == [("k:s1", "Ada", "FirstCo")]
    new = made[0]["contact_id"]
    assert sorted((r["contact_id"], r["source_external_id"]) for r in execution.new_identities(plan, staging, idents).collect()) == sorted([(new, "1"), (new, "2")])
    got = {r["id"]: (r["match_status"], r["matched_contact_id"], r["match_method"], r["resolved"]) for r in execution.patches(plan, staging, idents).collect()}
    assert got == {"s1": ("merged", new, "new_contact", True), "s2": ("auto_matched", new, "exact_email", True), "s3": ("needs_review", "c1", "rerun_conflict", False), "s4": ("rejected", None, "no_name", True), "s5": ("needs_review", "c1", "conflicting_keys", False), "s6": ("needs_review", "c1", "rerun_conflict", False)}
    elected = spark.createDataFrame([], "contact_id string, field string")
    facts = {(r["field"], r["new_value"]): (r["contact_id"], r["old_value"], r["is_current"]) for r in execution.log_rows(plan, staging, contacts, idents, elected).collect()}
    assert facts == {("full_name", "Ada"): (new, None, True), ("current_position", "Eng"): (new, None, True), ("current_company", "FirstCo"): (new, None, True), ("current_company", "SecondCo"): (new, "FirstCo", False), ("location", "Rome"): (new, None, True)}
    assert execution.patches(plan.filter("false"), staging, idents).count() == 0


def test_entries(spark):
    contacts = spark.createDataFrame([("a", "Ada", None, None), ("b", "Bob", at(3).date(), "old"), ("c", "Bob", at(9).date(), "")], "id string, full_name string, last_touchpoint_at date, notes string")
    ids = contacts.select("id")
    assert {r["id"] for r in entries.bumped(contacts, ids, "2026-01-05", "irl", None).collect()} == {"a", "b"}
    assert {r["id"]: r["notes"] for r in entries.append_note(contacts, ids, "hi", "2026-01-05", "me").collect()} == {"a": "[2026-01-05 me] hi", "b": "old\n[2026-01-05 me] hi", "c": "[2026-01-05 me] hi"}
    for bad in ("x", "nope=1", "closeness_tier=t9"):
        with pytest.raises(entries.EntryError):
            entries.parse_assignment(bad)
    assert entries.parse_assignment("location=") == ("location", None) and entries.parse_assignment("location=a=b") == ("location", "a=b")
    with pytest.raises(entries.EntryError):
        entries.touchpoints(ids, "seance", None, "2026-01-05", None, "me")
    with pytest.raises(entries.EntryError):
        entries.add_event(contacts, contacts, "E", "2026-01-05", None, ["Ada", "Bob", "Zoe"], "me")
    event, rows = entries.add_event(contacts, contacts, "E", "2026-01-05", None, ["Ada", "b", "a"], "me")
    assert {r["contact_id"] for r in rows.collect()} == {"a", "b"} and event.count() == 1
    with pytest.raises(entries.EntryError):
        entries.set_candidates(ids, "tags=vip", "me", F.current_timestamp(), spark.createDataFrame([], "tag string"))
    assert entries.set_candidates(ids, "tags=vip", "me", F.current_timestamp(), spark.createDataFrame([("vip",)], "tag string")).count() == 3
    agents = spark.createDataFrame([("me", "x", at(1))], "id string, description string, last_active timestamp")
    assert entries.require_agent(agents, "me", F.lit(at(8))).first()["last_active"] == at(8)
    with pytest.raises(entries.EntryError):
        entries.require_agent(agents, "you", F.lit(at(8)))
    assert {r["id"]: r["description"] for r in entries.register(agents, spark.createDataFrame([("me", "y"), ("you", "z")], "id string, description string"), "id").collect()} == {"me": "y", "you": "z"}
    added, held = entries.add_contacts(spark.createDataFrame([("Ada", "a@b.c", None, None, None), ("Ada", "a@b.c", None, None, None), (" ", "q@b.c", None, None, None), (None, None, None, None, None), ("Cy", None, None, None, None)], "full_name string, email string, phone string, linkedin_url string, handle string"))
    assert sorted(r["full_name"] for r in added.collect()) == ["Ada", "Cy"] and held.count() == 1


def test_the_gate(spark):
    contacts = spark.createDataFrame([(str(i), f"n{i:02}") for i in range(12)], "id string, full_name string")
    assert entries.gate(contacts, everyone=True, dry_run=True) == (None, {"cohort": 12, "dry_run": True, "sample": [f"n{i:02}" for i in range(10)]})
    assert entries.gate(contacts, F.lit(False)) == (None, {"cohort": 0, "dry_run": False, "changed": 0})
    with pytest.raises(cohort.CohortError):
        entries.gate(contacts, everyone=True)
    with pytest.raises(cohort.CohortError):
        entries.gate(contacts, F.lit(True), everyone=True)
    assert entries.gate(contacts, everyone=True, yes=True)[0].count() == 12


def test_backfill_in_one_job(spark):
    staged = spark.createDataFrame([("t1", "s", "1", "a@b.c", None, None, None, "note", "irl", "2026-01-05", "hi", "pending", at(5)), ("t2", "s", "2", "zz@b.c", None, None, None, "note", "irl", "2026-01-05", None, "orphaned", at(5)), ("t3", "s", "3", "a@b.c", None, None, None, "note", "irl", "soon", None, "linked", at(5))], "id string, source string, source_external_id string, email string, phone string, handle string, linkedin_url string, kind string, channel string, occurred_at string, summary string, match_status string, imported_at timestamp")
    idents = spark.createDataFrame([("i", "c1", "a@b.c", None, None, None, at(1))], "id string, contact_id string, email string, phone string, handle string, linkedin_url string, imported_at timestamp")
    inter = spark.createDataFrame([("x", "c2", None, "note", "email", at(2).date(), None, "me", at(2), at(2), "s", "1")], "id string, contact_id string, event_id string, kind string, channel string, occurred_at date, summary string, logged_by string, created_at timestamp, updated_at timestamp, source string, source_external_id string")
    contacts = spark.createDataFrame([("c1", None, None, None, "none"), ("c2", at(2).date(), "email", None, "t2_dm"), ("c3", at(1).date(), "irl", "q", "none")], "id string, last_touchpoint_at date, last_touchpoint_channel string, last_touchpoint_topic string, closeness_tier string")
    out = touchpoints.backfill(staged, idents, inter, contacts)
    assert {r["id"]: (r["match_status"], r["matched_contact_id"]) for r in out["staged"].collect()} == {"t1": ("linked", "c1"), "t2": ("orphaned", None)}
    assert {r["contact_id"] for r in out["touched"].collect()} == {"c1", "c2"}
    now = {r["id"]: (str(r["last_touchpoint_at"]), r["closeness_tier"]) for r in out["contacts"].collect()}
    assert now == {"c1": ("2026-01-05", "t2_dm"), "c2": ("None", "t2_dm"), "c3": ("2026-01-01", "none")}


def test_missing_functions(spark):
    assert [r["name"] for r in stats.missing_functions(spark, ("sha2", "no_such_thing")).collect()] == ["no_such_thing"]
