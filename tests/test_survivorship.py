import random
from datetime import datetime, timedelta

from kinfold.operators import survivorship as S

T0 = datetime(2025, 1, 1)
LOG = "id string, contact_id string, field string, new_value string, source string, confidence double, method string, created_at timestamp, verification_status string, is_current boolean, refresh_after date"


def row(i, c="c", f="location", v="a", src="s", conf=0.5, method="run", at=0, status="unverified", cur=False):
    return (str(i), c, f, v, src, conf, method, T0 + timedelta(hours=at), status, cur, None)


def elect(spark, rows):
    return {(r["contact_id"], r["field"]): r["value"] for r in S.elect(spark.createDataFrame(rows, LOG)).collect()}


def test_election_order(spark):
    assert elect(spark, [row(1, v="old", at=1), row(2, v="new", at=2)]) == {("c", "location"): "new"}
    assert elect(spark, [row(1, v="hand", method="manual_set", at=0), row(2, v="new", at=2)]) == {("c", "location"): "hand"}
    assert elect(spark, [row(1, v="low", conf=0.3), row(2, v="none", conf=None), row(3, v="high", conf=0.41)]) == {("c", "location"): "high"}


def test_disputed_values_never_win(spark):
    assert elect(spark, [row(1, v="bad", at=5), row(2, v="bad", status="disputed"), row(3, v="ok")]) == {("c", "location"): "ok"}
    assert elect(spark, [row(1, v=None, at=5), row(2, v=None, status="disputed")]) == {}
    assert elect(spark, [row(1, v="x", status=None)]) == {("c", "location"): "x"}
    assert elect(spark, []) == {}


def serial(cands, log):
    log = [dict(zip(("id", "c", "f", "v", "src", "conf", "method", "at", "status", "cur", "r"), r)) for r in log]
    out = {}
    for id_, c, f, v, src, method, conf, _ in cands:
        mine = [r for r in log if r["c"] == c and r["f"] == f]
        if f in S.ARRAY_FIELDS:
            out[id_] = "noop"
            continue
        disputed = any(r["status"] == "disputed" and r["v"] == v for r in mine)
        manual = any(r["method"] == "manual_set" and r["cur"] for r in mine)
        would = "golden" if method == "manual_set" else "losing" if disputed else "review" if manual else "golden" if (conf or 0) >= 0.7 else "review"
        if would == "losing":
            out[id_] = would
            continue
        if any(r["v"] == v and r["src"] == src and src is not None for r in mine):
            out[id_] = "noop"
            continue
        log.append({"id": id_, "c": c, "f": f, "v": v, "src": src, "conf": conf, "method": method, "at": T0 + timedelta(days=1, seconds=len(log)), "status": "unverified", "cur": False, "r": None})
        out[id_] = would
        if would == "golden":
            mine = [r for r in log if r["c"] == c and r["f"] == f]
            dead = {r["v"] for r in mine if r["status"] == "disputed"}
            live = [r for r in mine if r["status"] != "disputed" and r["v"] not in dead]
            win = max(live, key=lambda r: (r["method"] == "manual_set", r["at"], 0.4 if r["conf"] is None else r["conf"]), default=None)
            for r in mine:
                r["cur"] = r is win
    return out


def test_arbitration_equals_serial(spark):
    rng = random.Random(11)
    for _ in range(3):
        log = []
        for c in range(12):
            for f in ("location", "current_role"):
                n = rng.randint(0, 3)
                part = [row(f"l{c}{f}{k}", f"c{c}", f, rng.choice(["a", "b", None]), rng.choice(["s", "t"]), 0.5, "run", k, rng.choice(["unverified", "disputed"])) for k in range(n)]
                log += part
        cands = [(f"k{i:03d}", f"c{rng.randint(0, 11)}", rng.choice(["location", "current_role", "tags"]), rng.choice(["a", "b", "c", None]), rng.choice(["s", "t", None]), rng.choice(["run", "run", "manual_set"]), rng.choice([None, 0.2, 0.7, 0.9]), i) for i in range(150)]
        df = spark.createDataFrame(cands, "id string, contact_id string, field string, value string, source string, method string, confidence double, seq int")
        got = {r["id"]: r["outcome"] for r in S.arbitrate(df, spark.createDataFrame(log, LOG)).collect()}
        assert got == serial(cands, log)


def test_array_outcomes(spark):
    log = spark.createDataFrame([row(1, f="tags", v="dead", status="disputed")], LOG)
    contacts = spark.createDataFrame([("c", ["have"]), ("d", None)], "id string, tags array<string>")
    cands = spark.createDataFrame([("1", "c", "have"), ("2", "c", "dead"), ("3", "c", "new"), ("4", "c", "new"), ("5", "c", " "), ("6", "c", None), ("7", "d", "new")], "id string, contact_id string, value string")
    got = {r["id"]: r["outcome"] for r in S.apply_array(cands, contacts, log, "tags").collect()}
    assert got == {"1": "already", "2": "tombstoned", "3": "added", "4": "already", "5": "noop", "6": "noop", "7": "added"}
    assert {r["id"]: r["values"] for r in S.reject_array(contacts, spark.createDataFrame([("c", "have")], "contact_id string, value string"), "tags").collect()} == {"c": [], "d": []}


def test_due_dates(spark):
    got = {r["id"]: str(r["due"]) for r in S.due_dates(spark.createDataFrame([row(1), row(2, f="current_role"), row(3, method="manual_set"), row(4, f="website_url")], LOG)).collect()}
    assert got == {"1": "2025-06-30", "2": "2025-04-01", "3": "None", "4": "None"}
