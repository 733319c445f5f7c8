import random
from datetime import datetime, timedelta

from kinfold.operators import orphans, skew

T0 = datetime(2025, 1, 1)


def frames(spark, refs, targets):
    r = spark.createDataFrame(refs, "table_name string, ref_field string, row_id string, key string, at timestamp")
    return r, spark.createDataFrame(targets, "key string, first_at timestamp")


def test_orphans_equal_brute_force_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_ROWS", 10)
    rng = random.Random(1)
    targets = {f"k{i}": T0 + timedelta(hours=rng.randint(0, 99)) for i in range(20)}
    rows = []
    for i in range(400):
        key = "k0" if i % 3 == 0 else f"k{rng.randint(0, 30)}"
        rows.append(("t", "f", f"r{i}", key, None if i % 50 == 7 else T0 + timedelta(hours=rng.randint(0, 99))))
    r, t = frames(spark, rows, list(targets.items()))
    want = {x[2] for x in rows if not (x[3] in targets and x[4] is not None and targets[x[3]] <= x[4])}
    assert {x["row_id"] for x in orphans.orphan_rows(r, t).collect()} == want
    report = orphans.orphan_report(r, t).collect()
    assert sum(x["orphans"] for x in report) == len(want)
    assert {x["period"] for x in report} <= {"2025-01", None}


def test_empty_tables(spark):
    r, t = frames(spark, [], [])
    assert orphans.orphan_rows(r, t).collect() == [] and orphans.orphan_report(r, t).collect() == []
    r, t = frames(spark, [("t", "f", "a", "k", T0), ("t", "f", "a", "k", T0)], [])
    assert len(orphans.orphan_rows(r, t).collect()) == 2


def test_blank_keys_refer_to_nothing_and_extra_columns_do_not_clash(spark):
    df = spark.createDataFrame([("1", None, T0, "x"), ("2", "a", T0, "y")], "id string, ref string, made timestamp, key string")
    assert [x["row_id"] for x in orphans.references(df, "t", "ref", "ref", "id", "made").collect()] == ["2"]


def test_lookup_join_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_ROWS", 5)
    left = spark.createDataFrame([("a", 1)] * 30 + [("b", 2), (None, 3), ("c", 4)], "k string, v int")
    right = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, w string")
    got = [(r["k"], r["v"], r["w"]) for r in skew.lookup_join(left, right, "k").collect()]
    assert len(got) == 33 and got.count(("a", 1, "x")) == 30 and (None, 3, None) in got and ("c", 4, None) in got
