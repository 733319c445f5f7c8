import random

import pytest

from kinfold.llm import survivors as S


def run(spark, rows):
    return {(r["group_key"], r["field_name"]): r["survivor"] for r in S.consensus(spark.createDataFrame(rows, "group_key string, field_name string, value string, weight double")).collect()}


def profile(text, weight=1.0):
    return [{t: weight} for t in text.split()]


def test_profiles_grow():
    p = S.merge(profile("a b c", 2.0), profile("a c"))
    assert p == [{"a": 3.0}, {"b": 2.0}, {"c": 3.0}]
    p = S.merge(p, profile("a b x c"))
    assert p == [{"a": 4.0}, {"b": 3.0}, {"x": 1.0}, {"c": 4.0}]
    assert S.merge(p, profile("a b x c", 2.0))[2] == {"x": 3.0} and S.elect(p, 4.0) == ["a", "b", "c"]
    assert S.merge([], profile("x")) == [{"x": 1.0}] and S.merge(profile("x"), []) == [{"x": 1.0}] and S.merge([], []) == []


def test_tokens_vote_by_weight(spark):
    rows = [("g", "company", "Acme Robotics GmbH", 2.0), ("g", "company", "Acme Robotic GmbH", 1.0), ("g", "company", "The Acme Robotics", 1.5), ("h", "company", "Only One", 1.0)]
    assert run(spark, rows) == {("g", "company"): "Acme Robotics GmbH", ("h", "company"): "Only One"}


def test_one_heavy_value_wins(spark):
    assert run(spark, [("g", "f", "a b c", 1.0), ("g", "f", "x", 10.0), ("g", "f", "a b", 1.0)]) == {("g", "f"): "x"}


def test_the_heaviest_value_can_lose(spark):
    rows = [("g", "f", "Acme Old Name", 2.5), ("g", "f", "Beta Robotics", 2.0), ("g", "f", "Beta Robotics Inc", 2.0), ("g", "f", "Beta Robotix", 1.0)]
    assert run(spark, rows) == {("g", "f"): "Beta Robotics"}


def test_ties_are_stable_and_nothing_gives_nothing(spark):
    rows = [("g", "f", "b", 1.0), ("g", "f", "a", 1.0)]
    assert run(spark, rows) == run(spark, rows[::-1])
    assert run(spark, []) == {}


@pytest.mark.parametrize("bucket, fan_in", [(64, 16), (4, 2), (1, 3)])
def test_many_values_and_long_ones(spark, monkeypatch, bucket, fan_in):
    monkeypatch.setattr(S, "BUCKET", bucket)
    monkeypatch.setattr(S, "FAN_IN", fan_in)
    rows = [("g", "f", f"Acme Unit {i}", 1.0) for i in range(150)] + [("g", "f", "Acme Unit", 5.0), ("g", "f", "word " * 300, 1.0), ("h", "f", "x y", 1.0), ("h", "f", "x y z", 3.0), ("h", "f", "z", 1.0)]
    random.Random(1).shuffle(rows)
    assert run(spark, rows) == {("g", "f"): "Acme Unit", ("h", "f"): "x y z"}


def test_newest_survives_only_with_support(spark):
    """Of p7: a value that is newest but neither trusted nor repeated loses to what the other rows say."""
    from kinfold.llm.queries import _weighted

    values = spark.createDataFrame([("g", "f", "Acme Robotics", 4), ("g", "f", "Acme Robotics GmbH", 3), ("g", "f", "Zeta", 1), ("h", "f", "Zeta", 1), ("h", "f", "Acme", 9)], "group_key string, field_name string, value string, n long")
    summary = spark.createDataFrame([("g", "f", 8, 3, "Zeta", "Acme Robotics"), ("h", "f", 10, 2, "Zeta", "Zeta")], "group_key string, field_name string, rows long, n_values long, newest string, best string")
    got = {r["group_key"]: r["survivor"] for r in S.consensus(_weighted(values, summary)).collect()}
    assert got == {"g": "Acme Robotics", "h": "Zeta"}
