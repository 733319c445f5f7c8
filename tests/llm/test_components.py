import random

import pytest

from kinfold.llm import components as C
from kinfold.operators import skew


def find_all(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("seed", [1, 2])
def test_boruvka_equals_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randint(0, 200):03d}", f"n{rng.randint(0, 200):03d}") for _ in range(150)] + [("a", "a"), (None, "b")]
    edges += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)] + [(f"s{i}", "hub") for i in range(80)]
    edges += edges[:20]
    got = {r["id"]: r["label"] for r in C.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == find_all(edges)


def test_no_edges(spark):
    assert C.components(spark.createDataFrame([], "u string, v string")).collect() == []


def test_groups_with_a_hot_key_nulls_and_chains(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_ROWS", 10)
    rows = [(f"h{i:02d}", "hot@x.y", None, f"p{i}") for i in range(40)] + [("a", "1@x.y", None, None), ("b", "1@x.y", "u", None), ("c", None, "u", None), ("d", None, None, None), ("e", "lone@x.y", None, None), ("z", None, None, "p39"), ("a", "1@x.y", None, None)]
    df = spark.createDataFrame(rows, "id string, email string, url string, phone string").withColumn("group_id", __import__("pyspark").sql.functions.lit("clash"))
    got = {r["row_id"]: r["group_id"] for r in C.key_groups(df, "id", ["email", "url", "phone"]).collect()}
    assert {got[x] for x in ("a", "b", "c")} == {"a"} and "d" not in got and "e" not in got
    assert {got[f"h{i:02d}"] for i in range(40)} == {"h00"} == {got["z"]}


def test_card_keys_leave_shared_mailboxes_out(spark):
    df = spark.createDataFrame([("1", " INFO@x.y ", None, None, None), ("2", "Ada@x.y", "415-555-1234", "HTTPS://www.linkedin.example/in/A/", "@Ada")], "id string, email string, phone string, linkedin_url string, handle string")
    got = {r["id"]: tuple(r)[1:] for r in C.card_keys(df).collect()}
    assert got == {"1": (None,) * 4, "2": ("ada@x.y", "14155551234", "linkedin.example/in/a", "ada")}
