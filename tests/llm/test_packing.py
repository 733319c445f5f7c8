import random
from collections import Counter, defaultdict

import pytest

from kinfold.llm import packing as P


def check(plan, histogram, capacity):
    used = Counter()
    for contents, times in plan:
        assert sum(s * n for s, n in contents.items()) <= capacity and times > 0
        for s, n in contents.items():
            used[s] += n * times
    assert +used == Counter(histogram)
    return sum(t for _, t in plan)


@pytest.mark.parametrize("sizes, capacity", [([5], 10), ([10, 10], 10), ([6, 4, 6, 4], 10), ([3] * 10, 10), ([7, 5, 3, 2] * 9, 10), ([1] * 1000, 64), ([1025] * 7, 2048), ([2048, 1], 2048)])
def test_every_item_is_placed_once(sizes, capacity):
    h = Counter(sizes)
    n = check(P.plan_containers(h, capacity, 200), h, capacity)
    assert n >= -(-sum(sizes) // capacity)


def test_program_beats_or_meets_best_fit():
    rng = random.Random(1)
    for _ in range(4):
        h = Counter(rng.randint(200, 1100) for _ in range(2000))
        plain = check(P.pack_rest(Counter(h), 2048), h, 2048)
        planned = check(P.round_program(h, 2048, 800), h, 2048)
        bound = sum(s * n for s, n in h.items()) / 2048
        assert planned <= plain * 1.01 and planned <= bound * 1.03


def test_no_items():
    assert P.plan_containers({}, 10) == []


def test_frame(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([30, 30, 30, 7, 64, 100, 200, 1, 0, None])) for i in range(500)] + [(1, 30), (1, 30), (900, 64), (901, 128), (902, 129)]
    df = spark.createDataFrame(rows, "doc_id long, n int").repartition(5)
    got = P.fill_containers(df, "doc_id", "n", 64, 200).collect()
    by = defaultdict(int)
    for r in got:
        by[r["container_id"]] += r["size"]
    assert max(by.values()) <= 64 and sorted(by) == list(range(len(by)))
    total = sum(n for _, n in rows if n)
    assert sum(by.values()) == total and len(by) <= total / 64 * 1.05 + 2
    assert Counter(r["item_id"] for r in got) == sum((Counter({i: -(-n // 64)}) for i, n in rows if n), Counter())
    assert sorted((r["chunk"], r["size"]) for r in got if r["item_id"] == 902) == [(0, 64), (1, 64), (2, 1)]
    assert P.fill_containers(spark.createDataFrame([], "doc_id long, n int"), "doc_id", "n", 64).collect() == []
