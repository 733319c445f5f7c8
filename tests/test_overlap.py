import itertools
import random

import pyarrow as pa
import pytest

from kinfold.operators import overlap
from kinfold.operators.matching import clusters, similarity, trigram_set

RANDOM = random.Random(5)
SYLLABLES = ["il", "vodd", "eira", "gre", "ald", "nor", "mer", "ton", "pal", "sze", "ova", "lind"]
FIRST = ["Frederick", "Ekaterina", "Friederike", "Wilhelmina"]
NAMES = sorted({f"{RANDOM.choice(FIRST)} {''.join(RANDOM.choices(SYLLABLES, k=RANDOM.randint(2, 4)))}" for _ in range(300)} | {"Jo Li", "Jo", "a", " ".join(map(str, range(300, 420))), " ".join(map(str, range(303, 422)))})


def run(left, right=None, least=0.55):
    rows = [(n, s, sorted(trigram_set(n))) for s, side in enumerate((left, right or [])) for n in side]
    df: dict = {}
    for g in itertools.chain.from_iterable(r[2] for r in rows):
        df[g] = df.get(g, 0) + 1
    order = sorted(df, key=lambda g: (df[g], g))
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in p]), pa.array([r[2] for r in p]), pa.array([r[1] for r in p], pa.int32())], ["name", "grams", "side"]) for p in (rows[:400], rows[400:]) if p]
    filed = pa.Table.from_batches(overlap.filed(order, least)(iter(batches))).sort_by("gram").combine_chunks()
    out = [x for b in overlap.paired(least, right is None)(filed.to_batches(max_chunksize=500)) for x in b.to_pylist()]
    pairs = [(min(x["a"], x["b"]), max(x["a"], x["b"])) if right is None else (x["a"], x["b"]) for x in out]
    assert len(pairs) == len(set(pairs))
    return dict(zip(pairs, [x["score"] for x in out]))


@pytest.mark.parametrize("many, depth", [(1 << 27, 3), (400, 1), (2000, 2)])
@pytest.mark.parametrize("two", [False, True])
def test_pairs_equal_brute_force(monkeypatch, many, depth, two):
    monkeypatch.setattr(overlap, "MANY", many)
    monkeypatch.setattr(overlap.candidates, "__defaults__", (depth,))
    left, right = (NAMES[::2], NAMES[1::2] + NAMES[:60:2]) if two else (NAMES, None)
    sets = {n: trigram_set(n) for n in NAMES}
    want = {(a, b): s for a, b in (itertools.product(left, right) if two else itertools.combinations(NAMES, 2)) if (s := similarity(sets[a], sets[b])) >= 0.55}
    got = run(left, right)
    assert len(want) > 100 and got == want


def test_first_names_open_no_lists_of_all_pairs(monkeypatch):
    """Names of one first name share its trigrams, so that lists by trigram hold all of their pairs; most must never be compared."""
    seen = []
    compared = overlap.compared
    monkeypatch.setattr(overlap, "compared", lambda a, b, same: seen.append(len(a.n) * len(b.n)) or compared(a, b, same))
    names = sorted({"Frederick " + "".join(RANDOM.sample(SYLLABLES, 4)) for _ in range(500)})
    whole = run(names)
    plain, seen[:] = sum(seen), []
    monkeypatch.setattr(overlap, "MANY", 10_000)
    assert run(names) == whole and sum(seen) < plain


def test_two_sides_open_no_lists_of_all_pairs(monkeypatch):
    seen = []
    compared = overlap.compared
    monkeypatch.setattr(overlap, "compared", lambda a, b, same: seen.append(len(a.n) * len(b.n)) or compared(a, b, same))
    left, right = (sorted({"Frederick " + "".join(RANDOM.sample(SYLLABLES, 4)) for _ in range(400)}) for _ in range(2))
    whole = run(left, right)
    plain, seen[:] = sum(seen), []
    monkeypatch.setattr(overlap, "MANY", 10_000)
    assert run(left, right) == whole and sum(seen) < plain


def test_clusters_read_their_targets_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    staging = spark.createDataFrame([(i, n, None, None, None, None) for i, n in (("a", "Ann Lee"), ("b", "Bo Ray"))], "id string, full_name string, email string, phone string, linkedin_url string, handle string")
    fuzzy = spark.createDataFrame([("Ann Lee", "c", 0.95), ("Bo Ray", "c", 0.95)], "name string, contact_id string, score double").mapInPandas(counted, "name string, contact_id string, score double")
    assert {(r["id"], r["cluster_id"]) for r in clusters(staging, None, fuzzy).collect()} == {("a", "a"), ("b", "a")}
    assert seen.value == 2
