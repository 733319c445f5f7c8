import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from kinfold.functions import normalize as N
from kinfold.operators import components, matching

RANDOM = random.Random(11)
SYLLABLES = [a + b for a in ("br", "d", "f", "gl", "h", "k", "l", "m", "n", "p", "qu", "r", "s", "t", "v", "z") for b in ("a", "el", "i", "on", "ur")]
STAGED = "id string, full_name string, email string, phone string, linkedin_url string, handle string, imported_at timestamp"
IDENT = "id string, contact_id string, email string, phone string, linkedin_url string, handle string, imported_at timestamp"


class Plain(matching.Replay):
    """Compares a row with every contact created so far."""

    def decide(self, row):
        before = [dict(m, keys=dict(m["keys"])) for m in self.members]
        got = super().decide(row)
        if got[3] in ("fuzzy_name", "new_contact"):
            ref, score = (row["fuzzy_id"], row["fuzzy_score"]) if row["fuzzy_id"] else (None, 0.0)
            for m in before:
                s = matching.similarity(matching.trigram_set(row["full_name"]), m["grams"])
                if s > score:
                    ref, score = m["ref"], s
            assert (got[1], got[2]) == ((ref, score) if score >= N.REVIEW_BAND else (f"c:{row['id']}", None))
        for kind, method in matching.EXACT.items():
            first = next((m["ref"] for m in before if row[kind] and m["keys"].get(kind) == row[kind]), None)
            assert got[3] != method or got[1] == first
        return got


def replayed(names, kind, keys=0):
    state, out = kind(), []
    for i, name in enumerate(names):
        key = {k: f"{k}{RANDOM.randint(0, 10 * keys)}" if keys and RANDOM.random() < 0.2 else None for k in matching.EXACT}
        fuzzy = RANDOM.random() < 0.2
        out.append(state.decide({"id": i, "cluster_id": "c", "full_name": name, "hits": [], "fuzzy_id": "old" if fuzzy else None, "fuzzy_score": 0.6 if fuzzy else None, **key}))
    return out


def test_rows_are_compared_with_few_contacts(monkeypatch):
    """A row of a group is not compared with every contact that the group created."""
    seen = []
    similarity = matching.similarity
    monkeypatch.setattr(matching, "similarity", lambda a, b: seen.append(1) or similarity(a, b))
    names = [f"{RANDOM.choice(['Anna', 'Robert', 'Zoe', 'Ida'])} {''.join(RANDOM.choices(SYLLABLES, k=4))}" for _ in range(1500)]
    created = sum(x[0] == "merged" for x in replayed(names, matching.Replay))
    assert created > 500 and len(seen) < len(names) * created / 2 / 5


def test_the_index_of_contacts_finds_what_a_scan_finds():
    names = [f"{RANDOM.choice(['Anna', 'Robert', 'Zoe', 'Ida'])} {''.join(RANDOM.choices(SYLLABLES, k=RANDOM.randint(1, 3)))}" for _ in range(500)] + ["王伟", "王伟", "a", "a", "Jo", "jo"]
    RANDOM.shuffle(names)
    assert {"merged", "auto_matched", "needs_review"} <= {x[0] for x in replayed(names, Plain, keys=8)}


def test_a_cluster_of_decided_rows_is_not_replayed_in_one_task(spark):
    """Rows of one cluster whose existing contact is at least as near as any other row's name do not wait for each other."""
    names = [f"Ann Lee{chr(97 + i)}" for i in range(20)]
    schema = "id string, full_name string, email string, phone string, linkedin_url string, hits array<string>, fuzzy_score double"
    rows = [(f"r{i:02}", n, None, None, None, None, 1.0) for i, n in enumerate(names)] + [("n1", "Ann Leea Quark", None, None, None, None, None), ("n2", "Ann Leea Quark", None, None, None, None, None)]
    staged = spark.createDataFrame(rows, schema)
    pairs = matching.similar_pairs(matching.trigram_table(staged, "full_name"))
    assert pairs.count() >= 190
    assert {(r["id"], r["group_id"]) for r in matching.replay_groups(staged, pairs).collect()} == {("n1", "n1"), ("n2", "n1")}


def test_names_in_odd_letters_are_replayed_together(spark):
    """The replay reads full-width letters as plain ones, where SQL has no trigrams for them."""
    t0 = datetime(2026, 1, 1)
    rows = [("1", "Ｊｏｈｎ Ｓｍｉｔｈ", None), ("2", "John Smith", "j@x.y"), ("3", "Ｊｏｈｎ Ｓｍｉｔｈ", "j@x.y"), ("4", "Ｊｏｈｎ Ｓｍｉｔｈ", None)]
    staging = spark.createDataFrame([(i, n, e, None, None, None, t0 + timedelta(hours=int(i))) for i, n, e in rows], STAGED)
    got = {r["id"]: (r["match_status"], r["ref"], r["method"]) for r in matching.plan(staging, spark.createDataFrame([("c", "Zoe Vex")], "id string, full_name string"), spark.createDataFrame([], IDENT)).collect()}
    assert got == {"1": ("merged", "1:1", "new_contact"), "2": ("auto_matched", "1:1", "fuzzy_name"), "3": ("auto_matched", "1:1", "exact_email"), "4": ("auto_matched", "1:1", "fuzzy_name")}


@pytest.mark.parametrize("few", [0, 40, 1 << 20])
def test_components_labelled_in_one_task_equal_those_of_the_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    edges = [(f"n{RANDOM.randint(0, 150):03d}", f"n{RANDOM.randint(0, 150):03d}") for _ in range(110)] + [("n000", "n000"), (None, "n001")] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in label:
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    assert {r["id"]: r["label"] for r in components.connected_components(spark.createDataFrame(edges, "u string, v string")).collect()} == label
    assert components.connected_components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_a_long_path_is_labelled_at_once():
    order = np.random.default_rng(3).permutation(100_000)
    assert not components.least_labels(order[:-1], order[1:], len(order)).any()
