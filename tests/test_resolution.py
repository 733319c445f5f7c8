import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from kinfold.functions import normalize as N
from kinfold.operators import matching
from kinfold.operators.components import connected_components

T0 = datetime(2025, 1, 1)
STAGED = "id string, source string, source_external_id string, full_name string, email string, phone string, linkedin_url string, handle string, role string, company string, location string, twitter_username string, github_username string, website_url string, match_status string, imported_at timestamp"
GOLD = "id string, full_name string, current_position string, current_company string, location string, twitter_username string, github_username string, website_url string"
IDENT = "id string, contact_id string, email string, phone string, linkedin_url string, handle string, imported_at timestamp"


def staged(i, name=None, email=None, phone=None, url=None, handle=None, company=None, at=None, **more):
    return (str(i), "s", f"x{i}", name, email, phone, url, handle, more.get("role"), company, more.get("location"), None, None, None, "pending", T0 + timedelta(seconds=i if at is None else at))


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randint(0, 150):03d}", f"n{rng.randint(0, 150):03d}") for _ in range(120)] + [("n000", "n000"), (None, "n001")] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("hub", f"s{i}") for i in range(50)]
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
    got = {r["id"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_trigrams_are_made_once_per_distinct_text(spark):
    """No filter on the trigrams of every row stands below the distinct, and texts without any are in no pair."""
    df = spark.createDataFrame([("Ada Lovelace",), ("ada  lovelace",), ("...",), ("!!",), (None,)], "full_name string")
    table = matching.trigram_table(df, "full_name")
    below = table._jdf.queryExecution().optimizedPlan().toString().split("Aggregate", 1)[1].split("\n", 1)[1]
    assert "transform" not in below and "sequence" not in below
    assert [(r["a"], r["b"], r["score"]) for r in matching.similar_pairs(table).collect()] == [("Ada Lovelace", "ada  lovelace", 1.0)]


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 9))) for _ in range(150)] + ["Łukasz Ørsted", "lukasz orsted", "", " ", "Zoë", "zoe", "x" * 5000]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "full_name string")
    got = {(r["a"], r["b"]): r["score"] for r in matching.similar_pairs(matching.trigram_table(df, "full_name")).collect()}
    sets = {n: matching.trigram_set(n) for n in set(names)}
    want = {(a, b): matching.similarity(sets[a], sets[b]) for a in sets for b in sets if a < b and sets[a] and sets[b] and matching.similarity(sets[a], sets[b]) >= N.REVIEW_BAND}
    assert got == want and ("Zoë", "zoe") in got or ("zoe", "Zoë") in got


def test_exact_hits_and_conflicts(spark):
    s = spark.createDataFrame([staged(1, "A", "a@x.y"), staged(2, "B", "a@x.y", "415 555 1234"), staged(3, "C", "info@x.y"), staged(4, "D")], STAGED)
    i = spark.createDataFrame([("i1", "c1", "A@x.y", None, None, None, T0), ("i2", "c2", None, "+14155551234", None, None, T0), ("i3", "c3", "info@x.y", None, None, None, T0), ("i4", "c9", "a@x.y", None, None, None, T0 + timedelta(days=1))], IDENT)
    got = {r["id"]: (r["contact_id"], r["score"], r["method"]) for r in matching.resolve_exact(matching.exact_hits(s, i)).collect()}
    assert got == {"1": ("c1", 1.0, "exact_email"), "2": ("c1", 0.75, "conflicting_keys")}


def test_plan_follows_the_order_of_rows(spark):
    rows = [staged(1, "Ada Lovelace", "ada@x.y"), staged(2, "A. L.", "ada@x.y", phone="415 555 1234"), staged(3, "Somebody", phone="4155551234"), staged(4, None, "n@x.y"), staged(5, "Ada Lovelac"), staged(6, "Quite Different"), staged(7, "Grace Hopper", "grace@x.y"), staged(8, "ADA  lovelace"), staged(9, "Conflict", "ada@x.y", url="linkedin.example/in/g")]
    contacts = spark.createDataFrame([("c1", "Grace Hopper") + (None,) * 6], GOLD)
    ident = spark.createDataFrame([("i", "c1", None, None, "linkedin.example/in/g", None, T0)], IDENT)
    got = {r["id"]: (r["match_status"], r["ref"], r["method"]) for r in matching.plan(spark.createDataFrame(rows, STAGED), contacts, ident).collect()}
    ref = got["1"][1]
    assert got["1"] == ("merged", ref, "new_contact") and ref.endswith(":1")
    assert got["2"] == ("auto_matched", ref, "exact_email")
    assert got["3"] == ("auto_matched", ref, "exact_phone")  # the key that row 2 brought
    assert got["4"] == ("rejected", None, "no_name")
    assert got["5"][0] == "needs_review" and got["5"][1] == ref
    assert got["6"][0] == "merged"
    assert got["7"][:2] == ("auto_matched", "c1") and got["7"][2] == "fuzzy_name"
    assert got["8"] == ("auto_matched", ref, "fuzzy_name")
    assert got["9"] == ("needs_review", ref, "conflicting_keys")


def test_fold_equals_serial(spark):
    rng = random.Random(7)
    gold = {f"c{i}": rng.choice([None, "", "X", "Y"]) for i in range(12)}
    cleared = {c for c in gold if rng.random() < 0.3}
    rows = [(f"r{i}", f"c{rng.randint(0, 11)}", i, rng.choice([None, "", "X", "Y", "Z"])) for i in range(200)]
    want, acc = [], dict(gold)
    for rid, c, _, v in rows:
        if not v:
            continue
        if not acc[c]:
            if c in cleared:
                want.append((rid, "conflict"))
            else:
                acc[c] = v
                want.append((rid, "fill"))
        elif acc[c] != v:
            want.append((rid, "conflict"))
    fields = list(matching.FILL.values())
    att = spark.createDataFrame(rows, "id string, contact_id string, seq int, company string").select("*", *[F.lit(None).cast("string").alias(f) for f in fields if f != "company"])
    contacts = spark.createDataFrame(list(gold.items()), "id string, current_company string").select("*", *[F.lit(None).cast("string").alias(g) for g in matching.FILL if g != "current_company"])
    elected = spark.createDataFrame([(c, "current_company") for c in cleared], "contact_id string, field string")
    assert sorted((r["id"], r["kind"]) for r in matching.fold(att, contacts, elected).collect()) == sorted(want)


def test_the_plan_equals_a_serial_run_over_all_rows(spark):
    """A run without clusters, row by row over one list of contacts, decides the same."""
    import random
    from datetime import datetime, timedelta

    from kinfold.operators import matching as M

    rng = random.Random(5)
    names = ["Robert Smithson", "Robart Smithson", "Anna Gellert", "Anna Gelert", "Zoe Quarrington", "Ida Vexley", "Ida Vexly", "", None, "Theodore Walkenhurst"]
    rows, contacts, idents = [], [], []
    for i in range(40):
        email = f"m{rng.randint(0, 12)}@x.example" if rng.random() < 0.4 else None
        phone = f"+1555000{rng.randint(0, 9):04}" if rng.random() < 0.2 else None
        rows.append((f"s{i:02}", "a", rng.choice(names), email, phone, None, None, datetime(2026, 1, 1) + timedelta(hours=rng.randint(0, 400))))
    for i in range(6):
        contacts.append((f"c{i}", names[i]))
        idents.append((f"i{i}", f"c{i}", f"m{i}@x.example", None, None, None, datetime(2025, 1, 1)))
    staging = spark.createDataFrame(rows, "id string, source string, full_name string, email string, phone string, linkedin_url string, handle string, imported_at timestamp")
    got = {r["id"]: (r["match_status"], r["ref"] and r["ref"].split(":")[-1], r["score"] and round(r["score"], 4), r["method"]) for r in M.plan(staging, spark.createDataFrame(contacts, "id string, full_name string"), spark.createDataFrame(idents, "id string, contact_id string, email string, phone string, linkedin_url string, handle string, imported_at timestamp")).collect()}
    known = [{"ref": c, "grams": M.trigram_set(n), "email": {f"m{i}@x.example"}, "phone": set(), "old": True} for i, (c, n) in enumerate(contacts)]
    want = {}
    for i, _, name, email, phone, _, _, _ in sorted(rows, key=lambda r: (r[7], r[0])):
        if not name:
            want[i] = ("rejected", None, None, "no_name")
            continue
        hits = []
        for kind, value in (("email", email), ("phone", phone and phone[1:])):
            for k in known:
                if value and value in k[kind] and k["ref"] not in [h for h, _ in hits]:
                    hits.append((k["ref"], "exact_" + kind))
        if len(hits) > 1:
            want[i] = ("needs_review", hits[0][0], 0.75, "conflicting_keys")
            continue
        best = max(((M.similarity(M.trigram_set(name), k["grams"]), k["old"], k) for k in known), key=lambda x: (x[0], x[1]))
        if hits or best[0] >= 0.92:
            target = next(k for k in known if k["ref"] == hits[0][0]) if hits else best[2]
            want[i] = ("auto_matched", target["ref"], 1.0 if hits else round(best[0], 4), hits[0][1] if hits else "fuzzy_name")
            if not target["old"]:
                for kind, value in (("email", email), ("phone", phone and phone[1:])):
                    if value and not target[kind]:
                        target[kind].add(value)
        elif best[0] >= 0.55:
            want[i] = ("needs_review", best[2]["ref"], round(best[0], 4), "fuzzy_name")
        else:
            want[i] = ("merged", i, None, "new_contact")
            known.append({"ref": i, "grams": M.trigram_set(name), "email": {email} - {None}, "phone": {phone and phone[1:]} - {None}, "old": False})
    assert got == want and {"merged", "auto_matched", "needs_review", "rejected"} <= {w[0] for w in want.values()}
