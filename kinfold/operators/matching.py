"""Resolution of staged people: exact keys, trigram similarity, clusters, in-order replay and the fold into golden records."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import keys as K
from kinfold.functions import normalize as N
from kinfold.operators import overlap
from kinfold.operators.components import connected_components
from kinfold.operators.skew import lookup_join
from kinfold.session import cut

#: Keys that decide, in order, and the method each is named by. Shared mailboxes do not count.
EXACT = {"email": "exact_email", "linkedin_url": "exact_linkedin", "phone": "exact_phone"}
#: Golden columns that a staged column fills.
FILL = {"current_position": "role", "current_company": "company", "location": "location", "twitter_username": "twitter_username", "github_username": "github_username", "website_url": "website_url"}


def personal_key(kind: str, column: str | None = None) -> str:
    k = K.KEY_BUILDERS[kind](column or kind)
    return f"(case when not {K.is_role_email(k)} then {k} end)" if kind == "email" else k


def key_table(df: DataFrame, row_id: str, kinds: tuple[str, ...], *also: str) -> DataFrame:
    """(row_id, rank, key, also..) of canonical keys marked with their kind."""
    return df.select(row_id, *also, F.posexplode(F.array(*[F.concat(F.lit(k + ":"), F.expr(personal_key(k))) for k in kinds])).alias("rank", "key")).filter("key is not null")


def exact_hits(staging: DataFrame, identities: DataFrame) -> DataFrame:
    """(id, contact_id, method): contacts that hold a key of a staged row; a contact found by several keys counts by the first."""
    held = key_table(identities, "contact_id", tuple(EXACT), "imported_at", "id").groupBy("key").agg(F.min_by("contact_id", F.struct("imported_at", "id")).alias("owner"))
    hits = lookup_join(key_table(staging, "id", tuple(EXACT)), held, "key").filter("owner is not null")
    methods = F.element_at(F.array(*[F.lit(m) for m in EXACT.values()]), F.col("rank") + 1)
    return hits.groupBy("id", F.col("owner").alias("contact_id")).agg(F.min("rank").alias("rank")).select("id", "contact_id", "rank", methods.alias("method"))


def resolve_exact(hits: DataFrame) -> DataFrame:
    """(id, contact_id, score, method) per row with hits: one contact scores 1, several are conflicting keys at the first one."""
    per = hits.groupBy("id").agg(F.count("*").alias("n"), F.min_by(F.struct("contact_id", "method"), F.struct("rank", "contact_id")).alias("f"))
    return per.select("id", "f.contact_id", F.when(F.col("n") == 1, 1.0).otherwise(N.CONFLICT_SCORE).alias("score"), F.when(F.col("n") == 1, F.col("f.method")).otherwise("conflicting_keys").alias("method"))


def trigram_table(df: DataFrame, column: str) -> DataFrame:
    """(name, grams) of the distinct texts. Those without a trigram stay: a filter on it would be pushed below the distinct and make the
    trigrams of every row once more; `overlap` files nothing for them."""
    return df.filter(F.col(column).isNotNull()).select(F.col(column).alias("name")).distinct().withColumn("grams", F.expr(N.trigrams("name")))


def similar_pairs(left: DataFrame, right: DataFrame | None = None, least: float = N.REVIEW_BAND, written: bool = False) -> DataFrame:
    """(a, b, score) of distinct texts whose trigram sets have a Jaccard similarity of at least `least`; within one table a < b.

    Prefix filtering: only each text's rarest trigrams open candidates, which loses no pair, so common trigrams need no cap (see
    `overlap`). Trigrams over letters, digits and blank are at most 37^3, so their order fits the driver.
    left, right: (name, grams). written: both are tables already, so that reading them twice costs little."""
    sides = [x.select("name", "grams", F.lit(i).alias("side")) for i, x in enumerate((left, right)) if x is not None]
    every = sides[0] if right is None else sides[0].unionByName(sides[1])
    every = every if written else cut(every)
    order = [r[0] for r in every.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df")).orderBy("df", "gram").collect()]
    listed = every.mapInArrow(overlap.filed(order, least), overlap.FILED).repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "gram").sortWithinPartitions("gram")
    found = listed.mapInArrow(overlap.paired(least, right is None), overlap.PAIRED)
    return found if right is not None else found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")


def best_by_name(staging: DataFrame, contacts: DataFrame, grams: DataFrame | None = None) -> DataFrame:
    """(name, contact_id, score): the contact with the most similar name of each staged name, from the review band on; ties to the
    smaller id. grams: the trigrams of the staged names, where they are written already."""
    known = trigram_table(contacts, "full_name")
    pairs = similar_pairs(trigram_table(staging, "full_name"), known) if grams is None else similar_pairs(grams, cut(known), written=True)
    named = contacts.filter("full_name is not null").groupBy(F.col("full_name").alias("b")).agg(F.min("id").alias("contact_id"))
    return pairs.join(named, "b").groupBy(F.col("a").alias("name")).agg(F.max_by(F.struct("contact_id", "score"), F.struct("score", F.expr("translate(contact_id, '0123456789abcdef', 'fedcba9876543210')"))).alias("m")).select("name", "m.contact_id", "m.score")


def search_name(contacts: DataFrame, query: str, most: int = 10, least: float = 0.3) -> DataFrame:
    """(id, score): contacts by similarity of their name to one query."""
    spark = contacts.sparkSession
    asked = F.broadcast(spark.createDataFrame([(query,)], "q string").select(F.expr(N.trigrams("q")).alias("q")))
    inter = F.size(F.array_intersect("grams", "q"))
    scored = contacts.select("id", F.expr(N.trigrams("full_name")).alias("grams")).join(asked, F.size("grams") > 0).select("id", (inter / (F.size("grams") + F.size("q") - inter)).alias("score"))
    return scored.filter(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(most)


def hints(refs: DataFrame, contacts: DataFrame, most: int = 3) -> DataFrame:
    """(ref, hint, place): the names most similar to each reference, from the review band on; ties to the smaller name."""
    pairs = similar_pairs(trigram_table(refs, "ref"), trigram_table(contacts, "full_name"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return pairs.withColumn("place", place).filter(F.col("place") <= most).select(F.col("a").alias("ref"), F.col("b").alias("hint"), "place")


def review_queue(staging: DataFrame, most: int) -> DataFrame:
    """(id, full_name, match_confidence, place) of the rows to review first: those without a confidence lead, then the most confident."""
    rows = staging.filter("match_status = 'needs_review'").orderBy(F.col("match_confidence").desc_nulls_first(), "id").limit(most)
    return rows.select("id", "full_name", "match_confidence", F.row_number().over(Window.orderBy(F.col("match_confidence").desc_nulls_first(), "id")).alias("place"))


def clusters(staging: DataFrame, exact: DataFrame | None = None, fuzzy: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(id, cluster_id) of every staged row: rows linked by an equal key, by similar names, or by one common contact, directly or
    through others; alone otherwise. cluster_id is the smallest id. pairs: the similar pairs of staged names, where they are known."""
    keyed = key_table(staging, "id", ("email", "phone", "linkedin_url", "handle")).select("id", "key")
    named = staging.filter("full_name is not null").select("id", F.concat(F.lit("name:"), F.col("full_name")).alias("key"))
    targets = []
    if exact is not None:
        targets.append(exact.groupBy("id").agg(F.count("*").alias("n"), F.min("contact_id").alias("c")).filter("n = 1").select("id", F.concat(F.lit("contact:"), F.col("c")).alias("key")))
    if fuzzy is not None:
        open_ = staging.select("id", F.col("full_name").alias("name")).join(fuzzy.filter(F.col("score") >= N.AUTO_MERGE), "name")
        open_ = open_.join(exact.select("id").distinct(), "id", "left_anti") if exact is not None else open_
        targets.append(open_.select("id", F.concat(F.lit("contact:"), F.col("contact_id")).alias("key")))
    stars = keyed.unionByName(named)
    for t in targets:
        stars = stars.unionByName(t)
    stars = cut(stars)
    hubs = cut(stars.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("_n")))
    edges = lookup_join(stars, hubs.drop("_n"), "key", hubs.select("key", "_n")).select(F.col("id").alias("u"), F.col("hub").alias("v"))
    pairs = similar_pairs(trigram_table(staging, "full_name")) if pairs is None else pairs
    first = hubs.filter("key like 'name:%'").select(F.expr("substring(key, 6)").alias("name"), "hub")
    by_name = pairs.join(first.select(F.col("name").alias("a"), F.col("hub").alias("u")), "a").join(first.select(F.col("name").alias("b"), F.col("hub").alias("v")), "b").select("u", "v")
    found = connected_components(edges.unionByName(by_name))
    return staging.select("id").join(found, "id", "left").select("id", F.coalesce("label", "id").alias("cluster_id"))


def trigram_set(text: str | None) -> frozenset[str]:
    """The trigram set in Python, for decisions inside the replay; the same folding as the SQL form for Latin names."""
    import re
    import unicodedata

    if not text:
        return frozenset()
    low = text.lower()
    for a, b in N.LIGATURES.items():
        low = low.replace(a, b)
    low = "".join(N.STROKES.get(c, c) for c in low)
    low = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
    return frozenset(p[i : i + 3] for w in re.split("[^a-z0-9]+", low) if w for p in ["  " + w + " "] for i in range(len(w) + 1))


def similarity(a: frozenset[str], b: frozenset[str]) -> float:
    union = len(a | b)
    return len(a & b) / union if union else 0.0


class Replay:
    """Decisions on the rows of one group in order: what a row resolves to depends on the contacts that rows before it created.

    The contacts are filed under their keys and under the rarest trigrams of their names, of which two names at the review band share
    one (see `overlap`), so that a row is compared with few of them. What is rare is counted again whenever their number has doubled."""

    def __init__(self) -> None:
        self.members: list[dict] = []
        self.at: dict[str, int] = {}
        self.keyed: dict[tuple[str, str], int] = {}
        self.counts: dict[str, int] = {}
        self.filed: dict[str, list[int]] = {}

    def decide(self, row: dict) -> tuple[str, str | None, float | None, str]:
        """(status, reference, score, method). row: id, cluster_id, full_name, email, linkedin_url, phone (canonical), hits as
        [(method, contact_id)] in key order, fuzzy_id, fuzzy_score."""
        if not row["full_name"]:
            return "rejected", None, None, "no_name"
        held = dict(reversed([(m, c) for m, c in row["hits"]]))
        targets: dict[str, str] = {}
        for kind, method in EXACT.items():
            value = row[kind]
            if not value:
                continue
            if method in held:
                targets.setdefault(held[method], method)
            if (kind, value) in self.keyed:
                targets.setdefault(self.members[self.keyed[kind, value]]["ref"], method)
        if len(targets) > 1:
            return "needs_review", next(iter(targets)), N.CONFLICT_SCORE, "conflicting_keys"
        if targets:
            ref, method = next(iter(targets.items()))
            self._attach(ref, row)
            return "auto_matched", ref, 1.0, method
        ref, score = (row["fuzzy_id"], row["fuzzy_score"]) if row["fuzzy_id"] else (None, 0.0)
        grams = trigram_set(row["full_name"])
        for i in sorted({i for g in self._rarest(grams, max(score, N.REVIEW_BAND)) for i in self.filed.get(g, ())}):
            s = similarity(grams, self.members[i]["grams"])
            if s > score:
                ref, score = self.members[i]["ref"], s
        if ref and score >= N.AUTO_MERGE:
            self._attach(ref, row)
            return "auto_matched", ref, score, "fuzzy_name"
        if ref and score >= N.REVIEW_BAND:
            return "needs_review", ref, score, "fuzzy_name"
        key = f"{row['cluster_id']}:{row['id']}"
        self.at[key] = len(self.members)
        self.members.append({"ref": key, "grams": grams, "keys": {}})
        self._attach(key, row)
        self._file()
        return "merged", key, None, "new_contact"

    def _rarest(self, grams: frozenset[str], least: float) -> list[str]:
        """The trigrams of which a set shares one with any other at the bound."""
        n = len(grams)
        return sorted(grams, key=lambda g: (self.counts.get(g, 0), g))[: n - int(overlap.least_common(n, least)) + 1] if n else []

    def _file(self) -> None:
        """The last contact; all of them, in the order of new counts, when there are twice as many as at the last time."""
        n = len(self.members)
        again = n & (n - 1) == 0
        if again:
            self.counts, self.filed = Counter(g for m in self.members for g in m["grams"]), {}
        for i in range(0 if again else n - 1, n):
            for g in self._rarest(self.members[i]["grams"], N.REVIEW_BAND):
                self.filed.setdefault(g, []).append(i)

    def _attach(self, ref: str, row: dict) -> None:
        """A contact created here takes the keys that it lacks; of several contacts with a key, the first created has it."""
        i = self.at.get(ref)
        if i is None:
            return
        keys = self.members[i]["keys"]
        for k in EXACT:
            if row[k] and k not in keys:
                keys[k] = row[k]
                self.keyed[k, row[k]] = min(i, self.keyed.get((k, row[k]), i))


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    group, state = None, Replay()
    for pdf in batches:
        out = []
        for row in pdf.to_dict("records"):
            if row["group_id"] != group:
                group, state = row["group_id"], Replay()
            row["hits"] = [(h["method"], h["contact_id"]) for h in (row["hits"] if row["hits"] is not None else [])]
            for k in ("full_name", "fuzzy_id", *EXACT):
                row[k] = row[k] if isinstance(row[k], str) and row[k] else None
            out.append((row["id"], row["cluster_id"], *state.decide(row)))
        yield pd.DataFrame(out, columns=["id", "cluster_id", "match_status", "ref", "score", "method"])


def _alone(rows: DataFrame) -> DataFrame:
    """The decisions of Replay on rows that are the only one of their group, in columns: no row before them created a contact."""
    targets = F.array_distinct(F.transform("hits", lambda h: h["contact_id"]))
    n = F.coalesce(F.size(targets), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    first = F.get("hits", F.lit(0))
    fuzzy = F.when(F.col("fuzzy_id").isNotNull(), F.col("fuzzy_score"))
    named = F.col("full_name").isNotNull()
    clash, one = named & (n > 1), named & (n == 1)
    auto, near = named & (n == 0) & (fuzzy >= N.AUTO_MERGE), named & (n == 0) & (fuzzy >= N.REVIEW_BAND)
    key = F.concat("cluster_id", F.lit(":"), "id")
    return rows.select(
        "id", "cluster_id",
        F.when(~named, "rejected").when(clash, "needs_review").when(one | auto, "auto_matched").when(near, "needs_review").otherwise("merged").alias("match_status"),
        F.when(clash | one, first["contact_id"]).when(auto | near, F.col("fuzzy_id")).when(named, key).alias("ref"),
        F.when(clash, N.CONFLICT_SCORE).when(one, 1.0).when(auto | near, fuzzy).alias("score"),
        F.when(~named, "no_name").when(clash, "conflicting_keys").when(one, first["method"]).when(auto | near, "fuzzy_name").otherwise("new_contact").alias("method"),
    )


def relevant_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v): rows linked where the name of one may decide about the other in a replay.

    A contact is created by a row without hits whose name is like no existing contact's. Another row without hits asks for it where
    their names are more alike than its own and the best existing contact's. rows: (id, full_name, fuzzy_score) of those without hits."""
    names = cut(rows.groupBy("full_name").agg(F.min("id").alias("hub"), F.count("*").alias("_n"), F.max("fuzzy_score").alias("best")))
    creating = names.filter("best is null").select(F.col("full_name").alias("b"), F.col("hub").alias("v"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    near = cut(both.join(creating, "b").join(names.select(F.col("full_name").alias("a"), F.col("hub").alias("u"), "best"), "a").filter("best is null or score > best").select("u", "v"))
    asking = names.join(near.select(F.col("u").alias("hub")).distinct().withColumn("asks", F.lit(True)), "hub", "left").filter("_n > 1 and (best is null or asks)")
    same = lookup_join(rows.select("id", "full_name"), asking.select("full_name", "hub"), "full_name", names.select("full_name", "_n")).filter("hub is not null")
    return near.unionByName(same.select(F.col("id").alias("u"), F.col("hub").alias("v")))


def odd_pairs(rows: DataFrame) -> DataFrame | None:
    """(a, b, score) of similar names of one cluster, as a replay sees them, where it reads one of them in other trigrams than SQL does,
    such as full-width letters; None where there are no such names. rows: (full_name, cluster_id)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(grams=[sorted(trigram_set(n)) for n in pdf["name"]])

    names = rows.filter("full_name is not null").select(F.col("full_name").alias("name"), "cluster_id")
    # SQL leaves these letters as they are, or takes a joiner away that has no place among the accents
    beyond = names.filter(F.expr(N.unaccent_lower("name")).rlike("[^\\x00-\\x7f]") | F.col("name").contains("\u034f")).distinct()
    form = "name string, cluster_id string, grams array<string>"
    odd = cut(beyond.mapInPandas(read, form).filter(F.col("grams") != F.array_sort(F.expr(N.trigrams("name")))))
    if odd.isEmpty():
        return None
    beside = cut(names.join(odd.select("cluster_id").distinct(), "cluster_id", "left_semi").distinct().select("name", "cluster_id").mapInPandas(read, form))
    found = similar_pairs(beside.drop("cluster_id"), odd.drop("cluster_id"))
    a, b = (t.select(F.col("name").alias(x), F.col("cluster_id").alias("c" + x)) for t, x in ((beside, "a"), (odd, "b")))
    return found.join(a, "a").join(b, "b").filter("ca = cb").select("a", "b", "score")


def replay_groups(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, group_id) of the rows that a replay has to take one after the other: they share a key, or the name of one may decide about
    the other. Clusters are wider, and of many rows most fall into one of them; groups stay small."""
    named = rows.filter("full_name is not null")
    keyed = named.select("id", F.explode(F.array(*[F.concat(F.lit(k + ":"), F.col(k)) for k in EXACT])).alias("key")).filter("key is not null")
    hubs = cut(keyed.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("_n")).filter("_n > 1"))
    by_key = lookup_join(keyed, hubs.drop("_n"), "key", hubs.select("key", "_n")).filter("hub is not null").select(F.col("id").alias("u"), F.col("hub").alias("v"))
    by_name = relevant_pairs(named.filter("hits is null").select("id", "full_name", "fuzzy_score"), pairs)
    return connected_components(by_key.unionByName(by_name)).select("id", F.col("label").alias("group_id"))


def plan(staging: DataFrame, contacts: DataFrame, identities: DataFrame) -> DataFrame:
    """(id, cluster_id, match_status, ref, score, method) of every row: what a resolution run would do with it.

    Rows alone in their group are decided in columns. The others stream through a task in group order; a task holds the contacts
    created so far in one group, never the group's rows.
    """
    exact = cut(exact_hits(staging, identities))
    grams = cut(trigram_table(staging, "full_name"))
    fuzzy = cut(best_by_name(staging, contacts, grams))
    pairs = cut(similar_pairs(grams, written=True))
    grouped = clusters(staging, exact, fuzzy, pairs)
    hits = exact.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "method", "contact_id"))).alias("hits"))
    keyed = staging.select("id", F.expr("nullif(full_name, '')").alias("full_name"), "imported_at", *[F.expr(personal_key(k)).alias(k) for k in EXACT])
    near = fuzzy.select(F.col("name").alias("full_name"), F.col("contact_id").alias("fuzzy_id"), F.col("score").alias("fuzzy_score"))
    rows = cut(keyed.join(grouped, "id").join(hits, "id", "left").join(near, "full_name", "left"))
    odd = odd_pairs(rows)
    placed = cut(rows.join(replay_groups(rows, pairs if odd is None else pairs.unionByName(odd)), "id", "left"))
    ordered = placed.filter("group_id is not null").repartition("group_id").sortWithinPartitions("group_id", "imported_at", "id")
    replayed = ordered.select("id", "cluster_id", "group_id", "full_name", *EXACT, "hits", "fuzzy_id", "fuzzy_score").mapInPandas(_replay, "id string, cluster_id string, match_status string, ref string, score double, method string")
    return _alone(placed.filter("group_id is null")).unionByName(replayed)


def fold(attached: DataFrame, contacts: DataFrame, elected: DataFrame, keep_old: bool = False) -> DataFrame:
    """(id, contact_id, field, value, kind): the fills and conflicts of attaching staged rows to contacts in order.

    attached: (id, contact_id, seq, and the staged columns). The first value that is not missing fills a gap; later different ones
    conflict with what stands then; a gap that the log elected (elected: contact_id, field) is a deliberate clear and only conflicts.
    keep_old adds `stands`, the value a row was compared with.
    """
    long = attached.select("id", "contact_id", "seq", F.explode(F.create_map(*[x for g, s in FILL.items() for x in (F.lit(g), F.col(s))])).alias("field", "value")).filter("value is not null and value <> ''")
    gold = contacts.select(F.col("id").alias("contact_id"), F.explode(F.create_map(*[x for g in FILL for x in (F.lit(g), F.col(g))])).alias("field", "golden"))
    rows = long.join(gold, ["contact_id", "field"]).join(elected.select("contact_id", "field").distinct().withColumn("cleared", F.lit(True)), ["contact_id", "field"], "left")
    rows = rows.withColumns({"golden": F.expr("nullif(golden, '')"), "cleared": F.coalesce("cleared", F.lit(False))})
    before = Window.partitionBy("contact_id", "field").orderBy("seq", "id").rowsBetween(Window.unboundedPreceding, -1)
    stands = F.coalesce("golden", F.when(~F.col("cleared"), F.first("value", ignorenulls=True).over(before)))
    rows = rows.withColumn("stands", stands)
    kind = F.when(F.col("stands").isNull() & ~F.col("cleared"), "fill").when(F.col("stands").isNull(), "conflict").when(F.col("stands") != F.col("value"), "conflict")
    return rows.select("id", "contact_id", "field", "value", kind.alias("kind"), *(["stands"] if keep_old else [])).filter("kind is not null")


def birth_rows(planned: DataFrame, staging: DataFrame) -> DataFrame:
    """(create_key, field, new_value, source): the first log rows of contacts that a plan creates."""
    born = planned.filter("match_status = 'merged'").select("id", F.col("ref").alias("create_key")).join(staging, "id")
    return born.select("create_key", "source", F.explode(F.create_map(F.lit("full_name"), F.col("full_name"), *[x for g, s in FILL.items() for x in (F.lit(g), F.col(s))])).alias("field", "new_value")).filter("new_value is not null and new_value <> ''").select("create_key", "field", "new_value", "source")
