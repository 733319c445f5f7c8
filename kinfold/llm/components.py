"""Groups from pairwise matches by deterministic Boruvka hooking.

Each round every component selects its smallest outgoing edge and hooks along it, the resulting trees collapse by pointer doubling,
and edges are relabelled and deduplicated; at least half of the components that still have an edge disappear per round, so the
number of rounds is logarithmic. Nothing but counts and the heaviest roots reaches the driver; lineage is cut by tables in the shared
folder. Roots of very large trees are looked up by a bounded broadcast, so that no task gets all their members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions import keys as K
from kinfold.operators.skew import lookup_join
from kinfold.session import cut, cut_counted


def star_edges(rows: DataFrame, row_id: str, key_columns: list[str]) -> DataFrame:
    """(u, v): every row linked to the smallest row id of each of its keys. Null keys link nothing.

    A key's smallest id and size combine map-side, so a key of any size costs one row per partition; keys that hold a large share of
    the rows are joined by a bounded broadcast.
    """
    long = rows.select(F.col(row_id).alias("u"), F.explode(F.array(*[F.concat(F.lit(c[0] + ":"), F.col(c)) for c in key_columns])).alias("key")).filter("key is not null")
    hubs = long.groupBy("key").agg(F.min("u").alias("v"), F.count("*").alias("_n")).filter("_n > 1")
    linked = lookup_join(long, hubs.drop("_n"), "key", hubs.select("key", "_n"))
    return linked.filter("v is not null and v <> u").select("u", "v")


def _collapse(parents: DataFrame, n: int) -> DataFrame:
    """(id, parent) with every parent a root, by pointer doubling. parents: a forest whose roots point at themselves."""
    while True:
        up = parents.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
        step = lookup_join(parents, up, "parent", rows=n).select("id", F.coalesce("grand", "parent").alias("root"), (F.coalesce("grand", "parent") != F.col("parent")).alias("moved"))
        doubled, seen = cut_counted(step, moved=F.max("moved"))
        parents = doubled.select("id", F.col("root").alias("parent"))
        if not seen["moved"]:
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every vertex of an edge list (u, v): label is the smallest id of its component.

    Self-links, repeats and nulls are ignored; an empty list gives an empty result.
    """
    edges = edges.filter("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    live, seen = cut_counted(edges, n=F.count("*"))
    labels: DataFrame | None = None
    size = 0
    while seen["n"]:
        # the smallest edge of a component is the one whose ordered pair is smallest
        ends = live.select(F.col("u").alias("id"), F.struct("u", "v").alias("e")).unionByName(live.select(F.col("v").alias("id"), F.struct("u", "v").alias("e")))
        picks, found = cut_counted(ends.groupBy("id").agg(F.min("e").alias("e")).select("id", F.when(F.col("id") == F.col("e.u"), F.col("e.v")).otherwise(F.col("e.u")).alias("to")), n=F.count("*"))
        back = picks.select(F.col("id").alias("to"), F.col("to").alias("back"))
        hooked = lookup_join(picks, back, "to", rows=found["n"]).select("id", F.when((F.col("back") == F.col("id")) & (F.col("id") < F.col("to")), F.col("id")).otherwise(F.col("to")).alias("parent"))
        roots = _collapse(hooked, found["n"])
        if labels is None:
            labels, size = roots.select("id", F.col("parent").alias("label")), found["n"]
        else:
            now = lookup_join(labels, roots.select(F.col("id").alias("label"), F.col("parent").alias("up")), "label", rows=size)
            labels = cut(now.select("id", F.coalesce("up", "label").alias("label")))
        a = lookup_join(live, roots.select(F.col("id").alias("u"), F.col("parent").alias("pu")), "u", rows=seen["n"])
        b = lookup_join(a, roots.select(F.col("id").alias("v"), F.col("parent").alias("pv")), "v", rows=seen["n"])
        live, seen = cut_counted(b.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).filter("u <> v").distinct(), n=F.count("*"))
    if labels is None:
        return live.select(F.col("u").alias("id"), F.col("v").alias("label"))
    smallest = labels.groupBy("label").agg(F.min("id").alias("least"))
    return lookup_join(labels, smallest, "label", rows=size).select("id", F.col("least").alias("label"))


def key_groups(rows: DataFrame, row_id: str, key_columns: list[str]) -> DataFrame:
    """(row_id, group_id) of the rows that share a key with another row, directly or through others; group_id is the smallest row id.

    Rows without any key and rows alone in their group do not come out; a repeated id is one row. The first letters of the key
    columns must differ, as they mark the kind of a key.
    """
    labels = components(star_edges(rows, row_id, key_columns))
    return labels.select(F.col("id").alias("row_id"), F.col("label").alias("group_id"))


def card_keys(staging: DataFrame) -> DataFrame:
    """(id, email, phone, linkedin_url, handle) with canonical keys; shared mailboxes give no key."""
    keyed = staging.select("id", *[F.expr(K.KEY_BUILDERS[c](c)).alias(c) for c in ("email", "phone", "linkedin_url", "handle")])
    return keyed.withColumn("email", F.expr(f"case when not {K.is_role_email('email')} then email end"))


def card_groups(staging: DataFrame) -> DataFrame:
    return key_groups(card_keys(staging), "id", ["email", "phone", "linkedin_url", "handle"])
