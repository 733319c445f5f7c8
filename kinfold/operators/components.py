"""Connected components by alternating large-star and small-star steps, for the clusters that isolate a resolution run; what is left
of an edge list that fits one task is labelled there, since each further step costs several jobs however few edges there are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.skew import lookup_join
from kinfold.session import cut_counted

#: Edges up to which one task labels the rest: two ids of 36 letters each are some 80 MB.
FEW = 1 << 20


def least_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex of the component of each of n vertices, numbered in order."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges = list(batches)
    if not edges:
        return
    ends = pa.chunked_array([b[c] for c in ("u", "v") for b in edges]).combine_chunks().dictionary_encode()
    edges.clear()
    order = pc.sort_indices(ends.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    ids, label = ends.dictionary.take(order), least_labels(*np.split(place[ends.indices.to_numpy()], 2), len(order))
    for i in range(0, len(ids), 10_000):
        yield pa.RecordBatch.from_arrays([ids[i : i + 10_000], ids.take(pa.array(label[i : i + 10_000]))], ["id", "label"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label) of each vertex of an edge list (u, v); label is the smallest id of its component.

    Every step joins vertices to the minimum of their neighbourhood, which combines map-side; neighbourhoods are never collected, and
    a vertex with very many neighbours is joined by a bounded broadcast. Self-links, repeats and nulls are ignored.
    """
    live = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    live, seen = cut_counted(live, mark=mark)
    while True:
        if seen["mark"]["n"] <= FEW:
            kind = live.schema["u"].dataType.simpleString()
            return live.repartition(1).mapInArrow(_labelled, f"id {kind}, label {kind}")
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("_n"))
        large = lookup_join(both, least.drop("_n"), "u", least.select("u", "_n")).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, _ = cut_counted(large)
        small = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        joined = lookup_join(large, small.drop("_n"), "u", small.select("u", "_n"))
        step = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        live, now = cut_counted(step, mark=mark)
        if now["mark"] == seen["mark"]:
            break
        seen = now
    return live.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(live.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
