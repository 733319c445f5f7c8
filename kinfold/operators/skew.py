"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy when it holds at least this share of all rows, so there are at most 1 / HEAVY_SHARE heavy keys.
HEAVY_SHARE = 1 / 256
#: Below this many rows no key can make a task long, and the split is not worth a pass.
LEAST_ROWS = 50_000


def heavy_keys(counts: DataFrame, keys: list[str], n: str, share: float = HEAVY_SHARE) -> list[str]:
    """Key texts (see key_text) with at least `share` of the rows of pre-aggregated `counts`; never more than 1 / share reach the driver."""
    total, most = counts.dropna(subset=keys).agg(F.sum(n), F.max(n)).first()
    if (total or 0) < LEAST_ROWS or most < total * share:
        return []
    return [r[0] for r in counts.dropna(subset=keys).filter(F.col(n) >= F.lit(total * share)).select(key_text(keys)).limit(int(1 / share) + 1).collect()]


def key_text(keys: list[str]) -> Column:
    return F.concat_ws("\u0001", *[F.col(k).cast("string") for k in keys])


def lookup_join(left: DataFrame, right: DataFrame, on: str | list[str], counts: DataFrame | None = None, share: float = HEAVY_SHARE, rows: int | None = None) -> DataFrame:
    """Left join to a `right` that is unique in the key columns `on`.

    Heavy keys of the left side (found from per-key counts (on.., _n), which combine map-side) meet a broadcast of at most 1 / share
    right rows; the other keys go through a shuffle join. Rows with a null key are kept with nulls. No row is dropped. `rows`, where
    the caller knows how many left rows there are, saves the pass over few of them.
    """
    keys = [on] if isinstance(on, str) else on
    if rows is not None and rows < LEAST_ROWS:
        return left.join(right, keys, "left")
    counts = left.groupBy(*keys).agg(F.count("*").alias("_n")) if counts is None else counts
    heavy = heavy_keys(counts, keys, "_n", share)
    if not heavy:
        return left.join(right, keys, "left")
    hot = key_text(keys).isin(heavy)
    there = left.filter(hot).join(F.broadcast(right.filter(hot)), keys, "left")
    rest = left.filter(~hot).join(right.filter(~hot), keys, "left")
    return there.unionByName(rest)
