"""Best representative of each duplicate group by token-level consensus.

The values of a group are aligned progressively: the heaviest value is the first profile, and each next value is aligned to the
profile's columns and merged into it, adding columns where it has tokens of its own. Groups of many values are cut into buckets whose
profiles are built in parallel and then merged with each other in the same way, a few at a time, so that no task holds a whole group.
Tokens vote with their weight per column, and the existing value closest to the elected tokens survives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.skew import lookup_join
from kinfold.session import cut, cut_counted

#: Values whose profile one task builds, and profiles that one task merges. They steer how the work is cut.
BUCKET, FAN_IN = 64, 16

#: A column of a profile: token -> weight.
Profile = list[dict[str, float]]


def tokens_of(value: str) -> list[str]:
    return value.split()


def _exchange(a: dict[str, float], b: dict[str, float]) -> float:
    """0 where two columns share a token, 0.5 where they share one but for letter case, 1 otherwise."""
    if any(t in a for t in b):
        return 0.0
    low = {t.lower() for t in a}
    return 0.5 if any(t.lower() in low for t in b) else 1.0


def merge(a: Profile, b: Profile) -> Profile:
    """Global alignment of two profiles with gaps of cost 1; columns that are aligned add their weights, the others are kept. Ties
    prefer aligned columns, then a gap in b."""
    start = 0
    while start < min(len(a), len(b)) and _exchange(a[start], b[start]) == 0:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and _exchange(a[-1 - end], b[-1 - end]) == 0:
        end += 1
    left, right = a[start : len(a) - end], b[start : len(b) - end]
    n, m = len(left), len(right)
    swap = [[_exchange(x, y) for y in right] for x in left]
    cost = [[float(i + j) if not i or not j else 0.0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + swap[i - 1][j - 1], cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    middle: Profile = []
    i, j = n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + swap[i - 1][j - 1]:
            i, j = i - 1, j - 1
            middle.append(_sum(left[i], right[j]))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            middle.append(left[i])
        else:
            j -= 1
            middle.append(right[j])
    head = [_sum(x, y) for x, y in zip(a[:start], b[:start])]
    tail = [_sum(x, y) for x, y in zip(a[len(a) - end :], b[len(b) - end :])]
    return head + middle[::-1] + tail


def _sum(a: dict[str, float], b: dict[str, float]) -> dict[str, float]:
    out = dict(a)
    for t, w in b.items():
        out[t] = out.get(t, 0.0) + w
    return out


def elect(profile: Profile, total: float) -> list[str]:
    """The heaviest token of each column, the smaller one on ties; no token where more or equal weight has none there."""
    out = []
    for column in profile:
        token, weight = min(column.items(), key=lambda x: (-x[1], x[0]))
        if weight > total - sum(column.values()) + 1e-9:
            out.append(token)
    return out


def edit_distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


_GROUP = ("group_key", "field_name", "bucket", "buckets", "total")
_PROFILE = "group_key string, field_name string, bucket long, buckets long, total double, wanted array<string>, columns array<map<string,double>>"


def _build(read) -> object:
    """Rows in order of group and bucket -> one profile each; `read` makes a profile of a row. Whole groups give their elected tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        held: Profile = []

        def out() -> tuple:
            whole = key[3] <= 1
            return (*key, elect(held, key[4]) if whole else None, None if whole else held)

        for pdf in batches:
            rows = []
            for *at, value in pdf[[*_GROUP, "value"]].itertuples(index=False, name=None):
                if key is None or tuple(at[:3]) != key[:3]:
                    if key is not None:
                        rows.append(out())
                    key, held = tuple(at), read(value)
                else:
                    held = merge(held, read(value))
            yield pd.DataFrame(rows, columns=[*_GROUP, "wanted", "columns"])
        if key is not None:
            yield pd.DataFrame([out()], columns=[*_GROUP, "wanted", "columns"])

    return run


def _of_value(value: tuple) -> Profile:
    return [{t: value["weight"]} for t in tokens_of(value["value"])]


def _of_profile(columns) -> Profile:
    return [dict(c) for c in columns]


def _distance(value: str, wanted: Column) -> Column:
    @F.pandas_udf("int")
    def run(value: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([edit_distance(tokens_of(v), list(w)) for v, w in zip(value, wanted)], dtype="int32")

    return run(value, wanted)


def consensus(values: DataFrame) -> DataFrame:
    """(group_key, field_name, survivor, distance) from (group_key, field_name, value, weight), one row per distinct value of a group.

    Ties between tokens go to the smaller token, ties between values to the heavier, then the smaller one. Groups with one value keep
    it. Null values must be left out by the caller; weights are positive.
    """
    gf = ["group_key", "field_name"]
    summary, seen = cut_counted(values.groupBy(*gf).agg(F.max("value").alias("only"), F.sum("weight").alias("total"), F.count("*").alias("n_values")), most=F.max("n_values"))
    counts = summary.select(*gf, F.col("n_values").alias("_n"))
    many = lookup_join(values, summary.filter("n_values > 1"), gf, counts).filter("n_values > 1")
    many = many.withColumn("buckets", F.ceil(F.col("n_values") / BUCKET)).withColumn("bucket", F.pmod(F.xxhash64("value"), F.col("buckets")))
    ordered = many.repartition(*gf, "bucket").sortWithinPartitions(*gf, "bucket", F.desc("weight"), "value")
    profiles = ordered.select(*_GROUP, F.struct("value", "weight").alias("value")).mapInPandas(_build(_of_value), _PROFILE)
    parts = -(-(seen["most"] or 0) // BUCKET)
    if parts > 1:
        profiles = cut(profiles)
        elected = profiles.filter("wanted is not null").select(*gf, "wanted")
        profiles = profiles.filter("wanted is null")
        while parts > 1:
            parts = -(-parts // FAN_IN)
            fewer = profiles.withColumns({"order": F.col("bucket"), "bucket": F.floor(F.col("bucket") / FAN_IN), "buckets": F.ceil(F.col("buckets") / FAN_IN)})
            fewer = fewer.repartition(*gf, "bucket").sortWithinPartitions(*gf, "bucket", "order")
            profiles = cut(fewer.select(*_GROUP, F.col("columns").alias("value")).mapInPandas(_build(_of_profile), _PROFILE))
            elected = elected.unionByName(profiles.filter("wanted is not null").select(*gf, "wanted"))
            profiles = profiles.filter("wanted is null")
    else:
        elected = profiles.select(*gf, "wanted")
    scored = lookup_join(values, elected, gf, counts).filter("wanted is not null").withColumn("distance", _distance("value", F.col("wanted")))
    chosen = scored.groupBy(*gf).agg(F.min_by(F.struct(F.col("value").alias("survivor"), "distance"), F.struct("distance", -F.col("weight"), "value")).alias("s")).select(*gf, "s.survivor", "s.distance")
    return chosen.unionByName(summary.filter("n_values = 1").select(*gf, F.col("only").alias("survivor"), F.lit(0).alias("distance")))
