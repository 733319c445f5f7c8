"""Filling containers of fixed capacity by a configuration linear program over the length histogram.

Lengths are whole numbers up to the capacity, so however many items there are, the program has at most `capacity` rows and is solved
on the driver: multiplicative weights price the lengths, a knapsack dynamic program finds the best configuration at these prices,
and the averaged configurations cover the histogram with nearly the fewest containers. As usual for this program, the histogram is
grouped linearly before it is solved: longer lengths form classes of equal counts, each represented by its longest length, and short
lengths fill the room that is left. Configurations are rounded down and filled with the exact lengths of their classes, the program is
solved again on what is left, and the last few items go best fit. The plan of (configuration, number of containers) goes to all
workers as a table bounded by the capacity and the number of rounds. Items take their places by their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.session import cut


def best_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int, most: np.ndarray) -> dict[int, int]:
    """Knapsack: the multiset of sizes with the highest total price within the capacity, by dynamic programming over the capacity."""
    value = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    ends = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        if ends[c]:
            got = prices[: ends[c]] + value[c - sizes[: ends[c]]]
            k = int(got.argmax())
            if got[k] > value[c] + 1e-15:
                value[c], pick[c] = got[k], k
    found: Counter = Counter()
    c = capacity
    while c > 0:
        k = pick[c]
        if k < 0:
            c -= 1
        else:
            found[int(k)] += 1
            c -= int(sizes[k])
    return {k: min(n, int(most[k])) for k, n in found.items()}


def solve_configurations(sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int = 1500, rate: float = 0.1) -> list[tuple[dict[int, int], float]]:
    """[(configuration {row: times}, containers)] that cover every row's need in the fractional sense, near the fewest containers.

    Multiplicative weights on the covering program: each round adds the configuration of the highest price, as often as its scarcest
    row allows, and the price of a row falls by a factor with the part of its need that was covered. The sum is scaled so that the
    most covered row is covered exactly, so what is left over is one more, smaller program.
    """
    need = need.astype(float)
    log_price = -np.log(need)
    covered = np.zeros(len(sizes))
    used: dict[tuple, float] = defaultdict(float)
    for _ in range(rounds):
        config = best_configuration(sizes, np.exp(log_price - log_price.max()), capacity, need)
        at, n = np.array(list(config)), np.array(list(config.values()))
        step = (need[at] / n).min()
        covered[at] += n * step
        log_price[at] += np.log1p(-rate * n * step / need[at])
        used[tuple(sorted(config.items()))] += step
    high = (covered / need).max()
    return [(dict(c), x / high) for c, x in used.items()]


#: Rows of the program: the longer lengths in this many classes of equal counts, each rounded up to its longest length.
CLASSES = 48
#: Shorter lengths fill what room is left; they are at most this part of the capacity.
SMALL = 1 / 32
#: Steps of the knapsack program over the capacity.
STEPS = 256


#: Programs solved in turn on what the last one left over.
PASSES = 4


def _classes(histogram: dict[int, int], least: float) -> list[list[list[int]]]:
    """Classes of [length, count], longest first, with about equal counts; a length may be cut between classes."""
    large = [[s, n] for s, n in sorted(histogram.items(), reverse=True) if s > least and n > 0]
    total = sum(n for _, n in large)
    share = max(1, -(-total // CLASSES))
    out: list[list[list[int]]] = []
    room = 0
    for s, n in large:
        while n:
            if not room:
                out.append([])
                room = share
            k = min(n, room)
            out[-1].append([s, k])
            room -= k
            n -= k
    return out


def round_program(histogram: dict[int, int], capacity: int, rounds: int = 1500) -> list[tuple[dict[int, int], int]]:
    """[(contents {length: times}, containers)] from the program: configurations are rounded down and filled with the longest items
    of their classes, what is left goes best fit into the open room and then into new containers."""
    left = Counter(histogram)
    open_: list[list] = []  # [room, contents, containers]
    for _ in range(PASSES):
        classes = _classes(left, capacity * SMALL)
        if not classes:
            break
        placed = len(open_)
        unit = max(1, capacity // STEPS)
        sizes = np.array([-(-c[0][0] // unit) for c in classes])
        order = np.argsort(sizes, kind="stable")
        need = np.array([sum(n for _, n in c) for c in classes])
        for config, x in sorted(solve_configurations(sizes[order], need[order], capacity // unit, rounds), key=lambda c: -c[1]):
            config = dict(config)
            config[min(config)] -= 1  # the smallest place stays open for the exact fit below
            slots = [(classes[order[k]], n) for k, n in config.items() if n]
            if not slots:
                continue
            times = min([int(x), *(sum(m for _, m in c) // n for c, n in slots)])
            while times > 0:
                contents: Counter = Counter()
                again = times
                for c, n in slots:
                    if c[0][1] >= n:
                        again = min(again, c[0][1] // n)
                    else:
                        again = 1
                for c, n in slots:
                    if c[0][1] >= n:
                        contents[c[0][0]] += n
                        c[0][1] -= n * again
                    else:
                        want = n
                        while want:
                            k = min(want, c[0][1])
                            contents[c[0][0]] += k
                            c[0][1] -= k
                            want -= k
                            if not c[0][1]:
                                c.pop(0)
                    if c and not c[0][1]:
                        c.pop(0)
                for s, n in contents.items():
                    left[s] -= n * again
                open_.append([capacity - sum(s * n for s, n in contents.items()), dict(contents), again])
                times -= again
        _fill(left, open_)
        if len(open_) == placed:
            break
    _fill(left, open_)
    return [(c, n) for _, c, n in open_] + pack_rest(left, capacity)


def _fill(left: Counter, open_: list[list]) -> None:
    """Best fit of what is left, longest first, into the open room; both are changed in place."""
    rooms: dict[int, list[list]] = defaultdict(list)
    for o in open_:
        rooms[o[0]].append(o)
    keys = sorted(rooms)
    for s in sorted((s for s in left if left[s] > 0), reverse=True):
        while left[s] > 0:
            i = bisect_left(keys, s)
            if i == len(keys):
                break
            room = keys[i]
            _, contents, times = rooms[room].pop()
            if not rooms[room]:
                keys.pop(i)
            n = min(left[s], times)
            if n < times:
                if not rooms[room]:
                    insort(keys, room)
                rooms[room].append([room, contents, times - n])
            fuller = dict(contents)
            fuller[s] = fuller.get(s, 0) + 1
            left[s] -= n
            if not rooms[room - s]:
                insort(keys, room - s)
            rooms[room - s].append([room - s, fuller, n])
    open_[:] = [o for room in keys for o in rooms[room]]


def pack_rest(rest: Counter, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing on a histogram: containers that would be filled alike are made in one step."""
    out: list[tuple[dict[int, int], int]] = []
    rest = Counter({s: n for s, n in rest.items() if n > 0})
    keys = sorted(rest)
    while keys:
        config: Counter = Counter()
        room = capacity
        left = dict(rest)
        while room > 0:
            i = bisect_right(keys, room) - 1
            while i >= 0 and left[keys[i]] == 0:
                i -= 1
            if i < 0:
                break
            s = keys[i]
            n = min(left[s], room // s)
            config[s] += n
            left[s] -= n
            room -= n * s
        times = min(rest[s] // n for s, n in config.items())
        out.append((dict(config), times))
        for s, n in config.items():
            rest[s] -= n * times
        keys = [s for s in keys if rest[s] > 0]
    return out


def plan_containers(histogram: dict[int, int], capacity: int, rounds: int = 1500) -> list[tuple[dict[int, int], int]]:
    """[(contents, whole containers)] that place every item exactly once, by the rounded program."""
    return round_program(histogram, capacity, rounds) if histogram else []


def _places(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[list[int], list[tuple[int, int]]]]:
    """length -> (first ranks, (first container, items per container)) of the plan's entries that hold it."""
    first: Counter = Counter()
    places: dict[int, tuple[list[int], list[tuple[int, int]]]] = {}
    container = 0
    for config, times in plan:
        for s, n in config.items():
            ranks, where = places.setdefault(s, ([], []))
            ranks.append(first[s])
            where.append((container, n))
            first[s] += n * times
        container += times
    return places


def _assign(plan: list[tuple[dict[int, int], int]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = _places(plan)
        for pdf in batches:
            out = []
            for s, r in zip(pdf["size"], pdf["rank"]):
                ranks, where = places[s]
                i = bisect_right(ranks, r) - 1
                out.append(where[i][0] + (r - ranks[i]) // where[i][1])
            yield pdf.assign(container_id=out)[["item_id", "chunk", "size", "container_id"]]

    return run


def fill_containers(items: DataFrame, item_id: str, size: str, capacity: int, rounds: int = 1500) -> DataFrame:
    """(item_id, chunk, size, container_id) for every item with a size of at least 1.

    An item over the capacity is split into full chunks and a rest, numbered from 0; no other item is split. Items of size 0 take no
    room and, like items of null size, do not come out. Repeated ids are separate items. Ranks within a length are found from counts
    per partition and length, so that a length that many items share is never gathered in one task.
    """
    sized = items.select(F.col(item_id).alias("item_id"), F.col(size).cast("long").alias("size")).filter("size > 0")
    chunks = sized.select("item_id", F.posexplode(F.expr(f"transform(sequence(0, (size - 1) div {capacity}), i -> least(size - i * {capacity}, {capacity}))")).alias("chunk", "size"))
    chunks = cut(chunks.withColumn("part", F.spark_partition_id()))
    counts = chunks.groupBy("part", "size").agg(F.count("*").alias("n"))
    counts = cut(counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    histogram = {int(r["size"]): int(r["n"]) for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    plan = plan_containers(histogram, capacity, rounds)
    kind = items.schema[item_id].dataType.simpleString()
    within = chunks.withColumn("seq", F.row_number().over(Window.partitionBy("part", "size").orderBy("item_id", "chunk")) - 1)
    # counts per part and length grow with the parts: joined by key, where the window left the rows, never broadcast
    ranked = within.join(counts.select("part", "size", "before").hint("merge"), ["part", "size"]).select("item_id", F.col("chunk").cast("int").alias("chunk"), "size", (F.col("seq") + F.col("before")).alias("rank"))
    return ranked.mapInPandas(_assign(plan), f"item_id {kind}, chunk int, size long, container_id long")
