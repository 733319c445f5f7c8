"""Exact radius joins of strings under the Levenshtein metric by metric-space partitioning.

The first pivot is the empty string: the distance to it is the length, so its cells are rings of one length, and a query goes to the
rings within its radius. As the data grow, further pivots cut each ring: every indexed string is filed in the cell of its nearest
pivot, and a query is replicated to each cell that can hold a string within its radius, by the triangle inequality those whose pivot
is at most twice the radius farther than the nearest one, and at most the radius beyond the farthest string filed there. Inside a
cell the join is exact: strings that share a deletion variant, found on vectors of hashes, are compared by the metric itself, which
runs in columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.names import LONGEST, radius
from kinfold.session import cut_counted

#: Strings of one cell that meet in one task: larger cells are split on both sides, which keeps every pair of the cell together once.
CELL_INDEX, CELL_QUERIES = 16_000, 100_000
#: Deletion variants of indexed strings that one task holds.
CELL_VARIANTS = 4_000_000
#: Strings a pivot is added for, and the most pivots. Pivots are strings of the index in hash order, so that dense regions get more of
#: them and cells stay even; they steer the partition only, never the result.
CELL_SIZE, MOST_PIVOTS = 64_000, 2_048
#: Rings of a pivot, one per length; longer strings have radius 0 and are compared for equality.
RINGS = 128


def _codes(words: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), np.uint16)
    for i, w in enumerate(words):
        out[i, : len(w)] = [min(ord(c), 65535) for c in w]
    return out


def pivot_distances(words: list[str], pivots: list[str]) -> np.ndarray:
    """Levenshtein distance of every word to every pivot, one vector over the words per pivot."""
    width = max(map(len, words), default=0)
    codes, lengths = _codes(words, width), np.array([len(w) for w in words])
    out = np.empty((len(words), len(pivots)), np.int16)
    for j, p in enumerate(pivots):
        row = np.tile(np.arange(len(p) + 1, dtype=np.int16)[:, None], (1, len(words)))
        found = np.full(len(words), len(p), np.int16)
        own = [min(ord(c), 65535) for c in p]
        for i in range(width):
            above, row[0] = row[0].copy(), i + 1
            for k, c in enumerate(own, 1):
                here = row[k].copy()
                row[k] = np.minimum(np.minimum(here, row[k - 1]) + 1, above + (codes[:, i] != c))
                above = here
            ended = lengths == i + 1
            found[ended] = row[len(p)][ended]
        out[:, j] = found
    return out


def variants(word: str, edits: int) -> set[str]:
    """What is left of the word after exactly `edits` deletions, at most two."""
    if not edits:
        return {word}
    once = [word[:i] + word[i + 1 :] for i in range(len(word))]
    if edits == 1:
        return set(once)
    return {w[:j] + w[j + 1 :] for i, w in enumerate(once) for j in range(i, len(w))}


_LETTERS = np.random.default_rng(1).integers(1, 1 << 63, 1 << 16, dtype=np.uint64)
_PLACES = np.random.default_rng(2).integers(1, 1 << 63, RINGS, dtype=np.uint64) | np.uint64(1)


def variant_hashes(words: list[str], length: int, edits: int) -> np.ndarray:
    """(word, deletion) -> hash of what is left of each word of this length after `edits` deletions; equal texts have equal hashes."""
    letters = _LETTERS[_codes(words, length)]
    kept = [[i for i in range(length) if i not in gone] for gone in combinations(range(length), edits)]
    out = np.zeros((len(words), len(kept)), np.uint64)
    for k, places in enumerate(kept):
        for at, i in enumerate(places):
            out[:, k] += letters[:, i] * _PLACES[at]
    return out


class RingIndex:
    """Candidates among strings of one length. If two strings are within r edits, deleting at most r letters from each leaves the
    same text; as more can always be deleted from both, it is enough to look at the largest number allowed on the query's side, which
    the difference of the lengths ties to the number on the other."""

    def __init__(self, words: list[str], length: int):
        self.length, self.words = length, words
        self.by: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _depth(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all variants in order, and the word each belongs to."""
        if b not in self.by:
            hashes = variant_hashes(self.words, self.length, b)
            owner = np.repeat(np.arange(len(self.words), dtype=np.int64), hashes.shape[1])
            order = np.argsort(hashes, axis=None, kind="stable")
            self.by[b] = hashes.ravel()[order], owner[order]
        return self.by[b]

    def candidates(self, queries: list[str], r: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (query, string) that share a variant; all queries have one length."""
        size = len(queries[0])
        more = self.length - size
        if abs(more) > r:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a = min(r, r - more, size)
        known, owner = self._depth(min(a + more, self.length))
        asked = variant_hashes(queries, size, a)
        width, asked = asked.shape[1], asked.ravel()
        low = np.searchsorted(known, asked)
        hit = np.nonzero(known[np.minimum(low, len(known) - 1)] == asked)[0] if len(known) else np.zeros(0, np.int64)
        low = low[hit]
        n = np.searchsorted(known, asked[hit], "right") - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        who = np.repeat(hit // width, n)
        pairs = np.unique(who * len(self.words) + owner[at])
        return pairs // len(self.words), pairs % len(self.words)


def _file(pivots: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                words = list(pdf["word"].iloc[at : at + 4096])
                d = pivot_distances(words, pivots)
                home = d.argmin(axis=1)
                rings = np.array([len(w) for w in words])
                yield pd.DataFrame({"word": words, "cell": (home * RINGS + rings).astype("int32"), "far": d[np.arange(len(words)), home].astype("int32")})

    return run


def _send(pivots: list[str], reach: dict[int, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limit = np.full((len(pivots), RINGS), -(1 << 14))
        for cell, far in reach.items():
            limit[cell // RINGS, cell % RINGS] = far
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                words = list(pdf["word"].iloc[at : at + 4096])
                d = pivot_distances(words, pivots).astype(np.int32)
                r = np.array([radius(w) for w in words])
                rings = np.array([len(w) for w in words])
                near = d <= d.min(axis=1)[:, None] + 2 * r[:, None]
                sent, cells = [], []
                for shift in range(-int(r.max()), int(r.max()) + 1):
                    ring = np.clip(rings + shift, 0, RINGS - 1)
                    rows, homes = np.nonzero(near & ((abs(shift) <= r) & (ring == rings + shift))[:, None] & (d <= limit[:, ring].T + r[:, None]))
                    sent += [words[i] for i in rows]
                    cells.append(homes * RINGS + ring[rows])
                if sent:
                    yield pd.DataFrame({"word": sent, "cell": np.concatenate(cells).astype("int32")})

    return run


def _join(key, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    if index.empty or queries.empty:
        return pd.DataFrame({"q": [], "f": []}, dtype=object)
    known = RingIndex(list(index["word"]), int(key[0]) % RINGS)
    words = np.array(known.words, dtype=object)
    asked, met = [], []
    for size, group in queries["word"].groupby(queries["word"].str.len()):
        for at in range(0, len(group), 8192):
            part = group.iloc[at : at + 8192].to_numpy(dtype=object)
            q, f = known.candidates(list(part), radius("x" * int(size)))
            asked.append(part[q])
            met.append(words[f])
    return pd.DataFrame({"q": np.concatenate(asked), "f": np.concatenate(met)})


def radius_join(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, f, gap) of every query q and indexed string f within radius(q) edits; both frames have distinct strings `word`.

    Nulls are left out by the caller; the empty string matches itself. An empty side gives an empty result. The driver gets the
    pivots and one row per cell, both bounded.
    """
    size = index.agg(F.count("*").alias("n"), F.count_if(F.length("word") >= RINGS).alias("long")).first()
    every = (index, queries)
    if size["long"]:
        index = index.filter(F.length("word") < RINGS)
    queries = queries.filter(F.length("word") < RINGS)
    count = max(1, min(MOST_PIVOTS, size["n"] // CELL_SIZE))
    pivots = [r["word"] for r in index.orderBy(F.xxhash64("word"), "word").limit(count).collect()] or [""]
    filed, _ = cut_counted(index.mapInPandas(_file(pivots), "word string, cell int, far int"))
    cells = {r["cell"]: (r["far"], r["n"]) for r in filed.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}
    sent, _ = cut_counted(queries.mapInPandas(_send(pivots, {c: far for c, (far, _) in cells.items()}), "word string, cell int"))
    asked = {r["cell"]: r["n"] for r in sent.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    variants_of = {c: max(1, (c % RINGS) * (c % RINGS - 1) // 2) if c % RINGS <= LONGEST else 1 for c in cells}
    split = [(c, max(1, -(-n // CELL_INDEX), -(-n * variants_of[c] // CELL_VARIANTS)), max(1, -(-asked.get(c, 0) // CELL_QUERIES))) for c, (_, n) in cells.items()]
    spark = index.sparkSession
    plan = F.broadcast(spark.createDataFrame(split or [(0, 1, 1)], "cell int, parts int, salts int"))
    left = filed.join(plan, "cell").select("cell", "word", F.pmod(F.xxhash64("word"), F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    right = sent.join(plan, "cell").select("cell", "word", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"), F.pmod(F.xxhash64("word"), F.col("salts")).cast("int").alias("salt"))
    keys = ["cell", "part", "salt"]
    # as many partitions as groups: these are few bytes and much work, which coalescing by size would put into few tasks
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4 * sum(p * s for _, p, s in split), 4096))
    joined = left.repartition(groups, *keys).groupBy(*keys).cogroup(right.repartition(groups, *keys).groupBy(*keys)).applyInPandas(_join, "q string, f string")
    near = joined.withColumn("gap", F.expr(f"case when q = f then 0 when length(q) between 4 and 7 then levenshtein(q, f, 1) when length(q) between 8 and {LONGEST} then levenshtein(q, f, 2) else -1 end")).filter("gap >= 0")
    if size["long"]:
        equal = every[0].filter(F.length("word") >= RINGS).join(every[1], "word").select(F.col("word").alias("q"), F.col("word").alias("f"), F.lit(0).alias("gap"))
        near = near.unionByName(equal)
    return near
