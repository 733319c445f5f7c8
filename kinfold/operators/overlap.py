"""Pairs of sets with a Jaccard similarity of at least a bound, for sets of small whole numbers: the kernel of `matching.similar_pairs`.

Numbers stand in order of frequency, the rarest first. Two sets with enough in common share one of the first few numbers of each, so
every set is filed under these (`filed`), and the pairs of each list are found in one task (`paired`). A pair counts in the list of the
first number it shares only, so nothing has to be deduplicated. Lists are compared by signatures whose differing bits never outnumber
the differing elements; what passes is compared exactly. Lists of many pairs are filed again under the numbers that are rare *within
the list*: elements that most of a list holds together, as the trigrams of a first name are, tell nothing there. Nothing is capped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FILED = "gram int, place int, side int, name string, g array<int>"
PAIRED = "a string, b string, score double"
#: Pairs of a list from which it is filed again, and how often that is done.
MANY, DEPTH = 1 << 27, 3
#: Rows and columns compared at once, elements compared at once.
ROWS, COLUMNS, CELLS = 128, 4096, 1 << 23
#: Guards against rounding of the bounds; they only prune, the score decides.
EPS = 1e-6


def least_common(n: np.ndarray, least: float) -> np.ndarray:
    """What a set of n elements has in common with any other at the bound, at least."""
    return np.maximum(np.ceil(least * n - EPS), 1).astype(np.int64)


def padded(values: np.ndarray, n: np.ndarray, fill: int) -> np.ndarray:
    """Lists of n values each as rows."""
    out = np.full((len(n), max(int(n.max(initial=0)), 1)), fill, np.int32)
    out[np.arange(out.shape[1]) < n[:, None]] = values
    return out


def filed(order: list[str], least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(name, grams, side) -> a row for each of the rarest grams of a name, with all its grams as numbers. order: the rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(order, pa.string())
        for b in batches:
            if not b.num_rows:
                continue
            n = pc.list_value_length(b["grams"]).to_numpy(zero_copy_only=False).astype(np.int64)
            g = padded(pc.index_in(b["grams"].flatten(), value_set=known).to_numpy(zero_copy_only=False), n, np.iinfo(np.int32).max)
            g.sort(axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(g[np.arange(g.shape[1]) < n[:, None]], pa.int32()))
            most = n - least_common(n, least) + 1
            row = np.repeat(np.arange(len(n)), most)
            place = np.arange(len(row)) - np.repeat(np.cumsum(most) - most, most)
            for i in range(0, len(row), 10_000):
                r, p = row[i : i + 10_000], place[i : i + 10_000]
                at = pa.array(r)
                yield pa.RecordBatch.from_arrays([pa.array(g[r, p]), pa.array(p.astype(np.int32)), b["side"].take(at), b["name"].take(at), lists.take(at)], ["gram", "place", "side", "name", "g"])

    return run


class Rows:
    """Sets of a list: `rest` holds from `start` to `end` what may be in common beyond the `got` elements that all of the list share."""

    def __init__(self, index: np.ndarray, rest: np.ndarray, start: np.ndarray, end: np.ndarray, n: np.ndarray, got: int, least: float) -> None:
        self.index, self.rest, self.start, self.end, self.n, self.got, self.least = index, rest, start, end, n, got, least

    def part(self, at: np.ndarray, start: np.ndarray) -> Rows:
        return Rows(self.index[at], self.rest[at], start, self.end[at], self.n[at], self.got + 1, self.least)

    def live(self) -> np.ndarray:
        k = np.arange(self.rest.shape[1])
        return (k >= self.start[:, None]) & (k < self.end[:, None])

    def signed(self) -> tuple[np.ndarray, np.ndarray]:
        """(signatures, room): bits of differing sign of two rows are at most the sum of their rooms, in halves, for a pair at the bound."""
        live, signs = self.live(), np.empty((4, len(self.n)), np.uint64)
        mixed = self.rest.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for w in range(4):
            bit = np.where(live, np.uint64(1) << (mixed >> np.uint64(58 - 7 * w) & np.uint64(63)), np.uint64(0))
            signs[w] = np.bitwise_xor.reduce(bit, axis=1)
        room = self.end - self.start + self.got - 2 * self.least / (1 + self.least) * self.n
        return signs, np.floor(2 * room + EPS).astype(np.int16)

    def again(self, counts: np.ndarray) -> tuple[Rows, np.ndarray]:
        """The rows with their rest in order of the counts, and how many of its first elements a pair at the bound shares one of."""
        live = self.live()
        key = np.where(live, counts[np.where(live, self.rest, 0)] * np.int64(1 << 32) + self.rest, np.iinfo(np.int64).max)
        rest = np.take_along_axis(self.rest, np.argsort(key, axis=1), axis=1)
        held = self.end - self.start
        most = np.clip(held - (least_common(self.n, self.least) - self.got) + 1, 0, held)
        return Rows(self.index, rest, np.zeros_like(held), held, self.n, self.got, self.least), most


def compared(a: Rows, b: Rows, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs whose signatures let them be at the bound; same: a and b are the same rows, each pair once."""
    sides = []
    for x in (a,) if same else (a, b):
        signs, room = x.signed()
        by = np.argsort(-room, kind="stable")
        sides.append((x.index[by], np.ascontiguousarray(signs[:, by]), room[by]))
    (ai, asig, aroom), (bi, bsig, broom) = sides[0], sides[-1]
    if max(np.abs(r).max(initial=0) for _, _, r in sides) <= 60:  # sums fit a byte, which compares fastest
        aroom, broom = aroom.astype(np.int8), broom.astype(np.int8)
    kind, one = aroom.dtype.type, aroom.dtype.type(1)

    def differ(x: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x).astype(kind, copy=False)

    for i in range(0, len(ai), ROWS):
        s, r = asig[0, i : i + ROWS, None], aroom[i : i + ROWS, None]
        reach = np.searchsorted(-broom, int(aroom[i]) + 1, side="right")
        for j in range(i if same else 0, reach, COLUMNS):
            t = slice(j, min(j + COLUMNS, reach))
            near = differ(s ^ bsig[0, None, t]) <= (r + broom[None, t] + one) >> one
            at = np.flatnonzero(near)
            if not len(at):
                continue
            p, q = at // near.shape[1] + i, at % near.shape[1] + j
            if same:
                p, q = p[p < q], q[p < q]
            most = (aroom[p] + broom[q] + one) >> one
            for w in (1, 2, 3):
                ok = differ(asig[w, p] ^ bsig[w, q]) <= most
                p, q, most = p[ok], q[ok], most[ok]
            yield ai[p], bi[q]


def candidates(a: Rows, b: Rows, same: bool, depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    few = len(a.n) * len(b.n) <= MANY or not depth
    if few or min(least_common(x.n, x.least).min() for x in (a, b)) <= a.got:
        yield from compared(a, b, same)
        return
    counts = sum(np.bincount(x.rest[x.live()], minlength=1 << 16) for x in ((a,) if same else (a, b)))
    lists = []
    for x in (a,) if same else (a, b):
        x, most = x.again(counts)
        row = np.repeat(np.arange(len(most)), most)
        place = np.arange(len(row)) - np.repeat(np.cumsum(most) - most, most)
        gram = x.rest[row, place]
        by = np.argsort(gram, kind="stable")
        gram = gram[by]
        found, begin = np.unique(gram, return_index=True)
        lists.append((x, {int(k): (row[by[i:j]], place[by[i:j]] + 1) for k, i, j in zip(found, begin, np.append(begin[1:], len(gram)))}))
    (ax, al), (bx, bl) = lists[0], lists[-1]
    for k in al.keys() & bl.keys():
        p = ax.part(*al[k])
        yield from candidates(p, p if same else bx.part(*bl[k]), same, depth - 1)


def _list(rows: pa.Table, least: float, within: bool) -> Iterator[pa.RecordBatch]:
    n = pc.list_value_length(rows["g"]).to_numpy().astype(np.int64)
    side, place = rows["side"].to_numpy(), rows["place"].to_numpy().astype(np.int64)
    if len(n) < 2 or not within and side.min() == side.max():
        return
    g, name = padded(pc.list_flatten(rows["g"]).to_numpy(), n, -1), rows["name"]
    a, b = (Rows(at, g[at], place[at] + 1, n[at], n[at], 1, least) for at in ((np.arange(len(n)),) * 2 if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))))
    met = [np.minimum(p, q) * len(n) + np.maximum(p, q) if within else p * len(n) + q for p, q in candidates(a, b, within)]
    pairs = np.unique(np.concatenate(met)) if met else np.empty(0, np.int64)
    step = max(CELLS // g.shape[1] ** 2, 1)
    for k in range(0, len(pairs), step):
        p, q = pairs[k : k + step] // len(n), pairs[k : k + step] % len(n)
        wide = max(int(n[p].max()), int(n[q].max()))
        x, y = g[p, :wide], g[q, :wide]
        shared = ((x[:, :, None] == y[:, None, :]) & (x >= 0)[:, :, None]).any(axis=2)
        inter = shared.sum(axis=1)
        score = inter / (n[p] + n[q] - inter)
        ok = (score >= least) & (shared.argmax(axis=1) == place[p])
        if ok.any():
            yield pa.RecordBatch.from_arrays([name.take(pa.array(p[ok])).combine_chunks(), name.take(pa.array(q[ok])).combine_chunks(), pa.array(score[ok])], ["a", "b", "score"])


def paired(least: float, within: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Filed rows in order of their gram -> the pairs of each list; within: all rows are of one side, each pair once and in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for b in batches:
            gram = b["gram"].to_numpy()
            begins = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else []
            for i, j in zip(begins, np.append(begins[1:], len(gram))):
                if gram[i] != current and held:
                    yield from _list(pa.Table.from_batches(held).combine_chunks(), least, within)
                    held = []
                current = gram[i]
                held.append(b.slice(i, j - i))
        if held:
            yield from _list(pa.Table.from_batches(held).combine_chunks(), least, within)

    return run
