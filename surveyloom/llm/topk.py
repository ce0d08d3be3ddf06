"""Exact top-k by best-first search in M-trees.

Components are whole numbers.  One more component brings all vectors of a block to the
length of the longest, so that the largest inner product is the smallest distance.  Each
block becomes an M-tree: pages of entries with a routing object, a covering radius and the
distance to the parent's routing object.  Best-first search opens the page with the
smallest possible distance.  Before a distance is computed, the stored parent distance and
the triangle inequality bound it; entries that cannot beat the k-th result are skipped.
Queries of the same part of a tree search together, so that a page is opened once for all.
Blocks are parts of cells around pivots, which have a covering radius too: a query visits
only cells that may beat what it found in its home cell.

Distances and products in floating point only decide what is looked at, each with a margin
for its rounding.  Results are whole-number products: in 64-bit integers where those hold
them, else in Python's.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm._vectors import search_cells, usable

PAGE = 128
#: Queries that search a tree together.
TOGETHER = 128
_EPS = float(np.finfo(float).eps)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


@dataclass
class Page:
    """Entries of one page; ``children`` is None in a leaf, whose entries are vectors."""

    entries: np.ndarray  # routing objects of the children, or vectors: positions
    parent_distance: np.ndarray
    radius: np.ndarray
    children: list[Page] | None


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def whole_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact products of whole-number rows with a vector; beyond 64 bits they stop at the ends of that range."""
    limit = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, x.shape[1])
    if limit < 2.0**62:
        return x.astype(np.int64) @ q.astype(np.int64)
    other = [int(v) for v in q.tolist()]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, other, strict=True)), _LEAST), _MOST) for row in x.tolist()], np.int64)


class MTree:
    """An M-tree over whole-number vectors; ``computed`` and ``offered`` count distances."""

    def __init__(self, top: int, ids: np.ndarray, x: np.ndarray) -> None:
        # products of vectors divided by a power of two are as exact, and squares do not overflow
        self.unit = 2.0 ** max(0, int(np.ceil(np.log2(max(1.0, float(np.abs(x).max(initial=0)))))) - 400)
        self.top, self.ids, self.whole, self.x = top, ids, x, x / self.unit
        square = (self.x * self.x).sum(1)
        self.length = np.sqrt(square)
        self.longest = float(square.max())
        self.extra = np.sqrt(np.maximum(self.longest - square, 0))
        # a squared distance is a difference of terms up to 4 * longest, each rounded some times
        self.slack = np.sqrt(16 * _EPS * (x.shape[1] + 4) * self.longest)
        self.computed = self.offered = 0
        self.root, self.start = self._build(np.arange(len(x)), 0)

    def between(self, a: int, rows: np.ndarray) -> np.ndarray:
        """Distances from one vector to others, with the added component."""
        dots = self.x[rows] @ self.x[a] + self.extra[rows] * self.extra[a]
        return np.sqrt(np.maximum(2 * self.longest - 2 * dots, 0))

    def _build(self, rows: np.ndarray, parent: int) -> tuple[Page, int]:
        """A page over some vectors, and its routing object."""
        route = int(rows[0])
        if len(rows) <= PAGE:
            return Page(rows, self.between(route, rows), np.zeros(len(rows)), None), route
        # pivots far from one another, then every vector goes to its nearest pivot
        pivots, nearest, owner = [route], self.between(route, rows), np.zeros(len(rows), np.int64)
        for k in range(1, max(2, min(PAGE, len(rows) // (PAGE // 2)))):
            pivot = int(rows[np.argmax(nearest)])
            d = self.between(pivot, rows)
            owner[d < nearest] = k
            nearest = np.minimum(nearest, d)
            pivots.append(pivot)
        groups = [rows[owner == k] for k in range(len(pivots))]
        if max(map(len, groups)) == len(rows):  # all alike
            groups = np.array_split(rows, -(-len(rows) // PAGE))
        groups = [g for g in groups if len(g)]
        built = [self._build(np.concatenate(([p], g[g != p])), route) for g in groups for p in [self._middle(g)]]
        routes = np.array([r for _, r in built])
        radius = np.array([self.between(r, g).max() for (_, r), g in zip(built, groups, strict=True)])
        return Page(routes, self.between(route, routes), radius, [p for p, _ in built]), route

    def _middle(self, rows: np.ndarray) -> int:
        """The vector nearest to the group's mean: a routing object with a small radius."""
        mean = self.x[rows].mean(0)
        return int(rows[np.argmin(((self.x[rows] - mean) ** 2).sum(1))])

    def _some(self, q: np.ndarray, own: np.ndarray, kth: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Rows that may be among the ``top`` of each query that already has its ``kth``; products from ``end`` on are equal.

        The queries search together: a page is opened once, for all that may need it, the nearest to any of them first.
        """
        size = lengths(q)
        # a query at the common length keeps its order and its distances well-conditioned
        some = (size > 0) & (self.longest > 0)
        scale = np.where(some, np.sqrt(self.longest) / np.where(some, size, 1.0), 0.0)
        q = q * scale[:, None]
        slack = 4 * self.slack
        reach = lambda dots: np.sqrt(np.maximum(2 * self.longest - 2 * dots, 0))
        margin = 4 * _EPS * (q.shape[1] + 4) * self.length * np.sqrt(self.longest)
        end = end * scale * (1 - 1e-9)
        known = np.isfinite(kth) & some
        limit = np.where(known, reach(np.where(known, kth, 0.0) * scale), np.inf)
        best, sure = np.full((len(q), self.top), -np.inf), np.full(len(q), -np.inf)
        at, which, upper = [], [], []
        self.offered += len(q) * len(self.ids)
        heap, serial = [(0.0, 0, self.root, np.arange(len(q)), np.zeros(len(q)), reach(q @ self.x[self.start]))], 0
        while heap:
            _, _, page, who, bound, routed = heapq.heappop(heap)
            still = bound <= limit[who] + slack
            who, routed = who[still], routed[still]
            # the triangle inequality on stored parent distances, before any distance is computed
            near = np.abs(routed[:, None] - page.parent_distance) - page.radius <= (limit[who] + slack)[:, None]
            who, near = who[near.any(1)], near[near.any(1)]
            near = np.flatnonzero(near.any(0))
            if not len(near):
                continue
            rows = page.entries[near]
            self.computed += len(who) * len(rows)
            dots = q[who] @ self.x[rows].T
            if page.children is None:
                may = (dots + margin[rows] >= sure[who, None]) & (self.ids[rows] != own[who, None])
                hit = np.flatnonzero(may.any(1))
                i, j = np.nonzero(may[hit])
                at.append(who[hit][i])
                which.append(rows[j])
                upper.append(dots[hit][i, j] + margin[rows[j]])
                lower = np.concatenate((best[who[hit]], np.where(may[hit], dots[hit] - margin[rows], -np.inf)), 1)
                lower = np.partition(lower, lower.shape[1] - self.top, axis=1)[:, lower.shape[1] - self.top :]
                who = who[hit]
                best[who], least = lower, lower[:, 0]
                sure[who] = np.where(least <= -end[who], -np.inf, np.minimum(least, end[who]))
                limit[who] = np.minimum(limit[who], reach(sure[who]))
                continue
            d = reach(dots)
            low = np.maximum(d - page.radius[near], 0)
            for k, ask in enumerate((low <= (limit[who] + slack)[:, None]).T):
                if ask.any():
                    serial += 1
                    heapq.heappush(heap, (float(low[ask, k].min()), serial, page.children[near[k]], who[ask], low[ask, k], d[ask, k]))
        at, which, upper = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (at, which, upper))
        stay = upper >= sure[at]
        at, which = at[stay], which[stay]
        order = np.argsort(at, kind="stable")
        return np.split(which[order], np.searchsorted(at[order], np.arange(1, len(q))))

    def find(self, query_ids: np.ndarray, q: np.ndarray, kth: np.ndarray):
        unit = 2.0 ** np.maximum(0, np.ceil(np.log2(np.maximum(1.0, np.abs(q).max(1)))) - 400)
        # a bound that was cut at 64 bits says nothing
        reached = np.where(np.abs(kth) < 2.0**62, kth, -np.inf) / self.unit / unit
        reached = reached - np.abs(reached) * 8 * _EPS
        small = q / unit[:, None]
        # queries of the same part of the tree come together
        order = np.argsort(np.argmax(small @ self.x[self.root.entries].T, axis=1), kind="stable")
        at, which, scores = [], [], []
        for a in range(0, len(q), TOGETHER):
            some = order[a : a + TOGETHER]
            found = self._some(small[some], query_ids[some], reached[some], 2.0**63 / self.unit / unit[some])
            for i, rows in zip(some.tolist(), found, strict=True):
                score = whole_products(self.whole[rows], q[i])
                best = np.lexsort((self.ids[rows], ~score))[: self.top]
                at.append(np.full(len(best), i))
                which.append(rows[best])
                scores.append(score[best])
        return np.concatenate(at), np.concatenate(which), np.concatenate(scores)


class PivotCells:
    """Every vector belongs to its nearest pivot; a product with it is at most that with the pivot and the radius times the query's length."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        chosen = np.sort(np.random.default_rng(13).permutation(len(sample))[: max(1, cells)])
        self.pivots = sample[chosen] if len(sample) else np.zeros((1, sample.shape[1]))

    def _distances(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return np.stack([lengths(x - p) for p in self.pivots], axis=1)

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        return np.argmin(np.nan_to_num(self._distances(x), nan=np.inf), axis=1)

    def home_of(self, q: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return np.argmax(np.nan_to_num(q @ self.pivots.T, nan=-np.inf), axis=1)

    def measured(self, x: np.ndarray, cell: np.ndarray):
        d = np.nan_to_num(self._distances(x)[np.arange(len(x)), cell], nan=np.inf)
        for c in np.unique(cell).tolist():
            yield c, 0, 0.0, float(d[cell == c].max())

    def admitted(self, q: np.ndarray, kth: np.ndarray, bounds: dict) -> np.ndarray:
        out = np.zeros((len(q), max(bounds) + 1), bool)
        known = sorted(bounds)
        radius, size = np.array([bounds[c][0][1] for c in known]), lengths(q)
        with np.errstate(over="ignore", invalid="ignore"):
            most = q @ self.pivots[known].T + size[:, None] * radius
            # what rounding may have taken away
            most += 8 * _EPS * (q.shape[1] + 4) * size[:, None] * (lengths(self.pivots[known]) + radius)
            out[:, known] = ~(most < kth[:, None]) | (np.abs(kth) >= 2.0**62)[:, None]
        return out


def top_products(embeddings: DataFrame, every: int = 50, top: int = 5, scale: int = 256, block_rows: int = 16384, query_rows: int = 65536) -> DataFrame:
    """Each query's ``top`` largest whole-number inner products: query_id, rank, vec_id, score.

    ``embeddings`` needs vec_id and embedding; a component x counts as floor(``scale`` * x),
    exact for every finite x whose product with ``scale`` (a power of two) is finite.
    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but
    the query's own.  Exact; ties go to the smaller vec_id, and with fewer candidates all
    are returned.  A product beyond 64 bits counts as the end of that range.  Vectors that
    are null, empty, or hold null or non-finite components, and rows without vec_id, take no
    part.  A repeated vec_id counts once, with its smallest vector; vectors of different
    lengths are not compared.  An empty table gives an empty table.
    """
    # doubles of 2**53 or more are whole already, and the SQL function floor would cut them to 64 bits
    floored = lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(F.greatest(F.least(c, F.lit(1.7e308)), F.lit(-1.7e308)))
    whole = usable(embeddings, zero=True).withColumn("v", F.transform("v", lambda c: floored(c * scale)))
    return search_cells(whole, every, top, lambda alike, sample, n: PivotCells(sample, n), lambda ids, x: MTree(top, ids, x), "long", block_rows, query_rows)
