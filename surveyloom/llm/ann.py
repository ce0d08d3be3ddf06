"""Approximate nearest neighbours by few stable projections and a kd-tree.

Largest inner products become nearest neighbours by one more component that brings all
vectors to the length of the longest.  Gaussian projections to ``dims`` dimensions are
2-stable: a projected squared distance over the true one has a chi-square distribution.
The upper part of a kd-tree over the projections deals vectors into cells, a kd-tree of
each block does the rest.  A query verifies its nearest leaves whole, then reads all leaves
that the test below admits, and verifies their points in waves of growing projected
distance.  It stops when a point at its current k-th distance would have been projected
nearer than everything still to come with probability ``confidence``; by the same test
whole leaves are left unread, and whole cells, with the k-th distance of the first cell.
Queries of the same leaf go together: their projected distances are one matrix product.

Vectors are divided by their largest component first, so that tiny and huge ones keep
their directions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm._io import tidy
from surveyloom.llm._vectors import search_cells, usable

LEAF = 64
#: Leaves that a query verifies whole before the first test.
NEAREST = 4
#: Shares of the projected distance at which a query stops, verified one after another.
WAVES = (0.5, 0.75, 1.0)
#: Queries whose projected distances are taken by one product; vectors verified at once.
TOGETHER, VERIFIED = 128, 2048


def chi_square(x: np.ndarray, dims: int) -> np.ndarray:
    """Distribution function for an even number of degrees of freedom."""
    half = np.minimum(x / 2, 700)
    return 1 - np.exp(-half) * sum(half**i / math.factorial(i) for i in range(dims // 2))


def chi_square_quantile(p: float, dims: int) -> float:
    if p >= 1:
        return math.inf
    low, high = 0.0, 10.0 * dims + 100
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(np.array(middle), dims) < p else (low, middle)
    return high


def directions(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Queries at unit length, and their lengths; neither under- nor overflows before it must."""
    largest = np.abs(q).max(1)
    scaled = q / largest[:, None]
    length = np.sqrt((scaled * scaled).sum(1))
    return scaled / length[:, None], largest * length


class Projection:
    """Lifts vectors to one length and projects them; a query is brought to that length."""

    def __init__(self, components: int, dims: int, seed: int, largest: float, square: float) -> None:
        """``largest`` is the largest component of all vectors, ``square`` the largest squared length once divided by it."""
        self.largest, self.square = largest, square
        self.planes = np.random.default_rng(seed).standard_normal((components + 1, dims))

    def low(self, x: np.ndarray) -> np.ndarray:
        y = x / self.largest
        extra = np.sqrt(np.maximum(self.square - (y * y).sum(1), 0))
        return np.column_stack((y, extra)) @ self.planes

    def low_queries(self, q: np.ndarray) -> np.ndarray:
        return directions(q)[0] * math.sqrt(self.square) @ self.planes[:-1]

    def distance(self, q: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Squared distance, after lifting, of a vector with the inner product ``kth``."""
        length = directions(q)[1]
        with np.errstate(all="ignore"):
            cosine = kth / length / self.largest
        return np.where(np.isfinite(cosine), np.maximum(2 * self.square - 2 * math.sqrt(self.square) * cosine, 0), np.inf)


def kd_split(points: np.ndarray, leaf: int, leaves: int | None = None) -> tuple[list[np.ndarray], list]:
    """Leaves of a kd-tree (medians of the widest side), and the tree: (side, cut, left, right) or a leaf's number.

    With ``leaves`` the largest leaf is split until there are so many.
    """
    done: list[np.ndarray] = []

    def grow(rows: np.ndarray, want: int):
        if (want <= 1 if leaves else len(rows) <= leaf) or len(rows) < 2 or not np.ptp(points[rows], axis=0).any():
            done.append(rows)
            return len(done) - 1
        side = int(np.argmax(np.ptp(points[rows], axis=0)))
        cut = float(np.partition(points[rows, side], len(rows) // 2)[len(rows) // 2])
        below = points[rows, side] < cut
        if not below.any():
            below = points[rows, side] <= cut
        if below.all():
            done.append(rows)
            return len(done) - 1
        where = cut if (points[rows[~below], side] >= cut).all() and (points[rows[below], side] < cut).all() else math.nextafter(cut, math.inf)
        return (side, where, grow(rows[below], want // 2), grow(rows[~below], want - want // 2))

    tree = grow(np.arange(len(points)), leaves or 0)
    return done, tree


def leaf_of(tree, points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    stack = [(tree, np.arange(len(points)))]
    while stack:
        node, rows = stack.pop()
        if not isinstance(node, tuple):
            out[rows] = node
        else:
            side, cut, left, right = node
            below = points[rows, side] < cut
            stack += [(left, rows[below]), (right, rows[~below])]
    return out


def box_gaps(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance from each query to each box."""
    out = np.zeros((len(q), len(low)))
    for d in range(q.shape[1]):
        side = q[:, d, None]
        out += np.maximum(np.maximum(low[:, d] - side, side - high[:, d]), 0) ** 2
    return out


class KdCells:
    def __init__(self, projection: Projection, sample: np.ndarray, cells: int, confidence: float) -> None:
        self.projection = projection
        self.reach = chi_square_quantile(confidence, projection.planes.shape[1])
        self.tree = kd_split(projection.low(sample), 1, cells)[1] if len(sample) else 0

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        return leaf_of(self.tree, self.projection.low(x))

    def home_of(self, q: np.ndarray) -> np.ndarray:
        return leaf_of(self.tree, self.projection.low_queries(q))

    def measured(self, x: np.ndarray, cell: np.ndarray):
        low = self.projection.low(x)
        for c in np.unique(cell).tolist():
            own = low[cell == c]
            yield from ((c, d, a, b) for d, (a, b) in enumerate(zip(own.min(0).tolist(), own.max(0).tolist(), strict=True)))

    def admitted(self, q: np.ndarray, kth: np.ndarray, bounds: dict) -> np.ndarray:
        out = np.zeros((len(q), max(bounds) + 1), bool)
        known = sorted(bounds)
        box = np.array([[bounds[c][d] for d in range(self.projection.planes.shape[1])] for c in known])
        gaps = box_gaps(self.projection.low_queries(q), box[:, :, 0], box[:, :, 1])
        out[:, known] = gaps < self.reach * self.projection.distance(q, kth)[:, None]
        return out


class KdIndex:
    """A kd-tree over the projections of one block; ``verified`` and ``offered`` count vectors."""

    def __init__(self, projection: Projection, top: int, confidence: float, ids: np.ndarray, x: np.ndarray) -> None:
        self.projection, self.top, self.ids, self.x = projection, top, ids, x
        self.reach = chi_square_quantile(confidence, projection.planes.shape[1])
        points = projection.low(x)
        leaves, self.tree = kd_split(points, LEAF)
        self.order = np.concatenate(leaves)
        self.ids_in_order = ids[self.order]
        self.bounds = np.append(0, np.cumsum([len(r) for r in leaves]))
        self.points = points[self.order]
        self.low = np.minimum.reduceat(self.points, self.bounds[:-1])
        self.high = np.maximum.reduceat(self.points, self.bounds[:-1])
        self.unit = np.ascontiguousarray(x[self.order] / projection.largest)
        self.room = np.empty((VERIFIED, x.shape[1]))
        self.verified = self.offered = self.leaves_read = 0

    def find(self, query_ids: np.ndarray, q: np.ndarray, kth: np.ndarray):
        unit, low = directions(q)[0], self.projection.low_queries(q)
        far = self.projection.distance(q, kth)
        at, which = [], []
        # queries of the same leaf come together, so that they share the leaves they read
        order = np.argsort(leaf_of(self.tree, low), kind="stable")
        for a in range(0, len(q), TOGETHER):
            some = order[a : a + TOGETHER]
            for i, rows in zip(some.tolist(), self._some(unit[some], low[some], far[some], query_ids[some]), strict=True):
                at.append(np.full(len(rows), i))
                which.append(rows)
        at, which = np.concatenate(at), self.order[np.concatenate(which)]
        with np.errstate(over="ignore", invalid="ignore"):
            score = (self.x[which] * q[at]).sum(1)
        order = np.lexsort((self.ids[which], -score, at))
        at, which, score = at[order], which[order], score[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        return at[place < self.top], which[place < self.top], score[place < self.top]

    def _some(self, unit: np.ndarray, low: np.ndarray, far: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
        """For each of some queries the rows verified that may be among its best."""
        found = [_Found(self, u, f, o) for u, f, o in zip(unit, far.tolist(), own.tolist(), strict=True)]
        self.offered += len(found) * len(self.order)
        gap = box_gaps(low, self.low, self.high)
        first = np.argsort(gap, axis=1, kind="stable")[:, :NEAREST]
        for one, leaves in zip(found, first.tolist(), strict=True):
            one.verify(np.concatenate([np.arange(self.bounds[k], self.bounds[k + 1]) for k in leaves]))
        limits = np.array([one.limit() for one in found])
        want = gap <= limits[:, None]
        np.put_along_axis(want, first, False, 1)
        leaves = np.flatnonzero(want.any(0))
        self.leaves_read += first.size + int(want.sum())
        if len(leaves):
            size = np.diff(self.bounds)[leaves]
            start = np.append(0, np.cumsum(size))
            rows = np.arange(start[-1]) + np.repeat(self.bounds[leaves] - start[:-1], size)
            points, length = self.points[rows], (low * low).sum(1)
            square = (points * points).sum(1)
            # projected distances less the query's own square, in one product
            near = np.column_stack((-2 * low, np.ones(len(low)))) @ np.column_stack((points, square)).T
            slack = 1e-12 * float(length.max() + square.max())  # what rounding may have added
            place = np.full(len(self.low), -1)
            place[leaves] = np.arange(len(leaves))
            for one, own_near, less, done in zip(found, near, length.tolist(), place[first].tolist(), strict=True):
                for k in done:
                    if k >= 0:
                        own_near[start[k] : start[k + 1]] = np.inf
                for share in WAVES:
                    ready = np.flatnonzero(own_near < share * one.limit() + slack - less)
                    one.verify(rows[ready])
                    own_near[ready] = np.inf
        return [one.rows for one in found]


class _Found:
    """What one query has verified and may keep: rows and their products."""

    def __init__(self, index: KdIndex, unit: np.ndarray, far: float, own: int) -> None:
        self.index, self.unit, self.far, self.own = index, unit, far, own
        self.rows, self.product, self.least = np.zeros(0, np.int64), np.zeros(0), -np.inf

    def limit(self) -> float:
        """Projected distance beyond which a vector as near as the k-th lies only with a chance of 1 - confidence."""
        return self.index.reach * self.far if self.index.reach < np.inf else np.inf

    def verify(self, rows: np.ndarray) -> None:
        index, square = self.index, self.index.projection.square
        root, top = math.sqrt(square), index.top
        index.verified += len(rows)
        product = np.empty(len(rows))
        for a in range(0, len(rows), VERIFIED):
            some = rows[a : a + VERIFIED]
            np.take(index.unit, some, axis=0, out=index.room[: len(some)], mode="clip")
            np.dot(index.room[: len(some)], self.unit, out=product[a : a + len(some)])
        # all that ties the k-th to the last bits stays; the scores on the original vectors decide
        may = np.flatnonzero(product >= self.least - 1e-12 * root)
        may = may[index.ids_in_order[rows[may]] != self.own]
        self.rows, self.product = np.concatenate((self.rows, rows[may])), np.concatenate((self.product, product[may]))
        if len(may) and len(self.product) >= top:
            self.least = np.partition(self.product, len(self.product) - top)[len(self.product) - top]
            stay = self.product >= self.least - 1e-12 * root
            self.rows, self.product = self.rows[stay], self.product[stay]
            self.far = min(self.far, max(2 * square - 2 * root * self.least, 0.0))


def _longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch the largest component, and the largest squared length once divided by it."""
    for batch in batches:
        if len(batch):
            v = batch.column("v").flatten().to_numpy().reshape(len(batch), -1)
            largest = np.abs(v).max()
            square = ((v / largest) ** 2).sum(1).max()
            yield pa.RecordBatch.from_arrays([pa.array([largest]), pa.array([square])], names=["largest", "square"])


def _projection(vectors: DataFrame, components: int, dims: int, seed: int) -> Projection:
    parts = vectors.select("v").mapInArrow(tidy(_longest), "largest double, square double")
    # logarithms, since lengths may over- or underflow
    longest = F.max_by(F.struct("largest", "square"), F.log("square") + 2 * F.log("largest"))
    found = parts.agg(F.max("largest").alias("largest"), longest.alias("longest")).first()
    if found["largest"] is None:
        return Projection(components, dims, seed, 1.0, 1.0)
    square = found["longest"]["square"] * (found["longest"]["largest"] / found["largest"]) ** 2
    return Projection(components, dims, seed, found["largest"], square * (1 + 1e-12))


def nearest_neighbours(embeddings: DataFrame, every: int = 20, top: int = 20, dims: int = 20, confidence: float = 0.92, seed: int = 11, block_rows: int = 16384, query_rows: int = 65536) -> DataFrame:
    """Each query's ``top`` nearest by inner product: query_id, rank, vec_id, score.

    ``embeddings`` needs vec_id and embedding.  Queries are the rows whose vec_id is
    divisible by ``every``; candidates are all rows but the query's own.  Scores are inner
    products in double precision on the original vectors; ties go to the smaller vec_id,
    and with fewer candidates all are returned.  Vectors that are null, empty, zero, or
    hold null or non-finite components, and rows without vec_id, take no part.  A repeated
    vec_id counts once, with its smallest vector; vectors of different lengths are not
    compared, and those of other than the commonest length are searched exactly.  An empty
    table gives an empty table.
    """
    vectors = usable(embeddings, zero=False)
    held: dict[str, Projection] = {}

    def cells(alike: DataFrame, sample: np.ndarray, n: int) -> KdCells:
        made = KdCells(_projection(alike, sample.shape[1], dims, seed), sample, n, confidence)
        held["projection"] = made.projection
        return made

    def index(ids: np.ndarray, x: np.ndarray) -> KdIndex:
        projection, sure = held["projection"], confidence
        if x.shape[1] + 1 != len(projection.planes):
            largest = np.abs(x).max()
            projection, sure = Projection(x.shape[1], dims, seed, largest, float(((x / largest) ** 2).sum(1).max())), 1.0
        return KdIndex(projection, top, sure, ids, x)

    return search_cells(vectors, every, top, cells, index, "double", block_rows, query_rows)
