"""Searches of a query set against all vectors, through one partitioned index.

Vectors are dealt into cells that a bounded sample of them defines, and each cell into
blocks of bounded size.  A query first goes to its home cell; the k-th score it finds there
is a bound, and only cells that may hold something better get the query in the second
round.  In a task a block's vectors come first and are indexed once; its queries then
stream past them, so a block needs no more memory for more queries.  Of equal vectors only
the ``top + 1`` smallest ids can be in a result (one may be the query itself), so only
those are indexed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm._io import dropped, tidy, written

#: Vectors in the sample that defines cells, about; and most cells.
SAMPLE, MOST_CELLS = 20_000, 4096


class Cells(Protocol):
    """A division of space; ``bounds`` has what was measured of each cell's vectors."""

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        """Cell of each vector."""

    def home_of(self, q: np.ndarray) -> np.ndarray:
        """Cell that each query visits first."""

    def measured(self, x: np.ndarray, cell: np.ndarray) -> Iterator[tuple[int, int, float, float]]:
        """(cell, axis, low, high) of some vectors; lows and highs are combined over all."""

    def admitted(self, q: np.ndarray, kth: np.ndarray, bounds: dict[int, dict[int, tuple[float, float]]]) -> np.ndarray:
        """Queries x cells: which cells may hold better ones than the k-th score, -inf if there is none yet."""


class Index(Protocol):
    def find(self, query_ids: np.ndarray, q: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, vector position, score) of the best of some queries; ``kth`` is known to be reached."""


def usable(table: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, v): ids and vectors that take part, as doubles; a repeated vec_id counts once."""
    v = F.col("embedding").cast("array<double>")
    largest, least = F.array_max("embedding"), F.array_min("embedding")
    # not-a-number is the largest; array_contains says null, not false, where a component is null
    rows = table.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & (largest < float("inf")) & (least > float("-inf")) & ~F.array_contains(v, float("nan")))
    if not zero:
        rows = rows.filter((largest != 0) | (least != 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _alike(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch whose vectors have the same number of components, with that number."""
    size = batch.column("size").to_numpy()
    for n in np.unique(size).tolist():
        yield n, batch.filter(pa.array(size == n))


_ROW = "size int, cell int, block int, part int, query boolean, vec_id long, v array<double>, kth double"
_ROW_NAMES = ["size", "cell", "block", "part", "query", "vec_id", "v", "kth"]


def _rows(size: int, cell: np.ndarray, block: np.ndarray, part: np.ndarray, query: bool, some: pa.RecordBatch, kth: np.ndarray) -> pa.RecordBatch:
    n = len(some)
    columns = [pa.array(np.full(n, size, np.int32)), pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.full(n, query)), some.column("vec_id"), some.column("v"), pa.array(kth, pa.float64())]
    return pa.RecordBatch.from_arrays(columns, names=_ROW_NAMES)


def _spread(ids: np.ndarray, n: np.ndarray | int, seed: int) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(32)) % np.asarray(n).astype(np.uint64)).astype(np.int64)


def _assigned(cells: Cells, main: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, some in _alike(batch):
                cell = cells.cell_of(_matrix(some.column("v"))) if size == main else np.full(len(some), -1)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell.astype(np.int32))], names=[*some.schema.names, "cell"])

    return run


def _measured(cells: Cells) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cell, axis, low, high = zip(*cells.measured(_matrix(batch.column("v")), batch.column("cell").to_numpy()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(axis, pa.int32()), pa.array(low, pa.float64()), pa.array(high, pa.float64())], names=["cell", "axis", "low", "high"])

    return run


def _blocks(blocks: dict[tuple[int, int], int], parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Vectors -> rows for their block, once for each part of the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, some in _alike(batch):
                cell, ids = some.column("cell").to_numpy(), some.column("vec_id").to_numpy()
                block = _spread(ids, np.array([blocks[size, c] for c in cell.tolist()]), 1)
                for part in range(parts):
                    yield _rows(size, cell, block, np.full(len(some), part), False, some, np.zeros(len(some)))

    return run


def _routed(cells: Cells, main: int, blocks: dict[tuple[int, int], int], bounds: dict | None, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Queries -> rows for the blocks they visit: of the home cell, or (with ``bounds``) of the other cells admitted."""
    known = sorted(c for size, c in blocks if size == main)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, some in _alike(batch):
                kth = some.column("kth").to_numpy(zero_copy_only=False)
                if size != main:
                    visits = {-1: np.arange(len(some))} if bounds is None else {}
                else:
                    q = _matrix(some.column("v"))
                    home = cells.home_of(q)
                    if bounds is None:
                        visits = {c: np.flatnonzero(home == c) for c in known}
                    else:
                        may = cells.admitted(q, kth, bounds)
                        visits = {c: np.flatnonzero(may[:, c] & (home != c)) for c in known}
                for cell, at in visits.items():
                    if len(at):
                        own = some.take(pa.array(at))
                        part = _spread(own.column("vec_id").to_numpy(), parts, 2)
                        for block in range(blocks.get((size, cell), 0)):
                            yield _rows(size, np.full(len(at), cell), np.full(len(at), block), part, True, own, kth[at])

    return run


def _tasks(make_index: Callable[[np.ndarray, np.ndarray], Index], score: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by block, vectors before queries -> the best of each block for its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index, own = None, [], None, None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("size", "cell", "block", "part", "query")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(batch)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                *key, query = keys[a].tolist()
                if key != now:
                    now, held, index = key, [], None
                part = batch.slice(a, b - a)
                if not query:
                    held.append(part.select(["vec_id", "v"]))
                    continue
                if index is None:
                    if not held:
                        continue
                    table = pa.Table.from_batches(held).combine_chunks()
                    ids = table.column("vec_id").to_numpy()
                    order = np.argsort(ids, kind="stable")
                    own, held = ids[order], []
                    index = make_index(own, _matrix(table.column("v").combine_chunks())[order])
                queries = part.column("vec_id").to_numpy()
                q, at, s = index.find(queries, _matrix(part.column("v")), part.column("kth").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(queries[q]), pa.array(own[at]), pa.array(s, score)], names=["query_id", "vec_id", "score"])

    return run


def search_cells(vectors: DataFrame, every: int, top: int, make_cells: Callable[[DataFrame, np.ndarray, int], Cells], make_index: Callable, score: str, block_rows: int, query_rows: int) -> DataFrame:
    """Ranked results (query_id, rank, vec_id, score) of the rows whose id is divisible by ``every``.

    ``make_cells`` gets the vectors of the commonest size, a sample of them, and the number
    of cells wanted.  Vectors of other sizes are searched without cells.
    """
    spark = vectors.sparkSession
    # the hash comes first, so that sorting seldom compares vectors
    copies = Window.partitionBy("hash", "v").orderBy("vec_id")
    queries, queries_at = written(vectors.filter(F.col("vec_id") % every == 0).withColumn("size", F.size("v")))
    index, index_at = written(vectors.withColumn("hash", F.xxhash64("v")).withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= top + 1).drop("copy", "hash").withColumn("size", F.size("v")))
    sizes = index.groupBy("size").count().orderBy(F.col("count").desc(), "size").limit(1).collect()
    main, n = (sizes[0]["size"], sizes[0]["count"]) if sizes else (0, 0)
    alike = index.filter(F.col("size") == main)
    sample = alike.filter(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // SAMPLE))) == 0).select("vec_id", "v").toArrow().sort_by("vec_id")
    kind = pa.int64() if score == "long" else pa.float64()
    found = f"query_id long, vec_id long, score {score}"
    cells = make_cells(alike, _matrix(sample.column("v").combine_chunks()) if n else np.zeros((0, 1)), min(MOST_CELLS, max(1, -(-n // block_rows))))
    dealt, dealt_at = written(index.mapInArrow(tidy(_assigned(cells, main)), "vec_id long, v array<double>, size int, cell int"))
    blocks = {(r["size"], r["cell"]): -(-r["count"] // (2 * block_rows)) for r in dealt.groupBy("size", "cell").count().collect()}
    bounds: dict[int, dict[int, tuple[float, float]]] = {}
    for r in dealt.filter(F.col("size") == main).mapInArrow(tidy(_measured(cells)), "cell int, axis int, low double, high double").groupBy("cell", "axis").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        bounds.setdefault(r["cell"], {})[r["axis"]] = (r["low"], r["high"])
    parts = max(1, -(-queries.count() // query_rows))
    tasks = max(1, sum(blocks.values()) * parts)

    def searched(asking: DataFrame, with_bounds: dict | None) -> DataFrame:
        rows = dealt.mapInArrow(tidy(_blocks(blocks, parts)), _ROW).union(asking.mapInArrow(tidy(_routed(cells, main, blocks, with_bounds, parts)), _ROW))
        rows = rows.repartition(tasks, "size", "cell", "block", "part").sortWithinPartitions("size", "cell", "block", "part", "query")
        return rows.mapInArrow(tidy(_tasks(make_index, kind)), found)

    def ranked(best: DataFrame) -> DataFrame:
        return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))).filter(F.col("rank") <= top)

    first, first_at = written(ranked(searched(queries.withColumn("kth", F.lit(float("-inf"))), None)).drop("rank"))
    best = first
    if len(bounds) > 1:
        reached = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("least")).filter(F.col("n") == top)
        asking = queries.join(reached, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "size", F.coalesce("least", F.lit(float("-inf"))).alias("kth"))
        second, second_at = written(searched(asking, bounds))
        best = first.union(second)
    for path in (queries_at, index_at, dealt_at):
        dropped(spark, path)
    return ranked(best).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
