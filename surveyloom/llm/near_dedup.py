"""MinHash near-dedup with bottom-k sketches from a single hash function.

1. Each document keeps the smallest hashes of its shingle set.  Its k follows its size:
   linked sets share at least ``o = ceil(percent * size)`` values, the larger size counting,
   so the ``l`` smallest shared values are among the ``size - o + l`` smallest of either set.
   That is a certain bound, not a likely one.  Documents with equal sets form a class.
2. Inverted lists of retained values.  As documents that may be linked share at least so
   many of them, whatever the partner's size, all but one of that number need no look-up:
   each leaves out its most common ones, and two linked documents meet in the list of the
   rarest value that both retain.  With l as large as ``size - o + 1``, common passages are
   looked up only where more than half of a sketch consists of them.
3. A list is not expanded into pairs: its members go to its smallest one, the head.  All
   lists of a head make one group, so linked documents meet in some group, and groups never
   grow by chains.
4. Each member is first verified against the head that shares most lists with it.  What
   that links is one component, and pairs inside a component are not looked at again: in a
   group only members outside its largest component are compared with the rest, block by
   block.
5. A comparison counts shared retained values, bounds the similarity from above by the
   union's sketch, and verifies what is left on full sets.  Verified links and classes give
   the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm import _text as T
from surveyloom.llm._graph import connected_components
from surveyloom.llm._io import dropped, released, tidy, written

#: Shingles in a block of a group.
BLOCK_SHINGLES = 1_000_000
#: Members that are verified together with one copy of their head.
STAR_MEMBERS = 256
#: Tasks that the members of one group are spread over before they are dealt into blocks.
SPREAD = 16


def retained(n: np.ndarray | int, percent: int) -> tuple[np.ndarray | int, np.ndarray | int]:
    """(values a set of n keeps, number of them that it looks up)."""
    certain = -(-percent * n // 100)
    looked_up = n - certain + 1
    return n - certain + np.minimum(certain, looked_up), looked_up


def spared(n: int, percent: int) -> int:
    """Shared retained values that a set of n need not look up, whatever the size of its partner.

    Sets of n and m values that are linked share at least ``both`` values; the smallest of
    those are retained by either, so all but one of the fewest that any partner leaves in
    common may be spared.
    """
    m = np.arange(-(-percent * n // 100), 100 * n // percent + 1)
    both = -(-percent * (n + m) // (100 + percent))
    common = np.minimum(both, both - (m - retained(m, percent)[0]))
    return int(np.minimum(common, both - (n - retained(np.array([n]), percent)[0])).min()) - 1


def shingle_sets(chunk: T.Chunk, size: int) -> Iterator[np.ndarray]:
    """Sorted hashes of each document's distinct word shingles, letters A-Z lower-cased."""
    w = T.words(chunk)
    hashes = T.word_hashes(chunk, w, lower=True)
    grams = T.gram_hashes(hashes, size) >> np.uint64(1)
    counts = w.counts()
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = dict(zip(short.tolist(), (T.span_hashes(hashes, w.first[short], w.first[short] + counts[short]) >> np.uint64(1)).tolist(), strict=True)) if len(short) else {}
    for i, (begin, n) in enumerate(zip(w.first.tolist(), counts.tolist(), strict=False)):
        if n >= size:
            yield np.unique(grams[begin : begin + n - size + 1]).view(np.int64)
        else:
            yield np.array([whole[i]] if n else [], np.int64)


def _set_hash(values: np.ndarray) -> tuple[int, int]:
    x = values.view(np.uint64)
    return int(T.mix(x).sum(dtype=np.uint64).view(np.int64)), int(T.mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))


def _sketch(size: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    spare_of: dict[int, int] = {0: 0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for chunk in T.chunks(batch.column("text")):
                n, h1, h2, kept, spare = [], [], [], [], []
                for values in shingle_sets(chunk, size):
                    n.append(len(values))
                    if len(values) not in spare_of:
                        spare_of[len(values)] = spared(len(values), percent)
                    spare.append(spare_of[len(values)])
                    one, two = _set_hash(values)
                    h1.append(one)
                    h2.append(two)
                    kept.append(values[: int(retained(len(values), percent)[0])] if len(values) else values)
                at = np.append(0, np.cumsum([len(x) for x in kept])).astype(np.int32)
                sketch = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(kept)))
                yield pa.RecordBatch.from_arrays([ids.slice(chunk.first_row, len(chunk)), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), sketch, pa.array(spare, pa.int64())], names=["doc_id", "n_shingles", "h1", "h2", "sketch", "spare"])

    return run


def _full_sets(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Full sets of the documents that stand for a class with candidates; repeated rows give one in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            node, rep, h1, h2 = (batch.column(k).to_pylist() for k in ("node", "doc_id", "h1", "h2"))
            for chunk in T.chunks(batch.column("text")):
                out: list[list] = [[], [], []]
                for i, values in enumerate(shingle_sets(chunk, size), chunk.first_row):
                    if node[i] not in seen and _set_hash(values) == (h1[i], h2[i]):
                        seen.add(node[i])
                        for to, x in zip(out, (node[i], rep[i], values.tobytes()), strict=True):
                            to.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["node", "rep", "values"])

    return run


class Sets:
    """Some full sets with their sketches, and inverted lists of both."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.sets, self.percent = sets, percent
        self.sizes = np.array([len(x) for x in sets])
        self.kept = retained(self.sizes, percent)[0]
        self.flat, self.owner = self._lists([x[:k] for x, k in zip(sets, self.kept.tolist(), strict=True)])
        self.last = np.array([x[k - 1] for x, k in zip(sets, self.kept.tolist(), strict=True)])
        self.last[self.kept == self.sizes] = np.iinfo(np.int64).max  # complete everywhere

    @staticmethod
    def _lists(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        order = np.argsort(flat, kind="stable")
        return flat[order], owner[order]

    def bounded(self, i: int, among: np.ndarray) -> np.ndarray:
        """Those of ``among`` whose similarity to i may reach the threshold, by the union's sketch."""
        own = self.sets[i][: self.kept[i]]
        lo, hi = np.searchsorted(self.flat, own, "left"), np.searchsorted(self.flat, own, "right")
        n = hi - lo
        at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        met = self.owner[at]
        wanted = np.zeros(len(self.sets), bool)
        wanted[among] = True
        wanted &= self.percent * np.maximum(self.sizes, self.sizes[i]) <= 100 * np.minimum(self.sizes, self.sizes[i])
        near = np.flatnonzero(wanted & (np.bincount(met, minlength=len(self.sets)) > 0))
        if not len(near):
            return near
        # both sketches are complete up to ``reach``; what lies beyond is shared at most as a whole
        reach = np.minimum(self.last[near], self.last[i])
        limit = np.zeros(len(self.sets), np.int64)
        limit[near] = reach
        shared = np.bincount(met[self.flat[at] <= limit[met]], minlength=len(self.sets))[near]
        beyond = np.array([self.sizes[j] - np.searchsorted(self.sets[j][: self.kept[j]], r, "right") for j, r in zip(near.tolist(), reach, strict=True)])
        most = shared + np.minimum(beyond, self.sizes[i] - np.searchsorted(own, reach, "right"))
        ok = 100 * most >= self.percent * (self.sizes[near] + self.sizes[i] - most)
        return near[ok][np.argsort(-shared[ok], kind="stable")]

    def linked(self, i: int, j: int) -> bool:
        both = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
        return bool(100 * both >= self.percent * (self.sizes[i] + self.sizes[j] - both))


def verified_links(sets: list[np.ndarray], parts: list[int], blocks: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that join the components ``parts`` of some sets, or of two blocks of them, as pairs of positions.

    Pairs that are connected already are not verified.
    """
    m = len(sets)
    if m < 2:
        return []
    some = Sets(sets, percent)
    block = np.array(blocks)
    across = len(set(blocks)) > 1
    label = np.unique(np.array(parts), return_inverse=True)[1]
    parent = list(range(int(label.max()) + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    everyone = np.arange(m)
    for i in range(m):
        among = everyone[i + 1 :]
        among = among[label[among] != label[i]]
        if across:
            among = among[block[among] != block[i]]
        for j in some.bounded(i, among).tolist() if len(among) else []:
            a, b = root(int(label[i])), root(int(label[j]))
            if a != b and some.linked(i, j):
                parent[max(a, b)] = min(a, b)
                links.append((i, j))
    return links


def _grouped(keys: list[str], columns: list[str], found: Callable[[list[tuple]], list[tuple[int, int]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by ``keys`` -> links (a, b) of each run of rows with equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        links = lambda: pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
        for batch in batches:
            own = zip(*(batch.column(x).to_pylist() for x in keys), strict=True)
            for key, row in zip(own, zip(*(batch.column(x).to_pylist() for x in columns), strict=True), strict=True):
                if now != key:
                    out += found(held) if held else []
                    now, held = key, []
                held.append(row)
            if len(out) > 10_000:
                yield links()
                out = []
        out += found(held) if held else []
        yield links()

    return run


def _star_links(percent: int) -> Callable[[list[tuple]], list[tuple[int, int]]]:
    def found(rows: list[tuple]) -> list[tuple[int, int]]:
        head = next((x for x in rows if x[0]), None)
        members = [x for x in rows if not x[0]]
        if head is None or not members:
            return []
        some = Sets([np.frombuffer(x[2], np.int64) for x in [head, *members]], percent)
        near = some.bounded(0, np.arange(1, len(members) + 1)).tolist()
        return [(head[1], members[j - 1][1]) for j in near if some.linked(0, j)]

    return found


def _block_links(percent: int) -> Callable[[list[tuple]], list[tuple[int, int]]]:
    def found(rows: list[tuple]) -> list[tuple[int, int]]:
        rows = sorted(set(rows))
        links = verified_links([np.frombuffer(x[3], np.int64) for x in rows], [x[2] for x in rows], [x[1] for x in rows], percent)
        return [(rows[i][0], rows[j][0]) for i, j in links]

    return found


def _groups(looked_up: DataFrame) -> DataFrame:
    """(head, node, shared): members of the lists that each head leads, the head among them."""
    heads = looked_up.groupBy("value").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("value", "head")
    return looked_up.join(heads, "value").groupBy("head", "node").agg(F.count(F.lit(1)).alias("shared"))


def _stars(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) of each node to the head that shares most lists with it."""
    best = groups.filter("node <> head").groupBy("node").agg(F.max_by("head", F.struct("shared", -F.col("head"))).alias("head"))
    sized = best.join(best.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / F.lit(STAR_MEMBERS)).cast("int").alias("parts")), "head")
    members = sized.select("head", "node", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("leads"))
    leads = sized.select("head", "parts").distinct().select("head", F.col("head").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("leads"))
    rows = members.union(leads).join(sets, "node").repartition("head", "part").sortWithinPartitions("head", "part")
    return rows.mapInArrow(tidy(_grouped(["head", "part"], ["leads", "rep", "values"], _star_links(percent))), "a long, b long")


def _rest(groups: DataFrame, sets: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) between components inside the groups.

    Of a group's members those outside its largest component are compared with all others.
    Both kinds are cut into blocks; each pair of blocks with an outer member is a task's work.
    """
    where = sets.select("node", "rep", (F.length("values") / 8).cast("long").alias("n"))
    members = groups.select("head", "node").join(where, "node").join(components, F.col("rep") == F.col("id"), "left")
    members = members.select("head", "node", "n", F.coalesce("component", "rep").alias("component"))
    per = members.groupBy("head", "component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK_SHINGLES)).cast("int")
    per = per.groupBy("head").agg(F.max_by("component", F.struct("rows", -F.col("component"))).alias("largest"), F.max_by("n", F.struct("rows", -F.col("component"))).alias("inner"), F.sum("n").alias("whole"), F.count(F.lit(1)).alias("components"))
    per = per.filter("components > 1").select("head", "largest", blocks(F.col("inner")).alias("inner"), blocks(F.col("whole") - F.col("inner")).alias("outer"))
    # a group may be large: its one row meets its members in several tasks
    spread = per.withColumn("spread", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    rows = members.withColumn("spread", F.pmod(F.xxhash64("node"), F.lit(SPREAD)).cast("int")).join(spread, ["head", "spread"]).withColumn("out", F.col("component") != F.col("largest"))
    rows = rows.withColumn("block", F.when(F.col("out"), F.pmod(F.xxhash64("node"), F.col("outer"))).otherwise(F.col("outer") + F.pmod(F.xxhash64("node"), F.col("inner"))).cast("int"))
    # an outer block meets every block, an inner one only the outer ones; with one block of each, all stand together
    single = (F.col("outer") == 1) & (F.col("inner") == 1)
    last = F.when(F.col("out"), F.col("outer") + F.col("inner") - 1).otherwise(F.col("outer") - 1)
    rows = rows.withColumn("other", F.explode(F.when(single, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last))))
    rows = rows.withColumn("block", F.when(single, F.lit(0)).otherwise(F.col("block")))
    rows = rows.select("head", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "component", "node")
    dealt = rows.join(sets, "node").repartition("head", "low", "high").sortWithinPartitions("head", "low", "high")
    return dealt.mapInArrow(tidy(_grouped(["head", "low", "high"], ["rep", "block", "component", "values"], _block_links(percent))), "a long, b long")


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` % or more.

    ``docs`` needs doc_id and text; other columns are ignored.  A set holds the distinct
    ``shingle``-word shingles of the lower-cased text; fewer words are one shingle, and no
    words (null, empty or blank text) give an empty set, linked with nothing.  No link is
    lost, whatever the texts; sets are compared as 63-bit hashes of their shingles.  Returns
    one row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable over
    links) and kept (whether it is doc_id).  Rows that repeat a doc_id are one node with
    several sets.  A null doc_id is linked with nothing, has a null component_id and is
    kept.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches, sketches_at = written(texts.mapInArrow(tidy(_sketch(shingle, percent)), "doc_id long, n_shingles long, h1 long, h2 long, sketch array<long>, spare long"))
    usable = sketches.filter("doc_id is not null and n_shingles > 0")
    classes = usable.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "n_shingles", "sketch", "spare")).alias("x"), F.count(F.lit(1)).alias("rows"))
    # numbered once and written: a class is one number from here on
    classes, classes_at = written(classes.select(F.monotonically_increasing_id().alias("node"), F.col("x.doc_id").alias("rep"), "x.n_shingles", "x.sketch", "x.spare", "h1", "h2", "rows"))

    values = classes.select("node", "spare", F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("owners")).filter("owners > 1")
    own = Window.partitionBy("node")
    looked_up = (
        values.join(shared, "value")
        .withColumn("common", F.count(F.lit(1)).over(own))
        .withColumn("place", F.row_number().over(own.orderBy("owners", "value")))
        .filter(F.col("place") <= F.col("common") - F.col("spare"))
        .select("value", "node")
    )
    looked_up, looked_up_at = written(looked_up)
    groups, groups_at = written(_groups(looked_up))
    dropped(spark, looked_up_at)

    members = groups.select("node").distinct().join(classes.select("node", F.col("rep").alias("doc_id"), "h1", "h2"), "node")
    sets, sets_at = written(texts.join(members, "doc_id").mapInArrow(tidy(_full_sets(shingle)), "node long, rep long, values binary"))
    stars, stars_at = written(_stars(groups, sets, percent))
    starred = connected_components(stars, "a", "b").withColumnRenamed("node", "id")
    rest, rest_at = written(_rest(groups, sets, starred, percent))
    released(starred)
    for path in (groups_at, sets_at):
        dropped(spark, path)

    copies = usable.select("h1", "h2", F.col("doc_id").alias("a")).join(classes.filter("rows > 1").select("h1", "h2", F.col("rep").alias("b")), ["h1", "h2"]).filter("a <> b").select("a", "b")
    components = connected_components(stars.union(rest).union(copies), "a", "b")
    for path in (stars_at, rest_at, classes_at):
        dropped(spark, path)
    out = sketches.select("doc_id", "n_shingles").join(components, F.col("doc_id") == F.col("node"), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out, _ = written(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
    released(components)
    dropped(spark, sketches_at)
    return out
