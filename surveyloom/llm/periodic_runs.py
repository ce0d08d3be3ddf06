"""All maximal periodic runs of words, from longest previous factors.

1. Words become exact codes.  Prefix doubling sorts the suffixes of each document; its levels
   give the common extension of any two places, forwards and backwards.
2. Suffix order and LCP array give the longest previous factor of each place: the nearest
   earlier places before and after it in suffix order.  Following factors cuts a document
   into LZ blocks.
3. A run that touches a block's boundary b, and ends in the block that begins there, has a
   period below the lengths of the blocks on either side together, as the block before b with
   the word at b has no earlier occurrence.  For each such period the repetition around b and
   the one around ``b - period`` are extended both ways (Main's extensions).
4. A run strictly inside a block is a copy of one in the block's earlier occurrence.  Runs lie
   in buckets by their start; blocks copy theirs from left to right.

A document in which no four words in a row occur twice has no run of 12 words, so it ends
after the first two levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm._io import tidy
from surveyloom.llm import _text as T
from surveyloom.llm.suffix_dedup import previous_smaller

#: (boundary, period) pairs that are looked at together.
PAIRS = 1 << 20


def word_codes(chunk: T.Chunk, w: T.Words) -> np.ndarray:
    """A number for each word of a chunk, equal where the words are."""
    if not len(w.starts):
        return np.zeros(0, np.int64)
    offsets = np.append(0, np.cumsum(w.ends - w.starts)).astype(np.int32)
    flat = np.ascontiguousarray(chunk.data[~T.IS_SPACE[chunk.data]])
    words = pa.Array.from_buffers(pa.binary(), len(w.starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


class Order:
    """Suffix order of several documents' words; a suffix ends with its document.

    ``levels[k]`` has equal numbers where the next 2**k words are equal and stand in one
    document; only places that still tie are sorted again for the level after.
    """

    def __init__(self, codes: np.ndarray, bounds: np.ndarray) -> None:
        """Document i has the words ``codes[bounds[i]:bounds[i + 1]]``."""
        sizes = np.diff(bounds)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.begin, self.end = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
        n = len(codes)
        key = self.doc * (int(codes.max(initial=0)) + 1) + codes
        order = np.argsort(key)
        head = np.ones(n, bool)
        head[1:] = np.diff(key[order]) != 0
        first = np.flatnonzero(head)[np.cumsum(head) - 1]
        rank = np.empty(n, np.int64)
        rank[order] = first
        self.levels = [rank.astype(np.int32)]
        tied = order[self._ties(head)]
        #: documents in which some four words in a row occur twice
        self.repeating = np.zeros(0, np.int64)
        while len(tied):
            step = 1 << (len(self.levels) - 1)
            after = np.zeros(len(tied), np.int64)
            inside = np.flatnonzero(tied + step < self.end[tied])
            after[inside] = rank[tied[inside] + step] + 1
            key = rank[tied] * (n + 1) + after
            order = np.argsort(key)
            tied, key = tied[order], key[order]
            old = np.ones(len(tied), bool)
            old[1:] = np.diff(key // (n + 1)) != 0
            head = old.copy()
            head[1:] |= np.diff(key) != 0
            at = np.arange(len(tied))
            moved = np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(old, at, 0))
            rank = rank.copy()
            rank[tied] += moved
            self.levels.append(rank.astype(np.int32))
            tied = tied[self._ties(head)]
            if len(self.levels) == 3:
                self.repeating = np.unique(self.doc[tied])
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[rank] = np.arange(n)

    @staticmethod
    def _ties(head: np.ndarray) -> np.ndarray:
        """Those places of a sorted list that are no group of their own."""
        last = np.append(head[1:], True)
        return ~(head & last)

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from a and from b on; a < b in one document."""
        out = np.zeros(len(a), np.int64)
        end = self.end[a]
        for k in range(len(self.levels) - 1, -1, -1):
            fit = np.flatnonzero(b + out + (1 << k) <= end)
            same = fit[self.levels[k][a[fit] + out[fit]] == self.levels[k][b[fit] + out[fit]]]
            out[same] += 1 << k
        return out

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words before a and before b; a < b, a belongs to the document of b - 1."""
        out = np.zeros(len(a), np.int64)
        begin = self.begin[b - 1]
        for k in range(len(self.levels) - 1, -1, -1):
            fit = np.flatnonzero(a - out - (1 << k) >= begin)
            same = fit[self.levels[k][a[fit] - out[fit] - (1 << k)] == self.levels[k][b[fit] - out[fit] - (1 << k)]]
            out[same] += 1 << k
        return out


def longest_previous(order: Order, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, place) of the longest factor that also begins earlier, for every word; length 0 where there is none.

    ``suffixes`` are those of whole documents, in suffix order.
    """
    low, high = np.minimum(suffixes[1:], suffixes[:-1]), np.maximum(suffixes[1:], suffixes[:-1])
    lcp = np.zeros(len(suffixes), np.int64)
    alike = np.flatnonzero(order.doc[low] == order.doc[high])
    lcp[1 + alike] = order.ahead(low[alike], high[alike])
    # suffixes with a first word in common stand together
    group = np.cumsum(lcp == 0)
    length, place = np.zeros(len(order.doc), np.int64), np.zeros(len(order.doc), np.int64)
    for neighbour in (previous_smaller(suffixes, group), len(suffixes) - 1 - previous_smaller(suffixes[::-1], group[::-1])[::-1]):
        has = np.flatnonzero((neighbour >= 0) & (neighbour < len(suffixes)))
        own, earlier = suffixes[has], suffixes[neighbour[has]]
        common = order.ahead(earlier, own)
        longer = common > length[own]
        length[own[longer]], place[own[longer]] = common[longer], earlier[longer]
    return length, place


def lz_blocks(order: Order, length: np.ndarray, docs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the LZ blocks of some documents, one after another."""
    starts: list[int] = []
    for begin, end in zip(bounds[docs].tolist(), bounds[docs + 1].tolist(), strict=True):
        steps = np.maximum(length[begin:end], 1).tolist()
        i = 0
        while i < end - begin:
            starts.append(begin + i)
            i += steps[i]
    return np.array(starts, np.int64)


def _around(order: Order, at: np.ndarray, period: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(start, end, period) of the runs whose repetition touches ``at``: words at and after it against those a period on."""
    short = order.levels[min(1, len(order.levels) - 1)]
    # a repetition of at least least / 2 >= 4 words that touches a place has two equal words on one side of it
    after = (at + period + 2 <= order.end[at]) & (short[at] == short[np.minimum(at + period, len(short) - 1)])
    before = (at - 2 >= order.begin[at]) & (short[at - 2] == short[np.minimum(at + period - 2, len(short) - 1)])
    some = np.flatnonzero(after | before)
    at, period = at[some], period[some]
    ahead, behind = np.zeros(len(at), np.int64), order.behind(at, at + period)
    inside = np.flatnonzero(at + period < order.end[at])
    ahead[inside] = order.ahead(at[inside], at[inside] + period[inside])
    start, end = at - behind, at + period + ahead
    good = np.flatnonzero(end - start >= np.maximum(least, 2 * period))
    return start[good], end[good], period[good]


def _touching(order: Order, blocks: np.ndarray, docs: np.ndarray, bounds: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, end, period) of all runs that touch a boundary of blocks; other multiples of a period may be among them."""
    ends = np.append(blocks[1:], 0)
    last = np.append(np.flatnonzero(np.diff(order.doc[blocks])), len(blocks) - 1)
    ends[last] = bounds[docs + 1]
    size = ends - blocks
    # the boundary at the end of each block, the block after it, and the periods to try
    following = np.append(size[1:], 0)
    following[last] = 1
    n = size + following - 1
    edge = np.append(0, np.cumsum(n))
    found = [np.zeros((0, 3), np.int64)]
    for low in range(0, int(edge[-1]), PAIRS):
        flat = np.arange(low, min(low + PAIRS, int(edge[-1])))
        which = np.searchsorted(edge, flat, "right") - 1
        at, period = ends[which], flat - edge[which] + 1
        right = np.flatnonzero(at + period < bounds[1:][order.doc[blocks[which]]])
        # a repetition on the right that only touches its end is one on the left as well
        found.append(np.stack(_around(order, at[right], period[right], least), 1))
        left = np.flatnonzero(at - period >= order.begin[blocks[which]])
        found.append(np.stack(_around(order, at[left] - period[left], period[left], least), 1))
    out = np.concatenate(found)
    # of the multiples of a period that describe one run, the smallest
    out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
    new = np.ones(len(out), bool)
    new[1:] = (np.diff(out[:, 0]) != 0) | (np.diff(out[:, 1]) != 0)
    return out[new]


def runs_of(codes: np.ndarray, bounds: np.ndarray, least: int = 12) -> np.ndarray:
    """Rows (start, end, period) of all runs of several documents, by start and period.

    A run has at least ``least`` (8 or more) words and two periods, its period is its smallest, and no word
    beside it continues it.
    """
    order = Order(codes, bounds)
    docs = order.repeating
    if not len(docs):
        return np.zeros((0, 3), np.int64)
    wanted = np.zeros(len(bounds) - 1, bool)
    wanted[docs] = True
    length, place = longest_previous(order, order.suffixes[wanted[order.doc[order.suffixes]]])
    blocks = lz_blocks(order, length, docs, bounds)
    touching = _touching(order, blocks, docs, bounds, least)
    by_start: dict[int, list[tuple[int, int]]] = {}
    for start, end, period in touching.tolist():
        by_start.setdefault(start, []).append((end, period))
    # a run strictly inside a block needs a word of it on either side
    for block in blocks[length[blocks] >= least + 2].tolist():
        source, n = int(place[block]), int(length[block])
        for start in range(source + 1, source + n - least):
            own = by_start.get(start)
            if own:
                copies = [(end + block - source, period) for end, period in own if end < source + n]
                if copies:
                    by_start.setdefault(start + block - source, []).extend(copies)
    rows = [(start, end, period) for start in sorted(by_start) for end, period in sorted(by_start[start], key=lambda x: x[1])]
    return np.array(rows, np.int64).reshape(-1, 3)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run contains after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 1], -1)
    return np.cumsum(depth)[:-1] == 0


def joined(chunk: T.Chunk, w: T.Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space."""
    which = np.flatnonzero(kept)
    counts = np.diff(np.searchsorted(which, w.first))
    size = w.ends[which] - w.starts[which]
    space = np.ones(len(which), np.int64)
    space[np.cumsum(counts)[counts > 0] - 1] = 0
    begin = np.cumsum(size + space) - size - space
    total = int((size + space).sum())
    out = np.full(total, 32, np.uint8)
    flat = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin, size) + flat] = chunk.data[np.repeat(w.starts[which], size) + flat]
    edge = np.append(begin, total)[np.append(0, np.cumsum(counts))]
    return pa.Array.from_buffers(pa.string(), len(chunk), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(out)])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for chunk in T.chunks(batch.column("text")):
                w = T.words(chunk)
                runs = runs_of(word_codes(chunk, w), w.first, least)
                at = np.searchsorted(runs[:, 0], w.first)
                start = runs[:, 0] - np.repeat(w.first[:-1], np.diff(at))
                values = pa.StructArray.from_arrays([pa.array(start), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], fields=list(_RUN))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([ids.slice(chunk.first_row, len(chunk)), pa.array(w.counts()), lists, joined(chunk, w, kept_words(len(w.starts), runs))], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """Maximal periodic runs of words in each document, and its text with each run cut to one period.

    ``docs`` needs doc_id and text; other columns are ignored.  A run is a stretch of words in
    which words ``period`` apart are identical, of at least ``least`` words (8 or more) and
    two periods, that no neighbouring word extends.  Returns one row per input row: doc_id, n_words, runs (array of
    start, length and period, by start and period) and collapsed: the words that no run
    contains after its first period, joined by one space.  Null, empty and blank texts have no words, no
    runs and an empty collapsed text; repeated rows are rows of their own; a null doc_id stays
    null; an empty table gives an empty table.

    Nothing is shuffled.  A document is one task's work; it takes about 100 bytes a word and
    four more for each doubling of its longest repeat.
    """
    if least < 8:
        raise ValueError("least must be 8 or more")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(tidy(_found(least)), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
