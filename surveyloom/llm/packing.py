"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Tokenising works on units: texts are cut at single spaces between non-space characters,
where the tokenizer's pattern always starts a new piece, so a unit's ids do not depend on
its surroundings.  Each distinct unit of a task is encoded once; all else is vectorised.

Packing is hierarchical.  Documents are dealt by a hash; each task packs its pieces
best-fit, longest first, and emits nearly full bins.  Bins with room left travel on as
items of their fill, those of several tasks together, and are packed best-fit again.  No
task gets more than about ``task_pieces`` items, and no bin is given up for that: while
more remain than one task takes, they are dealt anew and merged again.  The rounds end
with a round of one task, or when a round of several merges less than one bin in a
thousand, as its tasks already were large samples of all bins.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm import _text as T
from surveyloom.llm._io import dropped, tidy, written

#: Distinct units that a task remembers between batches.
REMEMBERED = 300_000
#: Bytes of text that are looked at together, and units that pass through the tokenizer together.
ENCODE_BYTES, ENCODE_UNITS = 1 << 20, 4096


def _byte_of_symbol() -> dict[str, int]:
    """The byte that each printable symbol of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class UnitEncoder:
    """Token ids of texts, by distinct units; ids are those of the tokenizer for whole texts.

    A unit of Latin letters alone is one piece of the tokenizer's pattern, so its model gets
    it directly; all other units pass through the whole tokenizer.
    """

    def __init__(self, tokenizer_path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added_texts = added
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.symbols = {b: c for c, b in _byte_of_symbol().items()}
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of the units known, aligned with start and length
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    def learn(self, hashes: np.ndarray, units: list[bytes]) -> None:
        ids: list = []
        rest, texts = [], []
        plain = self.added is None or not any(map(_LETTERS.fullmatch, self.added_texts))
        for i, unit in enumerate(units):
            # a space and ASCII letters, or those alone, are most units
            if plain and unit.isascii() and unit[unit[0] == 32 :].isalpha():
                text = unit.decode()
                ids.append([t.id for t in self.model.tokenize("\u0120" + text[1:] if unit[0] == 32 else text)])
                continue
            text = unit.decode("utf-8", "replace")
            if _LETTERS.fullmatch(text) and not (self.added and self.added.search(text)):
                ids.append([t.id for t in self.model.tokenize("\u0120" + text[1:] if text[0] == " " and text.isascii() else text if text.isascii() else text.encode().decode("latin-1").translate(self.symbols))])
            else:
                ids.append(None)
                rest.append(i)
                texts.append(text)
        for begin in range(0, len(rest), ENCODE_UNITS):
            some = self.tokenizer.encode_batch_fast(texts[begin : begin + ENCODE_UNITS], add_special_tokens=False)
            for i, e in zip(rest[begin : begin + ENCODE_UNITS], some, strict=True):
                ids[i] = e.ids
        length = np.fromiter(map(len, ids), np.int32, len(ids))
        start = len(self.flat) + np.cumsum(length, dtype=np.int64) - length
        self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum())))
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.start, self.length = np.insert(self.keys, at, hashes), np.insert(self.start, at, start), np.insert(self.length, at, length)

    @staticmethod
    def cuts(chunk: T.Chunk) -> np.ndarray:
        """Starts of units: document starts, single spaces with no white space beside them, and marks after letters."""
        d = chunk.data
        inner = np.zeros(len(d), bool)
        if len(d) > 2:
            before, after = d[:-2], d[2:]
            ok = (d[1:-1] == 32) & ~T.IS_SPACE[before] & ~T.IS_SPACE[after]
            # control separators and lead bytes of other white space are left to the tokenizer
            ok &= ~((before >= 28) & (before <= 31)) & ~((after >= 28) & (after <= 31)) & ~np.isin(after, _SPACE_LEADS)
            second, third = np.zeros(len(before), np.uint8), np.zeros(len(before), np.uint8)
            second[1:], third[2:] = d[:-3], d[:-4] if len(d) > 4 else d[:0]
            ok &= ~((before >= 128) & (np.isin(second, _SPACE_LEADS) | np.isin(third, _SPACE_LEADS)))
            inner[1:-1] = ok
            # a mark that ends a word of ASCII letters is a piece of its own
            inner[1:] |= _MARKS[d[1:]] & _ASCII_LETTERS[d[:-1]]
        bounds = chunk.bounds[:-1][np.diff(chunk.bounds) > 0]
        inner[bounds] = True
        return np.flatnonzero(inner)

    def encode(self, chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk, and the bounds of each document's ids."""
        if len(chunk.data) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(chunk) + 1, np.int64)
        starts = self.cuts(chunk)
        ends = np.append(starts[1:], len(chunk.data))
        hashes = T.span_hashes(T.byte_symbols(chunk.data), starts, ends)
        order = np.argsort(hashes)
        ordered = hashes[order]
        head = np.ones(len(order), bool)
        head[1:] = ordered[1:] != ordered[:-1]
        distinct = ordered[head]
        if len(self.keys) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == distinct
        if not known.all():
            blob, example = chunk.data.tobytes(), order[head][~known]
            self.learn(distinct[~known], [blob[a:b] for a, b in zip(starts[example].tolist(), ends[example].tolist(), strict=True)])
            at = np.searchsorted(self.keys, distinct)
        which = np.empty(len(order), np.int64)
        which[order] = at[np.cumsum(head) - 1]
        n = self.length[which].astype(np.int64)
        edge = np.append(0, np.cumsum(n))
        take = np.arange(edge[-1]) + np.repeat(self.start[which] - edge[:-1], n)
        return self.flat[take], edge[np.searchsorted(starts, chunk.bounds)]


#: A space and Latin letters, or letters alone.
_LETTERS = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_ASCII_LETTERS, _MARKS = np.zeros(256, bool), np.zeros(256, bool)
_ASCII_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_MARKS[list(b".,;:!?")] = True
#: Lead bytes of every white space character outside ASCII.
_SPACE_LEADS = np.array([0xC2, 0xE1, 0xE2, 0xE3], np.uint8)
_encoders: dict[str, UnitEncoder] = {}


def unit_encoder(tokenizer_path: str) -> UnitEncoder:
    """This worker's encoder.  A worker outlives its task; what it keeps between tasks is the tokenizer alone."""
    encoder = _encoders.get(tokenizer_path) or _encoders.setdefault(tokenizer_path, UnitEncoder(tokenizer_path))
    encoder.forget()
    return encoder


def _pieces(tokenizer_path: str, end_id: int, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "spread"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = unit_encoder(tokenizer_path)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for chunk in T.chunks(batch.column("text"), ENCODE_BYTES):
                tokens, bounds = encoder.encode(chunk)
                tags = T.span_hashes(T.byte_symbols(chunk.data), chunk.bounds[:-1], chunk.bounds[1:]).view(np.int64)
                out: list[list] = [[], [], [], [], [], []]
                for i in range(len(chunk)):
                    own = np.append(tokens[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                    head = len(own) % capacity or capacity
                    edges = [0, *range(head, len(own) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        for to, x in zip(out, (ids[chunk.first_row + i], k, a, b - a, zlib.crc32(own[a:b].tobytes()), int(tags[i])), strict=True):
                            to.append(x)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names=names)
        encoder.forget()

    return run


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item indices, best-fit in the order of the items given, by free space."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # sorted list of those free spaces that some bin has
    bins: list[list[int]] = []
    for item, size in enumerate(sizes):
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            bins.append([item])
            which, left = len(bins) - 1, capacity - size
        else:
            room = rooms[at]
            which = free[room].pop()
            if not free[room]:
                rooms.pop(at)
            bins[which].append(item)
            left = room - size
        if left:
            if not free[left]:
                bisect.insort(rooms, left)
            free[left].append(which)
    return bins


_BIN = "done boolean, fill int, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>, sequence_id long"
_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _pack(capacity: int, nearly: int, level: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Items (rows with members) of a task -> bins; all of them are done at the last level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [batch for batch in batches if len(batch)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        task = TaskContext.get().partitionId()
        fill = table.column("fill").to_pylist()
        members = table.column("members").combine_chunks()
        at = members.offsets.to_numpy() - members.offsets[0].as_py()
        flat = members.flatten()
        key = list(zip((-x for x in fill), flat.field("doc_id").take(pa.array(at[:-1])).fill_null(-(1 << 63)).to_pylist(), flat.field("piece").take(pa.array(at[:-1])).to_pylist(), flat.field("ids_crc32").take(pa.array(at[:-1])).to_pylist(), strict=True))
        order = sorted(range(len(key)), key=key.__getitem__)
        bins = best_fit([fill[i] for i in order], capacity)
        total = [sum(fill[order[i]] for i in own) for own in bins]
        done = [last or x >= capacity - nearly for x in total]
        for begin in range(0, len(bins), 5000):
            take, size = [], []
            for own in bins[begin : begin + 5000]:
                rows = [np.arange(at[order[i]], at[order[i] + 1]) for i in own]
                take += rows
                size.append(sum(map(len, rows)))
            values = flat.take(pa.array(np.concatenate(take)))
            offsets = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
            n = len(size)
            number = np.arange(begin, begin + n, dtype=np.int64) + (task << 32) + (level << 56)
            yield pa.RecordBatch.from_arrays(
                [pa.array(done[begin : begin + n]), pa.array(total[begin : begin + n], pa.int32()), pa.ListArray.from_arrays(offsets, values.cast(_MEMBER)), pa.array(number)],
                names=["done", "fill", "members", "sequence_id"],
            )

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, task_pieces: int = 50_000, nearly: int = 8) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``capacity`` tokens.

    ``docs`` needs doc_id and text; other columns are ignored.  A document is its ids and
    then ``end_id``; a null or empty text has no ids, so it is ``end_id`` alone, and white
    space is ids like any other.  Only documents over the capacity are cut, into pieces of
    the capacity; the first may be shorter.  Returns one row per piece: doc_id, piece, start,
    length, ids_crc32, sequence_id and offset.  Rows that repeat a doc_id are documents of
    their own, each with pieces from 0; a null doc_id stays null.  An empty table gives an
    empty table.
    """
    spark = docs.sparkSession
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(_pieces(tokenizer_path, end_id, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long, spread long")
    pieces, pieces_at = written(pieces)
    paths = [pieces_at]
    out = pieces.filter(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (F.monotonically_increasing_id() + F.lit(1 << 60)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = pieces.filter(F.col("length") < capacity).select(F.xxhash64("doc_id", "spread", "piece").alias("key"), F.col("length").cast("int").alias("fill"), F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32")).alias("members"))
    n, level, last = pieces.filter(F.col("length") < capacity).count(), 0, False
    while not last:
        tasks = max(1, -(-n // task_pieces))
        last = tasks == 1
        bins, bins_at = written(items.repartition(tasks, "key").mapInArrow(tidy(_pack(capacity, nearly, level, last)), _BIN))
        paths.append(bins_at)
        counts = {r["done"]: r["count"] for r in bins.groupBy("done").count().collect()}
        # the first round puts pieces into bins, later ones bins into bins
        last = last or (level > 0 and n - sum(counts.values()) <= n // 1000)
        placed = (bins if last else bins.filter("done")).select("sequence_id", F.posexplode("members").alias("at", "m"), "members")
        before = F.aggregate(F.slice("members", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda a, x: a + x["length"])
        out = out.union(placed.select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", before.alias("offset")))
        n, level = counts.get(False, 0), level + 1
        # another deal in each round
        items = bins.filter("not done").select(F.xxhash64("sequence_id", F.lit(level)).alias("key"), "fill", "members")
        last = last or n == 0
    out, _ = written(out)
    for path in paths:
        dropped(spark, path)
    return out
