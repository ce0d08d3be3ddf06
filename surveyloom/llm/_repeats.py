"""Windows that also start earlier: the common frame of substring and suffix-array dedup.

A document is a sequence of symbols (words or bytes).  A window of ``length`` symbols is
repeated when an equal window starts earlier, in document order (smaller doc_id, then
smaller tag, then smaller position).  No pairs are ever emitted:

1. ``occurrences``: every window names an anchor, the first of its smallest k-grams;
   neighbouring windows mostly share it, so a run of windows becomes one row (gram of the
   anchor, hash of the run's symbols, place).  Grams that a sample shows to be common are
   anchors only where a window has no other, so a common line in varied surroundings does
   not gather its windows under one gram.  Runs that repeat inside one Arrow batch leave at
   once under a spread key, so a group of copies is thinned before the shuffle.
2. one shuffle by gram.  Runs with equal hashes agree in all symbols that they cover and in
   the anchor's place, so they are one class of occurrences: an extension of the anchor
   runs to both ends of the run.  The first of a class stands for it, the others are
   repeats of it.  A gram with several classes needs a look at the symbols; all other runs
   are unique.
3. runs of the second kind fetch their symbols from the document and are dealt by gram to
   ``resolve``, which the two operators bring along: it gives the length of each window's
   earlier match.  Grams with very many runs are dealt window by window instead, by two
   hashes of the window's symbols: the first copy of each chunk of texts travels, the least
   of them stays, and every other window is a repeat.  These rows stream, so no gram and no
   window has to fit into one task.
4. spans return to their documents.

Rows with a null doc_id take no part and are kept whole.  Rows that repeat a doc_id with
the same text are one document (each row gets its result); with different texts they are
documents of their own, told apart and ordered by a 64-bit hash of the text (``tag``, which
is 0 throughout where no doc_id repeats).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm._io import tidy
from surveyloom.llm import _text as T

#: A run's place is one number: first window (46 bits), number of windows (16), and whether
#: it is a certain repeat (1).  Places sort in document order.
_FIRST, _COUNT_MASK = 17, (1 << 16) - 1
#: Symbols that ``resolve`` gets at once, unless one bucket (of at most ``SPLIT_ABOVE`` runs) has more.
_RESOLVE_SYMBOLS = 1 << 18
#: A gram with more runs than this is dealt window by window.
SPLIT_ABOVE = 5_000
#: Documents in the sample that shows common grams, the share of them that makes a gram
#: common, and how many grams count as common.  No result depends on which these are.
SAMPLE, COMMON_SHARE, COMMON = 4_000, 0.005, 8_192


@dataclass(frozen=True)
class Alphabet:
    """What a symbol is: ``symbols(chunk)`` gives symbols and documents' bounds, ``hashable`` their uint64 values."""

    length: int
    gram: int
    symbols: Callable[[T.Chunk], tuple[np.ndarray, np.ndarray]]
    hashable: Callable[[np.ndarray], np.ndarray]
    dtype: type


def packed(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (first << _FIRST) | (count << 1)


def first_of(place: np.ndarray) -> np.ndarray:
    return place >> _FIRST


def count_of(place: np.ndarray) -> np.ndarray:
    return (place >> 1) & _COUNT_MASK


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _gram_counts(alphabet: Alphabet) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Grams that several documents of a task have, with the number of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for chunk in T.chunks(batch.column("text")):
                raw, first = alphabet.symbols(chunk)
                found += [np.unique(T.gram_hashes(alphabet.hashable(raw[a:b]), alphabet.gram)) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        if found:
            grams, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(grams[n > 1])), pa.array(n[n > 1])], names=["gram", "n"])

    return run


def common_grams(texts: DataFrame, alphabet: Alphabet) -> T.Common | None:
    """The most common grams of a bounded sample of documents, for a better spread only."""
    rows = texts.select("doc_id").count()
    some = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, rows // SAMPLE))) == 0).select("text").repartition(8)
    counts = some.mapInArrow(tidy(_gram_counts(alphabet)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = counts.filter(F.col("n") > max(8, int(min(rows, SAMPLE) * COMMON_SHARE))).orderBy(F.col("n").desc(), "gram").limit(COMMON).toArrow()
    return T.Common(found.column("gram").to_numpy().view(np.uint64)) if len(found) else None


def _occurrences(alphabet: Alphabet, common: T.Common | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "tag"))
            parts = []
            for chunk in T.chunks(batch.column("text")):
                raw, first = alphabet.symbols(chunk)
                found = T.anchors(raw, alphabet.hashable, first, alphabet.length, alphabet.gram, common)
                if len(found.doc):
                    row = chunk.first_row + found.doc
                    parts.append((found.gram, found.segment, ids[row], tags[row], packed(found.first_window, found.n_windows)))
            if not parts:
                continue
            gram, segment, doc, tag, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((place, tag, doc, segment, gram))
            gram, segment, doc, tag, place = gram[order], segment[order], doc[order], tag[order], place[order]
            same = np.zeros(len(gram), bool)
            same[1:] = (gram[1:] == gram[:-1]) & (segment[1:] == segment[:-1])
            # the very same place again is a repeated row, not a repeat
            start = np.maximum.accumulate(np.where(same, 0, np.arange(len(gram))))
            copy = same & ((doc != doc[start]) | (tag != tag[start]) | (place != place[start]))
            gram = np.where(copy, T.mix((doc ^ tag).astype(np.uint64) ^ place.astype(np.uint64)), gram)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(gram)), pa.array(_signed(segment)), pa.array(doc.astype(np.int64)), pa.array(tag.astype(np.int64)), pa.array(place | copy)],
                names=["gram", "segment", "doc_id", "tag", "place"],
            )

    return run


_OCCURRENCE = "gram long, segment long, doc_id long, tag long, place long"


def _classified(found: DataFrame) -> DataFrame:
    """Repeats inside a class, and runs whose gram has several classes; unique runs go."""
    by_gram = Window.partitionBy("gram", "certain")
    same = Window.partitionBy("gram", "certain", "segment").orderBy("doc_id", "tag", "place")
    whole = by_gram.orderBy("segment", "doc_id", "tag", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.struct("doc_id", "tag", "place")
    rows = (
        found.repartition("gram")
        .withColumn("certain", F.col("place").bitwiseAND(1) == 1)
        .withColumn("head", F.first(here).over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("least", F.first("segment").over(whole))
        .withColumn("most", F.last("segment").over(whole))
        .withColumn("group_rows", F.count(F.lit(1)).over(whole))
        .withColumn("copy", F.col("certain") | (F.col("head") != here))
        .filter(F.col("copy") | (F.col("least") != F.col("most")))
    )
    # a certain repeat needs no look at its symbols, so its gram ends here
    return rows.select("doc_id", "tag", "place", F.when(~F.col("copy"), F.col("gram")).alias("gram"), (F.col("group_rows") > SPLIT_ABOVE).alias("wide"))


def _joined(piece: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and length of each stretch of neighbouring windows of one piece."""
    new = np.ones(len(piece), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (first[1:] != first[:-1] + 1)
    run = np.flatnonzero(new)
    return run, np.diff(np.append(run, len(piece)))


_CUT = "bucket long, doc_id long, tag long, place long, symbols binary, check long"
_CUT_NAMES = ["bucket", "doc_id", "tag", "place", "symbols", "check"]


def _by_window(alphabet: Alphabet, raw: np.ndarray, runs: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
    """Runs (start in ``raw``, doc_id, tag, first, count) -> first copies of their windows, other copies as spans."""
    start, doc, tag, first, count = (np.array(x, np.int64) for x in zip(*runs, strict=True))
    # only what the runs cover is hashed
    cover = count + alphabet.length - 1
    edge = np.cumsum(cover) - cover
    symbols = alphabet.hashable(raw[np.repeat(start - edge, cover) + np.arange(cover.sum())])
    run = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    start, first, doc, tag = edge[run] + inside, first[run] + inside, doc[run], tag[run]
    key = T.span_hashes(symbols, start, start + alphabet.length)
    check = T.span_hashes(T.mix(symbols ^ np.uint64(0xA5A5A5A5A5A5A5A5)), start, start + alphabet.length)
    place = packed(first, np.ones(len(run), np.int64))
    order = np.lexsort((place, tag, doc, check, key))
    head = np.ones(len(order), bool)
    head[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    copy = np.zeros(len(order), bool)
    # the very same place again is a repeated row, not a repeat
    copy[order] = (doc[lead] != doc[order]) | (tag[lead] != tag[order]) | (place[lead] != place[order])
    gone, head = np.flatnonzero(copy), order[head]
    at, n = _joined(run[gone], first[gone])
    gone = gone[at]
    rows = len(gone) + len(head)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate((doc[gone], _signed(key[head])))),
            pa.array(np.concatenate((doc[gone], doc[head]))),
            pa.array(np.concatenate((tag[gone], tag[head]))),
            pa.array(np.concatenate((packed(first[gone], n), place[head]))),
            pa.nulls(rows, pa.binary()),
            pa.array(np.concatenate((np.zeros(len(gone), np.int64), _signed(check[head]))), mask=np.arange(rows) < len(gone)),
        ],
        names=_CUT_NAMES,
    )


def _cut(alphabet: Alphabet) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of documents with their runs -> certain spans, pieces of symbols to resolve, and windows of wide grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs")
            has = np.flatnonzero(np.diff(runs.offsets.to_numpy()) > 0) if runs.null_count < len(runs) else []
            if len(has) == 0:
                continue
            batch = batch.take(pa.array(has))
            ids, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "tag"))
            runs = batch.column("runs")
            at = runs.offsets.to_numpy()
            flat = runs.flatten()
            place, wide = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("place", "wide"))
            copy, gram = flat.field("gram").is_null().to_numpy(zero_copy_only=False), flat.field("gram").fill_null(0).to_numpy()
            for chunk in T.chunks(batch.column("text")):
                raw, first = alphabet.symbols(chunk)
                out: list[list] = [[], [], [], [], []]
                by_window: list[tuple[int, int, int, int, int]] = []
                for i in range(len(chunk)):
                    row = chunk.first_row + i
                    base, doc, tag = int(first[i]), int(ids[row]), int(tags[row])
                    for j in range(at[row] - at[0], at[row + 1] - at[0]):
                        begin, count = int(first_of(place[j])), int(count_of(place[j]))
                        if wide[j] and not copy[j]:
                            by_window.append((base + begin, doc, tag, begin, count))
                            continue
                        symbols = None if copy[j] else raw[base + begin : base + begin + count + alphabet.length - 1].tobytes()
                        for to, x in zip(out, (doc if copy[j] else int(gram[j]), doc, tag, packed(begin, count), symbols), strict=True):
                            to.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.binary()), pa.nulls(len(out[0]), pa.int64())], names=_CUT_NAMES)
                if by_window:
                    yield _by_window(alphabet, raw, by_window)

    return run


@dataclass
class Pieces:
    """What ``resolve`` gets: pieces of symbols in document order within each bucket."""

    bucket: np.ndarray
    doc: np.ndarray
    tag: np.ndarray
    first: np.ndarray
    count: np.ndarray
    symbols: np.ndarray
    bounds: np.ndarray

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Piece of each window, and where it starts in ``symbols``."""
        piece = np.repeat(np.arange(len(self.count)), self.count)
        inside = np.arange(len(piece)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        return piece, self.bounds[:-1][piece] + inside

    def positions(self) -> np.ndarray:
        """Numbers that sort windows in document order; equal ones are the very same place."""
        piece, start = self.windows()
        order = np.lexsort((self.tag, self.doc))
        new = np.ones(len(order), bool)
        new[1:] = (self.doc[order][1:] != self.doc[order][:-1]) | (self.tag[order][1:] != self.tag[order][:-1])
        document = np.empty(len(order), np.int64)
        document[order] = np.cumsum(new) - 1
        return (document[piece] << 46) | (self.first[piece] + start - self.bounds[:-1][piece])


def _resolved(alphabet: Alphabet, resolve: Callable[[Pieces], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches sorted by bucket -> spans of repeated windows; ``resolve`` gives lengths of earlier matches, hashed windows repeat their first."""
    size = np.dtype(alphabet.dtype).itemsize
    names = ["doc_id", "tag", "place"]

    def spans(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        bucket, doc, tag, place = (table.column(k).to_numpy() for k in ("bucket", "doc_id", "tag", "place"))
        symbols = np.frombuffer(b"".join(table.column("symbols").to_pylist()), alphabet.dtype)
        count = count_of(place)
        p = Pieces(bucket, doc, tag, first_of(place), count, symbols, np.append(0, np.cumsum(count + alphabet.length - 1)))
        matched = resolve(p)
        piece, start = p.windows()
        # a match of m symbols repeats m - length + 1 windows
        at = np.flatnonzero(matched >= alphabet.length)
        change = np.zeros(len(piece) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + matched[at] - alphabet.length + 1, -1)
        marked = np.cumsum(change[:-1]) > 0
        first = p.first[piece] + start - p.bounds[:-1][piece]
        piece, first = piece[marked], first[marked]
        run, n = _joined(piece, first)
        return pa.RecordBatch.from_arrays([pa.array(doc[piece[run]]), pa.array(tag[piece[run]]), pa.array(packed(first[run], n))], names=names)

    def later(hashed: pa.RecordBatch, least: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
        """Windows that are not the first of their hashes, and the last first one (``least`` is the one before)."""
        x = np.concatenate((least, np.stack([hashed.column(k).to_numpy() for k in ("bucket", "check", "doc_id", "tag", "place")])), axis=1)
        head = np.ones(x.shape[1], bool)
        head[1:] = (x[:2, 1:] != x[:2, :-1]).any(axis=0)
        lead = np.maximum.accumulate(np.where(head, np.arange(x.shape[1]), 0))
        copy = (x[2:, lead] != x[2:]).any(axis=0)[least.shape[1] :]
        return hashed.filter(pa.array(copy)).select(names), x[:, lead[-1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        nbytes = 0
        least = np.zeros((5, 0), np.int64)
        for batch in batches:
            hashed = batch.column("check").is_valid()
            if hashed.true_count:
                repeated, least = later(batch.filter(hashed), least)
                yield repeated
                batch = batch.filter(pc.invert(hashed))
            plain = batch.column("symbols").is_null()
            if plain.true_count:
                yield batch.filter(plain).select(names)
                batch = batch.filter(batch.column("symbols").is_valid())
            if len(batch) == 0:
                continue
            bucket = batch.column("bucket").to_numpy()
            grown = pc.binary_length(batch.column("symbols")).to_numpy()
            begin = 0
            for change in [*(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), None]:
                full = nbytes + int(grown[begin:change].sum()) >= _RESOLVE_SYMBOLS * size
                if change is None or full:
                    held.append(batch.slice(begin, (len(batch) if change is None else change) - begin))
                    nbytes += int(grown[begin:change].sum())
                    begin = change
                if change is not None and full:
                    yield spans(held)
                    held, nbytes = [], 0
        if held:
            yield spans(held)

    return run


@dataclass
class Documents:
    """Texts with the key that tells documents apart, dealt by it in one exchange that Spark reuses."""

    rows: DataFrame
    keys: list[str]
    carry: tuple[str, ...]

    def keyed(self) -> DataFrame:
        return self.rows.filter("doc_id is not null").repartition(*self.keys)


def documents(docs: DataFrame, carry: tuple[str, ...] = ()) -> Documents:
    """doc_id, text, tag and the columns carried along; whether any doc_id repeats is looked up at once."""
    repeated = docs.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long")).count().filter("count > 1").limit(1).count() > 0
    text = F.col("text").cast("string")
    tag = F.xxhash64(text) if repeated else F.lit(0).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), tag.alias("tag"), *(f"`{c}`" for c in carry))
    return Documents(rows, ["doc_id", "tag"] if repeated else ["doc_id"], carry)


def repeated_spans(docs: Documents, alphabet: Alphabet, resolve: Callable[[Pieces], np.ndarray]) -> DataFrame:
    """Per document the places of repeated windows."""
    texts = docs.rows.filter("doc_id is not null")
    found = texts.select("doc_id", "text", "tag").mapInArrow(tidy(_occurrences(alphabet, common_grams(texts, alphabet))), _OCCURRENCE)
    runs = _classified(found).groupBy(*docs.keys).agg(F.collect_list(F.struct("place", "gram", "wide")).alias("runs"))
    pieces = docs.keyed().join(runs, docs.keys, "left").mapInArrow(tidy(_cut(alphabet)), _CUT)
    return (
        pieces.repartition("bucket")
        .sortWithinPartitions("bucket", "check", "doc_id", "tag", "place")
        .mapInArrow(tidy(_resolved(alphabet, resolve)), "doc_id long, tag long, place long")
        .groupBy(*docs.keys)
        .agg(F.collect_list("place").alias("spans"))
    )


def covered(n: int, places: np.ndarray, length: int) -> np.ndarray:
    """Which of n symbols some repeated window covers."""
    change = np.zeros(n + 1, np.int64)
    first, count = first_of(places), count_of(places)
    np.add.at(change, first, 1)
    np.add.at(change, first + count + length - 1, -1)
    return np.cumsum(change[:-1]) > 0


def own_places(batch: pa.RecordBatch) -> Callable[[int], np.ndarray]:
    """Row -> places of the repeated windows of that row."""
    spans = batch.column("spans")
    if spans.null_count == len(spans):
        return lambda row: np.zeros(0, np.int64)
    at, places = spans.offsets.to_numpy(), spans.flatten().to_numpy()
    at = at - at[0]
    return lambda row: places[at[row] : at[row + 1]]


def rewritten(docs: Documents, spans: DataFrame, rewrite: Callable, schema: str) -> DataFrame:
    """Documents joined to their spans and rewritten; rows without doc_id have none."""
    kinds = dict(docs.rows.dtypes)
    schema = ", ".join([schema, *(f"`{c}` {kinds[c]}" for c in docs.carry)])
    joined = docs.keyed().join(spans, docs.keys, "left")
    empty = F.lit(None).cast(joined.schema["spans"].dataType).alias("spans")
    rest = docs.rows.filter("doc_id is null").withColumn("spans", empty)
    return joined.mapInArrow(tidy(rewrite), schema).union(rest.mapInArrow(tidy(rewrite), schema))


def carried(batch: pa.RecordBatch, chunk: T.Chunk, carry: tuple[str, ...]) -> list[pa.Array]:
    return [batch.column(c).slice(chunk.first_row, len(chunk)) for c in carry]
