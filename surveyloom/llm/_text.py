"""Vectorised text primitives used inside Spark tasks.

A text column arrives as Arrow batches.  The helpers here look at the UTF-8 bytes of
many documents at once, in chunks of bounded size, so that no Python loop runs per
word or per byte.  Hashes are 64-bit polynomial hashes modulo 2**64 over randomised
symbols, finished by a bit mixer; they depend on nothing but the content.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Windows that are looked at together; a longer document is several stretches.
STRETCH = 1 << 20
_POSITION_MASK = np.uint64((1 << 28) - 1)

#: Space, tab, line feed, vertical tab, form feed, carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: A-Z to a-z; every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1024 if n <= 1024 else -(-n // (1 << 18)) << 18
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                step = np.full(size, base, np.uint64)
                step[0] = 1
                setattr(self, name, np.multiply.accumulate(step))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``symbols[s:e]`` for each pair of bounds."""
    up, down = _powers.get(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k symbols; empty when there are fewer."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers.get(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[:-1], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * down[:n])


@dataclass
class Chunk:
    """Some documents' bytes: document i of the chunk is ``data[bounds[i]:bounds[i + 1]]``."""

    first_row: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """A string column's bytes in chunks of about ``limit``; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield Chunk(row, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row])
        row = end


@dataclass
class Words:
    """Words of a chunk: byte bounds of each, and for document i the words ``first[i]:first[i + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(chunk: Chunk) -> Words:
    """Runs of bytes other than ASCII white space."""
    data, bounds = chunk.data, chunk.bounds
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(bounds), np.int64))
    space = IS_SPACE[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    before[bounds[:-1][bounds[:-1] < len(data)]] = True
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, space[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return Words(starts, ends, np.searchsorted(starts, bounds))


def word_hashes(chunk: Chunk, w: Words, lower: bool = False) -> np.ndarray:
    data = LOWER[chunk.data] if lower else chunk.data
    return span_hashes(_BYTE_SYMBOL[data], w.starts, w.ends)


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _BYTE_SYMBOL[data]


def window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by doubling."""
    done, out = 1, x
    while done < w:
        step = min(done, w - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


@dataclass
class Anchors:
    """Runs of windows that agree on their anchor.

    All windows ``first_window .. first_window + n_windows - 1`` (of ``length`` symbols
    each) have ``anchor`` as the first of their smallest k-grams.  Equal windows, wherever
    they stand, have their anchor at the same place, so equal windows always meet under
    equal ``gram`` values.  ``segment`` is a hash of all symbols these windows cover and of
    the anchor's place in them.
    """

    doc: np.ndarray
    anchor: np.ndarray
    first_window: np.ndarray
    n_windows: np.ndarray
    gram: np.ndarray
    segment: np.ndarray


class Common:
    """A set of grams, asked for many grams at once."""

    def __init__(self, grams: np.ndarray) -> None:
        self.grams = np.sort(grams.astype(np.uint64))
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.grams & np.uint64(0xFFFF)).astype(np.int64)] = True

    def among(self, grams: np.ndarray) -> np.ndarray:
        out = self.seen[(grams & np.uint64(0xFFFF)).astype(np.int64)]
        may = np.flatnonzero(out)
        if len(may):
            at = np.minimum(np.searchsorted(self.grams, grams[may]), len(self.grams) - 1)
            out[may] = self.grams[at] == grams[may]
        return out


def anchors(raw: np.ndarray, hashable, first: np.ndarray, length: int, k: int, common: Common | None = None) -> Anchors:
    """Winnowed anchors of every window of ``length`` symbols inside one document.

    ``first`` has the documents' bounds in ``raw``, ``hashable`` turns symbols into uint64
    values.  Positions in the result count from the document's start.  Grams in ``common``
    are chosen only where a window has no other, which spreads windows beside a common
    line over their own surroundings.  A long document is worked on in stretches; a run that
    a stretch cuts is two runs.
    """
    if len(raw) <= STRETCH + length:
        return _stretch(hashable(raw), first, length, k, common)
    parts = []
    for doc, (begin, end) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        for at in range(begin, end - length + 1, STRETCH):
            symbols = hashable(raw[at : min(at + STRETCH + length - 1, end)])
            part = _stretch(symbols, np.array([0, len(symbols)]), length, k, common)
            parts.append(Anchors(part.doc + doc, part.anchor + at - begin, part.first_window + at - begin, part.n_windows, part.gram, part.segment))
    return Anchors(*(np.concatenate([getattr(x, name) for x in parts]) for name in ("doc", "anchor", "first_window", "n_windows", "gram", "segment"))) if parts else _stretch(hashable(raw[:0]), first[:1] * 0, length, k, common)


def _stretch(symbols: np.ndarray, first: np.ndarray, length: int, k: int, common: Common | None) -> Anchors:
    none = np.zeros(0, np.int64)
    empty = Anchors(none, none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    w = length - k + 1
    grams = gram_hashes(symbols, k)
    if len(grams) < w:
        return empty
    keys = ((grams >> np.uint64(1)) & ~_POSITION_MASK) | np.arange(len(grams), dtype=np.uint64)
    if common is not None:
        keys |= common.among(grams).astype(np.uint64) << np.uint64(63)
    chosen = (window_minimum(keys, w) & _POSITION_MASK).astype(np.int64)
    sizes = np.diff(first)
    n_windows = np.maximum(sizes - length + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), n_windows)
    if len(doc) == 0:
        return empty
    window = np.arange(len(doc)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + first[doc]
    chosen = chosen[window]
    new = np.empty(len(doc), bool)
    new[0] = True
    new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
    run = np.flatnonzero(new)
    count = np.diff(np.append(run, len(doc)))
    doc, begin, anchor = doc[run], window[run], chosen[run]
    cover = span_hashes(symbols, begin, begin + count - 1 + length)
    place = ((anchor - begin) * (1 << 20) + count).astype(np.uint64)
    return Anchors(doc, anchor - first[doc], begin - first[doc], count, grams[anchor], mix(cover ^ mix(place)))
