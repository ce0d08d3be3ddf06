"""Suffix-array dedup: remove byte strings that already occurred, by longest previous factors.

Sorting all suffixes of a corpus in one place is out of the question, and not needed:
only suffixes that agree on ``threshold`` bytes can matter to one another, and these share
their anchor (see ``_repeats``).  So suffixes are dealt by anchor, and runs of suffixes
that are equal byte for byte are one class, of which the first goes on: it is the previous
smaller position of all others.  Each task then sorts its suffixes by prefix doubling.  In
that suffix order, the nearest neighbours on either side with a smaller text position
(previous and next smaller values) have the longest earlier matches; the longer common
prefix of the two is the longest previous factor.  Where it reaches the threshold, all
bytes of the factor are a later copy and go; the first copy stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from surveyloom.llm import _repeats as R
from surveyloom.llm import _text as T

#: Bytes of an anchor.
ANCHOR_BYTES = 24


def _alphabet(threshold: int) -> R.Alphabet:
    return R.Alphabet(threshold, min(ANCHOR_BYTES, threshold), lambda c: (c.data, c.bounds), T.byte_symbols, np.uint8)


def _dense(x: np.ndarray) -> np.ndarray:
    """Rank of each value among the distinct ones."""
    order = np.argsort(x)
    ordered = x[order]
    step = np.zeros(len(x), np.int64)
    step[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(x), np.int64)
    rank[order] = np.cumsum(step)
    return rank


class Suffixes:
    """Suffixes of several texts that stand one after another; a suffix ends with its text."""

    def __init__(self, text: np.ndarray, bounds: np.ndarray) -> None:
        """``text`` are bytes, text i is ``text[bounds[i]:bounds[i + 1]]``."""
        self.left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(text))
        padded = np.concatenate((text, np.zeros(8, np.uint8)))
        self.words = np.zeros(len(text), np.uint64)
        for i in range(8):
            byte = np.where(self.left > i, padded[i : i + len(text)], 0).astype(np.uint64)
            self.words = (self.words << np.uint64(8)) | byte
        #: (n, rank of each suffix by its first n bytes), n doubling up to the longest text
        self.levels = [(8, _dense(self.words))]
        longest = int(self.left.max()) if len(text) else 0
        while self.levels[-1][0] < longest:
            known, rank = self.levels[-1]
            after = np.zeros(len(rank), np.int64)
            inside = np.flatnonzero(self.left > known)
            after[inside] = rank[inside + known] + 1
            self.levels.append((2 * known, _dense(rank * (int(rank.max()) + 2) + after)))

    @property
    def rank(self) -> np.ndarray:
        return self.levels[-1][1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of each pair of suffixes, from the levels of the sort."""
        most = np.minimum(self.left[a], self.left[b])
        out = np.zeros(len(a), np.int64)
        for known, rank in reversed(self.levels):
            open_ = np.flatnonzero(out < most)
            same = rank[a[open_] + out[open_]] == rank[b[open_] + out[open_]]
            out[open_[same]] += known
        open_ = np.flatnonzero(out < most)
        differ = self.words[a[open_] + out[open_]] ^ self.words[b[open_] + out[open_]]
        alike = np.ones(len(open_), bool)
        for i in range(8):
            alike &= (differ >> np.uint64(56 - 8 * i)) & np.uint64(255) == 0
            out[open_] += alike
        return np.minimum(out, most)


def previous_smaller(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Nearest index to the left with a smaller value and the same group, else -1.

    All candidates jump at once: what lies between a candidate and its own candidate is no
    smaller than it, so jumping there never passes a smaller value.  A candidate of another
    group ends the search: matches beyond it are too short.
    """
    jump = np.arange(-1, len(x) - 1)
    open_ = np.flatnonzero(jump >= 0)
    while True:
        other = group[jump[open_]] != group[open_]
        jump[open_[other]] = -1
        open_ = open_[~other]
        open_ = open_[x[jump[open_]] >= x[open_]]
        if not len(open_):
            return jump
        jump[open_] = jump[jump[open_]]
        open_ = open_[jump[open_] >= 0]


def longest_previous(suffixes: Suffixes, starts: np.ndarray, position: np.ndarray, threshold: int) -> np.ndarray:
    """Longest previous factor of the suffixes at ``starts``, where it reaches ``threshold``; else 0.

    ``position`` has the order of the suffixes in the corpus; equal numbers are the same
    place and no earlier match of one another.
    """
    order = np.lexsort((position, suffixes.rank[starts]))
    at, where = starts[order], position[order]
    # suffixes that agree on the threshold stand together
    new = np.zeros(len(order), bool)
    new[1:] = suffixes.common(at[1:], at[:-1]) < threshold
    group = np.cumsum(new)
    factor = np.zeros(len(order), np.int64)
    for previous in (previous_smaller(where, group), len(at) - 1 - previous_smaller(where[::-1], group[::-1])[::-1]):
        found = np.flatnonzero((previous >= 0) & (previous < len(at)))
        factor[found] = np.maximum(factor[found], suffixes.common(at[found], at[previous[found]]))
    out = np.zeros(len(order), np.int64)
    out[order] = np.where(factor >= threshold, factor, 0)
    return out


def _resolve(threshold: int):
    def resolve(p: R.Pieces) -> np.ndarray:
        return longest_previous(Suffixes(p.symbols, p.bounds), p.windows()[1], p.positions(), threshold)

    return resolve


def _rewrite(threshold: int, carry: tuple[str, ...], as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places = batch.column("doc_id"), R.own_places(batch)
            absent = batch.column("text").is_null().to_pylist()
            for chunk in T.chunks(batch.column("text")):
                at = chunk.bounds.tolist()
                n_removed, spans, kept = [], [], []
                for i in range(len(chunk)):
                    data, own = chunk.data[at[i] : at[i + 1]], places(chunk.first_row + i)
                    found: list[dict] = []
                    if len(own):
                        gone = R.covered(len(data), own, threshold)
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                        found = [{"first": a, "bytes": b - a} for a, b in edge.reshape(-1, 2).tolist()]
                        data = data[~gone]
                    n_removed.append(at[i + 1] - at[i] - len(data))
                    spans.append(found)
                    kept.append(data.tobytes())
                    if as_text:
                        kept[-1] = None if absent[chunk.first_row + i] else kept[-1].decode("utf-8", "ignore")
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(chunk.first_row, len(chunk)), pa.array(np.diff(chunk.bounds)), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("bytes", pa.int64())]))), pa.array(kept, pa.string() if as_text else pa.binary()), *R.carried(batch, chunk, carry)],
                    names=["doc_id", "n_bytes", "n_removed", "spans", "kept", *carry],
                )

    return run


def suffix_dedup(docs: DataFrame, threshold: int = 100, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """Remove every byte that a repeated string of ``threshold`` bytes covers.

    ``docs`` needs doc_id and text; of other columns only those in ``carry`` are returned.
    Texts are their UTF-8 bytes; a null text is empty.  Returns one row per input row:
    doc_id, n_bytes, n_removed, spans (maximal removed runs as first byte and length) and
    kept (remaining bytes; a cut may fall inside a character).  With ``as_text``, kept is a
    string without the remains of cut characters, and null where the text is.  Texts
    shorter than the threshold lose nothing.  See ``_repeats`` for null and repeated
    doc_ids.  An empty table gives an empty table.
    """
    dealt = R.documents(docs, carry)
    spans = R.repeated_spans(dealt, _alphabet(threshold), _resolve(threshold))
    schema = f"doc_id long, n_bytes long, n_removed long, spans array<struct<first:long,bytes:long>>, kept {'string' if as_text else 'binary'}"
    return R.rewritten(dealt, spans, _rewrite(threshold, carry, as_text), schema)
