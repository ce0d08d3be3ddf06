"""Substring dedup: remove words of passages that already occurred, by seed and extend.

Seeds are winnowed anchors (runs of eight words): whatever repeats over the threshold of
words contains one.  Occurrences of a seed meet by its hash (see ``_repeats``; occurrences
with the same surroundings are one class there).  A seed is extended word by word, to the
left and to the right: after each word, occurrences that still agree share a number.  A
window with r words left of its seed repeats the earliest occurrence that agrees with it
over r words to the left and over the rest to the right.  That pair's match then runs as
far as both sides agree: a maximal repeat.  Those of at least the threshold are removed;
the first occurrence stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from surveyloom.llm import _repeats as R
from surveyloom.llm import _text as T

#: Words of a seed.
SEED_WORDS = 8


def _symbols(chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
    w = T.words(chunk)
    return T.word_hashes(chunk, w), w.first


def _alphabet(threshold: int) -> R.Alphabet:
    return R.Alphabet(threshold, min(SEED_WORDS, threshold), _symbols, lambda x: x, np.uint64)


def seed_extensions(symbols: np.ndarray, bounds: np.ndarray, seed_at: np.ndarray, group: np.ndarray, words: int, most: int, step: int) -> np.ndarray:
    """Row t: numbers that agree for occurrences whose seeds agree with t more words; -1 beyond a piece.

    ``seed_at`` has the seeds' first words, ``group`` equal numbers for equal seeds.  ``step``
    is 1 for words to the right of the seed and -1 for words to its left.
    """
    rank = np.unique(symbols, return_inverse=True)[1]
    span = int(rank.max()) + 2 if len(rank) else 1
    out = np.full((most + 1, len(seed_at)), -1)
    out[0] = group
    for t in range(1, most + 1):
        at = seed_at + words - 1 + t if step > 0 else seed_at - t
        inside = np.flatnonzero((out[t - 1] >= 0) & (at < bounds[1:]) & (at >= bounds[:-1]))
        out[t, inside] = np.unique(out[t - 1, inside] * span + rank[at[inside]], return_inverse=True)[1]
    return out


def _extend(threshold: int):
    words = min(SEED_WORDS, threshold)
    most = threshold - words

    def resolve(p: R.Pieces) -> np.ndarray:
        """Length of the maximal repeat from each window on, 0 where it does not repeat."""
        owner = np.repeat(np.arange(len(p.count)), np.diff(p.bounds))
        grams = T.gram_hashes(p.symbols, words)
        at = np.flatnonzero(grams == p.bucket.view(np.uint64)[owner[: len(grams)]])
        at = at[at + words <= p.bounds[1:][owner[at]]]
        have, head = np.unique(owner[at], return_index=True)
        if len(have) != len(p.count):
            raise ValueError("a piece without its seed")
        seed_at = at[head]
        group = np.unique(p.bucket, return_inverse=True)[1]
        left, right = (seed_extensions(p.symbols, p.bounds, seed_at, group, words, most, step) for step in (-1, 1))
        piece, start = p.windows()
        reach = seed_at[piece] - start
        agree = left[reach, piece], right[most - reach, piece], reach
        position = p.positions()
        order = np.lexsort((position, *agree))
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in agree], axis=0)
        first = np.empty(len(order), np.int64)
        first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        again = np.flatnonzero(position[first] != position)
        # the pair's match runs on to the right while both agree; to the left, earlier windows tell
        mine, other = piece[again], piece[first[again]]
        on = ((right[1:, mine] == right[1:, other]) & (right[1:, mine] >= 0)).sum(0)
        matched = np.zeros(len(piece), np.int64)
        matched[again] = reach[again] + words + on
        return matched

    return resolve


def _rewrite(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places = batch.column("doc_id"), R.own_places(batch)
            for chunk in T.chunks(batch.column("text")):
                blob, at = chunk.data.tobytes(), chunk.bounds.tolist()
                n_words, n_removed, spans, kept = [], [], [], []
                for i in range(len(chunk)):
                    words, own = blob[at[i] : at[i + 1]].split(), places(chunk.first_row + i)
                    n_words.append(len(words))
                    found: list[dict] = []
                    if len(own):
                        gone = R.covered(len(words), own, threshold)
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                        found = [{"first": a, "words": b - a} for a, b in edge.reshape(-1, 2).tolist()]
                        words = [words[j] for j in np.flatnonzero(~gone).tolist()]
                    n_removed.append(n_words[-1] - len(words))
                    spans.append(found)
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(chunk.first_row, len(chunk)), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "spans", "kept_text"],
                )

    return run


def substring_dedup(docs: DataFrame, threshold: int = 20) -> DataFrame:
    """Remove every word that a repeated window of ``threshold`` words covers.

    ``docs`` needs doc_id and text; other columns are ignored.  Returns one row per input
    row: doc_id, n_words, n_removed, spans (maximal repeats as first word and length) and
    kept_text (kept words joined by one space).  A null or blank text has no words and an
    empty kept_text.  Documents of fewer words than the threshold lose nothing.  See
    ``_repeats`` for null and repeated doc_ids.  An empty table gives an empty table.
    """
    dealt = R.documents(docs)
    spans = R.repeated_spans(dealt, _alphabet(threshold), _extend(threshold))
    return R.rewritten(dealt, spans, _rewrite(threshold), "doc_id long, n_words long, n_removed long, spans array<struct<first:long,words:long>>, kept_text string")
