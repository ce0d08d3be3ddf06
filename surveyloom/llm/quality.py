"""Quality classifier: a generalised additive model with pairwise interactions.

Features are statistics of the text.  Training cycles over the features; each turn fits a
shallow tree to the gradients summed by bin and adds it to that feature's lookup table.
Then the pairs that explain most of the remaining gradient get two-dimensional tables in
the same way.  A score is a sum of table entries: bins are looked up and added for whole
batches.  Texts of any length are read whole; nothing but the text enters a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm._io import tidy
from surveyloom.llm import _text as T
from surveyloom.llm._labels import labelled_sample, labelled_texts, remainder

#: Bound on the labelled rows that training uses.
TRAINING_ROWS = 20_000

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\n\v\f\r",
    "stop": b".,;:?'\"-()",
    "shout": b"!",
    "bar": b"|",
    "markup": b"<>{}[]=/\\_",
    "symbol": b"#$%&*+@^~`",
}
_CLASS_OF = np.full(256, len(_CLASSES), np.uint8)
for _i, _members in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_members)] = _i
FEATURES = [
    "log_bytes", "log_words", "word_bytes", *_CLASSES, "other", "distinct_words", "top_word", "short_words", "long_words", "marked_words",
    "log_lines", "repeated_lines", "words_a_line", "capital_lines",
]


def _distinct(group: np.ndarray, value: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """By group: number of distinct values, and count of the most frequent one."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(g)))
    most = np.zeros(groups)
    np.maximum.at(most, g[at], run)
    return np.bincount(g[at], minlength=groups), most


def features(chunk: T.Chunk) -> np.ndarray:
    """A row of statistics for each document; zeros for an empty text."""
    m, data, bounds = len(chunk), chunk.data, chunk.bounds
    size = np.diff(bounds).astype(float)
    out = np.zeros((m, len(FEATURES)))
    if len(data) == 0:
        return out
    col = {name: i for i, name in enumerate(FEATURES)}
    doc = np.repeat(np.arange(m, dtype=np.int64), np.diff(bounds))
    kinds = len(_CLASSES) + 1
    counts = np.bincount(doc * kinds + _CLASS_OF[data], minlength=m * kinds).reshape(m, kinds)
    out[:, col["lower"] : col["lower"] + kinds] = counts / np.maximum(size, 1)[:, None]
    out[:, 0] = np.log1p(size)
    w = T.words(chunk)
    n = w.counts().astype(float)
    some = np.maximum(n, 1)
    owner = np.repeat(np.arange(m), w.counts())
    length = w.ends - w.starts
    out[:, col["log_words"]] = np.log1p(n)
    out[:, col["word_bytes"]] = np.bincount(owner, length, m) / some
    if len(owner):
        distinct, most = _distinct(owner, T.word_hashes(chunk, w), m)
        out[:, col["distinct_words"]] = distinct / some
        out[:, col["top_word"]] = most / some
    out[:, col["short_words"]] = np.bincount(owner, length <= 3, m) / some
    out[:, col["long_words"]] = np.bincount(owner, length >= 12, m) / some
    marked = np.isin(_CLASS_OF[data[w.ends - 1]], [5, 6, 7, 8]) if len(owner) else np.zeros(0)
    out[:, col["marked_words"]] = np.bincount(owner, marked, m) / some
    # lines: from each document's start, and behind each line feed
    start = np.union1d(np.flatnonzero(data == 10) + 1, bounds[:-1])
    start = start[start < len(data)]
    end = np.append(start[1:], len(data))
    full = end - start > 1
    start, end = start[full], end[full]
    lines = np.searchsorted(bounds, start, "right") - 1
    per = np.bincount(lines, minlength=m)
    out[:, col["log_lines"]] = np.log1p(per)
    if len(lines):
        last = np.where(data[end - 1] == 10, end - 1, end)
        distinct, _ = _distinct(lines, T.span_hashes(T.byte_symbols(data), start, last), m)
        out[:, col["repeated_lines"]] = 1 - distinct / np.maximum(per, 1)
        out[:, col["capital_lines"]] = np.bincount(lines, _CLASS_OF[data[start]] == 1, m) / np.maximum(per, 1)
    out[:, col["words_a_line"]] = n / np.maximum(per, 1)
    out[size == 0] = 0
    return out


@dataclass
class Additive:
    """Lookup tables by feature and by pair of features; scores are sums of their entries."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (edge, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edge, x[:, f], "right")]
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.coarse[f], x[:, f], "right"), np.searchsorted(self.coarse[g], x[:, g], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """A shallow tree over ordered bins by Newton gain; its value for each bin."""
    parts = [(0, len(grad))]
    g, h = np.append(0, np.cumsum(grad)), np.append(0, np.cumsum(hess))
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for a, b in parts:
            at = np.arange(a + 1, b)
            if not len(at):
                continue
            gl, hl, gr, hr = g[at] - g[a], h[at] - h[a], g[b] - g[at], h[b] - h[at]
            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1)
            gain[(hl < least) | (hr < least)] = 0
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], (a, b), int(at[i]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1)
    return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, bins: int = 32, pair_bins: int = 8, pairs: int = 8, rate: float = 0.15) -> Additive:
    """Fit the tables; reproducible for the same rows in the same order."""
    if len(y) == 0 or y.min() == y.max():
        return Additive(20.0 if len(y) == 0 or y[0] else -20.0, [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1])
    cut = lambda v, k: np.unique(np.quantile(v, np.arange(1, k) / k))
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Additive(float(np.log(p / (1 - p))), [cut(v, bins) for v in x.T], [])
    where = [np.searchsorted(e, v, "right") for e, v in zip(model.edges, x.T, strict=True)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total, least = np.full(len(y), model.base), max(1.0, len(y) / 2000)
    for _ in range(rounds):
        for f, at in enumerate(where):
            q = 1 / (1 + np.exp(-total))
            size = len(model.tables[f])
            step = rate * _tree(np.bincount(at, y - q, size), np.bincount(at, q * (1 - q), size), 3, least)
            model.tables[f] += step
            total += step[at]
    model.coarse = [cut(v, pair_bins) for v in x.T]
    rough = [np.searchsorted(e, v, "right") for e, v in zip(model.coarse, x.T, strict=True)]
    q = 1 / (1 + np.exp(-total))
    gains = []
    for f in range(x.shape[1]):
        for g in range(f):
            n = len(model.coarse[g]) + 1
            cell = rough[f] * n + rough[g]
            gr, he = np.bincount(cell, y - q), np.bincount(cell, q * (1 - q))
            gains.append((float((gr**2 / (he + 1)).sum()), f, g))
    model.pairs = [(f, g) for _, f, g in sorted(gains, reverse=True)[:pairs]]
    model.pair_tables = [np.zeros((len(model.coarse[f]) + 1, len(model.coarse[g]) + 1)) for f, g in model.pairs]
    for _ in range(pair_rounds):
        for (f, g), table in zip(model.pairs, model.pair_tables, strict=True):
            q = 1 / (1 + np.exp(-total))
            cell = rough[f] * table.shape[1] + rough[g]
            gr, he = (np.bincount(cell, v, table.size).reshape(table.shape) for v in (y - q, q * (1 - q)))
            # a shallow tree: one cut on the first feature, then cuts on the second within each side
            along = _tree(gr.sum(1), he.sum(1), 2, least)
            step = np.zeros(table.shape)
            for value in np.unique(along):
                side = along == value
                step[side] = _tree(gr[side].sum(0), he[side].sum(0), 2, least)
            table += rate * step
            total += rate * step[rough[f], rough[g]]
    return model


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in T.chunks(batch.column("text")):
            x = features(chunk)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.first_row, len(chunk)), batch.column("y").slice(chunk.first_row, len(chunk)), rows], names=["doc_id", "y", "x"])


def _scorer(model: Additive) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.scores(features(chunk)) for chunk in T.chunks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*batch.schema.names, "score"])

    return run


def train_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Additive:
    """Model from at most ``rows`` labelled rows (the sample's size bounds what is broadcast)."""
    sample = labelled_sample(labels, "quality", 4, 2, rows)
    got = labelled_texts(docs, sample).mapInArrow(tidy(_feature_rows), "doc_id long, y int, x array<double>").toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)))
    y = got.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T[::-1], y, got.column("doc_id").to_numpy()))
    return train(x[order], y[order])


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, threshold: float = 0.7) -> DataFrame:
    """All input rows and columns, with held_out, score and predicted.

    ``docs`` needs doc_id and text, ``labels`` doc_id and quality.  A null text scores like
    an empty one.  A null doc_id is never learnt from and is not held out.  Without labels
    every text scores near 1.  Repeated rows score alike.  Input columns called like the
    added ones are replaced; an empty table gives an empty table.
    """
    model = train_quality(docs, labels, rows)
    docs = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() not in {"held_out", "score", "predicted"}))
    schema = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes)
    scored = docs.mapInArrow(tidy(_scorer(model)), f"{schema}, score double")
    return scored.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
