"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A step of the network is a word.  Its input joins a word embedding (by hash) and a
character embedding (maximum over
the hashed character grams of the marked word).  Gated
recurrent units run over a window in both directions, attention pools their states, and a
logistic unit scores the window.  A document is covered by overlapping windows, all of
them are scored, and the three highest make the document's score: one doubtful window says
less than several.

Training is plain numpy on the driver, on a bounded sample of labelled rows.  All windows of
their whole texts pass through the network in each epoch.  A toxic document teaches through
its highest window, as the others may be clean; of a clean document every window counts.
Embeddings start from how far toxic documents are over-represented in their
bucket, among the documents learnt from; a tenth of the sample is kept out of that too and
calibrates the score.  Scoring works on chunks of whole texts: inputs are projected once
for each distinct word, and all windows of a chunk advance together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm import _text as T
from surveyloom.llm._io import tidy
from surveyloom.llm._labels import labelled_sample, labelled_texts, remainder

#: Bounds on training: labelled rows, and bytes of their texts.
TRAINING_ROWS, TRAINING_BYTES = 5_000, 64 << 20
#: Windows that go through the network together.
WINDOWS_AT_ONCE = 2048

WINDOW, STRIDE = 96, 72
#: Highest windows that a document's score is made from.
HIGHEST = 3
WORD_BUCKETS, CHAR_BUCKETS, EMBED, HIDDEN = 1 << 16, 1 << 18, 6, 8
#: Lengths of the character grams of a marked word.
CHAR_GRAMS = (3, 5, 6)
#: Of inputs in training, the share left out; and the embeddings' learning rate against the others'.
DROPOUT, EMBED_RATE = 0.15, 0.1
_MARK = np.uint64(0x2545F4914F6CDD1D)


def word_inputs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words given by byte bounds: word bucket, and their character-gram buckets with offsets.

    Letters A-Z count as lower case; a word has a mark before and behind it.
    """
    symbols = T.byte_symbols(T.LOWER[data])
    buckets = (T.span_hashes(symbols, starts, ends) % np.uint64(WORD_BUCKETS)).astype(np.int64)
    n = ends - starts + 2
    at = np.cumsum(n) - n
    marked = np.full(int(n.sum()), _MARK)
    inside = np.arange(len(marked)) - np.repeat(at, n)
    letters = (inside > 0) & (inside < np.repeat(n, n) - 1)
    marked[letters] = symbols[(np.repeat(starts, n) + inside - 1)[letters]]
    found, owner = [], []
    for size in CHAR_GRAMS:
        own = np.maximum(n - size + 1, 0)
        word = np.repeat(np.arange(len(n)), own)
        place = at[word] + np.arange(len(word)) - np.repeat(np.cumsum(own) - own, own)
        code = np.full(len(word), size, np.uint64)
        for j in range(size):
            code = code * np.uint64(0x9E3779B97F4A7C15) + marked[place + j]
        found.append((T.mix(code) % np.uint64(CHAR_BUCKETS)).astype(np.int64))
        owner.append(word)
    order = np.argsort(np.concatenate(owner), kind="stable")
    return buckets, np.concatenate(found)[order], np.append(0, np.cumsum(np.bincount(np.concatenate(owner), minlength=len(n))))


def windows_of(counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows over each document's words: document, first word, number of words.

    Windows start every STRIDE words; the last one ends with the document.
    """
    per = np.where(counts > WINDOW, -(-(counts - WINDOW) // STRIDE) + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), per)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = np.minimum(k * STRIDE, np.maximum(counts[doc] - WINDOW, 0))
    return doc, first[doc] + start, np.minimum(counts[doc], WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters, and forward and backward passes; arrays are features x windows."""

    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        d, h = 2 * EMBED, HIDDEN
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[-1])).astype(np.float32)
        self.p = {"word": 0.05 * f(WORD_BUCKETS, EMBED), "char": 0.05 * f(CHAR_BUCKETS, EMBED), "att_w": f(2 * h, 2 * h), "att_v": f(1, 2 * h)[0], "out": f(1, 2 * h)[0], "bias": np.array([-1.0], np.float32)}
        for way in "fb":
            self.p |= {f"x{way}": f(3 * h, d), f"h{way}": f(3 * h, h), f"c{way}": np.zeros((3 * h, 1), np.float32)}
        self.scale, self.shift = np.array([1.0, *[0.0] * (HIGHEST - 1)]), 0.0

    def inputs(self, buckets: np.ndarray, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        chars = np.maximum.reduceat(self.p["char"][grams], at[:-1], axis=0) if len(buckets) else np.zeros((0, EMBED), np.float32)
        return np.concatenate((self.p["word"][buckets], chars), axis=1).astype(np.float32)

    def _run(self, way: str, steps: np.ndarray, mask: np.ndarray | None, proj: np.ndarray, keep: list | None) -> np.ndarray:
        """steps: T x B word numbers; proj: projected inputs of the words, U x 3h. Returns T x h x B."""
        h, n = HIDDEN, steps.shape[1]
        weights = self.p[f"h{way}"]
        state = np.zeros((h, n), np.float32)
        states = np.empty((len(steps), h, n), np.float32)
        for t in range(len(steps)) if way == "f" else range(len(steps) - 1, -1, -1):
            x = proj[steps[t]].T
            gates = _sigmoid(x[: 2 * h] + weights[: 2 * h] @ state)
            z, r = gates[:h], gates[h:]
            rec = weights[2 * h :] @ state
            c = np.tanh(x[2 * h :] + r * rec)
            new = c + z * (state - c)
            if mask is not None:
                new = np.where(mask[t], new, state)
            if keep is not None:
                keep.append((t, state, z, r, rec, c))
            state = states[t] = new
        return states

    def forward(self, x: np.ndarray, steps: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
        """Logits of windows. x: U x d inputs of distinct words; steps, mask: T x B."""
        runs = []
        for way in "fb":
            tape: list | None = None if keep is None else keep.setdefault(way, [])
            runs.append(self._run(way, steps, mask, x @ self.p[f"x{way}"].T + self.p[f"c{way}"].T, tape))
        both = np.concatenate(runs, axis=1)
        hidden = np.tanh(np.matmul(self.p["att_w"], both))
        energy = np.einsum("k,tkb->tb", self.p["att_v"], hidden)
        if mask is not None:
            energy = np.where(mask, energy, np.float32(-1e9))
        energy -= energy.max(0)
        a = np.exp(energy)
        a /= a.sum(0)
        pooled = np.einsum("tb,tkb->kb", a, both)
        if keep is not None:
            keep |= {"both": both, "hidden": hidden, "a": a, "pooled": pooled}
        return self.p["out"] @ pooled + self.p["bias"][0]

    def backward(self, x: np.ndarray, steps: np.ndarray, mask: np.ndarray, keep: dict, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters but embeddings, and of x."""
        h, p, g = HIDDEN, self.p, {}
        both, hidden, a, pooled = (keep[k] for k in ("both", "hidden", "a", "pooled"))
        g["out"], g["bias"] = pooled @ dlogit, dlogit.sum(keepdims=True)
        dpool = p["out"][:, None] * dlogit
        dboth = a[:, None, :] * dpool
        da = np.einsum("kb,tkb->tb", dpool, both)
        denergy = a * (da - (a * da).sum(0))
        g["att_v"] = np.einsum("tb,tkb->k", denergy, hidden)
        dhid = denergy[:, None, :] * p["att_v"][:, None] * (1 - hidden**2)
        g["att_w"] = np.einsum("tkb,tjb->kj", dhid, both)
        dboth = dboth + np.matmul(p["att_w"].T, dhid)
        dx = np.zeros(x.shape, np.float32)
        for i, way in enumerate("fb"):
            weights = p[f"h{way}"]
            g[f"h{way}"] = np.zeros_like(weights)
            dproj_all = np.zeros((steps.shape[0], 3 * h, steps.shape[1]), np.float32)
            carry = np.zeros((h, steps.shape[1]), np.float32)
            for t, state, z, r, rec, c in reversed(keep[way]):
                d = carry + dboth[t, i * h : (i + 1) * h]
                live = d * mask[t]
                dz = live * (state - c) * z * (1 - z)
                dc = live * (1 - z) * (1 - c**2)
                dr = dc * rec * r * (1 - r)
                dproj = np.concatenate((dz, dr, dc))
                dproj_all[t] = dproj
                drec = dc * r
                back = np.concatenate((dz, dr, drec))
                g[f"h{way}"] += back @ state.T
                carry = d * ~mask[t] + live * z + weights.T @ back
            flat = dproj_all.transpose(0, 2, 1).reshape(-1, 3 * h)
            order = np.argsort(steps.ravel(), kind="stable")
            s = steps.ravel()[order]
            head = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            sums = np.zeros((len(x), 3 * h), np.float32)
            sums[s[head]] = np.add.reduceat(flat[order], head, axis=0)
            g[f"x{way}"], g[f"c{way}"] = sums.T @ x, sums.sum(0)[:, None]
            dx += sums @ p[f"x{way}"]
        return g, dx

    def highest(self, doc: np.ndarray, logits: np.ndarray, n: int) -> np.ndarray:
        """The HIGHEST window logits of each of n documents, in order; where there are fewer, that of no evidence."""
        out = np.full((n, HIGHEST), self.p["bias"][0], float)
        order = np.lexsort((-logits, doc))
        place = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
        some = place < HIGHEST
        out[doc[order][some], place[some]] = logits[order][some]
        return out

    def document_scores(self, chunk: T.Chunk) -> np.ndarray:
        """A score for each document from its highest windows; texts without words score as the bias alone."""
        w = T.words(chunk)
        doc, logits = np.zeros(0, np.int64), np.zeros(0, np.float32)
        if len(w.starts):
            hashes = T.word_hashes(chunk, w, lower=True)
            order = np.argsort(hashes)
            head = np.append(True, hashes[order][1:] != hashes[order][:-1])
            word = np.empty(len(order), np.int64)
            word[order] = np.cumsum(head) - 1
            example = order[head]
            x = self.inputs(*word_inputs(chunk.data, w.starts[example], w.ends[example]))
            doc, start, n = windows_of(w.counts(), w.first[:-1])
            logits = np.zeros(len(doc), np.float32)
            for short in (False, True):
                for some in np.array_split(np.flatnonzero((n < WINDOW) == short), max(1, -(-int(((n < WINDOW) == short).sum()) // WINDOWS_AT_ONCE))):
                    if len(some):
                        length = int(n[some].max())
                        place = np.arange(length)[:, None]
                        mask = place < n[some] if short else None
                        steps = word[np.minimum(start[some] + place, len(word) - 1)]
                        logits[some] = self.forward(x, steps, mask)
        return 1 / (1 + np.exp(-np.clip(self.highest(doc, logits, len(chunk)) @ self.scale + self.shift, -30, 30)))


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = end - begin
    return np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)


def _vocabulary_inputs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word_inputs`` of a list of words, some at a time."""
    buckets, grams, n = [], [], []
    for begin in range(0, len(words), 20_000):
        some = words[begin : begin + 20_000]
        ends = np.cumsum([len(w) for w in some])
        b, g, at = word_inputs(np.frombuffer(b"".join(some), np.uint8), np.append(0, ends[:-1]), ends)
        buckets.append(b)
        grams.append(g.astype(np.int32))
        n.append(np.diff(at))
    return np.concatenate(buckets), np.concatenate(grams), np.append(0, np.cumsum(np.concatenate(n)))


def fit(texts: list[list[bytes]], y: np.ndarray, epochs: int = 8, batch: int = 192, rate: float = 0.01, seed: int = 5) -> Network:
    """Train on documents given as lists of window texts (words joined by a space)."""
    net = Network(seed)
    if len(y) == 0 or y.min() == y.max():
        net.scale, net.shift = np.zeros(HIGHEST), -5.0 if len(y) == 0 or y[0] == 0 else 5.0
        return net
    r = np.random.default_rng(seed)
    flat = [t for own in texts for t in own]
    bag = np.repeat(np.arange(len(texts)), [len(own) for own in texts])
    vocabulary: dict[bytes, int] = {}
    count = np.array([len(t.split()) for t in flat], np.int64)
    word = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for t in flat for w in t.lower().split()), np.int32, int(count.sum()))
    first = np.cumsum(count) - count
    buckets, grams, at = _vocabulary_inputs(list(vocabulary))
    hold = r.permutation(len(y)) < len(y) // 10
    learn = np.flatnonzero(~hold)
    # embeddings start from how far toxic documents are over-represented in their bucket, in
    # standard deviations beyond what chance gives, among the documents learnt from
    seen = {"word": np.zeros((2, WORD_BUCKETS)), "char": np.zeros((2, CHAR_BUCKETS))}
    last = np.append(first, len(word))[np.cumsum([len(own) for own in texts])]
    begins = np.append(0, last[:-1])
    for i in learn.tolist():
        own = np.unique(word[begins[i] : last[i]])
        label = int(y[i])
        seen["word"][label][np.unique(buckets[own])] += 1
        seen["char"][label][np.unique(grams[_ranges(at[own], at[own + 1])])] += 1
    for name, (neg, pos) in seen.items():
        n, prior = pos + neg, np.clip(y[learn].mean(), 1e-6, 1 - 1e-6)
        surplus = (pos - n * prior) / np.sqrt(np.maximum(n, 1) * prior * (1 - prior))
        net.p[name][:, 0] = np.clip((surplus - 3) / 4, 0, 3)
    of_doc = np.append(0, np.cumsum([len(own) for own in texts]))
    moments: dict[str, list] = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0

    def prepared(rows: np.ndarray):
        place = np.arange(int(count[rows].max()))[:, None]
        mask = place < count[rows]
        words = word[np.minimum(first[rows] + place, len(word) - 1)]
        own, steps = np.unique(words, return_inverse=True)
        local = np.append(0, np.cumsum(at[own + 1] - at[own]))
        take = _ranges(at[own], at[own + 1])
        return mask, steps.reshape(words.shape), (buckets[own], grams[take], local)

    def windows(docs: np.ndarray) -> list[np.ndarray]:
        """All windows of some documents, those of one document together, about as many as go through the network at once."""
        rows = [np.arange(of_doc[d], of_doc[d + 1]) for d in docs]
        rows = [own[count[own] > 0] for own in rows]
        part = np.cumsum([len(own) for own in rows]) // WINDOWS_AT_ONCE
        found = [np.concatenate([own for own, k in zip(rows, part, strict=True) if k == i]) for i in np.unique(part)] if len(rows) else []
        return [some for some in found if len(some)]

    for epoch in range(epochs):
        order = r.permutation(learn)
        for begin in range(0, len(order), batch):
            total: dict[str, np.ndarray] = {}
            for rows in windows(order[begin : begin + batch]):
                mask, steps, words = prepared(rows)
                keep: dict = {}
                x = net.inputs(*words)
                kept = (r.random(x.shape) >= DROPOUT).astype(np.float32)
                logit = net.forward(x * kept, steps, mask, keep)
                # the highest window stands for its document; of a clean document all windows are clean
                top = np.zeros(len(rows), bool)
                by = np.lexsort((logit, bag[rows]))
                top[by[np.append(bag[rows][by][1:] != bag[rows][by][:-1], True)]] = True
                label = y[bag[rows]]
                share = np.where(label == 1, top, np.where(top, 1.0, 0.3)).astype(np.float32)
                dlogit = ((_sigmoid(logit) - label) * share / batch).astype(np.float32)
                g, dx = net.backward(x * kept, steps, mask, keep, dlogit)
                dx *= kept
                gw = np.zeros_like(net.p["word"])
                np.add.at(gw, words[0], dx[:, :EMBED])
                gc = np.zeros_like(net.p["char"])
                # the gram that gave the maximum gets its gradient
                size = np.diff(words[2])
                won = net.p["char"][words[1]] == np.repeat(x[:, EMBED:], size, axis=0)
                np.add.at(gc, words[1], np.repeat(dx[:, EMBED:], size, axis=0) * won)
                for k, grad in (g | {"word": gw, "char": gc}).items():
                    total[k] = total[k] + grad if k in total else grad
            if not total:
                continue
            g = total
            step += 1
            now = rate * (0.5 if epoch >= epochs - 2 else 1.0)
            for k, grad in g.items():
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.002 * (grad**2 - v)
                net.p[k] = (net.p[k] - now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.998**step)) + 1e-6) * (EMBED_RATE if k in ("word", "char") else 1)).astype(np.float32)
    # scales and shift on documents that were not learnt from
    test = np.flatnonzero(hold) if 0 < y[hold].sum() < hold.sum() else learn
    owner, logits = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
    for begin in range(0, len(test), 512):
        for rows in windows(test[begin : begin + 512]):
            mask, steps, words = prepared(rows)
            owner.append(bag[rows])
            logits.append(net.forward(net.inputs(*words), steps, mask))
    s, t = net.highest(np.concatenate(owner), np.concatenate(logits), len(y))[test], y[test]
    # a logistic fit by Newton's steps; a slight pull to the highest window alone keeps it finite where scores part the labels
    start = np.array([1.0, *[0.0] * HIGHEST])
    fitted, pull = start.copy(), np.full(len(start), 0.05)
    columns = np.vstack((s.T, np.ones(len(s))))
    for _ in range(50):
        q = _sigmoid(fitted @ columns)
        slope = columns @ (q - t) + pull * (fitted - start)
        bend = (columns * np.maximum(q * (1 - q), 1e-6)) @ columns.T + np.diag(pull)
        fitted = fitted - np.clip(np.linalg.solve(bend, slope), -2, 2)
    net.scale, net.shift = fitted[:-1], float(fitted[-1])
    return net


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, y = batch.column("doc_id"), batch.column("y")
        for chunk in T.chunks(batch.column("text")):
            w, blob = T.words(chunk), chunk.data.tobytes()
            doc, start, n = windows_of(w.counts(), w.first[:-1])
            edge = np.searchsorted(doc, np.arange(len(chunk) + 1))
            rows = [[b" ".join(blob[w.starts[j] : w.ends[j]] for j in range(start[k], start[k] + n[k])) for k in range(edge[i], edge[i + 1])] for i in range(len(chunk))]
            yield pa.RecordBatch.from_arrays([ids.slice(chunk.first_row, len(chunk)), y.slice(chunk.first_row, len(chunk)), pa.array(rows, pa.list_(pa.binary()))], names=["doc_id", "y", "windows"])


def train_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, size: int = TRAINING_BYTES) -> Network:
    """Network from all windows of at most ``rows`` labelled rows, whose texts have at most ``size`` bytes together.

    Rows are taken in hash order until one of the bounds is met; texts are never cut.
    """
    sample = labelled_sample(labels, "toxic", 5, 0, rows)
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").alias("size")).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("size").alias("size"))
    # at most ``rows`` numbers
    before = F.sum(F.coalesce("size", F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    sample = sample.join(sizes.select("doc_id", before.alias("__bytes")).filter(F.col("__bytes") <= size).select("doc_id"), "doc_id")
    got = labelled_texts(docs, sample).mapInArrow(tidy(_training_windows), "doc_id long, y int, windows array<binary>").toArrow().sort_by("doc_id").to_pylist()
    return fit([x["windows"] for x in got], np.array([x["y"] for x in got], float))


def _scorer(net: Network) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [net.document_scores(chunk) for chunk in T.chunks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*batch.schema.names, "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, threshold: float = 0.5) -> DataFrame:
    """All input rows and columns, with held_out, score and predicted.

    ``docs`` needs doc_id and text, ``labels`` doc_id and toxic.  A null, empty or blank
    text has no window and scores by the network's bias.  A null doc_id is never learnt
    from and is not held out.  Without labels every text scores near 0.  Repeated rows
    score alike.  Input columns called like the added ones are replaced; an empty table
    gives an empty table.
    """
    net = train_toxicity(docs, labels, rows)
    docs = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() not in {"held_out", "score", "predicted"}))
    schema = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes)
    scored = docs.mapInArrow(tidy(_scorer(net)), f"{schema}, score double")
    return scored.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
