import os
import subprocess
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from surveyloom.llm.ann import nearest_neighbours
from surveyloom.llm.mixing import mix_sources, mixed_copies
from surveyloom.llm.packing import best_fit, pack_documents
from surveyloom.llm.queries import tokenizer_path
from surveyloom.llm.topk import top_products
from tests.llm.fixtures import documents, frame


def water_fill(sizes, weights, share, epochs):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, target = share * sum(sizes.values()), set(sizes), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > epochs * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
        free -= over
    return target


def test_mixing_targets_and_totals(spark):
    mixed = mix_sources(frame(spark))
    rows = mixed.collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == len((r.text or "").encode().split()) and 0 <= r.taken <= 2 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
    want = water_fill(sizes, (5, 2, 1), 1.5, 2)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s, t in want.items():
        assert abs(taken[s] - t) <= 5, s
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(frame(spark)).collect()))
    copies = mixed_copies(mixed).select("doc_id", "text").collect()
    words = defaultdict(int)
    for r in copies:
        words[r.doc_id] += len(r.text.encode().split())
    assert all(words[r.doc_id] == r.taken for r in rows)


def test_mixing_of_nothing(spark):
    schema = "doc_id long, text string, source string"
    assert mix_sources(spark.createDataFrame([], schema)).count() == 0
    (row,) = mix_sources(spark.createDataFrame([(1, None, None)], schema)).collect()
    assert (row["size"], row.target, row.taken) == (0, 0.0, 0)


def test_best_fit_takes_the_tightest_bin():
    assert best_fit([6, 5, 4, 5, 3], 10) == [[0, 2], [1, 3], [4]]


SCRIPTS = [
    "plain words, with (brackets) and numbers 123 4567", "na\u00efve caf\u00e9 \u00dcber \u0141\u00f3d\u017a \u01c5 \u0180\u024f \u00d7 \u00f7", "\u0395\u03bb\u03bb\u03b7\u03bd\u03b9\u03ba\u03ac \u043f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440", "\u05e9\u05dc\u05d5\u05dd \u0645\u0631\u062d\u0628\u0627", "\u0928\u092e\u0938\u094d\u0924\u0947 \u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35",
    "\u4e16\u754c \u4f60\u597d \u3053\u3093 \uc548\ub155", "\U0001f600 \U0001f469\u200d\U0001f4bb a\U0001f600b", "it's we'll I'M 'tis don't  two  spaces\n\n new\tlines\r\n", "\u00a0nbsp \u2003em \u3000wide\u0085nel \x1c\x1d x", "a <|endoftext|> b<|endoftext|>", "e\u0301 combining \u0130i \u1e9e \ufb01 \u2168 \u00b2\u00bd", "x" * 3000, " lead", "trail ", " ", "A" + " a" * 50,
]


def test_ids_are_those_of_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from surveyloom.llm import _text as T
    from surveyloom.llm.packing import UnitEncoder

    tokenizer, encoder = Tokenizer.from_file(tokenizer_path()), UnitEncoder(tokenizer_path())
    r = np.random.default_rng(3)
    letters = [chr(c) for c in r.integers(32, 0x3000, 4000) if not 0xD800 <= c < 0xE000]
    texts = [*SCRIPTS, " ".join(SCRIPTS), *("".join(r.choice(letters, 30)) + " " + "".join(r.choice(letters, 3)) for _ in range(300))]
    texts += ["".join(chr(c) + " " + chr(c) * 2 for c in range(a, a + 64)) for a in range(32, 0x250, 64)]
    for chunk in T.chunks(pa.array(texts)):
        ids, bounds = encoder.encode(chunk)
        for i in range(len(chunk)):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(texts[chunk.first_row + i], add_special_tokens=False).ids, texts[chunk.first_row + i]


def test_packing_compares_with_plain_best_fit(spark):
    """As many sequences as best-fit over all documents in one place, or one more, also where bins cannot be filled."""
    r = np.random.default_rng(8)
    for low, high in ((1, 700), (500, 640), (300, 420)):
        rows = [(i, " a" * int(n)) for i, n in enumerate(r.integers(low, high, 300))]
        sizes = sorted((len(t) // 2 + 1 for _, t in rows), reverse=True)
        want = len(best_fit(sizes, 1024))
        for task_pieces in (40, 50_000):
            out = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path(), task_pieces=task_pieces).collect()
            got = len({o.sequence_id for o in out})
            assert len(out) == 300 and want <= got <= want + (0 if task_pieces > 300 else 2 + want // 20), (low, high, got, want)


@pytest.mark.parametrize("task_pieces", [20, 50_000])
def test_packing(spark, task_pieces):
    from tokenizers import Tokenizer

    rows = documents() + [(500, "a <|endoftext|> b  c\td \u2003 e\u00e9 'll 12 世界 \x1c x", *[None] * 7), (500, "again", *[None] * 7), (None, "no id", *[None] * 7)]
    texts = defaultdict(list)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    for r in rows:
        texts[r[0]].append([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2])
    out = pack_documents(frame(spark, rows), tokenizer_path(), task_pieces=task_pieces).collect()
    spans = defaultdict(list)
    for r in out:
        assert any(len(t) >= r.start + r.length and zlib.crc32(np.array(t[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for t in texts[r.doc_id]), r
        spans[r.sequence_id].append((r.offset, r.length))
        assert r.length == 1024 or r.piece == 0
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(len(t) for own in texts.values() for t in own)
    assert sum(r.length for r in out) == total
    assert len(spans) <= -(-total // 1024) + 2
    assert pack_documents(frame(spark, []), tokenizer_path()).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((400, 16)).astype(np.float32)
    x[100:140] = x[100]  # one very common vector
    x[200:300] *= 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] * 16), (1080, [float("inf")] * 16), (None, x[0].tolist()), (20, x[20].tolist()), (1100, [])]
    return spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int"), {i: v.astype(float) for i, v in enumerate(x)}


def brute(x, every, top, score):
    out = {}
    for q in x:
        if q % every == 0:
            s = sorted(((-score(x[q], x[v]), v) for v in x if v != q))[:top]
            out[q] = [(v, -a) for a, v in s]
    return out


@pytest.mark.parametrize("block_rows", [40, 150, 10_000])
def test_nearest_neighbours_recall(spark, vectors, block_rows):
    df, x = vectors
    want = brute(x, 20, 20, lambda a, b: float((a * b).sum()))
    got = defaultdict(list)
    for r in nearest_neighbours(df, block_rows=block_rows, query_rows=9).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({v for v, _ in want[q]} & {v for v, _ in got[q]}) / 20 for q in want]) >= 0.9
    for q, own in got.items():
        assert own == sorted(own, key=lambda p: (-p[1], p[0]))
        assert all(s == pytest.approx(float((x[q] * x[v]).sum()), abs=1e-12) for v, s in own)


def test_the_chi_square_test_stops_searches():
    from surveyloom.llm.ann import KdIndex, Projection

    r = np.random.default_rng(7)
    centres = r.standard_normal((40, 64)) * 2
    for spread, most in ((None, 0.75), (0.5, 0.2)):
        x = r.standard_normal((6000, 64)) if spread is None else centres[r.integers(0, 40, 6000)] + spread * r.standard_normal((6000, 64))
        x /= np.sqrt((x * x).sum(1))[:, None]
        index = KdIndex(Projection(64, 16, 11, np.abs(x).max(), float(((x / np.abs(x).max()) ** 2).sum(1).max())), 20, 0.9, np.arange(6000), x)
        q = np.arange(0, 6000, 60)
        at, which, _ = index.find(q, x[q], np.full(len(q), -np.inf))
        truth = x[q] @ x.T
        truth[np.arange(len(q)), q] = -9
        recall = np.mean([len(set(np.argsort(-truth[i])[:20].tolist()) & set(which[at == i].tolist())) / 20 for i in range(len(q))])
        assert recall >= 0.9 and index.verified < most * index.offered, (recall, index.verified / index.offered)


_COST = """
import time
import numpy as np
from surveyloom.llm.ann import KdIndex, Projection
from surveyloom.llm.topk import MTree

r = np.random.default_rng(9)
x = r.standard_normal((ROWS, 64))
x /= np.sqrt((x * x).sum(1))[:, None]
largest = np.abs(x).max()
if TREE:
    x = np.floor(256 * x)
    index = MTree(5, np.arange(ROWS), x)
else:
    index = KdIndex(Projection(64, 20, 11, largest, float(((x / largest) ** 2).sum(1).max())), 20, 0.92, np.arange(ROWS), x)
q = np.arange(0, ROWS, ROWS // 100)
spent = []
for run in (lambda: index.find(q, x[q], np.full(len(q), -np.inf)), lambda: [x @ x[i] for i in q]) * 3:
    began = time.process_time()
    run()
    spent.append(time.process_time() - began)
print(min(spent[::2]) / min(spent[1::2]))
"""


@pytest.mark.parametrize(("tree", "rows", "most"), [(False, 20_000, 8), (True, 8_000, 15)])
def test_a_search_costs_little_more_than_the_products_it_needs(tree, rows, most):
    """Without clusters half or all of the vectors are looked at; finding them must not cost far more than all products."""
    alone = os.environ | {"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1"}
    out = subprocess.run([sys.executable, "-c", f"ROWS, TREE = {rows}, {tree}\n{_COST}"], env=alone, cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True)
    assert float(out.stdout.split()[-1]) < most


def test_a_sure_search_is_exact():
    """With confidence 1 nothing is left out, in any batch of queries, whether or not a bound is known."""
    from surveyloom.llm.ann import KdIndex, Projection

    r = np.random.default_rng(10)
    x = r.integers(-2, 3, (3000, 6)).astype(float)
    x[x.any(1).argmin()] = 1
    x = x[x.any(1)]
    x[500:600] = x[500]
    ids = np.arange(len(x)) * 3
    index = KdIndex(Projection(6, 4, 11, 2.0, float(((x / 2) ** 2).sum(1).max())), 20, 1.0, ids, x)
    q = r.permutation(len(x))[:300]
    for known in (False, True):
        truth = {int(i): sorted((-float(s), int(v)) for v, s in zip(ids, x @ x[i]) if v != ids[i])[:20] for i in q}
        kth = np.array([-truth[int(i)][-1][0] if known else -np.inf for i in q])
        at, which, score = index.find(ids[q], x[q], kth)
        got = defaultdict(list)
        for a, w, s in zip(at.tolist(), which.tolist(), score.tolist()):
            got[int(q[a])].append((-s, int(ids[w])))
        assert got == truth


@pytest.mark.parametrize("known", [False, True])
def test_queries_that_search_a_tree_together(known):
    from surveyloom.llm.topk import MTree

    r = np.random.default_rng(12)
    x = np.floor(6 * (r.standard_normal((30, 5))[r.integers(0, 30, 2500)] + 0.3 * r.standard_normal((2500, 5))))
    x[700:800], x[900] = x[700], 0
    ids = np.arange(len(x)) * 2
    index = MTree(5, ids, x)
    q = np.append(r.permutation(len(x))[:400], [700, 900])
    truth = {int(i): sorted((-int(s), int(v)) for v, s in zip(ids, x @ x[i]) if v != ids[i])[:5] for i in q}
    at, which, score = index.find(ids[q], x[q], np.array([-truth[int(i)][-1][0] if known else -np.inf for i in q], float))
    got = defaultdict(list)
    for a, w, s in zip(at.tolist(), which.tolist(), score.tolist()):
        got[a].append((-s, int(ids[w])))
    assert [got[a] for a in range(len(q))] == [truth[int(i)] for i in q]
    assert 0 < index.computed < index.offered


def test_vectors_that_take_part(spark):
    from surveyloom.llm._vectors import usable

    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, None]), (2, [nan, 1.0]), (3, [1.0, inf]), (4, [-inf, 1.0]), (5, [None, None]), (6, [0.0, -0.0]), (7, [-0.0, -1.0]), (8, [0.0, 2.0]), (9, []), (10, None), (11, [None, nan])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(r.vec_id for r in usable(df, zero=False).collect()) == [7, 8]
    assert sorted(r.vec_id for r in usable(df, zero=True).collect()) == [6, 7, 8]


def test_the_length_of_the_longest(spark):
    """Squared lengths that over- or underflow, and a longest vector without the largest component."""
    from surveyloom.llm.ann import _projection

    for scale in (1e-200, 1.0, 1e200):
        rows = [(i, [scale * v for v in row]) for i, row in enumerate([[3.0, 3.0, 3.0], [4.0, 0.0, 0.0], [1e-3, 1.0, 0.0]] + [[0.5, 0.5, 0.5]] * 40)]
        made = _projection(spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(5), 3, 4, 11)
        assert made.largest == 4 * scale and made.square == pytest.approx(27 / 16, rel=1e-9)
    assert _projection(spark.createDataFrame([], "vec_id long, v array<double>"), 3, 4, 11).square == pytest.approx(1)


def test_nearest_neighbours_of_tiny_huge_and_tied_vectors(spark):
    """Lengths whose squares under- or overflow keep their directions; ties at the cut go to smaller ids."""
    rows = [(0, [1e-200, 0.0]), (20, [0.0, 3e120])] + [(i, [float(i % 7 - 3), float(i % 5 - 2)]) for i in range(21, 120)]
    rows += [(200 + i, [2.0, float(i) / 64]) for i in range(70)]  # product 2e-200 with the first query for all
    x = {i: np.array(v) for i, v in rows}
    got = defaultdict(list)
    for r in nearest_neighbours(spark.createDataFrame([r for r in rows if any(r[1])], "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = brute({i: v for i, v in x.items() if v.any()}, 20, 20, lambda a, b: float((a * b).sum()))
    assert set(got) == set(want)
    assert got[0] == want[0] and got[20] == want[20]


@pytest.mark.parametrize("block_rows", [40, 150, 10_000])
def test_top_products_are_exact(spark, vectors, block_rows):
    df, x = vectors
    whole = {i: np.floor(256 * v) for i, v in x.items()} | {1020: np.zeros(16)}
    want = brute(whole, 50, 5, lambda a, b: int((a * b).sum()))
    got = defaultdict(list)
    for r in top_products(df, block_rows=block_rows, query_rows=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert dict(got) == want


@pytest.mark.parametrize("power", [18, 23, 32, 60, 300])
def test_top_products_of_large_components(spark, power):
    """Products beyond 2**53 are ranked exactly; beyond 64 bits they stop at the range's ends and tie."""
    r = np.random.default_rng(power)
    rows = [(i, [float(v) for v in r.choice([-1.0, 1.0, 0.5, 2.0**power / 256, -(2.0**power) / 256, 2.0**power / 256 - 1], 6, p=[0.3, 0.3, 0.1, 0.1, 0.1, 0.1])]) for i in range(160)]
    whole = {i: [int(256 * v) for v in row] for i, row in rows}
    clamp = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    want = {}
    for q in range(0, 160, 50):
        want[q] = [(v, -a) for a, v in sorted((-clamp(sum(a * b for a, b in zip(whole[q], whole[v]))), v) for v in whole if v != q)[:5]]
    for block_rows in (30, 1000):
        got = defaultdict(list)
        for o in top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=block_rows).orderBy("query_id", "rank").collect():
            got[o.query_id].append((o.vec_id, o.score))
        assert dict(got) == want


@pytest.mark.parametrize("search", [nearest_neighbours, top_products])
def test_searches_of_few_or_no_vectors(spark, search):
    schema = "vec_id long, embedding array<float>"
    assert search(spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.5, 0.0])], schema)
    assert [r.vec_id for r in search(few).orderBy("rank").collect()] == [1, 2]
    assert search(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
