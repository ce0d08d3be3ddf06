import hashlib

import pytest

from surveyloom.llm import _repeats
from surveyloom.llm import substring_dedup as _words
from surveyloom.llm import suffix_dedup as _suffixes
from surveyloom.llm.near_dedup import near_dedup, retained, spared
from surveyloom.llm.substring_dedup import substring_dedup
from surveyloom.llm.suffix_dedup import Suffixes, longest_previous, suffix_dedup
from tests.llm.fixtures import documents, frame

import numpy as np


def covered(symbols, length, seen, key):
    gone = [False] * len(symbols)
    for p in range(len(symbols) - length + 1):
        k = key(symbols[p : p + length])
        if k in seen:
            gone[p : p + length] = [True] * length
        seen.add(k)
    return gone


def brute_words(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows):
        words = (t or "").encode().split()
        gone = covered(words, length, seen, tuple)
        out[d] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode())
    return out


def brute_bytes(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows):
        data = (t or "").encode()
        gone = covered(data, length, seen, bytes)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone) if not g))
    return out


def test_substring_dedup_equals_brute_force(spark):
    rows = documents()
    want = brute_words([(r[0], r[1] or "") for r in rows], 20)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(frame(spark)).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 500


def test_suffix_dedup_equals_brute_force(spark):
    rows = documents()
    want = brute_bytes([(r[0], r[1] or "") for r in rows], 100)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup(frame(spark)).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 500


def test_wide_grams_are_split_without_change(spark, monkeypatch):
    monkeypatch.setattr(_repeats, "SPLIT_ABOVE", 2)
    rows = documents()
    want = brute_words([(r[0], r[1] or "") for r in rows], 20)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(frame(spark)).collect()} == want


def short_line_documents():
    """A line shorter than the threshold, and one passage longer than it, between neighbours of their own."""
    line, passage = ("the line that stands in every document word for word twelve".split(), [f"passage{i}" for i in range(24)])
    own = lambda d, at, n: [f"w{d}x{at + i}" for i in range(n)]
    return [(d, " ".join(own(d, 0, 30) + line + own(d, 100, 30) + passage + own(d, 200, 30))) for d in range(60)]


def test_wide_grams_are_split_without_change_for_bytes(spark, monkeypatch):
    monkeypatch.setattr(_repeats, "SPLIT_ABOVE", 2)
    rows = documents()
    want = brute_bytes([(r[0], r[1] or "") for r in rows], 100)
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup(frame(spark)).collect()} == want


@pytest.mark.parametrize("dedup", ["words", "bytes"])
def test_no_bucket_outgrows_the_split_of_wide_grams(spark, monkeypatch, dedup):
    from surveyloom.llm import substring_dedup as words
    from surveyloom.llm import suffix_dedup as suffixes

    module, length, name = (words, 20, "_extend") if dedup == "words" else (suffixes, 100, "_resolve")
    make = getattr(module, name)

    def bounded(threshold):
        resolve = make(threshold)

        def run(p):
            fullest = int(np.unique(p.bucket, return_counts=True)[1].max())
            if fullest > 10:
                raise ValueError(f"a bucket of {fullest} pieces")
            return resolve(p)

        return run

    monkeypatch.setattr(_repeats, "SPLIT_ABOVE", 10)
    monkeypatch.setattr(module, name, bounded)
    rows = short_line_documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    if dedup == "words":
        want = brute_words(rows, length)
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(docs).collect()} == want
    else:
        want = brute_bytes(rows, length)
        assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup(docs).collect()} == want
    assert sum(x[1] for x in want.values()) >= 59 * 24


@pytest.mark.parametrize("dedup", [substring_dedup, suffix_dedup])
def test_rows_without_or_with_a_repeated_id(spark, dedup):
    text = " ".join(f"q{i}" for i in range(60))
    other = " ".join(f"z{i}" for i in range(60))
    rows = [(None, text), (1, text), (1, text), (2, text), (3, other), (3, other + " more")]
    got = dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    removed = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in got.collect())
    assert [x for x in removed if x[0] in (-1, 1)] == [(-1, 0), (1, 0), (1, 0)]
    assert [x[1] > 0 for x in removed if x[0] == 2] == [True]
    assert sorted(x[1] > 0 for x in removed if x[0] == 3) == [False, True]


@pytest.mark.parametrize("dedup", [substring_dedup, suffix_dedup, near_dedup])
def test_empty_table(spark, dedup):
    assert dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_factors(texts, threshold):
    """Per start the longest match with an earlier start, bounded by the ends of the texts."""
    starts = [(i, k) for i, t in enumerate(texts) for k in range(len(t) - threshold + 1)]
    out = []
    for i, k in starts:
        best = 0
        for j, m in starts:
            if (j, m) < (i, k):
                n = 0
                while k + n < len(texts[i]) and m + n < len(texts[j]) and texts[i][k + n] == texts[j][m + n]:
                    n += 1
                best = max(best, n)
        out.append(best if best >= threshold else 0)
    return out


def test_longest_previous_factors_equal_brute_force():
    r = np.random.default_rng(0)
    beyond, both = 0, [0, 0]
    for _ in range(60):
        threshold = int(r.integers(2, 12))
        texts = [bytes(r.integers(97, 99, int(r.integers(threshold, 60))).astype(np.uint8)) for _ in range(4)] + [b"abcabcabxabcabc" * 2, bytes(30)]
        flat, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        starts = np.concatenate([np.arange(a, b - threshold + 1) for a, b in zip(bounds[:-1], bounds[1:])])
        got = longest_previous(Suffixes(flat, bounds), starts, starts, threshold)
        want = np.array(brute_factors(texts, threshold))
        # the length counts, not only whether it reaches the threshold; texts' ends bound it
        assert (got >= threshold).tolist() == (want >= threshold).tolist()
        assert (got <= want).all() and (got == want).mean() > 0.9
        beyond += (got > threshold).sum()
        rank = Suffixes(flat, bounds).rank[starts]
        order = np.lexsort((starts, rank))
        both[0] += (np.diff(order) < 0).sum()
        both[1] += (np.diff(order) > 0).sum()
    assert beyond > 1000 and min(both) > 1000  # neighbours on both sides are smaller, in turn


def test_seeds_are_extended_to_maximal_repeats():
    from surveyloom.llm import _text as T
    from surveyloom.llm.substring_dedup import _extend

    words = lambda text: np.array([hash(w) & 0xFFFFFFFF for w in text.split()], np.uint64)
    seed = "s1 s2 s3 s4 s5 s6 s7 s8"
    texts = [f"a b c d {seed} e f g h i j k l m", f"x b c d {seed} e f g h i j k l m", f"a b c d {seed} e f g h i y z q w", f"a b c d {seed} e f g h i j k l m"]
    symbols = [words(t) for t in texts]
    gram = T.gram_hashes(words(seed), 8)[0].view(np.int64)
    n = np.array([len(s) - 19 for s in symbols])
    p = R_pieces(np.full(4, gram), np.arange(4), np.zeros(4, np.int64), np.zeros(4, np.int64), n, np.concatenate(symbols), np.append(0, np.cumsum([len(s) for s in symbols])))
    lengths = _extend(20)(p)
    first = np.append(0, np.cumsum(n))
    at = [lengths[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert at == [[0, 0], [0, 20], [0, 0], [21, 20]]


def R_pieces(*columns):
    return _repeats.Pieces(*columns)


@pytest.mark.parametrize("dedup", ["words", "bytes"])
def test_two_texts_of_one_id(spark, dedup):
    """Two texts that a short tag of the text could not tell apart, and a third document that repeats both."""
    one, two = "text number 423 " + "abc def ghi " * 40, "text number 558 " + "abc def ghi " * 3 + " ".join(f"u{i}" for i in range(40))
    rows = [(5, one), (5, two), (5, two), (9, two + " " + one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # the order of texts under one id is free: either one comes first
    wants = []
    for order in ((one, two), (two, one)):
        ranked = [(0, order[0]), (1, order[1]), (2, two + " " + one)]
        brute = brute_words(ranked, 20) if dedup == "words" else brute_bytes(ranked, 100)
        wants.append(sorted([(brute[order.index(one)][1]), brute[order.index(two)][1], brute[order.index(two)][1], brute[2][1]]))
    out = substring_dedup(docs) if dedup == "words" else suffix_dedup(docs)
    assert sorted(r.n_removed for r in out.collect()) in wants


@pytest.mark.parametrize("dedup", ["words", "bytes"])
def test_very_long_texts(spark, monkeypatch, dedup):
    """Texts over several stretches; runs that a stretch cuts meet whole ones."""
    from surveyloom.llm import _text as T

    rows = documents(20) + [(900, " ".join(f"v{i * 7919 % 3001}" for i in range(4000)), *[None] * 7), (901, "z " + " ".join(f"v{i * 7919 % 3001}" for i in range(37, 3000)), *[None] * 7)]
    monkeypatch.setattr(T, "STRETCH", 300)
    alphabet = (_words if dedup == "words" else _suffixes)._alphabet(20 if dedup == "words" else 100)
    found = [T.anchors(np.arange(5000).astype(np.uint64), lambda x: T.mix(x + np.uint64(1)), np.array([0, 5000]), alphabet.length, alphabet.gram) for _ in range(2)]
    windows = np.concatenate([np.arange(a, a + n) for a, n in zip(found[0].first_window, found[0].n_windows)])
    assert windows.tolist() == list(range(5000 - alphabet.length + 1))
    if dedup == "words":
        want = brute_words([(r[0], r[1]) for r in rows], 20)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(frame(spark, rows)).collect()}
    else:
        want = brute_bytes([(r[0], r[1]) for r in rows], 100)
        got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup(frame(spark, rows)).collect()}
    assert got == want


@pytest.mark.parametrize("dedup", ["words", "bytes"])
def test_common_grams_change_no_result(spark, monkeypatch, dedup):
    monkeypatch.setattr(_repeats, "COMMON_SHARE", 0.01)
    rows = short_line_documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    alphabet = (_words if dedup == "words" else _suffixes)._alphabet(20 if dedup == "words" else 100)
    assert len(_repeats.common_grams(docs, alphabet).grams) >= 5
    if dedup == "words":
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(docs).collect()} == brute_words(rows, 20)
    else:
        assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup(docs).collect()} == brute_bytes(rows, 100)


def brute_near(rows, size, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_dedup_equals_brute_force(spark, size, percent):
    want = brute_near([(r[0], r[1]) for r in documents()], size, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(frame(spark), size, percent).collect()}
    assert got == want


def test_near_dedup_across_blocks(spark, monkeypatch):
    import surveyloom.llm.near_dedup as N

    monkeypatch.setattr(N, "BLOCK_SHINGLES", 150)
    base = [f"t{i}" for i in range(100)]
    rows = [(d, " ".join(base[:d] + [f"x{d}"] + base[d + 1 :])) for d in range(24)]
    want = brute_near(rows, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == want


def test_candidates_are_never_lost():
    from surveyloom.llm.near_dedup import Sets, retained

    r = np.random.default_rng(4)
    for percent in (50, 80, 85):
        for _ in range(300):
            n = int(r.integers(1, 60))
            base = r.permutation(400)[: n + 12]
            a, b = np.unique(base[:n]), np.unique(np.concatenate((base[: n - min(n, int(r.integers(0, 6)))], base[n : n + int(r.integers(0, 8))])))
            if not len(b):
                continue
            both = len(np.intersect1d(a, b))
            if 100 * both < percent * (len(a) + len(b) - both):
                continue
            kept = [x[: retained(len(x), percent)[0]] for x in (a, b)]
            rarity = {v: r.random() for v in range(400)}
            looked = [set(sorted(k.tolist(), key=rarity.get)[: retained(len(x), percent)[1]]) for k, x in zip(kept, (a, b))]
            assert looked[0] & looked[1]
            assert Sets([a, b], percent).bounded(0, np.array([1])).tolist() == [1]


def test_near_dedup_splits_words_at_every_white_space(spark):
    words = [f"c{i}" for i in range(30)]
    rows = [(1, " ".join(words)), (2, "\v".join(words)), (3, "\f".join(words[:-1]) + "\rc29"), (4, "\u00a0".join(words))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {1: (28, 1), 2: (28, 1), 3: (28, 1), 4: (1, 4)}


def test_near_dedup_of_one_long_chain_and_of_unlinked_members(spark):
    """Every list has one head, but only neighbours are linked; others share a passage and nothing else."""
    words = [f"k{i}" for i in range(160)]
    rows = [(d, " ".join(words[d * 3 : d * 3 + 100])) for d in range(20)] + [(100 + d, " ".join(words[:40] + [f"own{d}x{i}" for i in range(60)])) for d in range(20)]
    want = brute_near(rows, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == want and len({x[1] for x in want.values()}) == 21


def test_near_dedup_null_and_repeated_ids(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "e f g h"), (7, "e f g h"), (8, None)]
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect())
    assert got == [(-1, None, True), (5, 5, True), (5, 5, True), (7, 5, False), (8, 8, True)]


def test_near_dedup_links_every_text_of_a_repeated_id(spark):
    one, two = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    near = lambda words: " ".join([*words[:-1], "z"])
    rows = [(5, " ".join(one)), (5, " ".join(two)), (6, near(one)), (7, near(two)), (7, near(two)), (9, "c d e f g")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect())
    assert got == [(5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (7, 5, False), (9, 9, True)]


def test_digest_queries(spark, sf):
    from surveyloom.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {d: (a, b, hashlib.sha256(c.encode()).hexdigest()) for d, (a, b, c) in brute_words([tuple(r) for r in docs], 20).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op1_substring_dedup"](spark, sf).collect()} == want
    want = {d: (a, b, n, hashlib.sha256(c).hexdigest()) for d, (a, b, n, c) in brute_bytes([tuple(r) for r in docs], 100).items()}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op3_suffix_dedup"](spark, sf).collect()} == want


@pytest.mark.parametrize("percent", [50, 80, 85, 95, 100])
def test_every_pair_of_sizes_leaves_a_common_lookup(percent):
    kept = {n: int(retained(np.array([n]), percent)[0][0]) for n in range(1, 401)}
    spare = {n: spared(n, percent) for n in kept}
    for n in kept:
        for m in range(n, 401):
            both = -(-percent * (n + m) // (100 + percent))
            if both <= n:
                # of the values that both sets hold, so many are retained by either at least
                assert max(spare[n], spare[m]) < min(both, both - n + kept[n], both - m + kept[m]), (n, m)


@pytest.mark.parametrize(("shingle", "percent", "words"), [(3, 85, 9), (5, 80, 9)])
def test_short_texts_with_one_word_more_are_linked(spark, shingle, percent, words):
    rows = []
    for i in range(40):
        text = [f"a{i}x{k}" for k in range(words)]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text[:-1]))]
    found = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shingle, percent).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in found)
