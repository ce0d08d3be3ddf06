import numpy as np
import pytest

from surveyloom.llm import quality, toxicity, url_filter
from tests.llm.fixtures import frame


@pytest.fixture(scope="module")
def tables(spark):
    good = [(i, f"The report number {i} describes how teams work together. It is short, and it reads well.", 1, 0) for i in range(0, 300)]
    bad = [(i, f"### $$$ click%%% now&&& {i} *** ||| $$$ ### idiot scum %%%", 0, 1) for i in range(300, 420)]
    rows = good + bad
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t, _, _ in rows] + [(None, "plain words here", "x", "y"), (900, None, "x", "y"), (901, "", "x", "y"), (902, " \n", "x", "y"), (0, rows[0][1], "x", "y")], "doc_id long, text string, Score string, y string")
    labels = spark.createDataFrame([(d, q, t) for d, _, q, t in rows] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


@pytest.mark.parametrize(("score", "label", "modulus", "fold"), [(quality.score_quality, "quality", 4, 2), (toxicity.score_toxicity, "toxic", 5, 0)])
def test_held_out_accuracy(spark, tables, score, label, modulus, fold):
    import zlib

    docs, labels = tables
    out = score(docs, labels)
    assert {"doc_id", "text", "y", "held_out", "score", "predicted"} <= set(out.columns) and "Score" not in out.columns
    rows = out.collect()
    truth = {r.doc_id: r[label] for r in labels.collect() if r[label] is not None}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == fold)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 20 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_no_labels_and_no_rows(spark, tables, score):
    docs, labels = tables
    assert score(docs, labels.limit(0)).count() == docs.count()
    assert score(docs.limit(0), labels).count() == 0


def test_additive_tables_learn_an_interaction():
    r = np.random.default_rng(1)
    x = r.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y, rounds=10, pair_rounds=60, pairs=2)
    assert (1, 0) in model.pairs and ((model.scores(x) > 0.5) == y).mean() > 0.95


def test_network_gradient():
    r = np.random.default_rng(0)
    net = toxicity.Network(1)
    x = r.standard_normal((5, 2 * toxicity.EMBED)).astype(np.float32)
    steps, mask = r.integers(0, 5, (6, 4)), np.ones((6, 4), bool)
    mask[4:, 2] = False
    loss = lambda: float(net.forward(x, steps, mask).sum())
    keep: dict = {}
    net.forward(x, steps, mask, keep)
    g, dx = net.backward(x, steps, mask, keep, np.ones(4, np.float32))
    for name, at in (("hf", (3, 2)), ("hb", (17, 1)), ("xf", (5, 3)), ("cb", (9, 0)), ("att_w", (2, 5)), ("out", (3,)), ("att_v", (1,))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=2e-3), name
    old = x[2, 1]
    x[2, 1] = old + 1e-2
    up = loss()
    x[2, 1] = old - 1e-2
    assert dx[2, 1] == pytest.approx((up - loss()) / 2e-2, rel=0.05, abs=2e-3)


def test_windows_cover_all_words():
    counts = np.array([0, 1, 47, 48, 49, 84, 85, 500])
    first = np.cumsum(counts) - counts
    doc, start, n = toxicity.windows_of(counts, first)
    for d, c in enumerate(counts):
        words = {w for s, k in zip(start[doc == d], n[doc == d]) for w in range(s - first[d], s - first[d] + k)}
        assert words == set(range(c))


def test_urls(spark):
    urls = {
        "http://A.net/x": ("a.net", "/x", "net/", "block"), "https://m.example.NET/en/25#top": ("m.example.net", "/en/25", "example.net/en/", "allow"),
        "x://example.com/de/?q": ("example.com", "/de/", "example.com/de/", "block"), "http://notexample.com/de/": ("notexample.com", "/de/", None, None),
        "http://b.org/fr/1": ("b.org", "/fr/1", "org/fr/", "allow"), "http://c.net?x=/": ("c.net", "", None, None), "no scheme/net/": ("", "", None, "allow"),
        "http://d.net/a://b/c": ("d.net", "/a://b/c", "net/", "block"), "://net/": ("net", "/", "net/", "block"), "": ("", "", None, "allow"),
    }
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(99, None, "h")]
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, Host string")).collect()}
    assert got[None] == ("", "", None, "allow")
    for u, (h, p, rule, verdict) in urls.items():
        assert got[u][:3] == (h, p, rule) and (verdict is None or got[u][3] == verdict), u
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_model_learns_its_table(spark):
    rows = [(i, u) for i, (u, _) in enumerate(url_filter.LABELLED)]
    got = {r.url: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=[]).collect()}
    assert all(got[u] == ("block" if y else "allow") for u, y in url_filter.LABELLED)


def test_fixture_rows_are_scored(spark, tables):
    assert quality.score_quality(frame(spark), tables[1]).count() == frame(spark).count()


def test_training_takes_one_text_of_a_repeated_id(spark, monkeypatch):
    from surveyloom.llm import quality, toxicity

    rows = [(1, f"text number {i} of the same document") for i in range(40)] + [(i, f"another text {i}") for i in range(2, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 12)], "doc_id long, quality int, toxic int")
    learnt = {}
    monkeypatch.setattr(quality, "train", lambda x, y: learnt.update(quality=len(y)))
    monkeypatch.setattr(toxicity, "fit", lambda windows, y: learnt.update(toxicity=len(y)))
    quality.train_quality(docs, labels)
    toxicity.train_toxicity(docs, labels)
    assert learnt["quality"] == quality.labelled_sample(labels, "quality", 4, 2, 100).count()
    assert learnt["toxicity"] == toxicity.labelled_sample(labels, "toxic", 5, 0, 100).count()


def test_url_verdicts_are_those_of_the_trained_model(spark):
    """The score in DataFrame functions against the regression that was trained, on urls whose grams repeat."""
    r = np.random.default_rng(6)
    parts = ["win", "casino", "news", "aaa", "-", "/", "example", ".com", "xxx", "guide", "2021", "buy", "/de/", "wiki", "É", "//"]
    urls = ["http://" + "".join(r.choice(parts, int(r.integers(0, 14)))) for _ in range(3000)] + ["http://", "nothing"]
    w = np.array(url_filter.weights(), float)
    got = {x.url: x for x in url_filter.judge_urls(spark.createDataFrame([(u,) for u in set(urls)], "url string"), rules=[]).collect()}
    verdicts = set()
    for u in set(urls):
        x = np.zeros(len(w))
        grams = url_filter.gram_buckets(got[u].host, got[u].path)
        np.add.at(x, grams, 1 / np.sqrt(max(len(grams), 1)))
        x[-1] = 1
        score = float(x @ w)
        verdicts.add(got[u].verdict)
        assert abs(score) < 8 or got[u].verdict == ("block" if score > 0 else "allow"), u
    assert verdicts == {"allow", "block"}


def test_a_long_text_is_learnt_from_whole(monkeypatch):
    """All windows of a text go into training, also where they pass in several parts; the held part counts nowhere."""
    filler = [f"plain{i}" for i in range(90)]
    r = np.random.default_rng(1)
    texts, y = [], []
    for i in range(120):
        words = r.choice(filler, 400).tolist()
        if i % 2:
            words[int(r.integers(100, 300))] = "vile"
        texts.append([" ".join(words[a : a + 48]).encode() for a in range(0, 360, 36)])
        y.append(i % 2)
    y = np.array(y, float)
    scores = []
    for at_once in (4096, 100):
        monkeypatch.setattr(toxicity, "WINDOWS_AT_ONCE", at_once)
        net = toxicity.fit(texts, y, epochs=40, batch=24)
        import pyarrow as pa

        (chunk,) = toxicity.T.chunks(pa.array([" ".join(r.choice(filler, 300).tolist() + extra) for extra in ([], ["vile"]) for _ in range(20)]))
        score = net.document_scores(chunk)
        assert (score[20:] > 0.5).mean() > 0.9 and (score[:20] < 0.5).mean() > 0.9
        scores.append(score)


def ranking(scored, labels, label):
    """Area under the curve on held-out rows, precision and recall of the predictions."""
    rows = scored.filter("held_out").join(labels.select("doc_id", label), "doc_id").select("score", "predicted", label).collect()
    order = np.argsort(np.argsort([r.score for r in rows], kind="stable"), kind="stable")
    y, said = np.array([r[label] for r in rows]) == 1, np.array([r.predicted for r in rows]) == 1
    area = (order[y].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (~y).sum())
    return area, (y & said).sum() / max(1, said.sum()), (y & said).sum() / y.sum()


def test_quality_on_the_labels_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    area, precision, recall = ranking(quality.score_quality(docs, labels), labels, "quality")
    assert area > 0.97 and precision > 0.95 and recall > 0.95


def test_toxicity_on_the_labels_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    area, precision, recall = ranking(toxicity.score_toxicity(docs, labels), labels, "toxic")
    assert area > 0.95 and precision > 0.9 and recall > 0.84


def test_a_very_long_text_alone(spark):
    words = " ".join(f"word{i % 997}" for i in range(150_000))
    docs = spark.createDataFrame([(1, words), (2, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in (1, 2, 3)], "doc_id long, quality int, toxic int")
    for scored in (quality.score_quality(docs, labels), toxicity.score_toxicity(docs, labels)):
        assert all(0 <= r.score <= 1 for r in scored.collect())


def test_training_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "w " * 50 * i) for i in range(1, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    learnt = []
    whole, toxicity.fit = toxicity.fit, lambda texts, y: learnt.append(sum(len(w) for own in texts for w in own[:1]))
    try:
        toxicity.train_toxicity(docs, labels)
        toxicity.train_toxicity(docs, labels, size=5_000)
    finally:
        toxicity.fit = whole
    assert 0 < learnt[1] < learnt[0]
