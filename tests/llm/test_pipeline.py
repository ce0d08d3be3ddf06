import corpus_pipeline as C
from surveyloom.llm.near_dedup import near_dedup
from tests.llm.fixtures import frame


def test_stages_on_the_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in C.STAGES[:-1]:
        before = docs.count()
        docs, _ = C.written(stage(spark, docs, sf))
        assert docs.columns == columns, name
        seen[name] = (before, docs.count())
        if name == "near_duplicates":
            assert near_dedup(docs).filter("not kept").count() == 0
    assert seen["quality"][1] < seen["quality"][0] and seen["near_duplicates"][1] < seen["near_duplicates"][0]
    assert seen["repeated_strings"][0] == seen["repeated_strings"][1]
    packed = C.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def brute_stages(rows):
    """Rows kept by near dedup, and their texts after repeated strings are gone, one after another."""
    from tests.llm.test_dedup import brute_bytes, brute_near

    kept = brute_near([(r[0], r[1]) for r in rows], 5, 80)
    rows = [r for r in rows if kept[r[0]][2]]
    texts = brute_bytes([(r[0], r[1] or "") for r in rows], 100)
    return {r[0]: None if r[1] is None else texts[r[0]][3].decode("utf-8", "ignore") for r in rows}


def test_stages_on_awkward_rows(spark, sf):
    """Null, empty, blank, one very long text, copies, near copies, repeated rows, a null id: through all stages."""
    from tests.llm.fixtures import documents

    rows = documents()
    long_text = " ".join(f"l{i * 7919 % 60013}" for i in range(60_000))
    rows += [(800, long_text, *rows[0][2:]), (801, long_text + " end", *rows[0][2:])]
    docs = frame(spark, [*rows, (None, "no id here", *rows[0][2:]), rows[0], rows[0]])
    accepted = C.STAGES[0][1](spark, docs, sf)
    assert set(accepted.columns) == set(docs.columns) - {"Score"} and accepted.count() <= docs.count()
    near, _ = C.written(C.STAGES[1][1](spark, docs, sf))
    want = brute_stages(rows)
    ids = [r.doc_id for r in near.select("doc_id").collect()]
    assert sorted(ids, key=str) == sorted([*want, None], key=str) and ids.count(rows[0][0]) <= 1 and 801 not in ids
    cut, _ = C.written(C.STAGES[2][1](spark, near, sf))
    assert cut.columns == C.COLUMNS
    got = {r.doc_id: (r.text, r.n_chars) for r in cut.collect() if r.doc_id is not None}
    assert {d: t for d, (t, _) in got.items()} == want and all(n == (None if t is None else len(t)) for t, n in got.values())
    mixed, _ = C.written(C.STAGES[3][1](spark, cut, sf))
    assert mixed.columns == C.COLUMNS and not mixed.filter("text is null or trim(text) = ''").count()
    words = lambda t: len((t or "").encode().split())
    total = sum(words(r.text) for r in cut.collect())
    assert abs(sum(words(r.text) for r in mixed.collect()) - 1.5 * total) <= 5 * 6
    packed = C.STAGES[4][1](spark, mixed, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed.select("doc_id").distinct().collect()}
    assert max(r.offset + r.length for r in packed) <= 1024


def test_stages_on_no_rows(spark, sf):
    docs = frame(spark, []).select(*C.COLUMNS)
    for _, stage in C.STAGES:
        docs, _ = C.written(stage(spark, docs, sf))
    assert docs.count() == 0


def test_no_tables_are_left(spark, sf):
    """Operators and the pipeline drop what they wrote; callers drop what a result reads."""
    from pathlib import Path

    from surveyloom.llm._io import released, shared_folder
    from surveyloom.llm.conversation_repair import repair_conversations
    from surveyloom.llm.queries import op8_nearest_neighbours, op9_top_products

    folder = Path(shared_folder(spark).removeprefix("file:"))
    tables = lambda: {p.name for p in folder.iterdir() if p.name.startswith("table-")}
    before = tables()
    docs = frame(spark)
    results = [near_dedup(docs), C.pack_documents(docs, C.tokenizer_path()), op8_nearest_neighbours(spark, sf), op9_top_products(spark, sf), C.run(spark, sf)]
    results.append(repair_conversations(spark.read.parquet(f"{sf}/conversations.parquet")))
    for result in results:
        assert result.count() > 0
        released(result)
    assert tables() == before
    # the tables that were given are not ours
    given = spark.read.parquet(f"{sf}/documents.parquet")
    released(given)
    assert given.count() > 0
