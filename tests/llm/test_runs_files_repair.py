import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.llm import conversation_repair as C
from surveyloom.llm.periodic_runs import kept_words, periodic_runs, runs_of
from surveyloom.llm.queries import made_periodic, tokenizer_path
from surveyloom.llm.token_files import Reader, ids_of, planes_of, read_token_files, write_token_files
from tests.llm.fixtures import documents, frame


def brute_runs(words, least=12):
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e, q) for (s, e), q in best.items()), key=lambda x: (x[0], x[2]))


def periodic_words(r):
    n, letters = r.randrange(90), r.choice([1, 2, 3, 5, 30])
    words = [r.randrange(letters) for _ in range(n)]
    if n and r.random() < 0.6:
        a = r.randrange(n)
        p = 1 + (n - a) // r.randrange(2, 9)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    if r.random() < 0.3:
        words = words + words[: r.randrange(len(words) + 1)] + words
    if r.random() < 0.3:
        extra = [r.randrange(letters) for _ in range(3)]
        words = words + extra + words + extra
    return words


@pytest.mark.parametrize("least", [8, 9, 12])
def test_runs_equal_brute_force(least):
    r, total = random.Random(least), 0
    for _ in range(400):
        docs = [periodic_words(r) for _ in range(r.randrange(1, 5))]
        bounds = np.append(0, np.cumsum([len(d) for d in docs])).astype(np.int64)
        want = [(s + b, e + b, q) for d, b in zip(docs, bounds.tolist()) for s, e, q in brute_runs(d, least)]
        got = runs_of(np.array([w for d in docs for w in d], np.int64), bounds, least)
        assert [tuple(x) for x in got.tolist()] == want
        total += len(want)
    assert total > 1000


def test_kept_words_are_first_periods():
    words = [0, 1] * 8 + [7]
    assert kept_words(17, runs_of(np.array(words), np.array([0, 17]))).tolist() == [True] * 2 + [False] * 14 + [True]


def test_periodic_runs_on_awkward_documents(spark):
    rows = [*documents(), (None, "a b " * 9, "en", "s", None, "v", "h", "s", "k"), (None, "a b " * 9, "en", "s", None, "v", "h", "s", "k")]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in periodic_runs(frame(spark, rows)).collect()))
    want = []
    for r in rows:
        words = (r[1] or "").encode().split()
        runs = brute_runs(words)
        gone = {i for s, e, q in runs for i in range(s + q, e)}
        want.append((r[0] is None, r[0] or 0, len(words), [(s, e - s, q) for s, e, q in runs], b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    assert got == sorted(want) and sum(len(x[3]) for x in want) > 5
    with pytest.raises(ValueError, match="least"):
        periodic_runs(frame(spark, rows), 7)
    assert periodic_runs(frame(spark, rows).limit(0)).count() == 0


def test_a_long_periodic_text(spark):
    text = " ".join(f"w{i % 7}" for i in range(200_000))
    (row,) = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(x.start, x.length, x.period) for x in row.runs] == [(0, 200_000, 7)] and row.collapsed == "w0 w1 w2 w3 w4 w5 w6"


def test_a_tenth_of_documents_is_made_periodic(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 40))) for i in range(300)] + [(5000, None), (None, "a b")]
    for r in made_periodic(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = dict(rows)[r.doc_id]
        words, h = (text or "").split(), zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[i if i < a else a + (i - a) % p] for i in range(n))
        assert r.text == text


@pytest.mark.parametrize("bits", [True, False])
def test_planes_are_lossless(bits):
    r = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (7, 2), (64, 50_257), (999, 1 << 17), (16_384, 1 << 32)):
        ids = r.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
        planes = planes_of(ids, bits)
        assert np.array_equal(ids_of(planes, n, bits), ids) and len(planes) == -(-int(ids.max(initial=0)).bit_length() // (1 if bits else 8))


@pytest.mark.parametrize(("bits", "block", "file"), [(True, 64, 2000), (False, 1 << 14, 1 << 23)])
def test_token_files_round_trip(spark, tmp_path, bits, block, file):
    from pyarrow import fs
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = [*documents(), (None, "no id", "en", "s", None, "v", "h", "s", "k"), (3, "again", "en", "s", None, "v", "h", "s", "k")]
    folder = write_token_files(frame(spark, rows), tokenizer_path(), str(tmp_path / "ids"), bits=bits, block_ids=block, file_ids=file)
    got = read_token_files(spark, folder, bits).orderBy("start").collect()
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    want = sorted((str(r[0]), [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    # a block alone, by the chunk index
    files = sorted((tmp_path / "ids").glob("*.ids"))
    assert len(files) > (3 if file == 2000 else 0)
    with fs.LocalFileSystem().open_input_file(str(files[0])) as stream:
        reader = Reader(stream, bits)
        whole = np.concatenate(list(reader.documents()))
        last = len(reader.blocks) - 1
        assert np.array_equal(reader.block(last), whole[last * block :]) and reader.n_ids == len(whole)


def test_token_files_of_nothing_and_of_what_is_no_file(spark, tmp_path):
    folder = write_token_files(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path(), str(tmp_path / "none"))
    assert read_token_files(spark, folder).count() == 0
    with pytest.raises(ValueError, match="multiple"):
        write_token_files(frame(spark), tokenizer_path(), block_ids=12)
    from pyarrow import BufferReader

    with pytest.raises(ValueError, match="not a file"):
        Reader(BufferReader(b"x" * 100), True)


def brute_repair(rows):
    """Least (cost, edits, turns) over all edits, state by state; and the faults."""
    step = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    full = {"u": "user", "a": "assistant"}

    def inserted(best):
        best = dict(best)
        for _ in range(4):
            for q in list(best):
                role = "a" if q == 2 else "u"
                cost, edits, turns = best[q]
                way, to = (cost + 3, edits + "I", (*turns, (full[role], ""))), step[role, q]
                best[to] = min(best.get(to, way), way)
        return best

    best, seen, faults = inserted({0: (0, "", ())}), set(), []
    for role, text in rows:
        shown = text.strip(" \t\n\v\f\r")
        fault = 1 if not shown else 2 if (role, text) in seen else 0 if shown[-1] in ".!?" else 3
        seen.add((role, text))
        faults.append(fault)
        ways = []
        for q, (cost, edits, turns) in best.items():
            ways.append((q, (cost + 4, edits + "D", turns)))
            if fault in (0, 3):
                if (role[:1], q) in step:
                    ways.append((step[role[:1], q], (cost + fault, edits + "K", (*turns, (role, text)))))
                ways += [(step[r, q], (cost + fault + 3, edits + "R", (*turns, (full[r], text)))) for r in "ua" if (r, q) in step]
        best = {}
        for to, way in ways:
            best[to] = min(best.get(to, way), way)
        best = inserted(best)
    return min(best[q] for q in (0, 3) if q in best), faults


def conversation(r, n):
    return [(r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "s"]), r.choice(["a.", "b", "c!", " ", "", "d?", "e. ", "f.", "g.", "h."]) if r.random() < 0.8 else f"t{r.randrange(99)}.") for _ in range(n)]


def test_least_edits_equal_brute_force():
    r = random.Random(5)
    for _ in range(1500):
        rows = conversation(r, r.randrange(1, 12))
        got = C._segment([(1, i, *x) for i, x in enumerate(rows)], 0, True)
        (cost, audit, turns), faults = brute_repair(rows)
        assert (got["cost"], got["audit"], tuple((x["role"], x["text"]) for x in got["turns"])) == (cost, audit, turns)
        assert [got["blank"], got["duplicate"], got["truncated"]] == [faults.count(k) for k in (1, 2, 3)]


@pytest.mark.parametrize("segment", [3, 512])
def test_conversations_of_any_length_are_repaired(spark, segment):
    r = random.Random(7)
    rows, want = [], {}
    for conv in [None, *range(60)]:
        turns = conversation(r, 300 if conv == 17 else r.randrange(1, 9))
        numbers = sorted((r.randrange(12) if conv != 17 else i // 2 for i, _ in enumerate(turns)))
        numbers = [None] * (r.random() < 0.2) + numbers[: len(turns) - 1] + numbers if len(turns) > 1 and conv != 17 else numbers
        numbers = numbers[: len(turns)]
        ordered = sorted(zip(numbers, turns), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        (cost, audit, kept), faults = brute_repair([x[1] for x in ordered])
        known = [x[0] for x in ordered if x[0] is not None]
        initials = [x[1][0][:1] for x in ordered]
        gaps = known[-1] - known[0] + 1 - len(set(known)) if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest()
        want[conv] = (gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, sha, kept)
        rows += [(conv, n, role, text, "x", 1) for n, (role, text) in ordered]
    r.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string, low long").repartition(3)
    segments = C.repair_conversations(table, segment)
    assert segments.filter("not alone").count() >= (100 if segment == 3 else 2)
    digests = {x.conv_id: x.repaired_sha256 for x in C.repaired_digests(segments).collect()}
    turns = {}
    for x in C.repaired_turns(segments).orderBy("place", "at").collect():
        turns.setdefault(x.conv_id, []).append((x.role, x.text))
    got = {x.conv_id: (x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit, digests[x.conv_id], tuple(turns.get(x.conv_id, ()))) for x in C.conversation_audits(segments).collect()}
    assert got == want


def test_nulls_in_turns_are_one_space_and_nothing_stays_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    segments = C.repair_conversations(spark.createDataFrame([(1, None, None, "hi."), (1, None, "user", None)], schema))
    (row,) = C.conversation_audits(segments).collect()
    assert (row.gaps, row.blank, row.illegal, row.cost, row.audit) == (0, 1, 1, 8, "DD")
    assert C.conversation_audits(C.repair_conversations(spark.createDataFrame([], schema))).count() == 0
    assert segments.select(F.size("turns")).collect()[0][0] == 0
