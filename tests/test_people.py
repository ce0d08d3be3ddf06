"""Names of people: matching, replacing, pseudonyms and back."""

import random

import pytest
from pyspark.sql import functions as F

from surveyloom.operators import people, privacy

LEADS = ["Majano Siliezar, Michael E", "Ramirez Pineda, Janeth C"]
AGENTS = ["Aguilar Marroquin, Fatima A", "Amaya Aguirre, Jose P"]


def table(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def matched(spark, queries, names, kind="supervisor"):
    found = people.best_matches(table(spark, queries, "q"), "q", table(spark, names, "n"), "n", kind)
    return {r.query: r.matched for r in found.collect()}


def test_profile(spark):
    (p,) = people.profiles(table(spark, [LEADS[0]], "n"), "n").collect()
    assert (p.whole, p.natural, p.words) == ("majano siliezar michael e", "michael e majano siliezar", ["majano", "siliezar", "michael"])
    assert set(p.aliases) == {"majano siliezar michael e", "michael e majano siliezar", "michael majano", "majano siliezar", "michael e", "majano", "siliezar", "michael"}
    assert [len(a) for a in p.aliases] == sorted((len(a) for a in p.aliases), reverse=True)


def test_supervisors_by_name_part_order_and_typo(spark):
    michael, janeth = LEADS
    want = {"michael": michael, "MICHAEL": michael, "janeth": janeth, "majano": michael, "siliezar": michael, "ramirez": janeth, "Michael Majano": michael, "Michael E Majano Siliezar": michael, "micheal": michael, "mayano": michael, "janet": janeth}
    nobody = ["equipo", "supervisor", "analisis", "de", "", "  ", "zzzz", "x" * 5000]
    assert matched(spark, [*want, *nobody, None], LEADS) == want


def test_agents_need_more(spark):
    assert matched(spark, ["Fatima Aguilar", "Jose Amaya", "fatma"], AGENTS, "agent") == {"Fatima Aguilar": AGENTS[0], "Jose Amaya": AGENTS[1], "fatma": AGENTS[0]}
    # three edits, or two in a short word, are penalised
    assert matched(spark, ["christop", "maira"], ["Perez, Christopher", "Lopez, Maria"], "agent") == {}


def plain(x):
    return " ".join("".join(c if c.isalnum() else " " for c in x.lower()).split())


def soundex(word):
    codes = {c: d for d, group in (("1", "bfpv"), ("2", "cgjkqsxz"), ("3", "dt"), ("4", "l"), ("5", "mn"), ("6", "r")) for c in group}
    out, last = word[:1].upper(), codes.get(word[:1], "0")
    for c in word[1:]:
        if c in "hw":
            continue
        code = codes.get(c, "0")
        if code not in ("0", last):
            out += code
        last = code
    return (out + "000")[:4]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute(query, profiles, kind):
    """Every word and alias of everybody against one text."""
    q, scores = plain(query), {}
    for p in sorted(profiles, key=lambda p: p.name):
        best = 0.0
        for w in (w for w in p.words if len(w) >= 3):
            d, n, like = edits(q, w), max(len(q), len(w)), people.similar_text(q, w)
            sound = kind == "supervisor" and soundex(q) == soundex(w)
            s = max(1 - d / n, like, 0.85 if sound else 0)
            if d > (1 if n <= 5 else 2) and not (sound and like >= 0.7):
                s *= 0.5 if n <= 5 else 0.6
            best = max(best, s)
        if kind == "supervisor":
            best = max([best, *(people.similar_text(q, a) for a in p.aliases)])
        scores[p.name] = best
    (first, a), (_, b) = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:2]
    least, distance, sure = people.ACCEPT[kind]
    return first if a >= least and (a - b >= distance or a >= sure) else None


@pytest.mark.parametrize("kind", ["supervisor", "agent"])
def test_index_loses_no_score(spark, kind):
    r = random.Random(4)
    syllables = "ma ri na lo pe ta chi es ar gon zu le fra no vic".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(2, 5)))
    names = sorted({f"{word()} {word()}, {word()}" for _ in range(40)})
    profiles = people.profiles(table(spark, names, "n"), "n").collect()
    queries = set()
    for _ in range(400):
        q = list(r.choice(r.choice(profiles).aliases))
        for _ in range(r.randrange(4)):
            at = r.randrange(len(q))
            q[at : at + r.randrange(2)] = r.choice(["", "a", "x", "e"])
            q = q or ["a"]
        queries.add("".join(q).strip() or "a")
    found = people.best_matches(table(spark, sorted(queries), "q"), "q", table(spark, names, "n"), "n", kind).collect()
    got = {x.query: x.matched for x in found if x.step == 4}
    decided = {x.query for x in found if x.step < 4}
    want = {q: brute(q, profiles, kind) for q in queries - decided if plain(q) and plain(q) not in people.STOPWORDS}
    assert got == {q: n for q, n in want.items() if n} and len(got) > 50


PEOPLE = [("bms", "4250331", "AGT_IDIDID"), ("supervisor", LEADS[0], "SUP_MICHAE"), ("supervisor", LEADS[1], "SUP_JANETH"), ("agent", AGENTS[0], "AGT_FATIMA"), ("agent", AGENTS[1], "AGT_JOSEPA")]


def test_people_in_texts_become_pseudonyms(spark):
    texts = [
        (1, "haz un analisis completo del equipo de michael y de janeth", "haz un analisis completo del equipo de SUP_MICHAE y de SUP_JANETH", 0, 2),
        (2, "haz un analisis del equipo de micheal", "haz un analisis del equipo de SUP_MICHAE", 0, 1),
        (3, "Agent 4250331, not 42503310; MAJANO  Silíezar. Fátima A and Jose Amaya", "Agent AGT_IDIDID, not 42503310; SUP_MICHAE. AGT_FATIMA and AGT_JOSEPA", 3, 1),
        (4, "Ramírez, Pineda", "SUP_JANETH", 0, 1), (5, "nobody", "nobody", 0, 0), (6, "", "", 0, 0), (7, None, None, 0, 0),
    ]
    people_table = spark.createDataFrame(PEOPLE, "kind string, name string, pseudonym string")
    t = spark.createDataFrame([x[:2] for x in texts], "id int, t string")
    got = {r.id: (r.replaced, r.agents, r.supervisors) for r in people.without_people(t, "id", "t", people_table).collect()}
    assert got == {x[0]: x[2:] for x in texts}
    with pytest.raises(ValueError, match="more than 2 people"):
        people.without_people(t, "id", "t", people_table, most=2)
    nobody = people.without_people(t, "id", "t", people_table.limit(0)).collect()
    assert {r.id: r.replaced for r in nobody} == {x[0]: x[1] for x in texts}


def test_people_of_any_number_in_texts(spark):
    n = 250_000
    ids = spark.range(n).select(F.lit("bms").alias("kind"), F.concat(F.lit("B"), F.col("id")).alias("name"), F.concat(F.lit("AGT_"), F.col("id")).alias("pseudonym"))
    agents = spark.range(20_000).select(F.lit("agent"), F.concat(F.lit("Lopez"), F.col("id"), F.lit(", Ana")), F.concat(F.lit("AG_"), F.col("id")))
    # signs only, signs at the ends, two words; a pseudonym that makes a name of a supervisor out of a text
    more = spark.createDataFrame([("bms", "#!", "AGT_SIGN"), ("bms", "c++", "AGT_CPP"), ("bms", "-x y-", "AGT_XY"), ("bms", "77", "Maria"), ("supervisor", "Zubieta, Maria", "SUP_Z")], "kind string, name string, pseudonym string")
    texts = [
        (1, "ask b7, B249999 and xB8", "ask AGT_7, AGT_249999 and xB8", 2, 0), (2, "a#!b c++ -x y- cx", "aAGT_SIGNb AGT_CPP AGT_XY cx", 3, 0), (3, "77 Zubieta, and Ana  Lopez19999", "SUP_Z, and AG_19999", 2, 1), (4, None, None, 0, 0), (None, "B1", "AGT_1", 1, 0),
    ]
    t = spark.createDataFrame([x[:2] for x in texts], "id int, t string")
    got = {r.id: (r.replaced, r.agents, r.supervisors) for r in people.without_people(t, "id", "t", ids.union(agents).union(more)).collect()}
    assert got == {x[0]: x[2:] for x in texts}


def test_reidentified_texts(spark):
    vault = spark.range(100_000).select(F.concat(F.lit("AGT_"), F.lpad("id", 6, "0")).alias("pseudonym"), F.concat(F.lit("Person "), F.col("id")).alias("internal_id"))
    t = spark.createDataFrame([(1, "AGT_000007 and AGT_099999, AGT_000007."), (2, "XAGT_000007 AGT_0000070 SUP_UNKNOWN"), (3, None), (4, "none")], "id int, t string")
    got = {r.id: r.named for r in people.reidentified(t, "id", "t", vault).collect()}
    assert got == {1: "Person 7 and Person 99999, Person 7.", 2: "XAGT_000007 AGT_0000070 SUP_UNKNOWN", 3: None, 4: "none"}
    assert people.reidentified(t, "id", "t", vault, allowed=False).filter("named <=> t").count() == 4


def test_many_pseudonyms_against_a_large_vault(spark):
    vault = spark.range(200_000).select(F.lit("s").alias("scope"), F.lit("agent").alias("type"), F.concat(F.lit("old"), "id").alias("internal_id"), F.concat(F.lit("AGT_"), F.lpad(F.upper(F.conv(F.col("id").cast("string"), 10, 36)), 4, "0")).alias("pseudonym"))
    entities = spark.range(100_000).select(F.lit("agent").alias("type"), F.concat(F.lit("new"), "id").alias("internal_id"))
    made = privacy.new_pseudonyms(entities, vault, "s", length=4)
    row = made.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pseudonym").alias("p"), F.countDistinct("internal_id").alias("i")).first()
    assert tuple(row) == (100_000,) * 3 and made.join(vault, "pseudonym").count() == 0
    with pytest.raises(ValueError, match="pseudonyms of 1"):
        privacy.new_pseudonyms(entities.limit(50), vault, "s", length=1)
    # only the rounds of the result are left, until they are discarded
    from pathlib import Path

    from surveyloom.sources.stored import discarded, shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    left = {p.name for p in folder.iterdir()}
    discarded(made)
    assert {p.name for p in folder.iterdir()} < left and vault.count() == 200_000
