"""Names of people: profiles, the known person that a text means, people replaced in texts.

Known people are a table.  Their profiles (aliases and words) are indexed by whole alias, by
word, by what is left of a word after up to two deletions, by sound, and by pairs of
letters; a query meets only the profiles that share such a key.  Those keys lose nothing:
words within two edits share a remainder, and texts that are similar enough to count
share two letters that stand next to each other or have one letter between them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.sources.stored import written

# fixed values: words that are never a person
STOPWORDS = """
de del la las el los un una unos unas y o e en para por con sin sobre a al
equipo supervisor supervisora supervisores sup agente agentes asesor asesora asesores rep ejecutivo
analisis datos metricas metrica nps csat profesionalismo encuesta encuestas cuenta cliente clientes
verbatim verbatims comentarios comentario team leader tl promedio desempeno rendimiento calidad
todo todos todas hola como cual cuales quien quienes que haz hacer dame muestra mostrar ver quiero favor
buenos dias tardes noches informacion detalle completo general total grupo ola wave mes semana dia fecha
bajo alto mejor peor ranking tabla grafico comparativa
""".split()

#: Least score, distance to the second best, and the score that needs no distance.
ACCEPT = {"supervisor": (0.78, 0.12, 0.90), "agent": (0.80, 0.15, 0.90)}
#: Below this no score changes a decision: the least score less the distance.
RELEVANT = 0.65
_ACCENTED, _PLAIN = "áéíóúüñ", "aeiouun"


def plain(x: Column) -> Column:
    """Lower case without accents, only letters and digits, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(x), _ACCENTED, _PLAIN), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def _words(x: Column, least: int) -> Column:
    return F.filter(F.split(x, " "), lambda w: F.length(w) >= least)


def profiles(people: DataFrame, name: str) -> DataFrame:
    """(name, whole, natural, words, aliases) of each known person; "Surnames, Given" is also turned round.

    Aliases have three letters or more, are no stop word, and stand longest first.
    """
    known = people.select(F.col(name).cast("string").alias("name")).filter(F.trim("name") != "").distinct()
    halves = F.split("name", ",", 2)
    turned = F.size(halves) == 2
    surnames, given = F.when(turned, plain(halves[0])).otherwise(""), F.when(turned, plain(F.get(halves, F.lit(1)))).otherwise("")
    rows = known.select("name", plain(F.col("name")).alias("whole"), surnames.alias("surnames"), given.alias("given"))
    natural = F.when(F.col("name").contains(","), F.trim(F.concat_ws(" ", "given", "surnames"))).otherwise(F.col("whole"))
    heads = F.get(_words(F.col("given"), 2), F.lit(0)), F.get(_words(F.col("surnames"), 2), F.lit(0))
    short = F.when(F.col("name").contains(","), F.coalesce(F.concat(heads[0], F.lit(" "), heads[1]), F.lit(""))).otherwise(F.col("whole"))
    rows = rows.select("*", natural.alias("natural"), short.alias("short"), _words(F.col("whole"), 2).alias("words"))
    aliases = F.array_distinct(F.concat(F.array("whole", "natural", "short", "surnames", "given"), F.col("words")))
    aliases = F.filter(aliases, lambda a: (F.length(a) >= 3) & ~a.isin(STOPWORDS))
    longest = F.transform(F.array_sort(F.transform(aliases, lambda a: F.struct((-F.length(a)).alias("n"), a.alias("a")))), lambda x: x["a"])
    return rows.select("name", "whole", "natural", "words", longest.alias("aliases"))


def similar_text(a: str, b: str) -> float:
    """Twice the matching characters over all: the longest common run, and so on left and right of it."""
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similar_text(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _remainders(word: Column) -> Column:
    """A word, and what is left of it after one or two deletions."""
    without = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    once = F.when(F.length(word) > 1, without(word)).otherwise(F.array(F.lit("")))
    twice = F.flatten(F.transform(once, lambda w: F.when(F.length(w) > 1, without(w)).otherwise(F.array(F.lit("")))))
    return F.array_distinct(F.concat(F.array(word), once, twice))


def _letter_pairs(text: Column) -> Column:
    """Pairs of letters next to each other or with one between."""
    n = F.length(text)
    pair = lambda gap: F.when(n > gap, F.transform(F.sequence(F.lit(1), n - gap), lambda i: F.concat(F.substring(text, i, F.lit(1)), F.substring(text, i + gap, F.lit(1))))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(pair(1), pair(2)))


def _edit_score(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def _scores(asked: DataFrame, known: DataFrame, kind: str) -> DataFrame:
    """(q, name, score) wherever the score may count; ``asked`` has q."""
    similar = F.pandas_udf(_similar, "double")
    words = known.select("name", F.explode("words").alias("word")).filter(F.length("word") >= 3)
    # texts much longer than any word or alias are like none
    longest = known.agg(F.max(F.array_max(F.transform("words", F.length))).alias("__word"), F.max(F.array_max(F.transform("aliases", F.length))).alias("__alias"))
    asked = asked.crossJoin(F.broadcast(longest)).filter(F.length("q") <= (2 / RELEVANT - 1) * F.greatest("__word", "__alias"))
    near = asked.filter(F.length("q") <= F.col("__word") + 2).select("q", F.explode(_remainders(F.col("q"))).alias("key")).join(words.select("word", F.explode(_remainders(F.col("word"))).alias("key")).distinct(), "key").select("q", "word")
    if kind == "supervisor":
        near = near.union(asked.select("q", F.soundex("q").alias("key")).join(words.select("word", F.soundex("word").alias("key")).distinct(), "key").select("q", "word"))
    near = near.distinct().select("*", F.levenshtein("q", "word").alias("edits"), similar("q", "word").alias("like"))
    sound = F.soundex("q") == F.soundex("word") if kind == "supervisor" else F.lit(False)
    longest = F.greatest(F.length("q"), F.length("word"))
    score = F.greatest(_edit_score(F.col("q"), F.col("word")), "like", F.when(sound, 0.85).otherwise(0.0))
    # a short word may differ by one edit, a longer one by two, unless it sounds the same and is alike
    far = (F.col("edits") > F.when(longest <= 5, 1).otherwise(2)) & ~(sound & (F.col("like") >= 0.70))
    out = near.select("q", "word", F.when(far, score * F.when(longest <= 5, 0.5).otherwise(0.6)).otherwise(score).alias("score")).join(words, "word").select("q", "name", "score")
    if kind == "supervisor":
        # the whole text against whole aliases; the edit distance bounds the similarity from above
        aliases = known.select("name", F.explode("aliases").alias("alias"))
        keyed = asked.select("q", F.explode(_letter_pairs(F.col("q"))).alias("key")).join(aliases.select("alias", F.explode(_letter_pairs(F.col("alias"))).alias("key")).distinct(), "key")
        pairs = keyed.select("q", "alias").distinct().filter(F.levenshtein("q", "alias") <= (1 - RELEVANT) * (F.length("q") + F.length("alias")))
        out = out.union(pairs.select("q", "alias", similar("q", "alias").alias("score")).join(aliases, "alias").select("q", "name", "score"))
    return out.groupBy("q", "name").agg(F.max("score").alias("score")).filter(F.col("score") > RELEVANT)


def best_matches(asked: DataFrame, column: str, people: DataFrame, name: str, kind: str = "supervisor") -> DataFrame:
    """(query, matched): for each distinct text the known person it means.

    In this order: the name itself in any case; the whole name, its natural order or an alias;
    for supervisors, all its words of three letters and more among the words of one person
    only; else the most similar person, if similar enough and clearly more so than the second.
    Stop words mean nobody.  Of equals the first name counts.  Texts that mean nobody are
    not in the result.
    """
    least, distance, sure = ACCEPT[kind]
    known = profiles(people, name)
    queries = asked.select(F.col(column).cast("string").alias("query")).distinct().select("query", F.trim("query").alias("trimmed"))
    queries = queries.filter("trimmed <> ''").select("query", "trimmed", plain(F.col("trimmed")).alias("q"))
    itself = queries.join(known.select("name", F.lower("name").alias("low")), F.lower("trimmed") == F.col("low")).select("query", F.lit(1).alias("step"), "name")
    usable = queries.filter((F.col("q") != "") & ~F.col("q").isin(STOPWORDS))
    keys = known.select("name", F.explode(F.array_distinct(F.concat(F.array("whole", "natural"), "aliases"))).alias("q"))
    steps = itself.union(usable.join(keys, "q").select("query", F.lit(2).alias("step"), "name"))
    if kind == "supervisor":
        tokens = usable.select("query", F.array_distinct(F.filter(F.split("q", " "), lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS))).alias("tokens"))
        held = tokens.select("query", F.size("tokens").alias("n"), F.explode("tokens").alias("word")).join(known.select("name", F.explode(F.array_distinct("words")).alias("word")), "word")
        whole = held.groupBy("query", "name").agg(F.count(F.lit(1)).alias("found"), F.first("n").alias("n")).filter("found = n")
        steps = steps.union(whole.groupBy("query").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("k")).filter("k = 1").select("query", F.lit(3).alias("step"), "name"))
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "name")
    texts = usable.select("q").distinct()
    ranked = _scores(texts, known, kind).select("q", "name", "score", F.row_number().over(best).alias("k")).filter("k <= 2")
    two = ranked.groupBy("q").agg(F.max(F.when(F.col("k") == 1, F.struct("name", "score"))).alias("first"), F.coalesce(F.max(F.when(F.col("k") == 2, F.col("score"))), F.lit(0.0)).alias("second"))
    sound = (F.col("first.score") >= least) & ((F.col("first.score") - F.col("second") >= distance) | (F.col("first.score") >= sure))
    steps = steps.union(usable.join(two.filter(sound).select("q", F.col("first.name").alias("name")), "q").select("query", F.lit(4).alias("step"), "name"))
    return steps.groupBy("query").agg(F.min(F.struct("step", "name")).alias("x")).select("query", F.col("x.name").alias("matched"), F.col("x.step").alias("step"))


_FOLD = str.maketrans(_ACCENTED + _ACCENTED.upper(), _PLAIN * 2)
# separators between words: commas, points and all white space are one space
_FLAT = _FOLD | {i: " " for i in range(0x3001) if chr(i).isspace() or chr(i) in ",."}


def flat(text: str) -> tuple[str, Sequence[int]]:
    """A text in lower case with plain letters and single spaces, and the place of each of its letters in the text."""
    low = (text.lower() if len(text.lower()) == len(text) else "".join(c.lower()[:1] for c in text)).translate(_FLAT)
    if "  " not in low:
        return low, range(len(low))
    where = [i for i, c in enumerate(low) if c != " " or not i or low[i - 1] != " "]
    return "".join(low[i] for i in where), where


class Automaton:
    """Some phrases looked for at once; longer phrases go first, wherever they stand."""

    def __init__(self, tokens: dict[str, str]) -> None:
        import ahocorasick

        self.tokens = tokens
        self.machine = ahocorasick.Automaton()
        for phrase in tokens:
            self.machine.add_word(phrase, phrase)
        self.machine.make_automaton()

    def replaced(self, text: str) -> tuple[str, int]:
        """The text with every phrase at word bounds replaced, and how many different ones there were."""
        if not self.tokens:
            return text, 0
        low, where = flat(text)
        found = []
        for end, phrase in self.machine.iter(low):
            begin = end - len(phrase) + 1
            inside = (begin and _is_word(low[begin - 1]) and _is_word(phrase[0])) or (end + 1 < len(low) and _is_word(low[end + 1]) and _is_word(phrase[-1]))
            if not inside:
                found.append((-len(phrase), begin, phrase))
        taken, spans = [False] * len(low), []
        for n, begin, phrase in sorted(found):
            if not any(taken[begin : begin - n]):
                taken[begin : begin - n] = [True] * -n
                spans.append((where[begin], where[begin - n - 1] + 1, phrase))
        for begin, end, phrase in sorted(spans, reverse=True):
            text = text[:begin] + self.tokens[phrase] + text[end:]
        return text, len({phrase for _, _, phrase in spans})


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


_WORD = re.compile(r"\b[^\W_]{4,}\b")


_RUN = re.compile(r"\w+")
#: So many phrases are sent to every task; more of them meet the texts in a shuffle.
FEW = 10_000


def phrase_key(phrase: str) -> tuple[int, str]:
    """How many words a phrase has, and its part from the first to the last of them; without words, its first sign.

    Wherever a phrase stands at word bounds, its words are whole words of the text, so the
    text has the same part.
    """
    runs = list(_RUN.finditer(phrase))
    return (len(runs), phrase[runs[0].start() : runs[-1].end()]) if runs else (0, phrase.strip()[:1])


def text_keys(text: str | None, sizes: list[int]) -> list[str]:
    """Keys of all phrases that may stand in a text, where phrases have so many words."""
    low = flat(text or "")[0]
    runs = [m.span() for m in _RUN.finditer(low)]
    keys = {low[runs[i][0] : runs[i + n - 1][1]] for n in sizes if n for i in range(len(runs) - n + 1)}
    return sorted(keys | ({c for c in low if c != " " and not _is_word(c)} if 0 in sizes else set()))


def _ids(ids: DataFrame) -> DataFrame:
    """(phrase, pseudonym) of ids; of those that read alike the last name counts."""
    fold = F.pandas_udf(lambda x: x.map(lambda n: str(n).lower().translate(_FOLD) if n is not None and str(n).strip() else None), "string")
    named = ids.select(F.col("name").cast("string").alias("name"), "pseudonym").filter("name is not null")
    return named.select(fold("name").alias("phrase"), "name", "pseudonym").filter("phrase is not null").groupBy("phrase").agg(F.max_by("pseudonym", F.struct("name", "pseudonym")).alias("pseudonym"))


def _aliases(people: DataFrame) -> DataFrame:
    """(phrase, pseudonym) of all aliases; of equal aliases the first name counts, of its pseudonyms the first."""
    first = profiles(people, "name").select("name", F.explode("aliases").alias("phrase")).groupBy("phrase").agg(F.min("name").alias("name"))
    return first.join(people.groupBy(F.col("name").cast("string").alias("name")).agg(F.min("pseudonym").alias("pseudonym")).hint("merge"), "name").select("phrase", "pseudonym")


def _met(texts: DataFrame, key: str, column: str, phrases: DataFrame) -> DataFrame | None:
    """(k, phrase, pseudonym): the phrases that each text may hold; None if there are no phrases."""
    keyed = F.pandas_udf(lambda x: pd.DataFrame([phrase_key(p) for p in x], columns=["words", "part"]), "words int, part string")
    phrases = phrases.withColumn("__key", keyed("phrase")).select("phrase", "pseudonym", "__key.words", F.col("__key.part").alias("part"))
    kinds = phrases.groupBy("words").count().collect()
    if not kinds:
        return None
    sizes = sorted(r["words"] for r in kinds)
    parts = F.pandas_udf(lambda x: x.map(lambda t: text_keys(t, sizes)), "array<string>")
    few = sum(r["count"] for r in kinds) <= FEW
    found = texts.select(F.col(key).alias("k"), F.explode(parts(column)).alias("part")).join(F.broadcast(phrases) if few else phrases.hint("merge"), "part")
    return found.select("k", "phrase", "pseudonym")


def without_people(texts: DataFrame, key: str, column: str, people: DataFrame, most: int | None = None) -> DataFrame:
    """Adds ``replaced``, ``agents`` and ``supervisors``: known people become their pseudonyms.

    ``people`` has kind (bms, supervisor or agent), name (or id) and pseudonym, and may be of
    any size, unless ``most`` says how many there may be (ValueError): texts and phrases are
    joined by whole words, so a text meets only phrases whose words it has.  ``key`` names a
    column that tells texts apart.  Ids go first, then aliases of supervisors, longest first, then
    words of four letters and more that mean one supervisor though misspelt (looked up once for
    each distinct word of all texts), then aliases of agents.  Each step reads the text that
    the one before left.  The counts are of different ids and aliases replaced.  A null text
    stays null.
    """
    names = people.select(F.lower("kind").alias("kind"), "name", "pseudonym")
    if most is not None and names.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} people to look for")
    # supervisors are looked up in many ways; written, so that only one reads all people
    leads, agents = written(names.filter("kind = 'supervisor'").distinct()), names.filter("kind = 'agent'")
    words = texts.select(F.col(key).alias("k"), F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(r"(?<![\p{L}\p{N}_])([\p{L}\p{N}]{4,})(?![\p{L}\p{N}_])"), F.lit(1)))).alias("word"))
    # written, as the ways of looking them up would each read all texts again
    means = best_matches(written(words.select("word").distinct()), "word", leads, "name").join(leads.select(F.col("name").alias("matched"), "pseudonym"), "matched").groupBy("query").agg(F.min("pseudonym").alias("pseudonym"))
    meant = words.join(means, F.col("word") == F.col("query")).select("k", F.col("word").alias("phrase"), "pseudonym")

    def replaced(rows: DataFrame, hits: dict[str, DataFrame | None], count: str) -> DataFrame:
        """One step: phrases, then words looked up, each text with its own."""
        listed = [hit.withColumn("what", F.lit(what)) for what, hit in hits.items() if hit is not None]
        if not listed:
            return rows
        pairs = lambda what: F.map_from_entries(F.collect_set(F.when(F.col("what") == what, F.struct("phrase", "pseudonym")))).alias(f"__{what}")
        own = reduce(DataFrame.union, listed).groupBy("k").agg(*map(pairs, hits)).hint("merge")
        return rows.join(own, F.col(key).eqNullSafe(F.col("k")), "left").drop("k").withColumn("__x", F.pandas_udf(_step, "t string, n long")("__text", "__phrases")).withColumns({"__text": F.col("__x.t"), count: F.col(count) + F.col("__x.n")}).drop("__x", "__phrases")

    rows = texts.withColumns({"__text": F.col(column), "agents": F.lit(0).cast("long"), "supervisors": F.lit(0).cast("long")})
    rows = replaced(rows, {"phrases": _met(rows, key, "__text", _ids(names.filter("kind = 'bms'"))), "words": meant}, "agents")
    rows = replaced(rows, {"phrases": _met(rows, key, "__text", _aliases(leads))}, "supervisors")
    rows = rows.withColumn("__x", F.pandas_udf(_looked_up, "t string, n long")("__text", "__words")).withColumns({"__text": F.col("__x.t"), "supervisors": F.col("supervisors") + F.col("__x.n")})
    rows = replaced(rows, {"phrases": _met(rows, key, "__text", _aliases(agents))}, "agents")
    return rows.select(*texts.columns, F.col("__text").alias("replaced"), "agents", "supervisors")


def _step(texts: pd.Series, phrases: pd.Series) -> pd.DataFrame:
    """Each text with its own phrases replaced, and how many different ones there were."""
    return pd.DataFrame([(t, 0) if t is None or not own else Automaton(dict(own)).replaced(t) for t, own in zip(texts, phrases, strict=True)], columns=["t", "n"])


def _looked_up(texts: pd.Series, words: pd.Series) -> pd.DataFrame:
    """Each text with its words of four letters and more replaced by what they mean, and how many different ones there were."""
    out = []
    for text, own in zip(texts, words, strict=True):
        own = dict(own) if own is not None else {}
        hits = [w for w in dict.fromkeys(_WORD.findall(text)) if w in own] if own and text is not None else []
        for word in hits:
            text = re.sub(rf"\b{re.escape(word)}\b", lambda _, by=own[word]: by, text)
        out.append((text, len(hits)))
    return pd.DataFrame(out, columns=["t", "n"])


def reidentified(texts: DataFrame, key: str, column: str, vault: DataFrame, allowed: bool = True) -> DataFrame:
    """Adds ``named``: pseudonyms of a text, at word bounds, as the names they stand for, for readers who may see them.

    ``vault`` has pseudonym and internal_id and may be of any size: the pseudonyms that occur
    are joined with it, so a text meets only its own.
    """
    if not allowed:
        return texts.withColumn("named", F.col(column))
    occurs = texts.select(F.col(key).alias("k"), F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(r"\b([A-Z]{3}_[A-Z0-9]+)\b"), F.lit(1)))).alias("pseudonym"))
    own = occurs.join(vault.select("pseudonym", "internal_id"), "pseudonym").groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("pseudonym", "internal_id"))).alias("__names"))
    # pieces before and after each token, in turn; a piece that is a known token becomes its name
    pieces = F.split(F.col(column), r"(?<=\b[A-Z]{3}_[A-Z0-9]{1,60}\b)|(?=\b[A-Z]{3}_[A-Z0-9]{1,60}\b)")
    named = F.array_join(F.transform(pieces, lambda x: F.coalesce(F.try_element_at("__names", x), x)), "")
    joined = texts.join(own, F.col(key).eqNullSafe(F.col("k")), "left")
    return joined.select(*texts.columns, F.when(F.col("__names").isNull(), F.col(column)).otherwise(named).alias("named"))
