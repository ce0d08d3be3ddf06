"""Repair of conversations to the role pattern ``(s?(ua)+)?`` by cheapest edits.

Edits of a turn: Keep (0), Rerole to user or assistant (3), Delete (4, the only one for
blank and duplicate turns); an empty user or assistant turn may be Inserted anywhere (3).  A
truncated turn that is not deleted costs 3 more.

Grammar states are four: nothing yet, after the system turn, after a user turn, after an
assistant turn.  For each turn one integer holds all cost layers: its c-th group of four bits
is the set of states from which the turns from here on can be brought to acceptance at cost
c.  Layers of a turn follow from those of the next one by shifts and masks, all costs at
once.  The first layer with the entry state is the cost; a walk through the bits that takes
the least letter on a path of that cost gives the least audit.

Turns are dealt by ranges of (conversation, turn), so a conversation of any length is spread
over tasks in segments of bounded size.  Most conversations are one segment.  Of the others
each segment gives its cost from every state to every state; one row per segment is chained,
backwards for the cost that remains after it and forwards for the state that it begins in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm._io import dropped, tidy, written

#: Turns and bytes of text in a segment.
SEGMENT_TURNS, SEGMENT_BYTES = 512, 1 << 22
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
REROLE, DELETE, INSERT, OPEN = 3, 4, 3, 3
#: States from which a role may follow, and the state after it.
STEPS = {"s": (0b0001, 1), "u": (0b1011, 2), "a": (0b0100, 3)}
#: Role that a new or reroled turn gets in each state.
NEXT = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}
#: Cost of ending in each state, and the edits of that: inserts up to an assistant turn.
ENDING, TAIL = (0, 6, 3, 0), ("", "II", "I", "")
LEGAL = frozenset(("su", "ua", "au"))


def fault_of(text: str) -> int:
    """Fault of a turn by its text alone."""
    last = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1:]
    return BLANK if not last else 0 if last in ".!?" else TRUNCATED


def _before(layers: int, role: str, ones: int) -> int:
    """Layers of the states from which a turn of this role leads into ``layers``."""
    states, after = STEPS[role]
    reached = (layers >> after) & ones
    out = 0
    for q in range(4):
        if states >> q & 1:
            out |= reached << q
    return out


def _either(layers: int, ones: int) -> int:
    """The same for a role of choice: user, or assistant after a user turn."""
    return _before(layers, "u", ones) | _before(layers, "a", ones)


def cost_layers(turns: list[tuple[str, int]], ending: tuple[int, ...]) -> list[int]:
    """Layers before each turn and after the last one; ``turns`` are (role initial, fault), ``ending`` costs by final state (negative: not allowed)."""
    most = max(ending)
    layers = 0
    for state, cost in enumerate(ending):
        if cost >= 0:
            layers |= 1 << (4 * cost + state)
    out = [layers]
    for left, (initial, fault) in enumerate(reversed(turns), 1):
        # nothing costs more than deleting all turns and adding two
        width = 4 * (DELETE * left + most + 2 * INSERT + 1)
        ones = ((1 << width) - 1) // 15
        after, layers = layers, layers << 4 * DELETE
        if fault not in (BLANK, DUPLICATE):
            extra = OPEN if fault == TRUNCATED else 0
            if initial in STEPS:
                layers |= _before(after, initial, ones) << 4 * extra
            layers |= _either(after, ones) << 4 * (REROLE + extra)
        for _ in range(2):
            layers |= _either(layers, ones) << 4 * INSERT
        layers &= (1 << width) - 1
        out.append(layers)
    return out[::-1]


def least_cost(layers: int, state: int) -> int:
    """First layer that holds a state; -1 if none does."""
    own = (layers >> state) & (((1 << (layers.bit_length() + 4) // 4 * 4) - 1) // 15)
    return ((own & -own).bit_length() - 1) // 4 if own else -1


def least_audit(turns: list[tuple[str, int]], layers: list[int], state: int) -> tuple[str, int, int]:
    """(edits, their last state, cost) of the ASCII-least cheapest edits from a state on."""
    cost = left = least_cost(layers[0], state)
    has = lambda at, q, c: c >= 0 and layers[at] >> (4 * c + q) & 1
    out, i = [], 0
    while i < len(turns):
        initial, fault = turns[i]
        bound = fault in (BLANK, DUPLICATE)
        extra = OPEN if fault == TRUNCATED else 0
        chosen = STEPS[NEXT[state]][1]
        if has(i + 1, state, left - DELETE):
            out.append("D")
            i, left = i + 1, left - DELETE
        elif has(i, chosen, left - INSERT):
            out.append("I")
            state, left = chosen, left - INSERT
        elif not bound and initial in STEPS and STEPS[initial][0] >> state & 1 and has(i + 1, STEPS[initial][1], left - extra):
            out.append("K")
            i, state, left = i + 1, STEPS[initial][1], left - extra
        else:
            out.append("R")
            i, state, left = i + 1, chosen, left - REROLE - extra
    return "".join(out), state, cost


def applied(audit: str, state: int, roles: list[str], texts: list[str]) -> list[dict]:
    """The turns that edits leave."""
    out, at = [], 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        if edit == "K":
            role, text, initial = roles[at], texts[at], roles[at][:1]
        else:
            initial = NEXT[state]
            role, text = ROLES[initial], "" if edit == "I" else texts[at]
        at += edit != "I"
        state = STEPS[initial][1]
        out.append({"role": role, "text": text})
    return out


_TURNS = "turns array<struct<role:string,text:string>>"
_SEGMENT = f"conv_id long, place long, alone boolean, low long, high long, distinct_turns long, first string, last string, illegal long, blank long, duplicate long, truncated long, cost long, audit string, digests array<binary>, {_TURNS}"
_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("place", pa.int64()), ("alone", pa.bool_()), ("low", pa.int64()), ("high", pa.int64()), ("distinct_turns", pa.int64()), ("first", pa.string()), ("last", pa.string())]
    + [(k, pa.int64()) for k in ("illegal", "blank", "duplicate", "truncated", "cost")]
    + [("audit", pa.string()), ("digests", pa.list_(pa.binary())), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
)


def _counted(faults: list[int]) -> dict:
    return {"blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED)}


def _segment(rows: list[tuple], place: int, alone: bool) -> dict:
    """A segment's row; a conversation that is one segment is repaired at once."""
    turns = [r[1] for r in rows if r[1] is not None]
    roles, texts = [r[2] for r in rows], [r[3] for r in rows]
    initials = [r[:1] for r in roles]
    out = {
        "conv_id": rows[0][0], "place": place, "alone": alone, "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "distinct_turns": len(set(turns)), "first": initials[0], "last": initials[-1],
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials[:-1], initials[1:], strict=True)),
    }
    if not alone:
        digests = [hashlib.sha256(f"{r[0]}\0{len(r[2])}\0{r[2]}{r[3]}".encode("utf-8", "surrogatepass")).digest()[:16] for r in rows]
        return out | {"digests": digests, "turns": [{"role": a, "text": b} for a, b in zip(roles, texts, strict=True)]}
    seen, faults = set(), []
    for pair in zip(roles, texts, strict=True):
        fault = fault_of(pair[1])
        faults.append(DUPLICATE if fault != BLANK and pair in seen else fault)
        seen.add(pair)
    own = list(zip(initials, faults, strict=True))
    audit, state, cost = least_audit(own, cost_layers(own, ENDING), 0)
    audit += TAIL[state]
    return out | _counted(faults) | {"cost": cost, "audit": audit, "turns": applied(audit, 0, roles, texts)}


def _batches(rows: Iterator[dict], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= SEGMENT_BYTES or len(held) >= 5000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in names), strict=True)


def _weight(row: dict) -> int:
    return sum(len(t["text"]) for t in row["turns"])


def _segments(limit: int):
    """Sorted turns of a task -> segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32

        def found() -> Iterator[dict]:
            number, held, size, cut, first = 0, [], 0, False, True
            for row in _rows(batches, "conv_id", "turn", "role", "text"):
                if held and row[0] != held[-1][0]:
                    # the first conversation of a task may have begun in another one
                    yield _segment(held, part + number, not cut and not first)
                    number, held, size, cut, first = number + 1, [], 0, False, False
                elif len(held) >= limit or size >= SEGMENT_BYTES:
                    yield _segment(held, part + number, False)
                    number, held, size, cut = number + 1, [], 0, True
                held.append(row)
                size += len(row[3])
            if held:
                yield _segment(held, part + number, False)

        return _batches(found(), _ARROW, _weight)

    return run


def _own(turns: list[dict], repeated: list[int] | None) -> list[tuple[str, int]]:
    again = set(repeated or ())
    out = []
    for k, t in enumerate(turns):
        fault = fault_of(t["text"])
        out.append((t["role"][:1], DUPLICATE if fault != BLANK and k in again else fault))
    return out


def _crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least cost through a segment from each state (rows of four) to each state; -1 where there is no way."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("costs", pa.list_(pa.int64())), *((k, pa.int64()) for k in ("blank", "duplicate", "truncated"))])

    def found() -> Iterator[dict]:
        for conv, place, turns, repeated in _rows(batches, "conv_id", "place", "turns", "repeated"):
            own = _own(turns, repeated)
            ways = [cost_layers(own, tuple(0 if q == to else -1 for q in range(4)))[0] for to in range(4)]
            yield {"conv_id": conv, "place": place, "costs": [least_cost(ways[to], at) for at in range(4) for to in range(4)]} | _counted([f for _, f in own])

    return _batches(found(), schema, lambda _: 0)


def _remaining(group: pd.DataFrame) -> pd.DataFrame:
    """Cost that remains after each segment of a conversation, by state."""
    group = group.sort_values("place")
    ending, out = list(ENDING), []
    for costs in reversed(group["costs"].tolist()):
        out.append(list(ending))
        ending = [min(int(costs[4 * at + to]) + ending[to] for to in range(4) if costs[4 * at + to] >= 0) for at in range(4)]
    return pd.DataFrame({"place": group["place"], "ending": out[::-1]})


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least edits of a segment from each state, given what remains after it."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("audits", pa.list_(pa.string())), ("states", pa.list_(pa.int64()))])

    def found() -> Iterator[dict]:
        for conv, place, turns, repeated, ending in _rows(batches, "conv_id", "place", "turns", "repeated", "ending"):
            own, least = _own(turns, repeated), min(ending)
            layers = cost_layers(own, tuple(x - least for x in ending))
            ways = [least_audit(own, layers, q) for q in range(4)]
            yield {"conv_id": conv, "place": place, "audits": [w[0] for w in ways], "states": [w[1] for w in ways]}

    return _batches(found(), schema, lambda row: sum(map(len, row["audits"])))


def _chosen(group: pd.DataFrame) -> pd.DataFrame:
    """State that each segment of a conversation begins in, and its edits; inserts after the last turn are the last segment's."""
    group = group.sort_values("place")
    state, entries, audits = 0, [], []
    for own, states in zip(group["audits"], group["states"], strict=True):
        entries.append(state)
        audits.append(own[state])
        state = int(states[state])
    audits[-1] += TAIL[state]
    return pd.DataFrame({"place": group["place"], "entry": entries, "audit": audits})


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in _ARROW if f.name not in ("digests", "turns", "alone", "cost")]

    def found() -> Iterator[dict]:
        for row in _rows(batches, *names, "entry", "repeated", "turns"):
            out, (entry, repeated, turns) = dict(zip(names, row, strict=False)), row[-3:]
            own = iter(_own(turns, repeated))
            cost = 0
            for edit in out["audit"]:
                fault = 0 if edit == "I" else next(own)[1]
                cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (OPEN if fault == TRUNCATED and edit != "D" else 0)
            yield out | {"alone": False, "cost": cost, "turns": applied(out["audit"], entry, [t["role"] for t in turns], [t["text"] for t in turns])}

    return _batches(found(), _ARROW, _weight)


def repair_conversations(rows: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """Segments of repaired conversations: counts of faults, edits and the turns that remain.

    ``rows`` needs conv_id, turn, role and text; other columns are ignored.  Null roles and
    texts are one space; a null conv_id is a conversation of its own; null turns come first.
    Turns of one number follow their role and text.  A turn is blank if it has no character
    but white space, else a duplicate if a turn before it has its role and text, else
    truncated if its last such character is none of ``.!?``.

    One row per segment, ``place`` ordering those of a conversation: conv_id, place, alone
    (whether it is the whole conversation for sure), low, high and distinct_turns of turn
    numbers, first and last role initial, illegal (neighbours in it whose initials are not su,
    ua or au), blank, duplicate, truncated, cost, audit (a letter for each edit: D, I, K, R)
    and turns (array of role and text).  ``conversation_audits`` and ``repaired_turns``
    read it.  An empty table gives an empty table.

    All segments are written to the shared folder; a task holds one batch of them.
    """
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(k).cast("string"), F.lit(" ")).alias(k) for k in ("role", "text")))
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    # long texts are no bounds of ranges; their first letters are
    dealt = turns.repartitionByRange(*keys, F.substring("text", 1, 32)).sortWithinPartitions(*keys, F.col("text"))
    segments, segments_at = written(dealt.mapInArrow(tidy(_segments(segment_turns)), _SEGMENT))
    spread = segments.filter("not alone").drop("blank", "duplicate", "truncated", "cost", "audit", "alone")

    # conversations of several segments: duplicates by their digests
    digests = spread.select("place", F.posexplode("digests").alias("at", "digest"), "turns").select("place", "at", "digest")
    first = digests.groupBy("digest").agg(F.min(F.struct("place", "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    repeated = digests.join(first, "digest").filter(F.struct("place", "at") > F.col("first")).groupBy("place").agg(F.collect_list("at").alias("repeated"))
    spread, spread_at = written(spread.drop("digests").join(repeated, "place", "left"))
    crossings, crossings_at = written(spread.mapInArrow(tidy(_crossings), "conv_id long, place long, costs array<long>, blank long, duplicate long, truncated long"))
    remaining = crossings.groupBy("conv_id").applyInPandas(_remaining, "place long, ending array<long>")
    ways = spread.select("conv_id", "place", "turns", "repeated").join(remaining, "place").mapInArrow(tidy(_ways), "conv_id long, place long, audits array<string>, states array<long>")
    chosen = ways.groupBy("conv_id").applyInPandas(_chosen, "place long, entry long, audit string")
    counts = crossings.drop("conv_id", "costs")
    whole = spread.join(counts, "place").join(chosen, "place").mapInArrow(tidy(_repaired), _SEGMENT)
    out, _ = written(segments.filter("alone").drop("digests").unionByName(whole.drop("digests")))
    for path in (segments_at, spread_at, crossings_at):
        dropped(rows.sparkSession, path)
    return out


def conversation_audits(segments: DataFrame) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost and audit.

    Gaps are turn numbers that are missing between the smallest and the largest one.
    """
    sums = ("blank", "duplicate", "truncated", "cost")
    alone = segments.filter("alone").select("conv_id", (F.coalesce(F.col("high") - F.col("low") + 1, F.lit(0)) - F.col("distinct_turns")).alias("gaps"), *sums, "illegal", "audit")
    own = Window.partitionBy("conv_id").orderBy("place")
    spread = segments.filter("not alone").select("*", F.lag("high").over(own).alias("before"), F.lag("last").over(own).alias("last_before"))
    seam = F.col("last_before").isNotNull() & ~F.concat("last_before", "first").isin(*LEGAL)
    distinct = F.col("distinct_turns") - F.when(F.col("low") == F.col("before"), 1).otherwise(0)
    spread = spread.groupBy("conv_id").agg(
        (F.coalesce(F.max("high") - F.min("low") + 1, F.lit(0)) - F.sum(distinct)).alias("gaps"), *(F.sum(k).alias(k) for k in sums), F.sum(F.col("illegal") + seam.cast("long")).alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    return alone.unionByName(spread)


def repaired_turns(segments: DataFrame) -> DataFrame:
    """(conv_id, place, at, role, text): the turns that remain, in the order of place and at."""
    return segments.select("conv_id", "place", F.posexplode("turns").alias("at", "t")).select("conv_id", "place", "at", "t.role", "t.text")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def found() -> Iterator[dict]:
        now, digest, empty = None, None, True
        for conv, turns in _rows(batches, "conv_id", "turns"):
            if digest is None or conv != now:
                if digest is not None:
                    yield {"conv_id": now, "repaired_sha256": digest.hexdigest()}
                now, digest, empty = conv, hashlib.sha256(), True
            for t in turns:
                digest.update(f"{'' if empty else chr(10)}{t['role']}:{t['text']}".encode("utf-8", "surrogatepass"))
                empty = False
        if digest is not None:
            yield {"conv_id": now, "repaired_sha256": digest.hexdigest()}

    return _batches(found(), schema, lambda _: 0)


def repaired_digests(segments: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): hash of the lines ``role:text`` of each conversation; long ones stream through one task each."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    spread = segments.filter("not alone").select("conv_id", "place", "turns").repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(tidy(_hashed), "conv_id long, repaired_sha256 string")
    return segments.filter("alone").select("conv_id", F.sha2(lines, 256).alias("repaired_sha256")).unionByName(spread)
