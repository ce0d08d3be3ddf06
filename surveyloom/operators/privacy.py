"""Privacy: scrubbing, pseudonyms, minimised results and redacted arguments."""

from __future__ import annotations

import secrets
import string
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.text import scrubbed
from surveyloom.sources.stored import discarded, written

PREFIX = {"agent": "AGT", "agent_bms": "AGT", "agent_name": "AGT", "supervisor": "SUP", "survey": "REC", "record": "REC"}


def scrub(texts: DataFrame, column: str) -> DataFrame:
    """The column with emails, phones and accounts replaced, and a count of each."""
    clean, counts = scrubbed(F.col(column))
    return texts.withColumns({"scrubbed": clean, **counts})


def new_pseudonyms(entities: DataFrame, vault: DataFrame, scope: str, length: int = 6, draws: int = 4) -> DataFrame:
    """(scope, type, internal_id, pseudonym) of entities that the vault does not have, unique in the scope.

    The random part is a digest of a secret drawn once on the driver, of the identity and of
    the number of the draw.  In each round every entity without a pseudonym draws ``draws``
    times; a pseudonym that the vault and earlier rounds don't have goes to the first entity
    that drew it, and an entity keeps the first it got.  Rounds are written, so each plan
    reads a few tables and recomputed tasks see what was drawn; the result is read from
    them (``stored.discarded`` removes them).  Raises ValueError where the scope has fewer free pseudonyms than entities.
    """
    salt = secrets.token_hex(16)
    alphabet = string.ascii_uppercase + string.digits
    prefix = F.coalesce(F.create_map(*(F.lit(x) for kv in PREFIX.items() for x in kv))[F.lower("type")], F.lit("ENT"))
    known = vault.filter(F.col("scope") == scope)
    left = written(entities.select("type", "internal_id").distinct().join(known.select("type", "internal_id"), ["type", "internal_id"], "left_anti"))
    most = left.groupBy(prefix.alias("prefix")).count().join(known.groupBy(F.split("pseudonym", "_")[0].alias("prefix")).agg(F.count(F.lit(1)).alias("held")), "prefix", "left").agg(F.max(F.col("count") + F.coalesce("held", F.lit(0)))).first()[0] or 0
    if most > len(alphabet) ** length:
        raise ValueError(f"{most} pseudonyms of {length} letters under one prefix")
    rounds: list[DataFrame] = []
    while rounds == [] or left.count():
        digest = F.sha2(F.concat_ws("|", F.lit(salt), F.lit(scope), "type", "internal_id", F.lit(str(len(rounds))), F.col("draw").cast("string")), 256)
        pick = lambda i: F.pmod(F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("long"), F.lit(len(alphabet))).cast("int") + 1
        letters = F.concat(*(F.substr(F.lit(alphabet), pick(i), F.lit(1)) for i in range(length)))
        drawn = left.withColumn("draw", F.explode(F.array(*map(F.lit, range(draws))))).withColumn("digest", digest)
        drawn = drawn.select("type", "internal_id", "draw", F.concat_ws("_", prefix, letters).alias("pseudonym"))
        for taken in (known, *rounds):
            drawn = drawn.join(taken.select("pseudonym"), "pseudonym", "left_anti")
        owner = F.struct("type", "internal_id", "draw")
        got = drawn.groupBy("pseudonym").agg(F.min(owner).alias("x")).groupBy("x.type", "x.internal_id").agg(F.min_by("pseudonym", "x.draw").alias("pseudonym"))
        rounds.append(written(got.select(F.lit(scope).alias("scope"), "type", "internal_id", "pseudonym")))
        before, left = left, written(left.join(rounds[-1].select("type", "internal_id"), ["type", "internal_id"], "left_anti"))
        discarded(before)
    discarded(left)
    return reduce(DataFrame.union, rounds)


def minimised(result: DataFrame, vault: DataFrame, scope: str, allowed: list[str] | None = None, allow_text: bool = False) -> DataFrame:
    """Identity columns become references from the scope's vault; free text goes unless allowed.

    With ``allowed``, only those of its columns that the result has are looked at.
    """
    if allowed:
        result = result.select(*(c for c in result.columns if c in allowed))
    known = vault.filter(F.col("scope") == scope)
    for column, kind, ref in (("agent_bms", "agent", "agent_ref"), ("supervisor", "supervisor", "supervisor_ref"), ("survey_id", "record", "record_ref")):
        if column in result.columns:
            m = known.filter(F.col("type") == kind).select(F.col("internal_id").alias(column), F.col("pseudonym").alias(ref))
            result = result.join(m, column, "left").drop(column)
    return result.drop(*(c for c in ("agent_name", *([] if allow_text else ["verbatim"])) if c in result.columns))


def resolved(value: object, mapping: dict[str, str]) -> object:
    """Arguments of a call, however nested, with every pseudonym as the identity it stands for."""
    if isinstance(value, dict):
        return {k: resolved(v, mapping) for k, v in value.items()}
    if isinstance(value, list):
        return [resolved(v, mapping) for v in value]
    return mapping.get(value, value) if isinstance(value, str) else value


SENSITIVE = ("password", "secret", "token", "email", "phone", "api_key")


def redacted(value: object) -> object:
    """A nested value with everything under a sensitive key replaced."""
    if isinstance(value, dict):
        return {k: "[REDACTED]" if any(s in str(k).lower() for s in SENSITIVE) else redacted(v) for k, v in value.items()}
    return [redacted(v) for v in value] if isinstance(value, list) else value
