"""Organisation: members, teams, effective-dated membership and as-of lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions.text import code


def members(surveys: DataFrame) -> DataFrame:
    """Agents and supervisors met in surveys; keys are stable hashes, so reruns agree."""
    agents = surveys.groupBy(F.col("agent_bms").alias("external_id")).agg(F.min("agent_name").alias("name")).withColumn("role", F.lit("agent"))
    leads = surveys.select(code("SUP", F.col("supervisor")).alias("external_id"), F.col("supervisor").alias("name"), F.lit("supervisor").alias("role")).distinct()
    return agents.unionByName(leads).filter("external_id is not null")


def new_members(surveys: DataFrame, known: DataFrame) -> DataFrame:
    return members(surveys).join(known.select("external_id"), "external_id", "left_anti")


def teams(surveys: DataFrame) -> DataFrame:
    return surveys.select(code("TEAM", F.col("supervisor")).alias("team"), "supervisor").distinct()


def name_conflicts(surveys: DataFrame) -> DataFrame:
    """Agents with more than one distinct trimmed name."""
    names = surveys.select("agent_bms", F.trim("agent_name").alias("n")).filter("n <> ''").distinct()
    return names.groupBy("agent_bms").agg(F.count(F.lit(1)).alias("names"), F.min("n").alias("first_name")).filter("names > 1")


def same_day_conflicts(surveys: DataFrame) -> DataFrame:
    """Agents with more than one supervisor on a day."""
    pairs = surveys.select("agent_bms", "survey_date", "supervisor").distinct()
    return pairs.groupBy("agent_bms", "survey_date").agg(F.count(F.lit(1)).alias("supervisors")).filter("supervisors > 1")


def membership_intervals(surveys: DataFrame) -> DataFrame:
    """Gaps and islands: for each agent, stretches under one supervisor; the last stays open.

    On a day with several supervisors the smallest name counts.
    """
    days = surveys.groupBy("agent_bms", "survey_date").agg(F.min("supervisor").alias("supervisor"))
    order = Window.partitionBy("agent_bms").orderBy("survey_date")
    changed = F.coalesce((F.lag("supervisor").over(order) != F.col("supervisor")).cast("int"), F.lit(0))
    islands = days.withColumn("changed", changed).withColumn("island", F.sum("changed").over(order))
    spans = islands.groupBy("agent_bms", "island", "supervisor").agg(F.min("survey_date").alias("effective_from"), F.max("survey_date").alias("last_day"))
    after = F.lead("island").over(Window.partitionBy("agent_bms").orderBy("island"))
    return spans.select("agent_bms", "supervisor", "effective_from", F.when(after.isNotNull(), F.col("last_day")).alias("effective_to"))


def as_of(rows: DataFrame, memberships: DataFrame, key: str, day: str) -> DataFrame:
    """Each row with its latest membership that covers the day; without one, nulls.

    An equi-join on the member, with the interval as a residual condition; the latest start
    wins by an aggregate, so no member's rows have to be sorted.
    """
    m = memberships.select(F.col(key).alias("__key"), F.col("supervisor").alias("as_of_supervisor"), F.col("effective_from").alias("__from"), F.col("effective_to").alias("__to"))
    days = rows.select(key, day).distinct()
    covering = days.join(m, (F.col(key) == F.col("__key")) & (F.col("__from") <= F.col(day)) & (F.col("__to").isNull() | (F.col("__to") >= F.col(day))))
    latest = covering.groupBy(key, day).agg(F.max_by("as_of_supervisor", F.struct("__from", "as_of_supervisor")).alias("as_of_supervisor"))
    return rows.join(latest, [key, day], "left")


def roster(memberships: DataFrame, day: str) -> DataFrame:
    """Who belongs to which supervisor on a day."""
    d = F.lit(day).cast("date")
    return memberships.filter((F.col("effective_from") <= d) & (F.col("effective_to").isNull() | (F.col("effective_to") >= d)))


def transfer(memberships: DataFrame, agent: str, supervisor: str, day: str) -> DataFrame:
    """Close an agent's memberships that reach the day, and open a new one from it."""
    d = F.lit(day).cast("date")
    hit = (F.col("agent_bms") == agent) & (F.col("effective_from") < d) & (F.col("effective_to").isNull() | (F.col("effective_to") >= d))
    closed = memberships.withColumn("effective_to", F.when(hit, F.date_sub(d, 1)).otherwise(F.col("effective_to")))
    opened = memberships.sparkSession.range(1).select(F.lit(agent).alias("agent_bms"), F.lit(supervisor).alias("supervisor"), d.alias("effective_from"), F.lit(None).cast("date").alias("effective_to"))
    return closed.select(*opened.columns).union(opened)


def matching_any(rows: DataFrame, wanted: DataFrame, pairs: list[tuple[str, str]], key: str) -> DataFrame:
    """Rows that match by any of several keys: a union of equi-joins instead of an OR join."""
    parts = [rows.join(wanted.select(F.col(w).alias(r)).dropna().distinct(), r, "left_semi") for r, w in pairs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates([key])
