"""Performance cases: daily results, versions and their comparison, baselines and deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.scores import round4
from surveyloom.operators import kpi


def baseline(surveys: DataFrame, opened: str, by: str) -> DataFrame:
    """KPIs of the 31 dates up to and including the opening day."""
    d = F.lit(opened).cast("date")
    return kpi.kpis(surveys.filter(F.col("survey_date").between(F.date_sub(d, 30), d)), by)


def daily_results(surveys: DataFrame, by: str, opened: str, until: str) -> DataFrame:
    return kpi.dense_daily(surveys, surveys, by, opened, until)


def new_version(versions: DataFrame, case: str) -> DataFrame:
    """(case, next version): one more than the largest so far."""
    return versions.groupBy(case).agg((F.max("version") + 1).alias("version"))


def compare_versions(a: DataFrame, b: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Full outer comparison of two versions: added, removed, changed or the same, with deltas."""
    x = a.select(*keys, *(F.col(m).alias(f"{m}_a") for m in measures), F.lit(True).alias("__a"))
    y = b.select(*keys, *(F.col(m).alias(f"{m}_b") for m in measures), F.lit(True).alias("__b"))
    j = x.join(y, keys, "full_outer")
    same = F.lit(True)
    for m in measures:
        same = same & F.col(f"{m}_a").eqNullSafe(F.col(f"{m}_b"))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(same, "same").otherwise("changed")
    deltas = [round4(F.col(f"{m}_b") - F.col(f"{m}_a")).alias(f"{m}_delta") for m in measures]
    return j.select(*keys, change.alias("change"), *(F.col(f"{m}_{s}") for m in measures for s in "ab"), *deltas)


def deltas(current: DataFrame, base: DataFrame, by: str) -> DataFrame:
    """Current KPIs minus the baseline's; null where either has no sample."""
    b = base.select(by, *(F.col(k).alias(f"base_{k}") for k in kpi.KPIS))
    return current.join(b, by, "left").select(by, "survey_volume", *kpi.KPIS, *(round4(F.col(k) - F.col(f"base_{k}")).alias(f"{k}_delta") for k in kpi.KPIS))


def primary_or_fallback(primary: DataFrame, fallback: DataFrame, by: str) -> DataFrame:
    """All rows of the first relation, and rows of the second for keys that the first lacks."""
    return primary.unionByName(fallback.join(primary.select(by).distinct(), by, "left_anti"))


#: Sampled rows for each range of case numbers; they only make the ranges even.
SAMPLES_A_RANGE = 20


def _range_of(cases: DataFrame, opened: str, key: str):
    """Number of the range that a row's (opened, key) lies in, between fixed sampled bounds."""
    ranges = int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = cases.filter(F.col(opened).isNotNull() & F.col(key).isNotNull())
    sample = known.select(opened, key).orderBy(F.xxhash64(opened, key), opened, key).limit(SAMPLES_A_RANGE * ranges).collect()
    sample = sorted({(r[0], r[1]) for r in sample})
    bounds = sample[:: max(1, -(-len(sample) // ranges))][1:]
    if not bounds:
        return F.lit(0)
    kinds = dict(cases.dtypes)
    fixed = F.array(*(F.struct(F.lit(o).cast(kinds[opened]).alias("o"), F.lit(k).cast(kinds[key]).alias("k")) for o, k in bounds))
    here = F.struct(F.col(opened).alias("o"), F.col(key).alias("k"))
    return F.size(F.filter(fixed, lambda b: b <= here))


def numbered(cases: DataFrame, opened: str, key: str) -> DataFrame:
    """Case numbers CAS-year-nnnn, counted by year in the order of opening.

    Rows are numbered inside ranges of (opened, key), after the counts of the year's
    earlier ranges, so that no task gets a whole year.
    """
    from pyspark.sql import Window

    dealt = cases.withColumn("__year", F.year(opened)).withColumn("__range", _range_of(cases, opened, key))
    counts = dealt.groupBy(F.col("__year").alias("__y"), F.col("__range").alias("__r")).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__y").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__y", "__r", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__year", "__range").orderBy(opened, key))
    rows = dealt.withColumn("__inside", inside).join(counts, F.col("__year").eqNullSafe(F.col("__y")) & (F.col("__range") == F.col("__r")))
    number = F.format_string("CAS-%d-%04d", "__year", F.col("__before") + F.col("__inside"))
    return rows.select(*(F.col(f"`{c}`") for c in cases.columns), number.alias("case_number"))


def member_days(surveys: DataFrame, members: DataFrame, memberships: DataFrame, start: str, end: str) -> DataFrame:
    """Every member on every day of a range: KPIs (null without a sample), and the supervisor in charge on that day.

    ``members`` has agent_bms.  An end before the start counts as the start.
    """
    from surveyloom.operators.org import as_of

    days = kpi.dense_daily(surveys, members, "agent_bms", start, max(start, end))
    return as_of(days, memberships, "agent_bms", "survey_date").withColumnRenamed("as_of_supervisor", "effective_supervisor")


def recalculated(days: DataFrame, versions: DataFrame) -> DataFrame:
    """(agent_bms, version, ...): a case's next version with means over its sampled days.

    ``versions`` has agent_bms and version; a case without versions gets the first.
    """
    means = kpi.weighted_means(days, "agent_bms")
    return means.join(new_version(versions, "agent_bms"), "agent_bms", "left").withColumn("version", F.coalesce("version", F.lit(1)))
