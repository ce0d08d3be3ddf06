"""KPI aggregates, goals, daily series on a dense calendar, and period comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.functions.scores import exact, goal_status, round4, round_to, sentiment, top_box_clamped

KPIS = ("nps", "csat", "professionalism")
#: Default targets and warning thresholds.
GOALS = {"nps": (0.5, 0.2), "csat": (0.8, 0.7), "professionalism": (0.85, 0.75)}


def kpi_columns() -> list[Column]:
    """Volume and rounded scores of a group; scores are null without surveys."""
    n = F.count(F.lit(1))
    score = lambda x: round4(F.try_divide(F.sum(exact(x)).cast("double"), n))
    return [
        n.alias("survey_volume"),
        round4(F.try_divide(F.sum(exact(F.col("nps_score"))).cast("double"), F.count("nps_score"))).alias("nps"),
        score(top_box_clamped(F.col("csat_score"))).alias("csat"),
        score(top_box_clamped(F.col("professionalism_score"))).alias("professionalism"),
        (n > 0).alias("has_sample"),
    ]


def kpis(surveys: DataFrame, *by: str) -> DataFrame:
    return surveys.groupBy(*by).agg(*kpi_columns())


def goals_table(spark: SparkSession, custom: dict[str, tuple[float, float | None]] | None = None) -> DataFrame:
    """(metric, target, warning); values beyond 1 are percentages."""
    share = lambda v: None if v is None else round(v / 100.0, 4) if abs(v) > 1 else float(v)
    rows = [(k, share(t), share(w)) for k, (t, w) in (GOALS | (custom or {})).items()]
    return spark.createDataFrame(rows, "metric string, target double, warning double")


def compare_with_goals(values: DataFrame, by: list[str], goals: DataFrame) -> DataFrame:
    """One row per group and metric: value, target, gap, whether it is met, and status."""
    long = values.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in KPIS))).alias("x")).select(*by, "x.*")
    joined = long.join(goals, "metric")
    return joined.select(*by, "metric", "value", "target", round4(F.col("value") - F.col("target")).alias("gap"), F.coalesce(F.col("value") >= F.col("target"), F.lit(False)).alias("meets_goal"), goal_status(F.col("value"), F.col("target"), F.col("warning")).alias("status"))


def daily(surveys: DataFrame, *by: str) -> DataFrame:
    return kpis(surveys, *by, "survey_date")


def dense_daily(surveys: DataFrame, keys: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Every key on every day; days without surveys have volume 0 and null scores, never 0."""
    spine = keys.select(by).distinct().withColumn("survey_date", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))))
    days = daily(surveys.filter(F.col("survey_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))), by)
    return spine.join(days, [by, "survey_date"], "left").withColumns({"survey_volume": F.coalesce("survey_volume", F.lit(0)), "has_sample": F.coalesce("has_sample", F.lit(False))})


def weighted_means(days: DataFrame, *by: str) -> DataFrame:
    """Means of daily scores, weighted by volume, over days with a sample."""
    # daily scores have four decimals: exact sums do not depend on row order
    def mean(k: str) -> Column:
        return round4(F.try_divide(F.sum(F.col(k).cast("decimal(8,4)") * F.col("survey_volume")).cast("double"), F.sum(F.when(F.col(k).isNotNull(), F.col("survey_volume"))).cast("double"))).alias(k)

    return days.groupBy(*by).agg(F.sum("survey_volume").alias("survey_volume"), *(mean(k) for k in KPIS), F.count_if("has_sample").alias("sampled_days"))


def weighted_totals(rows: DataFrame) -> DataFrame:
    """One row: volume and means weighted by volume; 0 where there is nothing to weigh."""
    return weighted_means(rows).fillna(0).fillna(0.0, subset=list(KPIS))


def sentiment_counts(surveys: DataFrame, *by: str) -> DataFrame:
    s = surveys.withColumn("__s", sentiment(F.col("nps_score")))
    count = lambda k: F.count_if(F.col("__s") == k)
    return s.groupBy(*by).agg(count("promoter").alias("promoters"), count("passive").alias("passives"), count("detractor").alias("detractors"), F.count(F.lit(1)).alias("total"))


def category_share(surveys: DataFrame, *by: str) -> DataFrame:
    """Analysed surveys by category, as a share of the group's volume, one decimal."""
    counts = surveys.groupBy(*by, "category_name").agg(F.count(F.lit(1)).alias("n"))
    totals = surveys.groupBy(*by).agg(F.count(F.lit(1)).alias("volume"))
    joined = counts.filter("category_name is not null").join(totals, list(by)) if by else counts.filter("category_name is not null").crossJoin(F.broadcast(totals))
    return joined.select(*by, "category_name", "n", round_to(F.col("n") * 100.0 / F.greatest(F.lit(1), "volume"), 1).alias("percentage"))


def previous_period(surveys: DataFrame, start: str, end: str, *by: str) -> DataFrame:
    """KPIs of a period and of the equally long one before it, in one pass."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    days = F.datediff(b, a) + 1
    phase = F.when(F.col("survey_date").between(a, b), "current").when(F.col("survey_date").between(F.date_sub(a, days), F.date_sub(a, 1)), "previous")
    split = kpis(surveys.withColumn("period", phase).filter("period is not null"), *by, "period")
    return split.drop("has_sample")


def top_categories(surveys: DataFrame, by: str, k: int = 3) -> DataFrame:
    """The k most frequent categories of each group, as a list in order."""
    from pyspark.sql import Window

    counts = surveys.filter("category_name is not null").groupBy(by, "category_name").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.col("n").desc(), "category_name"))).filter(F.col("rank") <= k)
    return ranked.groupBy(by).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("rank", "category_name"))), lambda x: x["category_name"])).alias("top_categories"))


def progress(analyses: DataFrame, total: int) -> DataFrame:
    """Completed, failed and pending of ``total``, and the percentage completed (100 of none)."""
    done, failed = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed")
    out = analyses.agg(F.lit(total).cast("long").alias("total"), done.alias("completed"), failed.alias("failed"))
    return out.withColumn("pending", F.greatest(F.lit(0), F.col("total") - F.col("completed") - F.col("failed"))).withColumn("percentage", F.when(F.col("total") > 0, round_to(F.col("completed") * 100.0 / F.col("total"), 1)).otherwise(100.0))


def computed_column(value: Column, kind: str, target: float = 1.0) -> Column:
    """Columns that dashboards derive from a metric; ``target`` is the factor of a custom one.

    Without a positive target there is no percentage of it.
    """
    if kind == "percent_of_target":
        return value / target * 100.0 if target > 0 else F.lit(None).cast("double")
    if kind == "diff_from_target":
        return value - target
    if kind == "multiply_100":
        return value * 100.0
    if kind == "custom":
        return value * target
    raise ValueError(f"unknown computed column {kind!r}")
