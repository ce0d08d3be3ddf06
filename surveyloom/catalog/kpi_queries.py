"""KPI, calendar and share queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.catalog._base import CLAMPED_MEAN, MEAN, query, r4
from surveyloom.functions import scores
from surveyloom.operators import kpi
from surveyloom.sources.surveys import analyses, surveys

_KPI = f"count(*) AS survey_volume, {r4(MEAN.format('nps_score'))} AS nps, {r4(CLAMPED_MEAN.format('csat_score'))} AS csat, {r4(CLAMPED_MEAN.format('professionalism_score'))} AS professionalism, count(*) > 0 AS has_sample"
_SPAN = "survey_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"
_DENSE = f"""
d AS (SELECT agent_bms, survey_date, {_KPI} FROM surveys WHERE {_SPAN} GROUP BY 1, 2),
spine AS (SELECT agent_bms, CAST(t.day AS DATE) AS survey_date FROM (SELECT DISTINCT agent_bms FROM surveys) CROSS JOIN generate_series(DATE '2024-01-05', DATE '2024-01-20', INTERVAL 1 DAY) t(day)),
dense AS (SELECT s.agent_bms, s.survey_date, coalesce(survey_volume, 0) AS survey_volume, nps, csat, professionalism, coalesce(has_sample, FALSE) AS has_sample FROM spine s LEFT JOIN d ON s.agent_bms = d.agent_bms AND s.survey_date = d.survey_date)"""


@query("kpi_by_supervisor", f"SELECT supervisor, {_KPI} FROM surveys GROUP BY 1")
def kpi_by_supervisor(spark, sf):
    return kpi.kpis(surveys(spark, sf), "supervisor")


@query("kpi_global", f"SELECT {_KPI} FROM surveys")
def kpi_global(spark, sf):
    return kpi.kpis(surveys(spark, sf))


@query("kpi_no_sample", f"SELECT {_KPI} FROM surveys WHERE survey_date > DATE '2030-01-01'")
def kpi_no_sample(spark, sf):
    """Without surveys the scores are null and has_sample is false."""
    return kpi.kpis(surveys(spark, sf).filter("survey_date > date'2030-01-01'"))


@query("kpi_goal_comparison", f"""
k AS (SELECT supervisor, {_KPI} FROM surveys GROUP BY 1),
l AS (SELECT supervisor, 'nps' AS metric, nps AS value, 0.5::DOUBLE AS target, 0.2::DOUBLE AS warning FROM k
  UNION ALL SELECT supervisor, 'csat', csat, 0.6::DOUBLE, 0.45::DOUBLE FROM k
  UNION ALL SELECT supervisor, 'professionalism', professionalism, 0.85::DOUBLE, 0.75::DOUBLE FROM k)
SELECT supervisor, metric, value, target, {r4('(value - target)')} AS gap, coalesce(value >= target, FALSE) AS meets_goal,
  CASE WHEN value IS NULL THEN 'no_sample' WHEN value >= target THEN 'on_target' WHEN value >= warning THEN 'warning' ELSE 'critical' END AS status FROM l""")
def kpi_goal_comparison(spark, sf):
    """A custom goal given in percent replaces a default one."""
    return kpi.compare_with_goals(kpi.kpis(surveys(spark, sf), "supervisor"), ["supervisor"], kpi.goals_table(spark, {"csat": (60, 45)}))


@query("daily_series", f"SELECT survey_date, {_KPI} FROM surveys GROUP BY 1")
def daily_series(spark, sf):
    return kpi.daily(surveys(spark, sf))


@query("dense_calendar", f"{_DENSE} SELECT * FROM dense")
def dense_calendar(spark, sf):
    s = surveys(spark, sf)
    return kpi.dense_daily(s, s, "agent_bms", "2024-01-05", "2024-01-20")


def _weighted(k: str) -> str:
    x = f"CAST(sum(CAST({k} AS DECIMAL(8,4)) * survey_volume) AS DOUBLE) / CAST(nullif(sum(CASE WHEN {k} IS NOT NULL THEN survey_volume END), 0) AS DOUBLE)"
    return f"{r4('(' + x + ')')} AS {k}"


@query("weighted_daily_means", f"{_DENSE} SELECT agent_bms, CAST(sum(survey_volume) AS BIGINT) AS survey_volume, {_weighted('nps')}, {_weighted('csat')}, {_weighted('professionalism')}, count_if(has_sample) AS sampled_days FROM dense GROUP BY 1")
def weighted_daily_means(spark, sf):
    s = surveys(spark, sf)
    return kpi.weighted_means(kpi.dense_daily(s, s, "agent_bms", "2024-01-05", "2024-01-20"), "agent_bms")


@query("sentiment_counts", "SELECT supervisor, count_if(nps_score > 0) AS promoters, count_if(nps_score = 0) AS passives, count_if(nps_score < 0) AS detractors, count(*) AS total FROM surveys GROUP BY 1")
def sentiment_counts(spark, sf):
    return kpi.sentiment_counts(surveys(spark, sf), "supervisor")


@query("category_share_by_supervisor", """
v AS (SELECT supervisor, count(*) AS volume FROM surveys GROUP BY 1)
SELECT supervisor, category_name, count(*) AS n, floor(count(*) * 100.0::DOUBLE / greatest(1, any_value(volume)) * 10 + 0.5) / 10.0::DOUBLE AS percentage
FROM surveys JOIN v USING (supervisor) WHERE category_name IS NOT NULL GROUP BY 1, 2""")
def category_share_by_supervisor(spark, sf):
    return kpi.category_share(surveys(spark, sf), "supervisor")


@query("previous_period", f"""
p AS (SELECT *, CASE WHEN survey_date BETWEEN DATE '2024-01-16' AND DATE '2024-01-25' THEN 'current' WHEN survey_date BETWEEN DATE '2024-01-06' AND DATE '2024-01-15' THEN 'previous' END AS period FROM surveys)
SELECT supervisor, period, {_KPI.rsplit(',', 1)[0]} FROM p WHERE period IS NOT NULL GROUP BY 1, 2""")
def previous_period(spark, sf):
    return kpi.previous_period(surveys(spark, sf), "2024-01-16", "2024-01-25", "supervisor")


@query("top_categories_per_agent", """
c AS (SELECT agent_bms, category_name, count(*) AS n FROM surveys WHERE category_name IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY agent_bms ORDER BY n DESC, category_name) AS k FROM c)
SELECT agent_bms, string_agg(category_name, ',' ORDER BY k) AS top_categories FROM r WHERE k <= 3 GROUP BY 1""")
def top_categories_per_agent(spark, sf):
    return kpi.top_categories(surveys(spark, sf), "agent_bms")


@query("categorisation_progress", """
SELECT 9000::BIGINT AS total, count_if(status = 'completed') AS completed, count_if(status = 'failed') AS failed,
  greatest(0, 9000 - count_if(status = 'completed') - count_if(status = 'failed')) AS pending,
  floor(count_if(status = 'completed') * 100.0::DOUBLE / 9000 * 10 + 0.5) / 10.0::DOUBLE AS percentage FROM analyses""")
def categorisation_progress(spark, sf):
    return kpi.progress(analyses(spark, sf), 9000)


@query("uncategorised_surveys", "SELECT survey_id, supervisor FROM surveys s WHERE NOT EXISTS (SELECT 1 FROM analyses a WHERE a.survey_id = s.survey_id AND status = 'completed')")
def uncategorised_surveys(spark, sf):
    done = analyses(spark, sf).filter("status = 'completed'")
    return surveys(spark, sf).join(done, "survey_id", "left_anti").select("survey_id", "supervisor")


@query("surveys_in_category", "SELECT DISTINCT survey_id FROM surveys s WHERE EXISTS (SELECT 1 FROM analyses a JOIN categories USING (category_id) WHERE a.survey_id = s.survey_id AND name = 'click')")
def surveys_in_category(spark, sf):
    from surveyloom.sources.surveys import categories

    named = analyses(spark, sf).join(categories(spark, sf).filter("name = 'click'"), "category_id")
    return surveys(spark, sf).join(named, "survey_id", "left_semi").select("survey_id")


@query("category_analysis_counts", "SELECT name, count(a.survey_id) AS analyses FROM categories LEFT JOIN analyses a USING (category_id) GROUP BY 1")
def category_analysis_counts(spark, sf):
    from surveyloom.sources.surveys import categories

    counted = analyses(spark, sf).groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))
    return categories(spark, sf).join(counted, "category_id", "left").select("name", F.coalesce("n", F.lit(0)).alias("analyses"))


@query("score_variance", "SELECT supervisor, CASE WHEN count(*) < 2 THEN 0.0 ELSE floor(var_samp(professionalism_score) * 1000000 + 0.5) / 1000000 END AS variance FROM surveys GROUP BY 1")
def score_variance(spark, sf):
    return surveys(spark, sf).groupBy("supervisor").agg(scores.round_to(F.coalesce(F.var_samp("professionalism_score"), F.lit(0.0)), 6).alias("variance"))


@query("peak_day", "SELECT supervisor, max_by(survey_date, n * 100000 - date_diff('day', DATE '2020-01-01', survey_date)) AS peak_day, max(n) AS peak_volume FROM (SELECT supervisor, survey_date, count(*) AS n FROM surveys GROUP BY 1, 2) GROUP BY 1")
def peak_day(spark, sf):
    """Day of the largest volume, the earliest of ties."""
    d = surveys(spark, sf).groupBy("supervisor", "survey_date").agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy("supervisor").agg(F.max_by("survey_date", F.struct("n", -F.datediff("survey_date", F.lit("2020-01-01").cast("date")))).alias("peak_day"), F.max("n").alias("peak_volume"))


@query("data_version_digest", """
SELECT supervisor, sha256(concat(supervisor, ':2024-01-01:2024-01-31:', string_agg(survey_id, ':' ORDER BY survey_id))) AS data_version
FROM surveys WHERE tenure_days < 30 GROUP BY 1""")
def data_version_digest(spark, sf):
    """Digest over a group's sorted records."""
    s = surveys(spark, sf).filter("tenure_days < 30").groupBy("supervisor").agg(F.sort_array(F.collect_list("survey_id")).alias("ids"))
    return s.select("supervisor", F.sha2(F.concat("supervisor", F.lit(":2024-01-01:2024-01-31:"), F.concat_ws(":", "ids")), 256).alias("data_version"))


@query("scalar_scores", """
SELECT survey_id, CASE WHEN csat_score >= 0.65 THEN 'green' WHEN csat_score >= 0.55 THEN 'yellow' ELSE 'red' END AS tier,
  CASE WHEN abs(tenure_days) > 1 THEN floor(tenure_days / 100.0::DOUBLE * 10000 + 0.5) / 10000.0::DOUBLE ELSE tenure_days END AS share,
  least(1.0, greatest(-1.0, professionalism_score * 1.5::DOUBLE)) AS bounded, abs(professionalism_score * 1.5::DOUBLE - least(1.0, greatest(-1.0, professionalism_score * 1.5::DOUBLE))) > 0.00001 AS was_bounded,
  csat_score * 100.0::DOUBLE AS multiplied, csat_score - 0.8::DOUBLE AS difference, DATE '1899-12-30' + CAST(floor(45000 + tenure_days) AS INTEGER) AS from_serial FROM surveys""")
def scalar_scores(spark, sf):
    bounded, moved = scores.clamp(F.col("professionalism_score") * 1.5, -1.0, 1.0)
    return surveys(spark, sf).select(
        "survey_id", scores.tier(F.col("csat_score")).alias("tier"), scores.percentage_to_share(F.col("tenure_days").cast("double")).alias("share"), bounded.alias("bounded"), moved.alias("was_bounded"),
        kpi.computed_column(F.col("csat_score"), "multiply_100").alias("multiplied"), kpi.computed_column(F.col("csat_score"), "diff_from_target", 0.8).alias("difference"), scores.excel_date(F.lit(45000) + F.col("tenure_days")).alias("from_serial"),
    )
