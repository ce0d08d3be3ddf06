"""Queries of the DSL: dimensions, filters, aggregations, sorting, shares and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.catalog._base import MEAN, TOP_MEAN, query
from surveyloom.operators.endpoints import calculate_metric, category_distribution, compare_metrics, custom_tool, dimension_values, run_forecast, sandbox, widget
from surveyloom.plans.dsl import run, with_share
from surveyloom.sources.surveys import analyses, categories, surveys

NPS, CSAT, PROF = MEAN.format("nps_score"), TOP_MEAN.format("csat_score"), TOP_MEAN.format("professionalism_score")


def _dsl(name: str, dsl: dict, sql: str, joined: bool = False):
    def f(spark, sf):
        extra = (analyses(spark, sf), categories(spark, sf)) if joined else ()
        return run(dsl, surveys(spark, sf), *extra)

    f.__doc__ = f"The DSL query {dsl}."
    query(name, sql)(f)


_dsl(
    "dsl_metric_by_dimension",
    {"metrics": ["nps", "csat"], "group_by": ["category", "supervisor"], "date_range": {"from": "2024-01-03", "to": "2024-01-28"}},
    f"""SELECT coalesce(name, 'Uncategorized') AS category, supervisor, {NPS} AS nps, {CSAT} AS csat, count(*) AS sample_count
    FROM surveys LEFT JOIN analyses USING (survey_id) LEFT JOIN categories USING (category_id)
    WHERE survey_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-28' GROUP BY 1, 2""",
    joined=True,
)
_dsl("dsl_global", {"metrics": ["nps", "csat", "professionalism", "survey_volume"]}, f"SELECT {NPS} AS nps, {CSAT} AS csat, {PROF} AS professionalism, count(*) AS survey_volume FROM surveys")
_dsl("dsl_agent_label", {"metric": "nps", "group_by": "agent_bms"}, f"SELECT agent_bms, {NPS} AS nps, count(*) AS sample_count, max(agent_name) AS agent_name FROM surveys GROUP BY 1")
_dsl("dsl_top_supervisors", {"metric": "csat", "group_by": ["supervisor"], "sort_by": "csat", "limit": 5}, f"SELECT supervisor, {CSAT} AS csat, count(*) AS sample_count FROM surveys GROUP BY 1 ORDER BY csat DESC, supervisor LIMIT 5")
_dsl("dsl_bottom_agents", {"metric": "professionalism", "group_by": ["agent"], "sort_by": "professionalism", "sort_order": "asc", "limit": 7}, f"SELECT agent_name AS agent, {PROF} AS professionalism, count(*) AS sample_count, max(agent_name) AS agent_name FROM surveys GROUP BY 1 ORDER BY professionalism, agent LIMIT 7")
_dsl("dsl_daily_trend", {"metrics": ["nps", "survey_volume"], "group_by": ["survey_date"], "sort_by": "survey_date", "sort_order": "asc"}, f"SELECT survey_date, {NPS} AS nps, count(*) AS survey_volume FROM surveys GROUP BY 1")
_dsl("dsl_filter_in", {"metric": "nps", "group_by": ["wave"], "filters": [{"field": "wave", "operator": "in", "value": ["BUILDING", "MACHINERY"]}, {"field": "tenure_days", "operator": ">=", "value": 100}]}, f"SELECT wave, {NPS} AS nps, count(*) AS sample_count FROM surveys WHERE wave IN ('BUILDING', 'MACHINERY') AND tenure_days >= 100 GROUP BY 1")
_dsl("dsl_filter_between", {"metric": "csat", "group_by": ["tenure"], "filters": [{"field": "tenure", "operator": "between", "value": [50, 120]}]}, f"SELECT tenure_days AS tenure, {CSAT} AS csat, count(*) AS sample_count FROM surveys WHERE tenure_days BETWEEN 50 AND 120 GROUP BY 1")
_dsl("dsl_filter_like", {"metric": "survey_volume", "group_by": ["supervisor"], "filters": [{"field": "supervisor", "operator": "like", "value": "%A%"}]}, "SELECT supervisor, count(*) AS survey_volume FROM surveys WHERE supervisor LIKE '%A%' GROUP BY 1")
_dsl("dsl_filter_category", {"metric": "nps", "group_by": ["supervisor"], "filters": [{"field": "category", "operator": "=", "value": "Uncategorized"}]}, f"SELECT supervisor, {NPS} AS nps, count(*) AS sample_count FROM surveys LEFT JOIN analyses USING (survey_id) LEFT JOIN categories USING (category_id) WHERE coalesce(name, 'Uncategorized') = 'Uncategorized' GROUP BY 1", joined=True)
_dsl("dsl_filter_compare", {"metric": "csat", "group_by": ["wave", "supervisor"], "filters": [{"field": "supervisor", "operator": "!=", "value": "NATION_3"}, {"field": "tenure_days", "operator": "<", "value": 300}, {"field": "survey_date", "operator": ">", "value": "2024-01-05"}]}, f"SELECT wave, supervisor, {CSAT} AS csat, count(*) AS sample_count FROM surveys WHERE supervisor <> 'NATION_3' AND tenure_days < 300 AND survey_date > DATE '2024-01-05' GROUP BY 1, 2")
for _kind, _sql in (("sum", "CAST(sum(CAST(csat_score AS DECIMAL(6,4))) AS DOUBLE)"), ("min", "min(csat_score)"), ("max", "max(csat_score)"), ("count", "count(csat_score)"), ("avg", MEAN.format("csat_score"))):
    _dsl(f"dsl_aggregate_{_kind}", {"metric": "csat", "aggregation": _kind, "group_by": ["wave"]}, f"SELECT wave, {_sql} AS csat, count(*) AS sample_count FROM surveys GROUP BY 1")


@query("dsl_share_after_limit", """
t AS (SELECT supervisor, count(*) AS survey_volume FROM surveys GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6)
SELECT *, floor(survey_volume * 10000.0::DOUBLE / greatest(1, (SELECT sum(survey_volume) FROM t)) + 0.5) / 100.0::DOUBLE AS percentage FROM t""")
def dsl_share_after_limit(spark, sf):
    """Shares are of the rows that the limit left."""
    return with_share(run({"metric": "survey_volume", "group_by": ["supervisor"], "limit": 6}, surveys(spark, sf)))


@query("category_distribution", """
t AS (SELECT coalesce(name, 'Uncategorized') AS category, count(*) AS survey_volume FROM surveys LEFT JOIN analyses USING (survey_id) LEFT JOIN categories USING (category_id) GROUP BY 1)
SELECT *, floor(survey_volume * 10000.0::DOUBLE / (SELECT sum(survey_volume) FROM t) + 0.5) / 100.0::DOUBLE AS percentage FROM t""")
def category_distribution_query(spark, sf):
    return category_distribution(surveys(spark, sf), analyses(spark, sf), categories(spark, sf))


@query("calculate_metric", f"SELECT coalesce({NPS}, 0.0::DOUBLE) AS value, count(*) AS total_surveys FROM surveys WHERE supervisor = 'NATION_1'")
def calculate_metric_query(spark, sf):
    return calculate_metric("nps", surveys(spark, sf), [{"field": "supervisor", "value": _nation(1)}])


@query("compare_metrics", f"SELECT wave, {NPS} AS nps, {CSAT} AS csat, count(*) AS sample_count FROM surveys WHERE wave IN ('BUILDING', 'FURNITURE') GROUP BY 1")
def compare_metrics_query(spark, sf):
    return compare_metrics(["nps", "csat"], "wave", ["BUILDING", "FURNITURE"], surveys(spark, sf))


def _nation(k: int) -> str:
    return f"NATION_{k}"


@query("dimension_values", """
SELECT 'wave' AS dimension, wave AS value FROM surveys WHERE wave IS NOT NULL AND wave <> '' GROUP BY 2
UNION ALL SELECT 'supervisor', supervisor FROM surveys GROUP BY 2
UNION ALL SELECT 'category', name FROM categories""")
def dimension_values_query(spark, sf):
    s = surveys(spark, sf)
    return dimension_values(s, ["wave", "supervisor"]).union(categories(spark, sf).select(F.lit("category"), "name"))


@query("widget_comparison", f"SELECT supervisor, {NPS} AS nps, count(*) AS sample_count FROM surveys WHERE wave = 'BUILDING' GROUP BY 1 ORDER BY nps DESC NULLS LAST, supervisor LIMIT 12")
def widget_comparison(spark, sf):
    """A dashboard's comparison of twelve supervisors at most, over one wave."""
    return widget("comparison", surveys(spark, sf), filters=[{"field": "wave", "value": "BUILDING"}])


@query("widget_category_breakdown", "SELECT coalesce(name, 'Uncategorized') AS category, count(*) AS survey_volume FROM surveys LEFT JOIN analyses USING (survey_id) LEFT JOIN categories USING (category_id) GROUP BY 1")
def widget_category_breakdown(spark, sf):
    return widget("category_breakdown", surveys(spark, sf), analyses(spark, sf), categories(spark, sf))


@query("custom_tool_query", f"SELECT wave, {CSAT} AS csat, count(*) AS sample_count FROM surveys WHERE tenure_days >= 30 AND supervisor <> 'NATION_2' GROUP BY 1 ORDER BY csat DESC NULLS LAST, wave LIMIT 3")
def custom_tool_query(spark, sf):
    """A stored template with a call's arguments: its filter, one more, and another limit."""
    template = {"metrics": ["csat"], "group_by": ["wave"], "filters": [{"field": "tenure", "operator": ">=", "value": 30}], "limit": 9}
    return run(custom_tool(template, {"filters": [{"field": "supervisor", "operator": "!=", "value": _nation(2)}], "limit": 3, "metrics": None}), surveys(spark, sf))


@query("sandbox_query", f"SELECT agent_name AS agent, {NPS} AS nps, count(*) AS sample_count, max(agent_name) AS agent_name FROM surveys GROUP BY 1 ORDER BY nps DESC NULLS LAST, agent LIMIT 50")
def sandbox_query(spark, sf):
    """A query for trying things out, cut to fifty groups whatever it asks for."""
    return run(sandbox({"metrics": ["nps"], "group_by": ["agent"], "limit": 500}), surveys(spark, sf))


@query("forecast_of_a_part", """
d AS (SELECT survey_date, count(*) AS n FROM surveys WHERE supervisor <> 'NATION_0' GROUP BY 1)
SELECT 'all' AS series, CASE WHEN count_if(n >= 20) < 28 THEN 1 ELSE 7 END AS rows, CASE WHEN count_if(n >= 20) >= 28 THEN max(survey_date) + 7 END AS last_day FROM d""")
def forecast_of_a_part(spark, sf):
    """Days that are projected from the surveys of a part."""
    out = run_forecast(surveys(spark, sf), "csat", 7, [{"field": "supervisor", "operator": "!=", "value": _nation(0)}])
    return out.groupBy("series").agg(F.count(F.lit(1)).cast("int").alias("rows"), F.max("date").alias("last_day"))
