import pytest
from pyspark.sql import functions as F

from surveyloom.functions.formula import FormulaError, compile_formula
from surveyloom.operators.endpoints import WIDGETS, custom_tool, widget
from surveyloom.plans.dsl import plan, run, validate
from surveyloom.sources.surveys import surveys


@pytest.fixture(scope="module")
def rows(spark):
    data = [("a", 1.0, 1.0, 1.0, "B1", "Ann", "S1", "2026-01-15", "w", 10, "x"), ("b", -1.0, -0.5, 0.5, "B2", "Bob", "S2", "2026-01-16", "w", 20, None), ("c", 0.0, 0.5, 0.0, "B2", "Bob", "S2", "2026-01-17", "v", 20, "x")]
    return spark.createDataFrame(data, "survey_id string, nps_score double, csat_score double, professionalism_score double, agent_bms string, agent_name string, supervisor string, survey_date string, wave string, tenure_days int, category_name string").withColumn("survey_date", F.col("survey_date").cast("date"))


@pytest.mark.parametrize("bad", [
    {}, {"metric": "profit"}, {"metric": "nps", "aggregation": "median"}, {"metric": "nps", "group_by": ["password"]}, {"metric": "nps", "filters": [{"field": "id", "value": 1}]},
    {"metric": "nps", "filters": [{"field": "wave", "operator": "regexp", "value": "x"}]}, {"metric": "nps", "filters": [{"field": "wave"}]}, {"metric": "nps", "filters": [{"field": "wave", "operator": "in", "value": "x"}]},
    {"metric": "nps", "filters": [{"field": "tenure", "operator": "between", "value": [1]}]}, {"metric": "nps", "date_range": {"from": "soon"}}, {"metric": "nps", "sort_by": "password"}, {"metric": "nps", "sort_order": "up"},
])
def test_invalid_queries(bad):
    with pytest.raises(ValueError):
        validate(bad)


def test_normalisation():
    q = validate({"metric": "NPS", "group_by": "Agent", "limit": 5000, "filters": [{"field": "WAVE", "operator": "IN", "value": ["a"]}]})
    assert (q.metrics, q.group_by, q.limit, q.filters[0].field) == (("nps",), ("agent",), 1000, "wave")


def test_top_box_and_label(rows):
    (r,) = run({"metrics": ["csat"], "group_by": "agent_bms", "filters": [{"field": "agent_bms", "value": "B2"}]}, rows).collect()
    assert (r.csat, r.sample_count, r.agent_name) == (0.25, 2, "Bob")


def test_filters_on_dates_and_categories(rows):
    got = run({"metric": "survey_volume", "group_by": "category", "date_range": {"from": "2026-01-16"}}, rows).collect()
    assert {(r.category, r.survey_volume) for r in got} == {("x", 1), ("Uncategorized", 1)}
    assert run({"metric": "survey_volume", "filters": [{"field": "category", "operator": "like", "value": "Un%"}]}, rows).first()[0] == 1


def test_fan_out_of_repeated_analyses(spark, rows):
    analyses = spark.createDataFrame([("a", 1), ("a", 1)], "survey_id string, category_id long")
    names = spark.createDataFrame([(1, "Policy")], "category_id long, name string")
    got = {r.category: r.survey_volume for r in run({"metric": "survey_volume", "group_by": "category"}, rows, analyses, names).collect()}
    assert got == {"Policy": 2, "Uncategorized": 2}


def test_category_join_only_where_used(spark, rows):
    plain = plan(validate({"metric": "nps", "group_by": "wave"}), rows, rows.select("survey_id", F.lit(1).alias("category_id")), rows.select(F.lit(1).alias("category_id"), F.lit("x").alias("name")))
    assert "Join" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark, sf):
    q = run({"metric": "nps", "group_by": "wave"}, surveys(spark, sf).filter("event_id > 5"))
    text = q._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(event_id,5)" in text and "props" not in text and "text" not in text.split("ReadSchema")[1]


def test_widgets_and_tools(rows):
    assert all(widget(k, rows).count() > 0 for k in WIDGETS)
    merged = custom_tool({"metric": "nps", "filters": [{"field": "wave", "value": "w"}]}, {"group_by": ["supervisor"], "filters": [{"field": "tenure", "value": 10}]})
    assert [r.supervisor for r in run(merged, rows).collect()] == ["S1"]


def test_formula(spark):
    df = spark.createDataFrame([(1.0, 2.0, [1.0, 2.0, 6.0])], "a double, b double, xs array<double>")
    names = {c: F.col(c) for c in df.columns}
    value = lambda t: df.select(compile_formula(t, names, frozenset({"xs"}))).first()[0]
    assert [value(t) for t in ("1 + 2 * 3", "-(a - b) * 2", "avg(xs)", "SUM(xs) / COUNT(xs)", "MAX(xs) - min(xs)", "xs + 1", "ROUND(2.5)")] == [7, 2, 3, 3, 5, 4, 3]
    for bad in ("a +", "c", "(a", "a $ b", "a b"):
        with pytest.raises(FormulaError):
            compile_formula(bad, names)
    with pytest.raises(Exception, match="division by zero"):
        value("a / 0")
