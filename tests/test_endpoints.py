"""Endpoints: minimised queries, forecasts and drivers with filters, listings, small rules."""

import pytest
from pyspark.sql import functions as F

from surveyloom.operators import drivers, endpoints, kpi, listings, reports
from surveyloom.sources.surveys import surveys

VAULT = "scope string, type string, internal_id string, pseudonym string"


def test_queries_take_and_give_pseudonyms(spark, sf):
    s = surveys(spark, sf)
    lead = s.agg(F.min("supervisor")).first()[0]
    vault = spark.createDataFrame([("me", "supervisor", lead, "SUP_MINEXX"), ("you", "supervisor", lead, "SUP_YOURSX")], VAULT)
    dsl = {"metrics": ["nps", "survey_volume"], "group_by": ["supervisor", "agent_bms"], "filters": [{"field": "supervisor", "operator": "in", "value": ["SUP_MINEXX"]}]}
    out, made = endpoints.query_data(dsl, s, vault, "me")
    rows = out.collect()
    assert {r.supervisor_ref for r in rows} == {"SUP_MINEXX"} and made.count() == len({r.agent_ref for r in rows}) == s.filter(F.col("supervisor") == lead).select("agent_bms").distinct().count()
    assert not {"supervisor", "agent_bms", "agent_name"} & set(out.columns) and sum(r.percentage for r in rows) == pytest.approx(100, abs=0.5)
    # another scope's pseudonym means nobody here
    assert endpoints.query_data(dsl | {"filters": [{"field": "supervisor", "operator": "=", "value": "SUP_YOURSX"}]}, s, vault, "me")[0].count() == 0
    plain, none = endpoints.query_data({"metrics": ["nps"], "group_by": ["wave"]}, s, vault, "me")
    assert set(plain.columns) == {"wave", "nps", "sample_count"} and none.count() == 0


def test_forecasts_of_a_part(spark):
    days = spark.range(40).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("survey_date"), (F.col("id") / 100).alias("v"))
    s = days.crossJoin(spark.range(50)).select("survey_date", F.when(F.col("id") < 25, "a").otherwise("b").alias("wave"), F.col("v").alias("nps_score"), F.lit(1.0).alias("csat_score"))
    whole = endpoints.run_forecast(s, "nps", 3).collect()
    assert {r.series for r in whole} == {"all"} and len(whole) == 3 and all(0.39 < r.value < 0.44 for r in whole)
    part = endpoints.run_forecast(s, "nps", 3, [{"field": "wave", "operator": "=", "value": "a"}], by="wave").collect()
    assert {r.series for r in part} == {"a"} and {r.status for r in endpoints.run_forecast(s.filter("wave = 'c'"), "csat").collect()} <= {"INSUFFICIENT_HISTORY"}
    with pytest.raises(ValueError, match="unknown filter"):
        endpoints.run_forecast(s, "nps", 3, [{"field": "planet", "value": 1}])


def test_drivers_of_a_part(spark):
    rows = [(f"S{i}", f"2024-01-{1 + i % 28:02d}", "w" if i % 2 else " ", f"s{i % 3}", None if i % 5 else i, 1.0 if i % 4 else -1.0, None if i % 7 == 0 else float(i % 3 > 0)) for i in range(300)]
    s = spark.createDataFrame(rows, "survey_id string, survey_date string, wave string, supervisor string, tenure_days int, nps_score double, csat_score double").withColumn("survey_date", F.to_date("survey_date"))
    tables = {"analyses": spark.createDataFrame([(f"S{i}", i % 2) for i in range(200)] + [("S0", 1)], "survey_id string, category_id int"), "categories": spark.createDataFrame([(0, "A"), (1, "B")], "category_id int, name string")}
    data = drivers.driver_input(s, "nps_score", {"wave": "w", "date_from": "2024-01-05", "date_to": None}, **tables)
    assert data.count() == s.filter("wave = 'w' and survey_date >= '2024-01-05'").count() and {r[0] for r in data.select("category").distinct().collect()} == {"B", "Uncategorized"}
    assert drivers.driver_input(s, "nps_score", None, **tables).count() == 301  # a survey with two analyses counts twice
    table, found = endpoints.run_driver_analysis(s, "nps", supervisor="s1", **tables)
    assert found["status"] == "OK" and found["n"] == 100 and not table.filter("term like 'supervisor:%'").count()
    assert endpoints.run_driver_analysis(s, "csat", date_to="2024-01-01", **tables)[1]["status"] == "INSUFFICIENT_SAMPLE"
    with pytest.raises(ValueError, match="cannot be filtered"):
        drivers.driver_input(s, "nps_score", {"planet": "x"})


def test_answers_of_the_registry(spark, sf):
    answer = endpoints.envelope({"metrics": ["survey_volume"], "group_by": ["wave"]}, surveys(spark, sf), {"data.view"})
    assert answer["success"] and answer["count"] == len(answer["data"]) > 1 and answer["dsl"]["group_by"] == ["wave"]
    with pytest.raises(PermissionError):
        endpoints.envelope({"metrics": ["nps"]}, surveys(spark, sf), {"other"})


def test_listings_have_pages(spark):
    t = spark.createDataFrame([(i, f"2024-01-{1 + i:02d}", "ok" if i % 2 else "bad") for i in range(20)], "id int, day string, status string").withColumn("day", F.to_timestamp("day"))
    ids = lambda **k: [r.id for r in listings.filtered(t, "day", "id", k.pop("equal", {}), size=3, **k).collect()]
    assert ids() == [19, 18, 17] and ids(page=2) == [16, 15, 14] and ids(equal={"status": "ok", "id": None}) == [19, 17, 15] and ids(start="2024-01-03", end="2024-01-04") == [3, 2] and ids(page=99) == []


def test_names_inside_names(spark):
    names = ["ana lopez", "lopez", "ana lopez rivera", "an", "x", "pez riv", "other", "", None]
    got = {tuple(r) for r in reports.contained(spark.createDataFrame([(n,) for n in names], "n string")).collect()}
    texts = [n for n in names if n]
    assert got == {(a, b) for a in texts for b in texts if a != b and a in b}


def test_names_inside_names_of_another_table(spark, capsys):
    mine, theirs = ["ana lopez", "lopez", "an", "other", "ñandú", ""], ["lopez", "ana lopez rivera", "an other", "x", "a very long name, ana lopez, with more around it", None]
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "n string")
    found = reports.contained(frame(mine), frame(theirs))
    assert {tuple(r) for r in found.collect()} == {(a, b) for a in mine if a for b in theirs if b and a != b and a in b}
    # sizes of tables of pieces are not what the planner takes them for, so none may be broadcast
    reviews = reports.merged_reviews(frame(mine).select(F.col("n").alias("agent_bms"), F.col("n").alias("agent_name")), frame(theirs).select(F.col("n").alias("name"), F.lit("c").alias("comment")))
    for df in (found, reviews):
        df.explain()
        assert "BroadcastHashJoin" not in capsys.readouterr().out
    assert {r.agent_bms: r.way for r in reviews.collect()} == {"ana lopez": 4, "lopez": 1, "an": 4, "other": 4, "ñandú": None, "": None}


def test_columns_and_totals(spark):
    v = spark.createDataFrame([(0.5,)], "v double")
    one = lambda kind, target: v.select(kpi.computed_column(F.col("v"), kind, target).alias("x")).first().x
    assert one("custom", 3.0) == 1.5 and one("percent_of_target", 2.0) == 25.0 and one("percent_of_target", 0.0) is None
    empty = spark.createDataFrame([], "survey_volume long, nps double, csat double, professionalism double, has_sample boolean")
    assert tuple(kpi.weighted_totals(empty).select("survey_volume", "nps", "csat").first()) == (0, 0.0, 0.0)
