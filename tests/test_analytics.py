import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import audit, drivers, forecast, ingest, org, privacy, usage
from surveyloom.sources import files


def day(i, start="2026-01-01"):
    return dt.date.fromisoformat(start) + dt.timedelta(days=i)


def test_models():
    y = np.array([0.2, 0.3, 0.4, 0.5, 0.6])
    assert forecast._linear(y, 2)[0].tolist() == [0.7, 0.8]
    assert forecast._naive(y, 2)[0].tolist() == [0.6, 0.6]
    assert forecast._holt(y, 1)[0][0] == pytest.approx(0.7, abs=0.02)
    name, mae, _ = forecast.select_model(forecast.walk_forward(np.full(30, 0.5)))
    assert (name, mae) == ("naive", 0.0)


def test_gate_and_projection(spark):
    rows = [("s", day(i), min(0.95, 0.40 + 0.018 * i), 25) for i in range(30)]
    df = spark.createDataFrame(rows, "series string, date date, value double, n long")
    g = forecast.gate(df, 14).first()
    assert (g.status, g.max_horizon) == ("EXCESSIVE_HORIZON", 10)
    out = forecast.forecast(df, "csat", 7).orderBy("date").collect()
    assert len(out) == 7 and out[0].date == day(30) and all(0 <= r.value <= 1 for r in out)
    short = df.withColumn("n", F.when(F.dayofmonth("date") <= 5, 5).otherwise(F.col("n")))
    g = forecast.gate(short, 7).first()
    assert (g.eligible, g.excluded, g.status) == (25, 5, "INSUFFICIENT_HISTORY")
    (r,) = forecast.forecast(short, "csat", 7).collect()
    assert (r.status, r.model, r.date) == ("INSUFFICIENT_HISTORY", "none", None)


def test_reliability_levels():
    assert forecast.reliability(60, 50, 0.03, 7, 0) == ("HIGH", 100)
    assert forecast.reliability(27, 50, 0.03, 7, 0) == ("INSUFFICIENT", 10)
    assert forecast.reliability(28, 10, 0.5, 14, 20)[0] == "LOW"


def driver_rows(spark, n=120):
    r = np.random.default_rng(4)
    rows = [(["A", "B"][i % 2], ["w1", "w2", "w3"][i % 3], f"s{i // 2 % 4}", int(i * 7 % 50), i * 11 % 30, float(0.5 * (i % 2) + 0.01 * r.standard_normal())) for i in range(n)]
    return spark.createDataFrame(rows, "category string, wave string, supervisor string, tenure int, day int, y double")


def test_least_squares_equals_numpy(spark):
    rows = driver_rows(spark)
    out, info = drivers.ols(rows)
    d = drivers.design(drivers._patterns(rows))
    x = np.array(rows.select(F.array(*d.columns())).toPandas().iloc[:, 0].tolist())
    y = rows.toPandas().y.to_numpy()
    want = np.linalg.solve(x.T @ x + 1e-6 * np.eye(x.shape[1]), x.T @ y)
    got = {r.term: r for r in out.collect()}
    assert [got[n].coefficient for n in d.names] == pytest.approx(want.tolist(), abs=1e-8)
    assert got["category:B"].direction == "positive" and got["category:B"].confidence == "SUPPORTED" and info["r2"] > 0.99
    assert drivers.ols(rows.limit(5))[1]["status"] == "INSUFFICIENT_SAMPLE"


def test_logistic(spark):
    rows = driver_rows(spark).withColumn("y", F.when((F.col("category") == "B") == (F.col("day") % 7 != 0), 1.0).otherwise(0.0))
    out, info = drivers.logistic(rows)
    r = {r.term: r for r in out.collect()}["category:B"]
    assert info["status"] == "OK" and r.odds_ratio > 2 and r.direction == "positive"
    assert drivers.logistic(rows.withColumn("y", F.lit(1.0)))[1]["status"] == "LOW_VARIANCE"


def test_membership_transitions(spark):
    rows = [("BMS-500", "2026-01-05", "A"), ("BMS-500", "2026-02-10", "A"), ("BMS-500", "2026-03-01", "B")]
    s = spark.createDataFrame(rows, "agent_bms string, survey_date string, supervisor string").withColumn("survey_date", F.col("survey_date").cast("date"))
    got = [(r.supervisor, str(r.effective_from), r.effective_to and str(r.effective_to)) for r in org.membership_intervals(s).orderBy("effective_from").collect()]
    assert got == [("A", "2026-01-05", "2026-02-10"), ("B", "2026-03-01", None)]


def test_validation_messages(spark):
    rows = [("S1", "0.8", "95%", "0.9", "B", "L", "2026-09-05"), ("S2", "1.5", "95", "x", "B", "L", "45000"), ("", "", None, " ", "", "", ""), ("S3", "$0.5", "0.5", "0.5", None, "L", "someday")]
    raw = spark.createDataFrame(rows, "survey_id string, nps_score string, csat_score string, professionalism_score string, agent_bms string, supervisor string, survey_date string")
    got = {r.survey_id: r for r in ingest.validated(raw, percentages=("csat_score",)).collect()}
    assert len(got) == 3 and got["S1"].valid and got["S1"].csat_score == 0.95 and str(got["S1"].survey_date) == "2026-09-05"
    assert got["S2"].errors == ["nps_score is out of range", "professionalism_score is not a number"] and str(got["S2"].survey_date) == "2023-03-15"
    assert got["S3"].errors == ["agent_bms is required", "survey_date is not a date"] and got["S3"].nps_score == 0.5


def test_mapping():
    got = ingest.suggest_mapping(["Survey_ID", "NPS Score (avg)", "", "Agent BMS", "Agent", "Supervisor name"])
    assert got == {"survey_id": "Survey_ID", "agent_bms": "Agent BMS", "agent_name": "Agent", "nps_score": "NPS Score (avg)", "supervisor": "Supervisor name"}


def test_tampering_is_found(spark):
    e = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (3, 0, "c"), (4, 0, None)], "id long, ledger int, body string")
    chain = audit.linked(e, "ledger", "id", "id", "body")
    found = lambda c: [tuple(r) for r in audit.broken_links(c, "ledger", "id", "id", "body").orderBy("id", "reason").collect()]
    assert found(chain) == []
    altered = chain.withColumn("body", F.when(F.col("id") == 2, "x").otherwise(F.col("body")))
    assert found(altered) == [(2, "event_hash payload mismatch")]
    assert found(chain.filter("id <> 2")) == [(3, "previous_hash mismatch")]
    # a forged event with a hash that fits, and a next link that fits that, show at the next event's own hash
    forged = altered.withColumn("event_hash", F.when(F.col("id") == 2, audit.event_hash(F.col("previous_hash"), audit.canonical("id", "body"))).otherwise(F.col("event_hash")))
    assert found(forged) == [(3, "previous_hash mismatch")]
    new = {r.id: r.event_hash for r in forged.collect()}[2]
    relinked = forged.withColumn("previous_hash", F.when(F.col("id") == 3, F.lit(new)).otherwise(F.col("previous_hash")))
    assert found(relinked) == [(3, "event_hash payload mismatch")]
    everything = chain.withColumn("event_hash", F.lit("f" * 64))
    assert len(found(everything)) == 7


def test_scrubbing(spark):
    t = spark.createDataFrame([("mail a.b@c.org or 555-123-4567, card 1234 5678 9012 3456", 1), ("1234567890123456", 2), (None, 3)], "text string, id int")
    got = {r.id: (r.scrubbed, r.emails, r.phones, r.accounts) for r in privacy.scrub(t, "text").collect()}
    assert got[1] == ("mail [EMAIL_REDACTED] or [PHONE_REDACTED], card [ACCOUNT_REDACTED]", 1, 1, 1)
    assert got[2] == ("[PHONE_REDACTED]456", 0, 1, 0) and got[3] == (None, 0, 0, 0)


def test_pseudonyms_are_unique_in_their_scope(spark):
    entities = spark.createDataFrame([("agent", f"B{i}") for i in range(30)], "type string, internal_id string")
    vault = spark.createDataFrame([("c1", "agent", "old", "AGT_A"), ("c2", "agent", "B1", "AGT_B")], "scope string, type string, internal_id string, pseudonym string")
    # one letter for 30 of 35 free ones: draws must collide, with one another and with the vault
    made = privacy.new_pseudonyms(entities, vault, "c1", length=1).collect()
    assert len(made) == len({r.pseudonym for r in made}) == 30 and "AGT_A" not in {r.pseudonym for r in made}
    both = vault.union(spark.createDataFrame([("c1", "agent", "B1", "AGT_C")], vault.schema))
    rows = spark.createDataFrame([("B1", "x", 1)], "agent_bms string, verbatim string, n int")
    assert [r.asDict() for r in privacy.minimised(rows, both, "c1").collect()] == [{"n": 1, "agent_ref": "AGT_C"}]
    assert privacy.minimised(rows, both, "c2", ["agent_bms", "other"]).collect()[0].asDict() == {"agent_ref": "AGT_B"}
    assert privacy.resolved({"filters": [{"field": "agent", "value": ["AGT_C", "y"]}], "n": 1}, {"AGT_C": "B1"}) == {"filters": [{"field": "agent", "value": ["B1", "y"]}], "n": 1}


def test_driver_design(spark):
    """Eight supervisors, then the reference is left out; all categories; days from the first."""
    rows = []
    for i in range(400):
        rows.append((f"c{i % 250}", "w", f"s{min(i % 20, 12):02d}", 30, None, float(i % 3)))
    s = spark.createDataFrame([(c, w, p, t, f"2023-05-{1 + i % 28:02d}", y) for i, (c, w, p, t, _, y) in enumerate(rows)], "category_name string, wave string, supervisor string, tenure_days int, survey_date string, nps_score double").withColumn("survey_date", F.to_date("survey_date"))
    data = drivers.driver_input(s, "nps_score")
    assert data.agg(F.min("day"), F.max("day")).first() == (0, 27)
    d = drivers.design(drivers._patterns(data))
    assert d.references["supervisor"] == "s12" and [x for f, x in d.terms if f == "supervisor"] == [f"s{i:02d}" for i in range(7)]
    assert sum(f == "category" for f, _ in d.terms) == 249
    d = drivers.design(drivers._patterns(data), {"supervisor": "s11", "category": "none such"})
    assert d.references["supervisor"] == "s11" and sum(f == "supervisor" for f, _ in d.terms) == 8 and d.references["category"] == "c0"
    effects = [abs(round(r.coefficient, 3)) for r in drivers.ols(data)[0].collect() if r.term != "intercept"]
    assert effects == sorted(effects, reverse=True)


def test_endpoints_of_the_registry(spark):
    from surveyloom.operators import endpoints

    assert endpoints.metric_definition("NPS")["key"] == "nps" and "error" in endpoints.metric_definition("none")
    assert endpoints.sandbox({"metrics": ["nps"]})["limit"] == 20 and endpoints.sandbox({"limit": 500})["limit"] == 50
    assert endpoints.authorised(None) and endpoints.authorised({"data.view"}) and not endpoints.authorised({"x"})


def test_preflight(spark):
    rows = [(i, f"S{i}", "9" if i == 3 else "1", "1", "1", "B", "Sup", "2024-01-02") for i in range(1, 150)]
    raw = spark.createDataFrame(rows, "row int, survey_id string, nps_score string, csat_score string, professionalism_score string, agent_bms string, supervisor string, survey_date string")
    got = ingest.preflight(raw, "row").first()
    assert (got.ready_count, got.error_count, got.can_import) == (99, 1, False) and [e.row for e in got.sample_errors] == [3]
    assert ingest.preflight(raw.filter("row <> 3"), "row").first().can_import
    assert [r["row"] for r in ingest.first_errors(ingest.validated(raw), "row").collect()] == [3]


def test_pseudonyms(spark):
    entities = spark.createDataFrame([("agent", "B1"), ("agent", "B1"), ("supervisor", "S1")], "type string, internal_id string")
    vault = spark.createDataFrame([], "scope string, type string, internal_id string, pseudonym string")
    made = privacy.new_pseudonyms(entities, vault, "c1")
    first = {tuple(r) for r in made.collect()}
    assert len(first) == 2 and first == {tuple(r) for r in made.collect()} and {r[3][:4] for r in first} == {"AGT_", "SUP_"}
    assert privacy.new_pseudonyms(entities, made, "c1").count() == 0
    assert privacy.redacted({"a": [{"API_KEY": 1, "b": 2}]}) == {"a": [{"API_KEY": "[REDACTED]", "b": 2}]}


def test_tool_statistics(spark):
    calls = spark.createDataFrame([("q", "completed", 100.0), ("q", "error", 200.0)], "tool_name string, status string, duration_ms double")
    r = usage.tool_statistics(calls).first()
    assert (r.calls, r.avg_ms, r.errors) == (2, 150.0, 1)


def test_files(spark, tmp_path):
    book = str(tmp_path / "sample.xlsx")
    files.sample_workbook(book)
    assert files.inspect_workbook(book) == [{"name": "Surveys", "approximate_rows": 64}, {"name": "Notes", "approximate_rows": 1}]
    sheet = files.read_sheet(spark, book, "Surveys", 4)
    header, head, n = files.preview(sheet, 3)
    assert (len(header), len(head), n) == (10, 3, 60) and head[0]["Survey ID"] == "SRV-2026-0001"
    mapping = ingest.suggest_mapping(header)
    rows = ingest.validated(sheet.select(*(F.col(f"`{h}`").alias(f) for f, h in mapping.items())), percentages=("csat_score",))
    assert rows.filter("valid").count() == 60
    files.write_csv(sheet, str(tmp_path / "out"))
    assert files.read_csv(spark, str(tmp_path / "out")).count() == 60
    (tmp_path / "late.csv").write_text('Report\n,,\na,b\n1,"x, y"\n2,z\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "late.csv"), 3).collect()] == [("1", "x, y"), ("2", "z")]
    assert files.csv_text([{"a": 'say "hi"', "b": None}]) == '﻿"a","b"\r\n"say ""hi""",""\r\n'


def test_streamed_imports(spark, tmp_path):
    from surveyloom.streaming import imports

    rows = [(f"s{i % 8}", 1.0, 0.5, 0.5, "L", dt.datetime(2026, 1, 1 + i % 2)) for i in range(16)]
    spark.createDataFrame(rows, imports.SCHEMA).write.parquet(str(tmp_path / "in"))
    q = imports.start(imports.daily_totals(imports.arriving(spark, str(tmp_path / "in"))), "daily_imports", str(tmp_path / "check"))
    q.awaitTermination()
    got = spark.table("daily_imports").collect()
    assert sum(r.survey_volume for r in got) == 8 and all((r.nps, r.csat) == (1.0, 0.5) for r in got)


def test_sentiment_scales(spark):
    from surveyloom.functions.scores import sentiment

    df = spark.createDataFrame([(v,) for v in (1.0, -1.0, 0.0, 10.0, 8.0, 6.5, 6.0, None)], "v double")
    assert [r[0] for r in df.select(sentiment(F.col("v"))).collect()] == ["promoter", "detractor", "passive", "promoter", "passive", "passive", "detractor", None]


def test_case_numbers_of_all_orders_without_a_year_in_one_task(spark, sf):
    from surveyloom.operators import cases

    names = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderdate").cache()
        rows, count, want = sorted((r.o_orderdate, r.o_orderkey) for r in orders.collect()), {}, {}
        for day, key in rows:
            count[day.year] = count.get(day.year, 0) + 1
            want[key] = f"CAS-{day.year}-{count[day.year]:04d}"
        assert {r.o_orderkey: r.case_number for r in cases.numbered(orders, "o_orderdate", "o_orderkey").collect()} == want
        day = spark.range(2000).selectExpr("id AS k", "date'2024-05-01' AS d").repartition(4)
        got = cases.numbered(day, "d", "k").withColumn("task", F.spark_partition_id()).collect()
        assert {r.k: r.case_number for r in got} == {i: f"CAS-2024-{i + 1:04d}" for i in range(2000)}
        tasks = [r.task for r in got]
        assert max(map(tasks.count, set(tasks))) < 1000
        few = cases.numbered(spark.createDataFrame([(None, 1), (None, None)], "d date, k long"), "d", "k")
        assert sorted(r.case_number for r in few.collect()) == ["CAS-null-0001", "CAS-null-0002"]
        assert cases.numbered(day.limit(0), "d", "k").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
