"""Survey files, the store of tables, imports and templates, the log of calls."""

import hashlib

import pytest
from pyspark.sql import functions as F

from surveyloom.operators import grounding, ingest
from surveyloom.sources import files
from surveyloom.sources.stored import Store
from surveyloom.sources.survey_files import content_digests, letter, preview, read_survey_files


def rows(table):
    return [r.asDict() for r in table.drop("_file").orderBy("_row").collect()]


def test_a_preamble_that_recurs_as_data_stays(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Export,\n,\nid, note ,note\n1,"two\nlines",x\nExport,,\n\n,,\nid, note ,note\n2,"say ""hi""",\n', newline="")
    got = rows(read_survey_files(spark, str(tmp_path / "a.csv"), header_row=3))
    # one record may be several lines; blank ones are left out, but counted
    assert got == [
        {"_row": 4, "id": "1", "note": "two\nlines", "note_C": "x"}, {"_row": 5, "id": "Export", "note": None, "note_C": None},
        {"_row": 8, "id": "id", "note": " note ", "note_C": "note"}, {"_row": 9, "id": "2", "note": 'say "hi"', "note_C": None},
    ]


def test_files_of_a_folder_meet_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,x\n1,a\n")
    (tmp_path / "b.csv").write_text("x,id,extra\nb,2,e\n")
    table = read_survey_files(spark, str(tmp_path / "*.csv"))
    assert table.rdd.getNumPartitions() == 2 and sorted((r.id, r.x, r.extra) for r in table.collect()) == [("1", "a", None), ("2", "b", "e")]
    assert table.schema == read_survey_files(spark, f"file://{tmp_path}").schema
    with pytest.raises(Exception, match="nothing"):
        read_survey_files(spark, str(tmp_path / "nothing")).count()


def test_workbooks(spark, tmp_path):
    book = str(tmp_path / "sample.xlsx")
    files.sample_workbook(book)
    table = read_survey_files(spark, book, header_row=4, sheet="Surveys")
    assert table.count() == 60 and table.columns[2:5] == ["Survey ID", "NPS", "CSAT"] and table.agg(F.max("_row")).first()[0] == 64
    seen = preview(spark, book, header_row=4, sheet="Surveys", limit=2)
    assert seen["total_rows"] == 60 and seen["headers"]["A"] == "Survey ID" and [r["A"] for r in seen["rows"]] == ["SRV-2026-0001", "SRV-2026-0002"]
    assert preview(spark, book, header_row=90)["total_rows"] == 0
    with pytest.raises(Exception, match="no sheet 'x'"):
        read_survey_files(spark, book, sheet="x").count()
    (tmp_path / "old.xls").write_bytes(b"x")
    with pytest.raises(Exception, match="saved as xlsx"):
        read_survey_files(spark, str(tmp_path / "old.xls")).count()
    assert [letter(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_digests_of_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"report{i}.pdf").write_bytes(bytes([i]) * (i * 1_500_000))
    got = {r.path.rpartition("/")[2]: (r.bytes, r.sha256) for r in content_digests(spark, str(tmp_path)).collect()}
    assert got == {f"report{i}.pdf": (i * 1_500_000, hashlib.sha256(bytes([i]) * (i * 1_500_000)).hexdigest()) for i in range(3)}


def imported(spark, folder):
    store = Store(spark, str(folder))
    pairs = lambda values, schema: spark.createDataFrame(values, schema)
    store.replace({
        "imports": pairs([(1,), (2,)], "id int"), "surveys": pairs([("a", 1), ("b", 2), ("c", None)], "survey_id string, import_id int"),
        "versions": pairs([("a", 1), ("b", 1), ("b", 2)], "survey_id string, import_id int"), "analyses": pairs([("a",), ("b",), ("c",), (None,)], "survey_id string"),
    })
    return store


def count(store, version=None):
    return [store.read(name, version).count() for name in ingest.IMPORTED]


def test_an_import_goes_with_all_that_hangs_on_it(spark, tmp_path):
    store = imported(spark, tmp_path)
    assert count(store) == [4, 3, 3, 2] and ingest.delete_import(store, 1) == 1
    assert count(store) == [3, 1, 2, 1] and sorted(r[0] for r in store.read("surveys").collect()) == ["b", "c"]
    assert store.manifest()["note"] == {"event": "IMPORT_DELETED", "import_id": 1, "deleted_surveys": 1}
    assert ingest.clear_all(store) == (2, 1) and count(store) == [0, 0, 0, 0] and count(store, 1) == [4, 3, 3, 2]
    assert store.versions() == [1, 2, 3] and store.read("surveys").columns == ["survey_id", "import_id"]


def test_a_change_that_breaks_off_leaves_the_old_version(spark, tmp_path):
    store = imported(spark, tmp_path)
    bad = store.read("imports").select(F.raise_error(F.lit("broken")).cast("int").alias("id"))
    with pytest.raises(Exception, match="broken"):
        store.replace({"surveys": store.read("surveys").limit(0), "imports": bad})
    assert count(store) == [4, 3, 3, 2] and store.versions() == [1]

    class Slow(Store):
        """Another change comes between the tables and the manifest."""

        def manifest(self, version=None):
            before = super().manifest(version)
            if version is None and not hasattr(self, "met"):
                self.met = True
                store.replace({"imports": store.read("imports").limit(1)})
            return before

    with pytest.raises(FileExistsError):
        Slow(spark, str(tmp_path)).replace({"imports": store.read("imports").limit(0)})
    assert count(store) == [4, 3, 3, 1] and store.versions() == [1, 2]
    with pytest.raises(KeyError):
        store.read("nothing")


def test_mapping_templates(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    mapping = {"survey_id": "ID", "nps_score": "NPS %", "csat_score": "CSAT", "professionalism_score": "Prof", "agent_bms": "Agent", "supervisor": "Lead", "survey_date": "Date"}
    assert ingest.save_template(store, "weekly", mapping) == 1 and ingest.save_template(store, "weekly", mapping, ("nps_score",)) == 2 and ingest.save_template(store, "other", mapping) == 1
    raw = spark.createDataFrame([("S1", "80", "1", "0.5", "B", "L", "2024-01-02", "kept")], "`id` string, `nps %` string, CSAT string, Prof string, Agent string, Lead string, Date string, more string")
    new, old = ingest.with_template(raw, store, "weekly").first(), ingest.with_template(raw, store, "weekly", 1).first()
    assert (new.nps_score, new.valid, new.warnings, new.more) == (0.8, True, ["nps_score converted from percentage"], "kept")
    assert (old.valid, old.errors, old.warnings) == (False, ["nps_score is out of range"], [])
    with pytest.raises(ValueError, match="no column for"):
        ingest.with_template(raw.drop("Lead"), store, "weekly")
    with pytest.raises(ValueError, match="no such fields"):
        ingest.save_template(store, "x", {"nope": "a"})
    with pytest.raises(KeyError):
        ingest.with_template(raw, store, "none")


def test_warnings_are_counted_before_an_import(spark):
    raw = spark.createDataFrame([(i, f"S{i}", "50" if i % 2 else "0.5", "1", "1", "B", "L", "2024-01-02") for i in range(6)], "row int, survey_id string, nps_score string, csat_score string, professionalism_score string, agent_bms string, supervisor string, survey_date string")
    got = ingest.preflight(raw, "row", ("nps_score",)).first()
    assert (got.ready_count, got.warning_count, got.error_count, got.can_import) == (6, 3, 0, True)


def test_calls_are_logged_with_what_they_returned(spark):
    log = grounding.CallLog(spark)
    rows = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double")
    again = log.run("one", {"token": "secret", "n": 1}, lambda a: rows)
    log.run("one", {"n": 1}, lambda a: rows.orderBy(F.col("k").desc()))
    log.run("one", {"n": 2}, lambda a: rows.withColumn("v", F.lit(2.0)))
    assert log.run("bad", {}, lambda a: 1 / 0) is None and again.count() == 2
    got = log.table().orderBy("call").collect()
    assert [(r.status, r.rows) for r in got] == [("completed", 2)] * 3 + [("error", None)]
    assert got[0].digest == got[1].digest != got[2].digest and got[3].message == "ZeroDivisionError: division by zero" and "secret" not in got[0].arguments
    assert all(r.duration_ms >= 0 for r in got) and [c["call"] for c in log.cite([1, 4])] == [1]


def test_grounded_records_hold_no_people(spark):
    lead = "Majano Siliezar, Michael E"
    surveys = spark.createDataFrame([(f"S{i}", "2024-01-02", 1.0, 1.0, 1.0, f"mail a{i}@b.org, michael and Fatima A helped" if i else None, "4250331", "Aguilar Marroquin, Fatima A", lead if i < 4 else "Ramirez, Ana", "w", i) for i in range(6)], "survey_id string, survey_date string, nps_score double, csat_score double, professionalism_score double, verbatim string, agent_bms string, agent_name string, supervisor string, wave string, tenure_days int")
    analyses = spark.createDataFrame([("S1", 2), ("S1", 1), ("S2", 2)], "survey_id string, category_id int")
    categories = spark.createDataFrame([(1, "Billing"), (2, "Delay")], "category_id int, name string")
    people = spark.createDataFrame([("supervisor", lead, "SUP_AAAAAA"), ("agent", "Aguilar Marroquin, Fatima A", "AGT_BBBBBB")], "kind string, name string, pseudonym string")
    vault = spark.createDataFrame([("s", "supervisor", lead, "SUP_AAAAAA"), ("t", "agent", "4250331", "AGT_OTHERS")], "scope string, type string, internal_id string, pseudonym string")
    ask = lambda **a: grounding.grounded_records(surveys, analyses, categories, people, vault, "s", a)
    records, total, made = ask(supervisor="micheal", sort_by="tenure_days", sort_direction="asc")
    got = sorted(records.collect(), key=lambda r: r.tenure_days)
    assert total.first().total == 4 and [r.category for r in got] == ["Uncategorized", "Billing", "Delay", "Uncategorized"]
    assert [r.verbatim for r in got[:2]] == [None, "mail [EMAIL_REDACTED], SUP_AAAAAA and AGT_BBBBBB helped"]
    assert {r.supervisor_ref for r in got} == {"SUP_AAAAAA"} and len({r.agent_ref for r in got} - {"AGT_OTHERS"}) == 1 and made.count() == 5
    assert ask(supervisor="SUP_AAAAAA", category="Delay")[1].first().total == 2
    assert ask(filters=[{"field": "supervisor", "operator": "in", "value": ["SUP_AAAAAA"]}, {"field": "category", "operator": "like", "value": "bill"}])[1].first().total == 1
    assert ask(keyword="helped", limit=2)[0].count() == 2


def test_grounded_records_fetch_the_texts_of_a_page_only(spark):
    surveys = spark.range(400).select(F.concat(F.lit("S"), F.lpad("id", 3, "0")).alias("survey_id"), F.lit("2024-01-02").alias("survey_date"), *(F.lit(1.0).alias(c) for c in ("nps_score", "csat_score", "professionalism_score")), F.lit("B").alias("agent_bms"), F.lit("Ana").alias("agent_name"), F.lit("Lead").alias("supervisor"), F.lit("w").alias("wave"), F.col("id").cast("int").alias("tenure_days"))
    none = lambda schema: spark.createDataFrame([], schema)
    asked = []

    def texts(rows):
        asked.append(rows.count())
        return rows.withColumn("verbatim", F.concat(F.lit("mail a@b.org "), "survey_id"))

    ask = lambda **a: grounding.grounded_records(surveys, none("survey_id string, category_id int"), none("category_id int, name string"), none("kind string, name string, pseudonym string"), none("scope string, type string, internal_id string, pseudonym string"), "s", a, texts)
    records, total, _ = ask(limit=3)
    assert sorted(r.verbatim for r in records.collect()) == [f"mail [EMAIL_REDACTED] S00{i}" for i in range(3)] and total.first().total == 400 and asked == [3]
    assert [r.verbatim for r in ask(keyword="S399")[0].collect()] == ["mail [EMAIL_REDACTED] S399"]
