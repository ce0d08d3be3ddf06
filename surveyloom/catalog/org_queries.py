"""Organisation and ingest queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from surveyloom.catalog._base import query
from surveyloom.operators import ingest, org
from surveyloom.sources.stored import Store, shared_folder
from surveyloom.sources.surveys import surveys, table

_INTERVALS = """
days AS (SELECT agent_bms, survey_date, min(supervisor) AS supervisor FROM surveys GROUP BY 1, 2),
ch AS (SELECT *, CASE WHEN lag(supervisor) OVER w <> supervisor THEN 1 ELSE 0 END AS changed FROM days WINDOW w AS (PARTITION BY agent_bms ORDER BY survey_date)),
isl AS (SELECT *, sum(changed) OVER (PARTITION BY agent_bms ORDER BY survey_date) AS island FROM ch),
sp AS (SELECT agent_bms, island, supervisor, min(survey_date) AS effective_from, max(survey_date) AS last_day FROM isl GROUP BY 1, 2, 3),
memberships AS (SELECT agent_bms, supervisor, effective_from, CASE WHEN lead(island) OVER (PARTITION BY agent_bms ORDER BY island) IS NOT NULL THEN last_day END AS effective_to FROM sp)"""
_SUP = "substr('SUP-' || regexp_replace(upper(supervisor), '[^A-Z0-9]+', '-', 'g'), 1, 50)"


@query("workforce_members", f"SELECT agent_bms AS external_id, min(agent_name) AS name, 'agent' AS role FROM surveys GROUP BY 1 UNION ALL SELECT DISTINCT {_SUP}, supervisor, 'supervisor' FROM surveys")
def workforce_members(spark, sf):
    return org.members(surveys(spark, sf))


@query("workforce_teams", f"SELECT DISTINCT replace({_SUP}, 'SUP-', 'TEAM-') AS team, supervisor FROM surveys")
def workforce_teams(spark, sf):
    return org.teams(surveys(spark, sf))


@query("workforce_new_members", "SELECT agent_bms AS external_id, min(agent_name) AS name, 'agent' AS role FROM surveys WHERE survey_date > DATE '2024-01-01' AND agent_bms NOT IN (SELECT agent_bms FROM surveys WHERE survey_date <= DATE '2024-01-01') GROUP BY 1")
def workforce_new_members(spark, sf):
    """Idempotent backfill: only members that an earlier run did not know."""
    s = surveys(spark, sf)
    known = org.members(s.filter("survey_date <= date'2024-01-01'"))
    return org.new_members(s.filter("survey_date > date'2024-01-01'"), known).filter("role = 'agent'")


@query("membership_intervals", f"{_INTERVALS} SELECT * FROM memberships")
def membership_intervals(spark, sf):
    return org.membership_intervals(surveys(spark, sf))


@query("membership_as_of", f"""{_INTERVALS}
SELECT s.survey_id, s.agent_bms, s.survey_date, (SELECT max_by(m.supervisor, m.effective_from) FROM memberships m WHERE m.agent_bms = s.agent_bms AND m.effective_from <= s.survey_date AND (m.effective_to IS NULL OR m.effective_to >= s.survey_date)) AS as_of_supervisor FROM surveys s""")
def membership_as_of(spark, sf):
    s = surveys(spark, sf)
    return org.as_of(s.select("survey_id", "agent_bms", "survey_date"), org.membership_intervals(s), "agent_bms", "survey_date").select("survey_id", "agent_bms", "survey_date", "as_of_supervisor")


@query("membership_roster", f"{_INTERVALS} SELECT * FROM memberships WHERE effective_from <= DATE '2024-01-20' AND (effective_to IS NULL OR effective_to >= DATE '2024-01-20')")
def membership_roster(spark, sf):
    return org.roster(org.membership_intervals(surveys(spark, sf)), "2024-01-20")


@query("membership_transfer", f"""{_INTERVALS}
SELECT agent_bms, supervisor, effective_from, CASE WHEN agent_bms = 'BMS-00003' AND effective_from < DATE '2024-02-01' AND (effective_to IS NULL OR effective_to >= DATE '2024-02-01') THEN DATE '2024-01-31' ELSE effective_to END AS effective_to FROM memberships
UNION ALL SELECT 'BMS-00003', 'NATION_7', DATE '2024-02-01', NULL""")
def membership_transfer(spark, sf):
    return org.transfer(org.membership_intervals(surveys(spark, sf)), "BMS-00003", "NATION_7", "2024-02-01")


@query("same_day_conflicts", "SELECT agent_bms, survey_date, count(DISTINCT supervisor) AS supervisors FROM (SELECT agent_bms, survey_date, CASE WHEN tenure_days % 5 = 0 AND event_id % 2 = 0 THEN 'OTHER' ELSE supervisor END AS supervisor FROM surveys) GROUP BY 1, 2 HAVING count(DISTINCT supervisor) > 1")
def same_day_conflicts(spark, sf):
    moved = surveys(spark, sf).withColumn("supervisor", F.when((F.col("tenure_days") % 5 == 0) & (F.col("event_id") % 2 == 0), "OTHER").otherwise(F.col("supervisor")))
    return org.same_day_conflicts(moved)


@query("name_conflicts", "SELECT agent_bms, count(DISTINCT trim(n)) AS names, min(trim(n)) AS first_name FROM (SELECT agent_bms, CASE WHEN event_id % 2 = 0 AND tenure_days < 100 THEN agent_name || ' jr ' ELSE ' ' || agent_name END AS n FROM surveys) GROUP BY 1 HAVING count(DISTINCT trim(n)) > 1")
def name_conflicts(spark, sf):
    n = F.when((F.col("event_id") % 2 == 0) & (F.col("tenure_days") < 100), F.concat("agent_name", F.lit(" jr "))).otherwise(F.concat(F.lit(" "), "agent_name"))
    return org.name_conflicts(surveys(spark, sf).withColumn("agent_name", n))


@query("match_id_or_key", "SELECT survey_id FROM surveys WHERE event_id IN (1, 5, 9) OR agent_bms IN ('BMS-00003', 'BMS-00004')")
def match_id_or_key(spark, sf):
    wanted = spark.createDataFrame([(1, "BMS-00003"), (5, "BMS-00004"), (9, None)], "id long, bms string")
    return org.matching_any(surveys(spark, sf), wanted, [("event_id", "id"), ("agent_bms", "bms")], "survey_id").select("survey_id")


@query("latest_membership", f"{_INTERVALS} SELECT agent_bms, max_by(supervisor, effective_from) AS supervisor FROM memberships GROUP BY 1")
def latest_membership(spark, sf):
    return org.membership_intervals(surveys(spark, sf)).groupBy("agent_bms").agg(F.max_by("supervisor", "effective_from").alias("supervisor"))


# ingest: the events read twice, the second time with some values changed

def _incoming(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value", "event_type")
    again = e.filter("event_id % 3 <> 1").select((F.col("event_id") + F.lit(10_000_000)).alias("row"), "event_id", F.when(F.col("event_id") % 10 == 0, F.floor("value") + 1).otherwise(F.floor("value")).alias("v"), "event_type")
    first = e.select(F.col("event_id").alias("row"), "event_id", F.floor("value").alias("v"), "event_type")
    return first.union(again).withColumn("digest", F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), F.col("v").cast("string"), "event_type"), 256))


def _stored(spark, sf):
    e = table(spark, sf, "events").filter("event_id % 7 = 0").select("event_id", F.floor("value").alias("v"), "event_type")
    return e.select(F.lit(-1).cast("long").alias("row"), "event_id", "v", "event_type").withColumn("digest", F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), F.col("v").cast("string"), "event_type"), 256))


_INGEST = """WITH f AS (
  SELECT event_id AS row, event_id, CAST(floor(value) AS BIGINT) AS v, event_type FROM events
  UNION ALL SELECT event_id + 10000000, event_id, CAST(floor(value) AS BIGINT) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END, event_type FROM events WHERE event_id % 3 <> 1),
inc AS (SELECT *, sha256(concat_ws('|', CAST(event_id AS VARCHAR), CAST(v AS VARCHAR), event_type)) AS digest FROM f),
st AS (SELECT event_id, sha256(concat_ws('|', CAST(event_id AS VARCHAR), CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), event_type)) AS digest FROM events WHERE event_id % 7 = 0),
p AS (SELECT i.*, coalesce(lag(i.digest) OVER (PARTITION BY i.event_id ORDER BY i.row), st.digest) AS previous_hash FROM inc i LEFT JOIN st ON st.event_id = i.event_id),
c AS (SELECT *, CASE WHEN previous_hash IS NULL THEN 'insert' WHEN previous_hash = digest THEN 'duplicate' ELSE 'update' END AS action FROM p)"""


@query("ingest_classify", f"{_INGEST} SELECT row, event_id, digest, previous_hash, action FROM c", surveys=False)
def ingest_classify(spark, sf):
    return ingest.classify(_incoming(spark, sf), _stored(spark, sf), "event_id", "row", "digest").select("row", "event_id", "digest", "previous_hash", "action")


@query("ingest_upsert", f"{_INGEST} SELECT event_id, max_by(v, row) AS v, max_by(digest, row) AS digest FROM c GROUP BY 1", surveys=False)
def ingest_upsert(spark, sf):
    done = ingest.classify(_incoming(spark, sf), _stored(spark, sf), "event_id", "row", "digest")
    return ingest.upsert(done, _stored(spark, sf), "event_id", "row").select("event_id", "v", "digest")


@query("ingest_counts", f"{_INGEST} SELECT action, count(*) AS n FROM c GROUP BY 1", surveys=False)
def ingest_counts(spark, sf):
    return ingest.classify(_incoming(spark, sf), _stored(spark, sf), "event_id", "row", "digest").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("ingest_changed_fields", "SELECT event_id, 'value' AS changed FROM events WHERE event_id % 10 = 0", surveys=False)
def ingest_changed_fields(spark, sf):
    old = table(spark, sf, "events").select("event_id", "value", "event_type")
    new = old.withColumn("value", F.when(F.col("event_id") % 10 == 0, F.col("value") + 1000).otherwise(F.col("value")))
    return ingest.changed_fields(old, new, "event_id", ["value", "event_type"])


@query("ingest_delete_import", "SELECT event_id, event_type FROM events WHERE event_id % 4 <> 2", surveys=False)
def ingest_delete_import(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    return ingest.without_import(e, e.filter("event_id % 4 = 2"), "event_id")


_RAW = """WITH raw AS (
  SELECT event_id, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE 'S' || event_id END AS survey_id,
    CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 3 * 40 AS VARCHAR) || '%' WHEN event_id % 5 = 1 THEN 'x' WHEN event_id % 5 = 2 THEN '7' ELSE '0.' || CAST(event_id % 10 AS VARCHAR) END AS nps,
    CASE WHEN event_id % 4 = 0 THEN '45' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') WHEN event_id % 4 = 1 THEN '2024-01-' || lpad(CAST(event_id % 28 + 1 AS VARCHAR), 2, '0') WHEN event_id % 4 = 2 THEN CAST(event_id % 12 + 1 AS VARCHAR) || '/' || CAST(event_id % 28 + 1 AS VARCHAR) || '/2024' ELSE 'soon' END AS day
  FROM events)"""


@query("ingest_validate", _RAW + """,
n AS (SELECT *, nullif(trim(survey_id), '') AS sid, coalesce(TRY_CAST(nps AS DOUBLE), TRY_CAST(replace(nps, '%', '') AS DOUBLE)) AS x FROM raw),
m AS (SELECT *, CASE WHEN abs(x) > 1 THEN floor(x / 100.0::DOUBLE * 10000 + 0.5) / 10000.0::DOUBLE ELSE x END AS y,
  CASE WHEN event_id % 4 = 0 THEN DATE '1899-12-30' + CAST(day AS INTEGER) WHEN event_id % 4 = 1 THEN CAST(day AS DATE) WHEN event_id % 4 = 2 THEN CAST(strptime(day, '%m/%d/%Y') AS DATE) END AS d FROM n)
SELECT event_id, sid AS survey_id, sign(y) * floor(abs(y) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS nps_score, d AS survey_date,
  CAST((sid IS NULL)::INT + (y IS NULL OR y < -1 OR y > 1)::INT + (d IS NULL)::INT AS INTEGER) AS n_errors, coalesce(sid IS NOT NULL AND y BETWEEN -1 AND 1 AND d IS NOT NULL, FALSE) AS valid FROM m""", surveys=False)
def ingest_validate(spark, sf):
    """Every row of a file is judged: required fields, numbers with signs, ranges and date forms."""
    i = F.col("event_id")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    raw = table(spark, sf, "events").select(
        "event_id",
        F.when(i % 11 == 0, " ").otherwise(F.concat(F.lit("S"), i.cast("string"))).alias("survey_id"),
        F.when(i % 5 == 0, F.concat((i % 3 * 40).cast("string"), F.lit("%"))).when(i % 5 == 1, "x").when(i % 5 == 2, "7").otherwise(F.concat(F.lit("0."), (i % 10).cast("string"))).alias("nps_score"),
        F.when(i % 4 == 0, F.concat(F.lit("45"), pad(i % 1000, 3))).when(i % 4 == 1, F.concat(F.lit("2024-01-"), pad(i % 28 + 1, 2))).when(i % 4 == 2, F.concat((i % 12 + 1).cast("string"), F.lit("/"), (i % 28 + 1).cast("string"), F.lit("/2024"))).otherwise("soon").alias("survey_date"),
        *(F.lit("0.5").alias(c) for c in ("csat_score", "professionalism_score")),
        *(F.lit("x").alias(c) for c in ("agent_bms", "supervisor")),
    )
    out = ingest.validated(raw, percentages=("nps_score",))
    return out.select("event_id", "survey_id", "nps_score", "survey_date", F.size("errors").alias("n_errors"), "valid")


@query("ingest_template", _RAW + """,
n AS (SELECT *, nullif(trim(survey_id), '') AS sid, coalesce(TRY_CAST(nps AS DOUBLE), TRY_CAST(replace(nps, '%', '') AS DOUBLE)) AS x FROM raw),
m AS (SELECT *, CASE WHEN abs(x) > 1 THEN floor(x / 100.0::DOUBLE * 10000 + 0.5) / 10000.0::DOUBLE ELSE x END AS y FROM n)
SELECT event_id, sid AS survey_id, sign(y) * floor(abs(y) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS nps_score, event_id % 2 = 0 AS odd_column,
  CASE WHEN abs(x) > 1 THEN 'nps_score converted from percentage' ELSE '' END AS warnings, coalesce(sid IS NOT NULL AND y BETWEEN -1 AND 1 AND event_id % 4 <> 3, FALSE) AS valid FROM m""", surveys=False)
def ingest_template(spark, sf):
    """A file with headers of its own through the second version of a stored mapping."""
    i = F.col("event_id")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    raw = table(spark, sf, "events").select(
        "event_id",
        F.when(i % 11 == 0, " ").otherwise(F.concat(F.lit("S"), i.cast("string"))).alias("Survey  ID"),
        F.when(i % 5 == 0, F.concat((i % 3 * 40).cast("string"), F.lit("%"))).when(i % 5 == 1, "x").when(i % 5 == 2, "7").otherwise(F.concat(F.lit("0."), (i % 10).cast("string"))).alias("Net Promoter"),
        F.when(i % 4 == 0, F.concat(F.lit("45"), pad(i % 1000, 3))).when(i % 4 == 1, F.concat(F.lit("2024-01-"), pad(i % 28 + 1, 2))).when(i % 4 == 2, F.concat((i % 12 + 1).cast("string"), F.lit("/"), (i % 28 + 1).cast("string"), F.lit("/2024"))).otherwise("soon").alias("When"),
        *(F.lit("0.5").alias(c) for c in ("Sat.", "Manners")), *(F.lit("x").alias(c) for c in ("Who", "Lead")), (i % 2 == 0).alias("odd_column"),
    )
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    mapping = {"survey_id": "survey id", "nps_score": "NET PROMOTER", "csat_score": "sat.", "professionalism_score": "manners", "agent_bms": "who", "supervisor": "lead", "survey_date": "when"}
    ingest.save_template(store, "export", mapping | {"nps_score": "manners"})
    ingest.save_template(store, "export", mapping, ("nps_score",))
    out = ingest.with_template(raw, store, "export")
    return out.select("event_id", "survey_id", "nps_score", "odd_column", F.array_join("warnings", ",").alias("warnings"), "valid")


@query("ingest_cascade", """WITH e AS (SELECT *, event_id % 4 AS import_id FROM events), s AS (SELECT * FROM e WHERE import_id <> 2)
SELECT 'imports' AS name, (SELECT count(DISTINCT import_id) FROM s) AS n, CAST(3 AS BIGINT) AS version UNION ALL SELECT 'surveys', (SELECT count(*) FROM s), 3
UNION ALL SELECT 'versions', (SELECT count(*) FROM s WHERE event_id % 10 = 0), 3 UNION ALL SELECT 'analyses', (SELECT count(*) FROM s WHERE event_id % 3 = 0), 3
UNION ALL SELECT 'before', (SELECT count(*) FROM e), 1""", surveys=False)
def ingest_cascade(spark, sf):
    """An import deleted from a store with all that hangs on it, after a change to another table; the first version can still be read."""
    e = table(spark, sf, "events").withColumn("import_id", F.col("event_id") % 4)
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    store.replace({"surveys": e.select(F.col("event_id").alias("survey_id"), "import_id"), "imports": e.select(F.col("import_id").alias("id")).distinct(), "versions": e.filter("event_id % 10 = 0").select(F.col("event_id").alias("survey_id"), "import_id"), "analyses": e.filter("event_id % 6 = 0").select(F.col("event_id").alias("survey_id"))})
    store.replace({"analyses": e.filter("event_id % 3 = 0").select(F.col("event_id").alias("survey_id"))})
    ingest.delete_import(store, 2)
    version = store.manifest()["version"]
    count = lambda name, shown, v: store.read(name, v).agg(F.lit(shown).alias("name"), F.count(F.lit(1)).alias("n"), F.lit(v).cast("long").alias("version"))
    out = count("surveys", "before", 1)
    for name in ingest.IMPORTED:
        out = out.union(count(name, name, version))
    return out
