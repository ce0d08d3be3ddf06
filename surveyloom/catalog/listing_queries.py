"""Listings, pivots, histories, merging of reviews and chart geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.catalog._base import CLAMPED_MEAN, MEAN, query, r4, soundex
from surveyloom.operators import ingest, kpi, listings, org, reports, usage
from surveyloom.sources.surveys import surveys, table


@query("pivot_customer_parts", "SELECT DISTINCT o_custkey, l_suppkey, s_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey", surveys=False)
def pivot_customer_parts(spark, sf):
    """Customers and their suppliers through the order lines."""
    pivot = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey"), "o_orderkey")
    left = pivot.select("o_custkey").distinct()
    right = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return listings.through_pivot(left, pivot, right, "o_custkey", "l_suppkey").select("o_custkey", "l_suppkey", "s_name")


@query("permission_union", "SELECT c_custkey, min(way) AS way FROM (SELECT c_custkey, 'segment' AS way FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT o_custkey, 'order' FROM orders WHERE o_totalprice > 400000) GROUP BY 1", surveys=False)
def permission_union(spark, sf):
    a = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit("segment").alias("way"))
    b = table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"), F.lit("order").alias("way"))
    return listings.united(a, b, key="c_custkey")


@query("related_search", "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE contains(o_orderpriority, '1') OR contains(c_name, '1')", surveys=False)
def related_search(spark, sf):
    """A keyword in the row itself or in the related row."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return listings.related_search(rows, table(spark, sf, "customer"), "c_custkey", ["o_orderpriority"], ["c_name"], "1").select("o_orderkey")


@query("last_ten_surveys", """
k AS (SELECT agent_bms, survey_id, row_number() OVER (PARTITION BY agent_bms ORDER BY survey_date DESC, survey_id DESC) AS k FROM surveys)
SELECT agent_bms, survey_id, CAST(row_number() OVER (PARTITION BY agent_bms ORDER BY k DESC) AS INTEGER) AS place FROM k WHERE k <= 10""")
def last_ten_surveys(spark, sf):
    return listings.last_n(surveys(spark, sf).select("agent_bms", "survey_id", "survey_date"), "agent_bms", F.struct("survey_date", "survey_id"), 10).drop("survey_date")


@query("status_counts", "SELECT count(*) AS total, count_if(o_orderstatus = 'O') AS O, count_if(o_orderstatus = 'F') AS F, count_if(o_orderstatus = 'P') AS P FROM orders", surveys=False)
def status_counts(spark, sf):
    return listings.status_counts(table(spark, sf, "orders"), "o_orderstatus", ["O", "F", "P"])


@query("soft_delete", "SELECT s_suppkey, FALSE AS active FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_linenumber > 5)", surveys=False)
def soft_delete(spark, sf):
    used = table(spark, sf, "lineitem").filter("l_quantity > 49 and l_linenumber > 5").select(F.col("l_suppkey").alias("s_suppkey"))
    return listings.deactivated(table(spark, sf, "supplier").select("s_suppkey"), used, "s_suppkey")


@query("date_keys", "SELECT DISTINCT d FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders UNION ALL SELECT CAST(l_shipdate AS DATE) FROM lineitem)", surveys=False)
def date_keys(spark, sf):
    day = lambda t, c: table(spark, sf, t).select(F.col(c).cast("date").alias("d"))
    return listings.date_keys(day("orders", "o_orderdate"), day("lineitem", "l_shipdate"), day="d")


@query("date_part_filter", "SELECT event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-10' AND CAST(ts AS DATE) <= DATE '2024-01-12' GROUP BY 1", surveys=False)
def date_part_filter(spark, sf):
    day = F.to_date("ts")
    return table(spark, sf, "events").filter((day >= F.lit("2024-01-10").cast("date")) & (day <= F.lit("2024-01-12").cast("date"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("listing_nulls_last", "SELECT survey_id, category_name FROM surveys ORDER BY category_name IS NULL, category_name DESC, survey_id LIMIT 40 OFFSET 7480")
def listing_nulls_last(spark, sf):
    """A page across the edge between named rows and rows without a category."""
    return usage.page(surveys(spark, sf).select("survey_id", "category_name"), [F.col("category_name").desc_nulls_last(), "survey_id"], 40, 7480)


@query("tool_listing", "SELECT t AS tool_name, count(e.event_id) AS calls, count(CASE WHEN e.event_id % 9 = 0 THEN 1 END) AS errors FROM (SELECT unnest(['click', 'view', 'unused']) AS t) LEFT JOIN events e ON event_type = t GROUP BY 1", surveys=False)
def tool_listing(spark, sf):
    calls = table(spark, sf, "events").select(F.col("event_type").alias("tool_name"), F.col("value").alias("duration_ms"), F.when(F.col("event_id") % 9 == 0, "error").otherwise("completed").alias("status"))
    return usage.tool_listing(spark.createDataFrame([("click",), ("view",), ("unused",)], "tool_name string"), calls).drop("avg_ms")


@query("run_tool_frequencies", "SELECT user_id, event_type AS tool_name, count(*) AS n FROM events GROUP BY 1, 2", surveys=False)
def run_tool_frequencies(spark, sf):
    calls = table(spark, sf, "events").select("user_id", F.col("event_type").alias("tool_name"), F.col("event_id").alias("tokens"))
    return usage.run_diagnostics(calls, "user_id", "tokens").select("user_id", F.explode("tools").alias("tool_name", "n"))


@query("review_merge", """WITH a AS (SELECT p_partkey, 'P-' || p_partkey AS agent_bms, split_part(p_name, ' ', 2) || ' ' || p_brand || ', ' || split_part(p_name, ' ', 1) || ' ' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS agent_name FROM part)
SELECT agent_bms, agent_name, CASE p_partkey % 6 WHEN 0 THEN 'same name' WHEN 1 THEN 'id' WHEN 2 THEN 'turned round' WHEN 3 THEN 'shortened' WHEN 4 THEN 'longer' END AS comment,
  CAST(CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 4 END AS INTEGER) AS way FROM a""", surveys=False)
def review_merge(spark, sf):
    """Comments meet reviews by name in other letters, by id, by words turned round, by a name inside another; a sixth stays without one."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    given, surname = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    last, first = F.concat_ws(" ", surname, "p_brand"), F.concat_ws(" ", given, F.lpad(k.cast("string"), 9, "0"))
    base = p.select(F.concat(F.lit("P-"), k).alias("agent_bms"), F.concat_ws(", ", last, first).alias("agent_name"))
    # the key ends each name, so a shortened name is inside one other name only
    name = F.when(k % 6 == 0, F.upper(F.concat_ws(", ", last, first))).when(k % 6 == 1, F.concat(F.lit(" P-"), k)).when(k % 6 == 2, F.concat_ws(" ", first, last))
    name = name.when(k % 6 == 3, F.expr("substring(whole, 2)")).when(k % 6 == 4, F.concat(F.lit("Dr "), last, F.lit(", "), first, F.lit(" jr")))
    p = p.withColumn("whole", F.concat_ws(", ", last, first))
    comment = F.when(k % 6 == 0, "same name").when(k % 6 == 1, "id").when(k % 6 == 2, "turned round").when(k % 6 == 3, "shortened").when(k % 6 == 4, "longer")
    extra = p.select(name.alias("name"), comment.alias("comment")).filter("comment is not null")
    return reports.merged_reviews(base, extra)


@query("identity_lookup", "SELECT survey_id, (SELECT min(agent_name) FROM surveys x WHERE x.agent_bms = s.agent_bms) AS label FROM surveys s WHERE tenure_days < 40")
def identity_lookup(spark, sf):
    s = surveys(spark, sf)
    names = s.groupBy("agent_bms").agg(F.min("agent_name").alias("label"))
    return s.filter("tenure_days < 40").join(names, "agent_bms", "left").select("survey_id", "label")


@query("linked_surveys", "SELECT survey_id, 'SUP-' || replace(supervisor, '_', '-') AS supervisor_id, 'TEAM-' || replace(supervisor, '_', '-') AS team_id FROM surveys")
def linked_surveys(spark, sf):
    """Surveys with the ids of their supervisor and team."""
    s = surveys(spark, sf).select("survey_id", "supervisor")
    leads = org.members(surveys(spark, sf)).filter("role = 'supervisor'").select(F.col("name").alias("supervisor"), F.col("external_id").alias("supervisor_id"))
    teams = org.teams(surveys(spark, sf)).select("supervisor", F.col("team").alias("team_id"))
    return s.join(leads, "supervisor", "left").join(teams, "supervisor", "left").drop("supervisor")


@query("run_chart_geometry", f"""
d AS (SELECT supervisor, survey_date, count(*) AS survey_volume, {r4(MEAN.format('nps_score'))} AS nps, {r4(CLAMPED_MEAN.format('csat_score'))} AS csat FROM surveys GROUP BY 1, 2),
g AS (SELECT *, row_number() OVER (PARTITION BY supervisor ORDER BY survey_date) - 1 AS place, count(*) OVER (PARTITION BY supervisor) AS n, CASE WHEN min(nps) OVER (PARTITION BY supervisor) < -0.01 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS low, max(survey_volume) OVER (PARTITION BY supervisor) AS top FROM d)
SELECT supervisor, survey_date, CASE WHEN n > 1 THEN place * 520.0::DOUBLE / (n - 1) ELSE 260.0::DOUBLE END AS x, 115.0::DOUBLE * (1.0::DOUBLE - (nps - low) / (1.0::DOUBLE - low)) AS y, survey_volume * 115.0::DOUBLE * 0.32::DOUBLE / top AS bar FROM g""")
def run_chart_geometry(spark, sf):
    return listings.run_chart(kpi.daily(surveys(spark, sf), "supervisor"), "supervisor").drop("labelled")


@query("encryption_round_trip", "SELECT supervisor, count(*) AS n, TRUE AS same, TRUE AS hidden FROM surveys GROUP BY 1")
def encryption_round_trip(spark, sf):
    key = "0123456789abcdef"
    s = surveys(spark, sf).select("supervisor", listings.encrypted(F.col("supervisor"), key).alias("c"))
    back = F.aes_decrypt(F.unbase64("c"), F.lit(key)).cast("string")
    return s.groupBy("supervisor").agg(F.count(F.lit(1)).alias("n"), F.min(back == F.col("supervisor")).alias("same"), F.min(F.col("c") != F.col("supervisor")).alias("hidden"))


@query("name_codes", f"SELECT p_partkey, {soundex('split_part(p_name, chr(32), 1)')} AS code FROM part", surveys=False)
def name_codes(spark, sf):
    """Phonetic codes of part names."""
    return table(spark, sf, "part").select("p_partkey", F.soundex(F.element_at(F.split("p_name", " "), 1)).alias("code"))


@query("tool_catalogue", "SELECT p_partkey, p_size % 2 = 0 AS builtin, p_size AS sort_order, p_name AS name, row_number() OVER (ORDER BY p_size % 2 = 0 DESC, p_size, p_name, p_partkey) AS rank FROM part", surveys=False)
def tool_catalogue(spark, sf):
    """Parts stand for tools; names are made unique by the key."""
    tools = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 2 == 0).alias("builtin"), F.col("p_size").alias("sort_order"), F.concat_ws("\u0001", "p_name", F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("name"))
    return usage.catalogue(tools).withColumn("name", F.element_at(F.split("name", "\u0001"), 1))


@query("raw_records", "SELECT survey_id, survey_date, nps_score, total FROM surveys, (SELECT count(*) AS total FROM surveys WHERE contains(lower(supervisor), 'an') AND nps_score >= 0 AND survey_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-20') WHERE contains(lower(supervisor), 'an') AND nps_score >= 0 AND survey_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' ORDER BY survey_date DESC, survey_id LIMIT 200 OFFSET 10")
def raw_records(spark, sf):
    """A page of filtered records beside the total before paging."""
    filters = [{"field": "supervisor", "operator": "like", "value": "AN"}, {"field": "nps_score", "operator": ">=", "value": 0}, {"field": "survey_date", "operator": "between", "value": ["2024-01-03", "2024-01-20"]}]
    part, total = usage.raw_records(surveys(spark, sf), filters, offset=10)
    return part.select("survey_id", "survey_date", "nps_score").crossJoin(F.broadcast(total))


@query("run_chart_labels", """
d AS (SELECT DISTINCT supervisor, survey_date FROM surveys),
p AS (SELECT *, row_number() OVER (PARTITION BY supervisor ORDER BY survey_date) - 1 AS place, count(*) OVER (PARTITION BY supervisor) AS n FROM d)
SELECT supervisor, survey_date, place % CASE WHEN n > 16 THEN 3 WHEN n > 9 THEN 2 ELSE 1 END = 0 OR place = n - 1 AS labelled FROM p""")
def run_chart_labels(spark, sf):
    """Which days of a run chart get a label: every one, every second or every third, and the last."""
    return listings.run_chart(kpi.daily(surveys(spark, sf), "supervisor"), "supervisor").select("supervisor", "survey_date", "labelled")


@query("listing_filtered", """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 15 OFFSET 15""", surveys=False)
def listing_filtered(spark, sf):
    """The second page of a listing, newest first, by equality and by a period."""
    rows = table(spark, sf, "orders")
    return listings.filtered(rows, "o_orderdate", "o_orderkey", {"o_orderstatus": "O", "o_orderpriority": "1-URGENT", "o_custkey": None}, "1995-01-01", "1996-12-31", page=2).select("o_orderkey", "o_orderdate")


@query("computed_columns", """
k AS (SELECT supervisor, sum(CAST(nps_score AS DECIMAL(6,4)))::DOUBLE / count(nps_score) * 100 AS base FROM surveys GROUP BY 1)
SELECT supervisor, floor(base / 50 * 100 * 10 + 0.5) / 10 AS percent_of_target, floor((base - 50) * 10 + 0.5) / 10 AS difference, floor(base * 2.5 * 10 + 0.5) / 10 AS custom, CAST(NULL AS DOUBLE) AS without_target FROM k""")
def computed_columns(spark, sf):
    from surveyloom.functions.scores import exact

    k = surveys(spark, sf).groupBy("supervisor").agg((F.sum(exact(F.col("nps_score"))).cast("double") / F.count("nps_score") * 100).alias("base"))
    tenth = lambda x: F.floor(x * 10 + 0.5) / 10
    made = {"percent_of_target": ("percent_of_target", 50.0), "difference": ("diff_from_target", 50.0), "custom": ("custom", 2.5), "without_target": ("percent_of_target", 0.0)}
    return k.select("supervisor", *(tenth(kpi.computed_column(F.col("base"), kind, value)).alias(name) for name, (kind, value) in made.items()))


@query("weighted_totals", """
d AS (SELECT survey_date, count(*) AS v, floor(sum(CAST(nps_score AS DECIMAL(6,4)))::DOUBLE / count(*) * 10000 + 0.5) / 10000 AS nps FROM surveys WHERE wave = 'BUILDING' GROUP BY 1),
t AS (SELECT 'all days' AS part, sum(v) AS survey_volume, sum(CAST(nps AS DECIMAL(8,4)) * v)::DOUBLE / sum(v) AS nps FROM d)
SELECT part, CAST(survey_volume AS BIGINT) AS survey_volume, sign(nps) * floor(abs(nps) * 10000 + 0.5) / 10000 AS nps FROM t UNION ALL SELECT 'no day', 0, 0.0""")
def weighted_totals(spark, sf):
    """Totals of a table weighted by volume; an empty table has 0."""
    days = kpi.daily(surveys(spark, sf).filter("wave = 'BUILDING'"))
    total = lambda rows, part: kpi.weighted_totals(rows).select(F.lit(part).alias("part"), "survey_volume", "nps")
    return total(days, "all days").union(total(days.filter("survey_volume < 0"), "no day"))


@query("ingest_preflight", """WITH f AS (SELECT * FROM events ORDER BY event_id LIMIT 100)
SELECT count(*) FILTER (event_id % 13 <> 0 AND event_id % 7 <> 0) AS ready_count, count(*) FILTER (event_id % 3 = 0) AS warning_count, count(*) FILTER (event_id % 13 = 0 OR event_id % 7 = 0) AS error_count,
  string_agg(event_id, ',' ORDER BY event_id) FILTER (k <= 10) AS sample, FALSE AS can_import
FROM (SELECT *, CASE WHEN event_id % 13 = 0 OR event_id % 7 = 0 THEN row_number() OVER (PARTITION BY event_id % 13 = 0 OR event_id % 7 = 0 ORDER BY event_id) END AS k FROM f)""", surveys=False)
def ingest_preflight(spark, sf):
    """The first hundred rows of a file, judged before its import."""
    i = F.col("event_id")
    raw = table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("S"), i).alias("survey_id"), F.when(i % 3 == 0, "80%").otherwise("0.8").alias("nps_score"), F.when(i % 13 == 0, "bad").otherwise("1").alias("csat_score"), F.lit("1").alias("professionalism_score"),
        F.lit("B").alias("agent_bms"), F.when(i % 7 == 0, " ").otherwise("Lead").alias("supervisor"), F.lit("2024-01-02").alias("survey_date"),
    )
    out = ingest.preflight(raw, "event_id", ("nps_score",))
    return out.select("ready_count", "warning_count", "error_count", F.array_join(F.transform("sample_errors", lambda e: e["row"].cast("string")), ",").alias("sample"), "can_import")
