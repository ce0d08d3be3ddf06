"""Queries about people in texts, pseudonyms, grounded records and the log of calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.catalog._base import query, soundex
from surveyloom.operators import endpoints, grounding, people, privacy
from surveyloom.plans.dsl import run
from surveyloom.sources.surveys import analyses, categories, surveys, table, with_verbatim


def _leads(spark, sf):
    """A supervisor for each name of a part: "thing brandless, kind"."""
    words = F.split("p_name", " ")
    return table(spark, sf, "part").select(F.concat(words[1], F.lit("son, "), words[0], F.lit("ette")).alias("name")).distinct()


def _asked(spark, sf):
    """Texts that mean a supervisor more or less: whole names, parts, and typos at places that go with the key."""
    words, k = F.split("p_name", " "), F.col("p_partkey")
    natural = F.concat(words[0], F.lit("ette "), words[1], F.lit("son"))
    without = lambda x: F.concat(F.substring(x, F.lit(1), (k % F.length(x)).cast("int")), F.substring(x, (k % F.length(x) + 2).cast("int"), F.length(x)))
    first = F.concat(words[0], F.lit("ette"))
    text = F.when(k % 4 == 0, natural).when(k % 4 == 1, without(natural)).when(k % 4 == 2, without(first)).otherwise(F.concat(F.upper(words[1]), F.lit("SON")))
    return table(spark, sf, "part").select(text.alias("q")).distinct()


_LONGEST = "list_max(flatten(list_transform(range(1, len({a}) + 1), lambda i: list_transform(list_filter(range(1, len({a}) - i + 2), lambda l: contains({b}, substr({a}, i, l))), lambda l: {{'l': l, 'i': -i}}))))"


@query("people_matches", f"""WITH RECURSIVE w AS (SELECT DISTINCT split_part(p_name, ' ', 1) || 'ette' AS g, split_part(p_name, ' ', 2) || 'son' AS s FROM part),
p AS (SELECT s || ', ' || g AS name, s || ' ' || g AS whole, g || ' ' || s AS nat, g, s FROM w),
q AS (
  SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN n WHEN 1 THEN left(n, p_partkey % len(n)) || substr(n, p_partkey % len(n) + 2) WHEN 2 THEN left(g, p_partkey % len(g)) || substr(g, p_partkey % len(g) + 2) ELSE upper(s) END AS query
  FROM (SELECT p_partkey, split_part(p_name, ' ', 1) || 'ette' AS g, split_part(p_name, ' ', 2) || 'son' AS s, split_part(p_name, ' ', 1) || 'ette ' || split_part(p_name, ' ', 2) || 'son' AS n FROM part)
),
u AS (SELECT query, trim(regexp_replace(lower(query), ' +', ' ', 'g')) AS q FROM q),
alias AS (SELECT name, unnest([whole, nat, g, s]) AS a FROM p),
tok AS (SELECT name, unnest([s, g]) AS t FROM p),
step2 AS (SELECT query, min(name) AS name FROM u JOIN alias ON q = a GROUP BY 1),
part3 AS (SELECT DISTINCT query, name, word FROM (SELECT query, unnest(list_filter(str_split(q, ' '), lambda w: len(w) >= 3)) AS word FROM u) JOIN tok ON t = word),
step3 AS (SELECT query, min(name) AS name FROM (
  SELECT query, name FROM part3 JOIN u USING (query) GROUP BY query, name, q HAVING count(*) = len(list_distinct(list_filter(str_split(q, ' '), lambda w: len(w) >= 3)))) GROUP BY 1 HAVING count(*) = 1),
texts AS (SELECT DISTINCT q FROM u),
pairs AS (SELECT DISTINCT q AS x, y FROM texts, (SELECT t AS y FROM tok UNION SELECT a FROM alias) WHERE levenshtein(q, y) <= 0.35 * (len(q) + len(y))),
segs AS (
  SELECT x, y, x AS a, y AS b, {_LONGEST.format(a='x', b='y')} AS m FROM pairs
  UNION ALL
  SELECT x, y, a, b, {_LONGEST.format(a='a', b='b')} AS m FROM (
    SELECT x, y, unnest([{{'a': left(a, -m.i - 1), 'b': left(b, strpos(b, substr(a, -m.i, m.l)) - 1)}}, {{'a': substr(a, -m.i + m.l), 'b': substr(b, strpos(b, substr(a, -m.i, m.l)) + m.l)}}], recursive := true) FROM segs WHERE m IS NOT NULL
  ) WHERE a <> '' AND b <> ''
),
alike AS (SELECT x AS q, y, 2.0::DOUBLE * coalesce(sum(m.l), 0) / (len(x) + len(y)) AS v FROM segs GROUP BY 1, 2),
byword AS (
  SELECT c.q, t, levenshtein(c.q, t) AS d, greatest(len(c.q), len(t)) AS n, coalesce(v, 0) AS v, {soundex('c.q')} = {soundex('t')} AS sound
  FROM (SELECT q, t FROM texts, (SELECT DISTINCT t FROM tok)) c LEFT JOIN alike ON alike.q = c.q AND y = t
),
scored AS (
  SELECT q, name, greatest(1 - d / n::DOUBLE, v, CASE WHEN sound THEN 0.85 ELSE 0 END) * CASE WHEN d > CASE WHEN n <= 5 THEN 1 ELSE 2 END AND NOT (sound AND v >= 0.7) THEN CASE WHEN n <= 5 THEN 0.5 ELSE 0.6 END ELSE 1 END AS score
  FROM byword JOIN tok USING (t)
  UNION ALL SELECT alike.q, name, v FROM alike JOIN alias ON a = y
),
best AS (SELECT q, name, max(score) AS score FROM scored GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, name) AS k FROM best),
two AS (SELECT q, max(CASE WHEN k = 1 THEN name END) AS name, max(CASE WHEN k = 1 THEN score END) AS one, coalesce(max(CASE WHEN k = 2 THEN score END), 0) AS two FROM ranked WHERE k <= 2 GROUP BY q)
SELECT u.query, coalesce(step2.name, step3.name, two.name) AS matched, CAST(CASE WHEN step2.name IS NOT NULL THEN 2 WHEN step3.name IS NOT NULL THEN 3 ELSE 4 END AS INTEGER) AS step
FROM u LEFT JOIN step2 USING (query) LEFT JOIN step3 USING (query) LEFT JOIN two ON two.q = u.q AND one >= 0.78 AND (one - two >= 0.12 OR one >= 0.9)
WHERE coalesce(step2.name, step3.name, two.name) IS NOT NULL""", surveys=False)
def people_matches(spark, sf):
    """Whole names, parts of names and typos, and the supervisor each one means."""
    return people.best_matches(_asked(spark, sf), "q", _leads(spark, sf), "name")


@query("people_replaced", """SELECT o_orderkey, 'ask AGT_' || o_custkey || ', or SUP_' || split_part(p_name, ' ', 1) || '_' || split_part(p_name, ' ', 2) || ' now' AS replaced, CAST(1 AS BIGINT) AS agents, CAST(1 AS BIGINT) AS supervisors
FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)""", surveys=False)
def people_replaced(spark, sf):
    """Ids and names inside texts become pseudonyms."""
    parts = table(spark, sf, "part")
    n, words = parts.count(), F.split("p_name", " ")
    texts = table(spark, sf, "orders").join(parts, F.col("p_partkey") == F.col("o_orderkey") % n)
    texts = texts.select("o_orderkey", F.concat(F.lit("ask bms"), F.col("o_custkey"), F.lit(", or "), F.initcap(words[0]), F.lit("ette "), words[1], F.lit("son now")).alias("t"))
    leads = parts.select(F.lit("supervisor").alias("kind"), F.concat(words[1], F.lit("son, "), words[0], F.lit("ette")).alias("name"), F.concat(F.lit("SUP_"), words[0], F.lit("_"), words[1]).alias("pseudonym")).distinct()
    agents = table(spark, sf, "customer").select(F.lit("bms"), F.concat(F.lit("bms"), F.col("c_custkey")), F.concat(F.lit("AGT_"), F.col("c_custkey")))
    return people.without_people(texts, "o_orderkey", "t", leads.union(agents)).select("o_orderkey", "replaced", "agents", "supervisors")


@query("people_reidentified", "SELECT o_orderkey, c_name || ' asked AGT_NOBODY, then ' || c_name || '.' AS named FROM orders JOIN customer ON c_custkey = o_custkey", surveys=False)
def people_reidentified(spark, sf):
    """Pseudonyms in texts as names again, through a vault of all customers."""
    token = lambda k: F.concat(F.lit("AGT_"), F.lpad(F.col(k).cast("string"), 9, "0"))
    vault = table(spark, sf, "customer").select(token("c_custkey").alias("pseudonym"), F.col("c_name").alias("internal_id"))
    texts = table(spark, sf, "orders").select("o_orderkey", F.concat(token("o_custkey"), F.lit(" asked AGT_NOBODY, then "), token("o_custkey"), F.lit(".")).alias("t"))
    return people.reidentified(texts, "o_orderkey", "t", vault).select("o_orderkey", "named")


@query("pseudonym_draws", "SELECT count(*) AS made, count(*) AS pseudonyms, count(*) AS entities, CAST(0 AS BIGINT) AS taken FROM customer WHERE c_custkey % 3 <> 0", surveys=False)
def pseudonym_draws(spark, sf):
    """Pseudonyms that are short enough to collide, beside a vault that has a third of the customers."""
    ids = table(spark, sf, "customer").select("c_custkey", F.lit("agent").alias("type"), F.col("c_name").alias("internal_id"))
    letters = F.lpad(F.upper(F.conv(F.col("c_custkey").cast("string"), 10, 36)), 4, "A")
    vault = ids.filter("c_custkey % 3 = 0").select(F.lit("s").alias("scope"), "type", "internal_id", F.concat(F.lit("AGT_"), letters).alias("pseudonym"))
    made = privacy.new_pseudonyms(ids, vault, "s", length=4)
    clash = made.join(vault.select("pseudonym"), "pseudonym", "left_semi").agg(F.count(F.lit(1)).alias("taken"))
    return made.agg(F.count(F.lit(1)).alias("made"), F.countDistinct("pseudonym").alias("pseudonyms"), F.countDistinct("internal_id").alias("entities")).crossJoin(clash)


@query("grounded_records", """
f AS (SELECT s.*, min(c.name) OVER () AS least FROM surveys s CROSS JOIN (SELECT min(name) AS name FROM categories) c),
hit AS (SELECT f.* FROM f WHERE tenure_days >= 20 AND survey_id IN (SELECT survey_id FROM analyses JOIN categories USING (category_id) WHERE name = least)),
page AS (SELECT * FROM hit ORDER BY survey_date DESC, survey_id LIMIT 300)
SELECT survey_date, nps_score, csat_score, professionalism_score, least AS category, wave, tenure_days, verbatim IS NOT NULL AS has_text, TRUE AS well_formed, (SELECT count(*) FROM hit) AS total,
  (SELECT count(DISTINCT agent_bms) FROM page) AS agents, (SELECT count(DISTINCT supervisor) FROM page) AS supervisors, count(*) AS n FROM page GROUP BY ALL""")
def grounded_records(spark, sf):
    """A page of records without people: filtered by category through analyses, scrubbed, with references instead of identities."""
    s = surveys(spark, sf)
    named = categories(spark, sf)
    first = named.agg(F.min("name")).first()[0]
    known = s.select(F.lit("supervisor").alias("kind"), F.col("supervisor").alias("name"), F.concat(F.lit("SUP_"), F.upper(F.substring(F.md5("supervisor"), 1, 6))).alias("pseudonym")).distinct()
    vault = spark.createDataFrame([], "scope string, type string, internal_id string, pseudonym string")
    records, total, _ = grounding.grounded_records(s, analyses(spark, sf), named, known, vault, "run", {"category": first, "filters": [{"field": "tenure_days", "operator": ">=", "value": 20}], "limit": 300}, lambda rows: with_verbatim(rows, spark, sf))
    fits = F.col("record_ref").rlike("^REC_[A-Z0-9]{6}$") & F.col("agent_ref").rlike("^AGT_[A-Z0-9]{6}$") & F.col("supervisor_ref").rlike("^SUP_[A-Z0-9]{6}$") & ~F.coalesce(F.col("verbatim"), F.lit("")).rlike("[a-z0-9]@[a-z0-9-]+[.][a-z]{2}")
    counts = records.agg(F.countDistinct("agent_ref").alias("agents"), F.countDistinct("supervisor_ref").alias("supervisors"))
    by = ["survey_date", "nps_score", "csat_score", "professionalism_score", "category", "wave", "tenure_days", F.col("verbatim").isNotNull().alias("has_text"), fits.alias("well_formed")]
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).crossJoin(total).crossJoin(counts)


def _digest(columns: str, rows: str) -> str:
    return f"(SELECT CAST(coalesce(sum(CAST('0x' || substr(md5(concat_ws('|', {columns})), 1, 12) AS BIGINT)), 0) AS VARCHAR) FROM {rows})"


@query("grounded_log", f"""
v AS (SELECT supervisor, count(*) AS survey_volume FROM surveys GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12),
d AS (SELECT DISTINCT 'wave' AS dimension, wave AS value FROM surveys WHERE wave IS NOT NULL AND wave <> '')
SELECT CAST(1 AS BIGINT) AS call, 'query_data' AS tool, 'completed' AS status, (SELECT count(*) FROM v) AS rows, {_digest('supervisor, CAST(survey_volume AS VARCHAR)', 'v')} AS digest, '{{"api_key": "[REDACTED]", "group_by": ["supervisor"], "limit": 12, "metrics": ["survey_volume"]}}' AS arguments
UNION ALL SELECT 2, 'dimension_values', 'completed', (SELECT count(*) FROM d), {_digest('dimension, value', 'd')}, '{{"dimensions": ["wave"]}}'
UNION ALL SELECT 3, 'query_data', 'error', NULL, NULL, '{{"metrics": ["none such"]}}'""")
def grounded_log(spark, sf):
    """The log of three calls, one of which fails."""
    s, log = surveys(spark, sf), grounding.CallLog(spark)
    log.run("query_data", {"metrics": ["survey_volume"], "group_by": ["supervisor"], "limit": 12, "api_key": "k"}, lambda a: run({k: v for k, v in a.items() if k != "api_key"}, s).select("supervisor", "survey_volume"))
    log.run("dimension_values", {"dimensions": ["wave"]}, lambda a: endpoints.dimension_values(s, a["dimensions"]))
    log.run("query_data", {"metrics": ["none such"]}, lambda a: run(a, s))
    return log.table().select("call", "tool", "status", "rows", "digest", "arguments")
