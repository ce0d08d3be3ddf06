"""Survey-shaped tables over the star schema, written alike for Spark and for SQL.

Scores avoid rounding, so both engines hold the same values.  One third of the agents
changes supervisor in the middle of the month; a quarter of the surveys is uncategorised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGE_DATE = "2024-01-16"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per survey.  The dimensions join by key; Spark picks how, by their size."""
    e = table(spark, sf_dir, "events").alias("e")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    day = F.col("ts").cast("date")
    moved = F.when((F.col("user_id") % 3 == 0) & (day >= F.lit(CHANGE_DATE).cast("date")), 1).otherwise(0)
    rows = e.join(c, F.col("c_custkey") == F.col("user_id")).withColumn("__nation", (F.col("c_nationkey") + moved) % 25)
    rows = rows.join(n, F.col("n_nationkey") == F.col("__nation"))
    return rows.select(
        F.col("event_id"),
        F.concat(F.lit("SRV-"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("survey_id"),
        F.when(F.col("value") > 60, 1.0).when(F.col("value") > 20, 0.0).otherwise(-1.0).alias("nps_score"),
        (F.floor(F.least("value", F.lit(100.0))) / 100.0).alias("csat_score"),
        (((F.col("event_id") * 37) % 21 - 10).cast("double") / 10.0).alias("professionalism_score"),
        F.concat(F.lit("BMS-"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("agent_bms"),
        F.col("c_name").alias("agent_name"),
        F.col("n_name").alias("supervisor"),
        day.alias("survey_date"),
        F.col("c_mktsegment").alias("wave"),
        ((F.col("user_id") * 7) % 400).cast("int").alias("tenure_days"),
        F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("category_name"),
    )


def with_verbatim(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds the free text; only queries that read texts pay for this join.  Events go round all documents."""
    texts = table(spark, sf_dir, "documents").count()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("__text"))
    joined = rows.join(docs, F.col("doc_id") == F.col("event_id") % max(1, texts), "left")
    return joined.withColumn("verbatim", F.when(F.col("event_id") % 4 != 0, F.col("__text"))).drop("doc_id", "__text")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(category_id, name): the distinct types, numbered by name."""
    from pyspark.sql import Window

    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct()
    return names.withColumn("category_id", F.row_number().over(Window.orderBy("name")).cast("long"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(survey_id, category_id, confidence, status): every twentieth survey was analysed twice."""
    e = table(spark, sf_dir, "events").filter("event_id % 4 <> 0").join(categories(spark, sf_dir), F.col("event_type") == F.col("name"))
    e = e.withColumn("copy", F.explode(F.when(F.col("event_id") % 20 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return e.select(F.concat(F.lit("SRV-"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("survey_id"), "category_id", ((F.col("event_id") % 100) / 100.0).alias("confidence"), F.when(F.col("event_id") % 7 == 0, "failed").otherwise("completed").alias("status"))


#: The same tables for DuckDB, as the head of a WITH clause.
SURVEYS_SQL = f"""
surveys AS (
  SELECT e.event_id, concat('SRV-', lpad(CAST(e.event_id AS VARCHAR), 8, '0')) AS survey_id,
    CASE WHEN e.value > 60 THEN 1.0::DOUBLE WHEN e.value > 20 THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS nps_score,
    floor(least(e.value, 100.0::DOUBLE)) / 100.0::DOUBLE AS csat_score,
    CAST((e.event_id * 37) % 21 - 10 AS DOUBLE) / 10.0::DOUBLE AS professionalism_score,
    CASE WHEN e.event_id % 4 = 0 THEN NULL ELSE d.text END AS verbatim,
    concat('BMS-', lpad(CAST(e.user_id AS VARCHAR), 5, '0')) AS agent_bms, c.c_name AS agent_name, n.n_name AS supervisor,
    CAST(e.ts AS DATE) AS survey_date, c.c_mktsegment AS wave, CAST((e.user_id * 7) % 400 AS INTEGER) AS tenure_days,
    CASE WHEN e.event_id % 4 = 0 THEN NULL ELSE e.event_type END AS category_name
  FROM events e JOIN customer c ON c.c_custkey = e.user_id
  JOIN nation n ON n.n_nationkey = (c.c_nationkey + CASE WHEN e.user_id % 3 = 0 AND CAST(e.ts AS DATE) >= DATE '{CHANGE_DATE}' THEN 1 ELSE 0 END) % 25
  CROSS JOIN (SELECT greatest(count(*), 1) AS texts FROM documents) dn LEFT JOIN documents d ON d.doc_id = e.event_id % dn.texts
),
categories AS (SELECT event_type AS name, row_number() OVER (ORDER BY event_type) AS category_id FROM (SELECT DISTINCT event_type FROM events)),
analyses AS (
  SELECT concat('SRV-', lpad(CAST(event_id AS VARCHAR), 8, '0')) AS survey_id, category_id, (event_id % 100) / 100.0::DOUBLE AS confidence,
    CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'completed' END AS status
  FROM events JOIN categories ON event_type = name CROSS JOIN (SELECT unnest([0, 1]) AS copy) WHERE event_id % 4 <> 0 AND (copy = 0 OR event_id % 20 = 1)
)"""
