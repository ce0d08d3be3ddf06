"""Surveys that keep arriving: daily KPIs per supervisor, kept up to date by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from surveyloom.functions.scores import exact, top_box_clamped

SCHEMA = "survey_id string, nps_score double, csat_score double, professionalism_score double, supervisor string, survey_time timestamp"


def arriving(spark: SparkSession, folder: str, files_each: int = 100) -> DataFrame:
    """New Parquet files in a folder as a stream; a repeated survey_id counts once within the lateness."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_each).parquet(folder)
    return rows.withWatermark("survey_time", "7 days").dropDuplicatesWithinWatermark(["survey_id"])


def daily_totals(stream: DataFrame) -> DataFrame:
    """Sums and counts by day and supervisor: they merge, which means do not."""
    day = F.window("survey_time", "1 day")
    total = lambda c: F.sum(exact(c)).cast("double")
    out = stream.groupBy(day.alias("day"), "supervisor").agg(F.count(F.lit(1)).alias("survey_volume"), total(F.col("nps_score")).alias("nps_sum"), total(top_box_clamped(F.col("csat_score"))).alias("csat_sum"))
    return out.select(F.col("day.start").cast("date").alias("survey_date"), "supervisor", "survey_volume", (F.col("nps_sum") / F.col("survey_volume")).alias("nps"), (F.col("csat_sum") / F.col("survey_volume")).alias("csat"))


def start(totals: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Run until the files present are read; the result is the in-memory table ``name``."""
    return totals.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
