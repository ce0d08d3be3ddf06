"""Merging a classifier's answers into the analyses of verbatims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Confidence of an answer that gives none.
DEFAULT_CONFIDENCE = 0.85


def merged_answers(pending: DataFrame, answers: DataFrame, categories: list[tuple[int, str]], analyses: DataFrame) -> DataFrame:
    """(survey_id, category_id, confidence, status) of the surveys that were waiting.

    ``pending`` has survey_id, ``answers`` survey_id, category and confidence, ``categories``
    the active ones in order (a dictionary of bounded size).  A category is the one of that
    name, else the first whose name stands in the answer in any letters, else the first of
    all.  Surveys that are completed are skipped, those without an answer fail with 0.
    """
    names = [F.lit(n) for _, n in categories]
    ids = [F.lit(i) for i, _ in categories]
    answer = F.coalesce("category", F.lit(""))
    exact = F.coalesce(*(F.when(answer == n, i) for n, i in zip(names, ids, strict=True)))
    inside = F.coalesce(*(F.when(F.contains(F.lower(answer), F.lower(n)), i) for n, i in zip(names, ids, strict=True)))
    open_ = pending.select("survey_id").distinct().join(analyses.filter("status = 'completed'").select("survey_id").distinct(), "survey_id", "left_anti")
    # of several answers for a survey the last counts; answers without an order count by their text
    one = answers.groupBy("survey_id").agg(F.max(F.struct("category", "confidence")).alias("a")).select("survey_id", "a.*", F.lit(True).alias("__answered"))
    rows = open_.join(one, "survey_id", "left")
    done = F.col("__answered").isNotNull()
    return rows.select("survey_id", F.when(done, F.coalesce(exact, inside, ids[0])).alias("category_id"), F.when(done, F.coalesce(F.col("confidence").cast("double"), F.lit(DEFAULT_CONFIDENCE))).otherwise(0.0).alias("confidence"), F.when(done, "completed").otherwise("failed").alias("status"))
