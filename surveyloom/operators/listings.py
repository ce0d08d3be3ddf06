"""Relations behind listings: pivots, permission unions, searches, histories, soft deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def through_pivot(left: DataFrame, pivot: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of two relations that a pivot connects, without duplicates of a pair."""
    return left.join(pivot.select(left_key, right_key).distinct(), left_key).join(right, right_key)


def united(*parts: DataFrame, key: str) -> DataFrame:
    """Union of relations with one row per key; the smallest row of a key stays."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rest = [c for c in out.columns if c != key]
    return out.groupBy(key).agg(F.min(F.struct(*rest)).alias("x")).select(key, "x.*")


def related_search(rows: DataFrame, related: DataFrame, key: str, own: list[str], theirs: list[str], keyword: str) -> DataFrame:
    """Rows that contain the keyword themselves, or whose related row does."""
    def hit(columns: list[str]) -> Column:
        out = F.lit(False)
        for c in columns:
            out = out | F.coalesce(F.col(c).contains(keyword), F.lit(False))
        return out

    matches = related.filter(hit(theirs)).select(key).distinct().withColumn("__related", F.lit(True))
    return rows.join(matches, key, "left").filter(hit(own) | F.col("__related").isNotNull()).drop("__related")


def last_n(rows: DataFrame, by: str, order: Column, n: int = 10) -> DataFrame:
    """The newest n rows of each group, numbered from the oldest of them."""
    newest = rows.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(order.desc()))).filter(F.col("__k") <= n)
    return newest.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.col("__k").desc()))).drop("__k")


def status_counts(rows: DataFrame, status: str, values: list[str]) -> DataFrame:
    """One row with the number of rows in each status, in one pass."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(status) == v).alias(v) for v in values))


def deactivated(rows: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Delete where nothing refers to a row; keep it as inactive where something does."""
    return rows.join(references.select(key).distinct(), key, "left_semi").withColumn("active", F.lit(False))


def date_keys(*parts: DataFrame, day: str) -> DataFrame:
    """Distinct union of the days of several tables."""
    out = parts[0].select(day)
    for p in parts[1:]:
        out = out.union(p.select(day))
    return out.distinct()


def run_chart(days: DataFrame, by: str, width: float = 520.0, height: float = 115.0) -> DataFrame:
    """Geometry of a run chart: x by day, y of the score on [-1, 1] or [0, 1], bar height by volume.

    The axis reaches below zero only where a score is below -0.01; bars fill 32 % of the plot.
    Of more than 9 days every second is labelled, of more than 16 every third, and always
    the last.
    """
    group = Window.partitionBy(by)
    place = F.row_number().over(group.orderBy("survey_date")) - 1
    n, low = F.count(F.lit(1)).over(group), F.when(F.min("nps").over(group) < -0.01, -1.0).otherwise(0.0)
    x = F.when(n > 1, place * width / (n - 1)).otherwise(F.lit(width / 2))
    return days.select(by, "survey_date", x.alias("x"), (height * (1.0 - (F.col("nps") - low) / (1.0 - low))).alias("y"), (F.col("survey_volume") * height * 0.32 / F.max("survey_volume").over(group)).alias("bar"), ((place % F.when(n > 16, 3).when(n > 9, 2).otherwise(1) == 0) | (place == n - 1)).alias("labelled"))


def encrypted(text: Column, key: str) -> Column:
    """Text as base64 of AES-GCM; each call draws a new nonce."""
    return F.base64(F.aes_encrypt(text, F.lit(key)))


def filtered(rows: DataFrame, day: str, key: str, equal: dict[str, object], start: str | None = None, end: str | None = None, page: int = 1, size: int = 15) -> DataFrame:
    """A page of a listing, newest first: rows with the given values (None asks for nothing) in a period, its last day included.

    Pages are counted by offset, so a late page sorts all before it.
    """
    for column, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(column) == F.lit(value))
    if start:
        rows = rows.filter(F.col(day) >= F.lit(start).cast("date"))
    if end:
        rows = rows.filter(F.col(day) < F.date_add(F.lit(end).cast("date"), 1))
    return rows.orderBy(F.col(day).desc_nulls_last(), F.col(key).desc()).offset((max(1, page) - 1) * size).limit(size)
