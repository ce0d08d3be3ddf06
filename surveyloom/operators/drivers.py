"""Driver analysis: which categories, waves, supervisors and tenures go with a score.

Rows are first aggregated to distinct predictor patterns; normal equations (and each step
of the logistic fit) are one distributed aggregation, and only matrices of the size of the
design reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.scores import erf_complement, sigmoid

MIN_OLS, MIN_LOGISTIC, TOP_SUPERVISORS = 10, 15, 8


def driver_input(surveys: DataFrame, target: str, filters: dict[str, str | None] | None = None, analyses: DataFrame | None = None, categories: DataFrame | None = None) -> DataFrame:
    """Predictors with their defaults, and the target; null targets go.  Days count from the first one.

    ``filters`` may have supervisor, wave, date_from and date_to, None asking for nothing.
    With ``analyses`` and ``categories`` the category comes from a left join, so a survey with
    two analyses counts twice; else ``surveys`` has category_name.
    """
    unknown = set(filters or {}) - {"supervisor", "wave", "date_from", "date_to"}
    if unknown:
        raise ValueError(f"drivers cannot be filtered by {sorted(unknown)}")
    for field, value in (filters or {}).items():
        if value is not None:
            day = F.lit(value).cast("date")
            surveys = surveys.filter(F.col("survey_date") >= day if field == "date_from" else F.col("survey_date") <= day if field == "date_to" else F.col(field) == F.lit(value))
    if analyses is not None and categories is not None:
        named = categories.select("category_id", F.col("name").alias("category_name"))
        surveys = surveys.drop("category_name").join(analyses.select("survey_id", "category_id"), "survey_id", "left").join(named, "category_id", "left")
    general = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("General"))
    known = surveys.filter(F.col(target).isNotNull())
    day0 = F.lit(known.agg(F.min("survey_date")).first()[0]).cast("date")
    return known.select(
        F.coalesce("category_name", F.lit("Uncategorized")).alias("category"), general("wave").alias("wave"), general("supervisor").alias("supervisor"),
        F.coalesce("tenure_days", F.lit(30)).alias("tenure"), F.datediff("survey_date", day0).alias("day"), F.col(target).alias("y"),
    )


def frequencies(rows: DataFrame, field: str) -> DataFrame:
    return rows.groupBy(F.col(field).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Design:
    """Levels that get a column; the reference level of each field has none."""

    terms: tuple[tuple[str, str | None], ...]
    references: dict[str, str]

    @property
    def names(self) -> list[str]:
        return [f if level is None else f"{f}:{level}" for f, level in self.terms]

    def columns(self):
        make = {"intercept": F.lit(1.0), "tenure": F.col("tenure") / 100.0, "day": F.col("day") / 30.0}
        return [make[f] if level is None else F.when(F.col(f) == level, 1.0).otherwise(0.0) for f, level in self.terms]


def design(patterns: DataFrame, references: dict[str, str] | None = None) -> Design:
    """All levels but the references; of supervisors only the TOP_SUPERVISORS most frequent.

    The reference is the most frequent level (ties by name) unless another one that is
    present is asked for.  The frequent supervisors are taken first, then the reference is
    left out, so by default there is one column less than TOP_SUPERVISORS.  Categories and
    waves are dictionaries of people's making; as many levels as they have reach the driver,
    and the normal equations grow with their square.
    """
    chosen, terms = {}, [("intercept", None)]
    for f in ("category", "wave", "supervisor"):
        counts = patterns.groupBy(F.col(f).alias("level")).agg(F.sum("n").alias("n"))
        asked = (references or {}).get(f)
        known = asked is not None and not counts.filter(F.col("level") == asked).isEmpty()
        top = counts.orderBy(F.col("n").desc(), "level")
        levels = [r["level"] for r in (top.limit(TOP_SUPERVISORS) if f == "supervisor" else top).collect()]
        chosen[f] = asked if known else levels[0]
        terms += [(f, x) for x in levels if x != chosen[f]]
    return Design((*terms, ("tenure", None), ("day", None)), chosen)


def _patterns(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category", "wave", "supervisor", "tenure", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))


def _sums(x: DataFrame, weight: str, k: int) -> np.ndarray:
    """X'WX of rows with an array ``x``: products of the few terms that are not 0, summed by cell."""
    held = x.select(weight, F.filter(F.transform("x", lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda t: t["v"] != 0).alias("t"))
    pairs = held.select(weight, F.explode("t").alias("a"), "t").select(weight, "a", F.explode("t").alias("b")).filter("a.i <= b.i")
    cells = pairs.groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.sum(F.col("a.v") * F.col("b.v") * F.col(weight)).alias("s")).collect()
    g = np.zeros((k, k))
    for r in cells:
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["s"]
    return g


def _moments(x: DataFrame, value: str, k: int) -> np.ndarray:
    """X'v of rows with an array ``x``."""
    rows = x.select(value, F.posexplode("x").alias("i", "v")).filter("v <> 0").groupBy("i").agg(F.sum(F.col("v") * F.col(value)).alias("s")).collect()
    out = np.zeros(k)
    for r in rows:
        out[r["i"]] = r["s"]
    return out


def gram(patterns: DataFrame, d: Design) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """X'X, X'y, the sum of y and of y squared, and n, as sums over the patterns."""
    k = len(d.terms)
    p = patterns.select(F.array(*d.columns()).alias("x"), "n", "sy", "syy")
    sy, syy, n = patterns.agg(F.sum("sy"), F.sum("syy"), F.sum("n")).first()
    return _sums(p, "n", k), _moments(p, "sy", k), sy or 0.0, syy or 0.0, n or 0


def p_value(stat: float) -> float:
    """Two-sided normal p-value, as in ``functions.scores.normal_p_value``."""
    return float(max(0.0001, min(1.0, erf_complement(abs(stat) / np.sqrt(2.0), np.exp))))


def confidence_label(n: int, p: float) -> str:
    return "INSUFFICIENT" if n < 10 else "LOW" if n < 30 else "MODERATE" if p > 0.08 else "SUPPORTED"


def by_effect(rows: list[tuple]) -> list[tuple]:
    """Drivers with the largest effect first, whatever its sign; the intercept is first of all."""
    return sorted(rows, key=lambda r: (r[0] != "intercept", -round(abs(r[1]), 3)))


def _rows(d: Design, beta: np.ndarray, se: np.ndarray, counts: np.ndarray, extra) -> list[tuple]:
    out = []
    for i, name in enumerate(d.names):
        t = beta[i] / se[i]
        p = p_value(t)
        out.append((name, float(beta[i]), float(se[i]), float(t), p, float(beta[i] - 1.96 * se[i]), float(beta[i] + 1.96 * se[i]), confidence_label(int(counts[i]), p), *extra(float(beta[i]))))
    return out


_BASE = "term string, coefficient double, se double, t double, p double, low double, high double, confidence string"


def ols(rows: DataFrame, references: dict[str, str] | None = None) -> tuple[DataFrame, dict]:
    """Least squares with a ridge of 1e-6: coefficients with inference, and diagnostics."""
    spark, schema = rows.sparkSession, f"{_BASE}, direction string"
    patterns = _patterns(rows).persist()
    try:
        n = patterns.agg(F.sum("n")).first()[0] or 0
        if n < MIN_OLS:
            return spark.createDataFrame([], schema), {"status": "INSUFFICIENT_SAMPLE", "n": n}
        d = design(patterns, references)
        g, b, sy, syy, n = gram(patterns, d)
    finally:
        patterns.unpersist()
    try:
        inverse = np.linalg.inv(g + 1e-6 * np.eye(len(g)))
    except np.linalg.LinAlgError:
        return spark.createDataFrame([], schema), {"status": "SINGULAR_MATRIX", "n": n}
    beta = inverse @ b
    sse = max(0.0, syy - 2 * float(beta @ b) + float(beta @ g @ beta))
    sst = syy - sy * sy / n
    se = np.sqrt(sse / max(1, n - len(beta)) * np.maximum(1e-8, np.diag(inverse)))
    direction = lambda v: ("positive" if v > 0.01 else "negative" if v < -0.01 else "neutral",)
    out = spark.createDataFrame(by_effect(_rows(d, beta, se, np.diag(g), direction)), schema)
    return out, {"status": "OK", "n": n, "r2": float(min(1.0, max(0.0, 1 - sse / sst))) if sst > 1e-12 else 1.0, "references": d.references}


def logistic(rows: DataFrame, references: dict[str, str] | None = None, steps: int = 15, tolerance: float = 1e-4) -> tuple[DataFrame, dict]:
    """Reweighted least squares on y >= 0.5: odds ratios and marginal percentage points.

    Each step is one aggregation over the predictor patterns.
    """
    spark, schema = rows.sparkSession, f"{_BASE}, odds_ratio double, marginal_pp double, direction string"
    binary = rows.withColumn("y", (F.col("y") >= 0.5).cast("double"))
    n, share = binary.agg(F.count(F.lit(1)), F.avg("y")).first()
    if n < MIN_LOGISTIC:
        return spark.createDataFrame([], schema), {"status": "INSUFFICIENT_SAMPLE", "n": n}
    if share <= 0.01 or share >= 0.99:
        return spark.createDataFrame([], schema), {"status": "LOW_VARIANCE", "n": n}
    patterns = _patterns(binary).persist()
    d = design(patterns, references)
    k = len(d.terms)
    p = patterns.select(F.array(*d.columns()).alias("x"), "n", "sy").persist()
    beta = np.zeros(k)
    try:
        for _ in range(steps):
            z = sum((F.col("x")[i] * float(beta[i]) for i in range(k)), F.lit(0.0))
            q = p.withColumn("p", sigmoid(z)).withColumn("w", F.col("n") * F.col("p") * (1 - F.col("p")))
            q = q.withColumn("residual", F.col("sy") - F.col("n") * F.col("p"))
            inverse = np.linalg.inv(_sums(q, "w", k) + 1e-5 * np.eye(k))
            move = inverse @ _moments(q, "residual", k)
            beta = beta + move
            if np.abs(move).max() < tolerance:
                break
        counts = _moments(p.withColumn("x", F.transform("x", lambda v: F.when(v != 0, 1.0).otherwise(0.0))), "n", k)
    finally:
        p.unpersist()
        patterns.unpersist()
    se = np.sqrt(np.maximum(1e-8, np.diag(inverse)))

    def extra(v: float) -> tuple:
        pp = round(v * share * (1 - share) * 100, 1)
        return round(float(np.exp(v)), 2), pp, "positive" if pp > 0.5 else "negative" if pp < -0.5 else "neutral"

    return spark.createDataFrame(by_effect(_rows(d, beta, se, counts, extra)), schema), {"status": "OK", "n": n, "mean": share, "references": d.references}
