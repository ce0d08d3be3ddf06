"""Daily forecasts: a data gate, four models, walk-forward selection and reliability.

The gate and the models that SQL can express are DataFrame operations over all series at
once.  Smoothing with a trend is a recursion, so fitting and selection run per series in
pandas groups, many series in parallel; a series has one row per day.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions.scores import exact, round_to, top_box

MIN_SAMPLE, MIN_PERIODS = 20, 28
BOUNDS = {"nps": (-1.0, 1.0), "csat": (0.0, 1.0), "professionalism": (0.0, 1.0)}


def series(surveys: DataFrame, metric: str, key: str) -> DataFrame:
    """(key, date, value, n): one row per series and day."""
    if metric not in BOUNDS:
        raise ValueError(f"cannot forecast {metric!r}")
    x = F.col(f"{metric}_score")
    value = F.sum(exact(x if metric == "nps" else top_box(x))).cast("double") / F.count(F.lit(1))
    return surveys.groupBy(F.col(key).alias("series"), F.col("survey_date").alias("date")).agg(value.alias("value"), F.count(F.lit(1)).alias("n"))


def gate(daily: DataFrame, horizon: int) -> DataFrame:
    """Whether each series has enough history for the horizon, and how much it has."""
    ok = F.col("n") >= MIN_SAMPLE
    eligible = F.count_if(ok)
    stats = daily.groupBy("series").agg(F.count(F.lit(1)).alias("periods"), eligible.alias("eligible"), F.count_if(~ok).alias("excluded"), F.avg(F.when(ok, F.col("n"))).alias("avg_volume"), F.var_samp(F.when(ok, F.col("value"))).alias("variance"), F.max("date").alias("last_date"))
    longest = F.greatest(F.lit(1), F.floor(F.col("eligible") / 3))
    status = F.when(F.col("eligible") < MIN_PERIODS, "INSUFFICIENT_HISTORY").when(F.lit(horizon) > longest, "EXCESSIVE_HORIZON").when(F.coalesce("variance", F.lit(0.0)) <= 1e-7, "LOW_VARIANCE").otherwise("ELIGIBLE")
    return stats.withColumn("max_horizon", longest.cast("long")).withColumn("status", status)


def naive(daily: DataFrame) -> DataFrame:
    return daily.groupBy("series").agg(F.max_by("value", "date").alias("forecast"))


def moving_average_backtest(daily: DataFrame, windows: tuple[int, ...] = (3, 5, 7)) -> DataFrame:
    """Mean absolute in-sample error of each window length, by series."""
    order = Window.partitionBy("series").orderBy("date")
    rows = daily.withColumn("i", F.row_number().over(order))
    for k in windows:
        rows = rows.withColumn(f"mae_{k}", F.when(F.col("i") > k, F.abs(F.col("value") - F.avg("value").over(order.rowsBetween(-k, -1)))))
    return rows.groupBy("series").agg(*(F.avg(f"mae_{k}").alias(f"mae_{k}") for k in windows))


def linear_trend(daily: DataFrame) -> DataFrame:
    """Least-squares line of the value on the day's index: slope, intercept, r2 (0 to 1; 1 without spread) and residual variance."""
    rows = daily.withColumn("i", (F.row_number().over(Window.partitionBy("series").orderBy("date")) - 1).cast("double"))
    out = rows.groupBy("series").agg(F.regr_slope("value", "i").alias("slope"), F.regr_intercept("value", "i").alias("intercept"), F.count(F.lit(1)).alias("n"), F.regr_syy("value", "i").alias("sst"), F.regr_sxy("value", "i").alias("sxy"))
    sse = F.greatest(F.col("sst") - F.coalesce(F.col("slope") * F.col("sxy"), F.lit(0.0)), F.lit(0.0))
    r2 = F.when(F.col("sst") <= 1e-5, 1.0).otherwise(F.least(F.greatest(1 - sse / F.col("sst"), F.lit(0.0)), F.lit(1.0)))
    return out.select("series", "slope", "intercept", "n", r2.alias("r2"), (sse / F.greatest(F.lit(1), F.col("n") - 2)).alias("variance"))


def historical_points(surveys: DataFrame, metric: str, start: str, end: str, dimension: str | None = None, value: str | None = None) -> DataFrame:
    """(date, value, sample_count): the daily series of a stored training period, computed anew."""
    column = {"csat": "csat_score", "professionalism": "professionalism_score"}.get(metric, "nps_score")
    rows = surveys.filter(F.col("survey_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if dimension and value is not None:
        rows = rows.filter(F.col({"agent": "agent_bms"}.get(dimension, dimension)) == value)
    v = F.col(column).cast("decimal(6,4)")
    if metric in ("csat", "professionalism"):
        v = F.when(v > 0, v).otherwise(F.lit(0).cast("decimal(6,4)"))
        mean = F.sum(v).cast("double") / F.count(F.lit(1))
    else:
        mean = F.sum(v).cast("double") / F.count(column)
    return rows.groupBy(F.col("survey_date").alias("date")).agg(round_to(mean, 4).alias("value"), F.count(F.lit(1)).alias("sample_count"))


# models of one series: each returns predictions for h steps, and the half-widths of intervals


def _naive(y: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray | None]:
    return np.full(h, round(float(y[-1]), 4)), None


def _moving(y: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray | None]:
    best, width = math.inf, min(3, len(y))
    for k in (3, 5, 7):
        if k < len(y):
            means = np.convolve(y, np.ones(k) / k, "valid")[:-1]
            mae = float(np.abs(y[k:] - means).mean())
            if mae < best:
                best, width = mae, k
    return np.full(h, round(float(y[-width:].mean()), 4)), None


def _linear(y: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray | None]:
    n = len(y)
    x = np.arange(n, dtype=float)
    spread = float(((x - x.mean()) ** 2).sum())
    slope = float(((x - x.mean()) * (y - y.mean())).sum()) / spread if spread else 0.0
    level = float(y.mean()) - slope * float(x.mean())
    ahead = np.arange(n, n + h, dtype=float)
    if n < 3:
        return np.round(level + slope * ahead, 4), None
    sigma2 = float(((y - level - slope * x) ** 2).sum()) / max(1, n - 2)
    half = 1.96 * math.sqrt(max(1e-4, sigma2)) * np.sqrt(1 + 1 / n + (ahead - x.mean()) ** 2 / spread)
    return np.round(level + slope * ahead, 4), half


def _holt(y: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray | None]:
    alpha, beta = np.meshgrid(np.arange(1, 10) / 10, np.array([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6]), indexing="ij")
    alpha, beta = alpha.ravel(), beta.ravel()
    level, trend = np.full(alpha.shape, y[0]), np.full(alpha.shape, y[1] - y[0] if len(y) > 1 else 0.0)
    sse = np.zeros(alpha.shape)
    for v in y[1:]:  # all 63 settings advance together
        guess = level + trend
        sse += (v - guess) ** 2
        new = alpha * v + (1 - alpha) * guess
        trend = beta * (new - level) + (1 - beta) * trend
        level = new
    i = int(np.argmin(sse))
    a, b = alpha[i], beta[i]
    steps = np.arange(1, h + 1)
    grown = np.array([1 + sum((a + j * a * b) ** 2 for j in range(1, s)) for s in steps])
    sigma2 = float(sse[i]) / max(1, len(y) - 1)
    return np.round(level[i] + trend[i] * steps, 4), 1.96 * np.sqrt(max(1e-4, sigma2) * grown)


#: In order of complexity.
MODELS = {"naive": _naive, "moving_average": _moving, "linear_trend": _linear, "holt_linear": _holt}


def walk_forward(y: np.ndarray) -> list[tuple[str, float, float]]:
    """(model, MAE, RMSE) of one-step forecasts on expanding prefixes."""
    n = len(y)
    steps = max(3, min(14, int(math.floor(n * 0.25 + 0.5))))
    if n - steps < 5:
        steps = max(2, n - 5)
    out = []
    for name, model in MODELS.items():
        e = np.array([y[t] - model(y[:t], 1)[0][0] for t in range(max(1, n - steps), n)])
        out.append((name, round(float(np.abs(e).mean()), 4), round(float(np.sqrt((e**2).mean())), 4)))
    return out


def select_model(results: list[tuple[str, float, float]], tolerance: float = 0.001) -> tuple[str, float, float]:
    """Smaller MAE, then RMSE, then the simpler model; closer than the tolerance is a tie."""
    best = results[0]
    for r in results[1:]:
        if r[1] < best[1] - tolerance or (abs(r[1] - best[1]) <= tolerance and r[2] < best[2] - tolerance):
            best = r
    return best


def reliability(eligible: int, avg_volume: float, mae: float, horizon: int, excluded: int) -> tuple[str, int]:
    """Level and score of a forecast's reliability."""
    if eligible < MIN_PERIODS:
        return "INSUFFICIENT", 10

    def points(value: float, limits: tuple, otherwise: int, below: bool) -> int:
        return next((p for limit, p in limits if (value <= limit if below else value >= limit)), otherwise)

    score = points(eligible, ((60, 30), (45, 24), (35, 18)), 12, False) + points(avg_volume, ((50, 25), (30, 20), (20, 15)), 5, False)
    score += points(mae, ((0.035, 25), (0.06, 18), (0.09, 12)), 5, True) + points(horizon / max(1, eligible), ((0.20, 20), (0.28, 15), (0.34, 10)), 0, True)
    if excluded / max(1, eligible + excluded) > 0.20:
        score = max(0, score - 15)
    return ("HIGH" if score >= 78 else "MODERATE" if score >= 55 else "LOW"), score


_FORECAST = "series string, status string, model string, mae double, rmse double, level string, score int, date date, raw double, value double, low double, high double, was_bounded boolean"


def forecast(daily: DataFrame, metric: str, horizon: int) -> DataFrame:
    """One row per series and future day; a series that fails the gate has one row without values.

    Days below the sample size are left out, but the days after the last raw one are
    projected.  Values and intervals are clamped to the metric's range.
    """
    low, high = BOUNDS[metric]

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        head = rows.iloc[0]
        base = {"series": key[0], "status": head.status}
        if head.status not in ("ELIGIBLE", "LOW_VARIANCE"):
            return pd.DataFrame({c: [{**base, "model": "none"}.get(c)] for c in _columns}, dtype=object)
        rows = rows.sort_values("date")
        y = rows.value[rows.n >= MIN_SAMPLE].to_numpy(float)
        name, mae, rmse = select_model(walk_forward(y))
        level, score = reliability(len(y), float(head.avg_volume), mae, horizon, int(head.excluded))
        raw, half = MODELS[name](y, horizon)
        clamped = np.clip(raw, low, high)
        days = [head.last_date + pd.Timedelta(days=i) for i in range(1, horizon + 1)]
        return pd.DataFrame({
            **base, "model": name, "mae": mae, "rmse": rmse, "level": level, "score": score, "date": days, "raw": raw, "value": clamped,
            "low": np.nan if half is None else np.clip(raw - half, low, high), "high": np.nan if half is None else np.clip(raw + half, low, high), "was_bounded": np.abs(raw - clamped) > 1e-5,
        })[_columns]

    _columns = [c.split()[0] for c in _FORECAST.split(", ")]
    gated = daily.join(gate(daily, horizon).select("series", "status", "avg_volume", "excluded", "last_date"), "series")
    return gated.groupBy("series").applyInPandas(one, _FORECAST)
