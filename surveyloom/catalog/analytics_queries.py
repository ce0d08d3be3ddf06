"""Forecast, driver, case, report, privacy, audit and usage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.catalog._base import CLAMPED_MEAN, MEAN, TOP_MEAN, query, r4
from surveyloom.catalog.kpi_queries import _DENSE as DENSE
from surveyloom.catalog.kpi_queries import _weighted as weighted
from surveyloom.catalog.org_queries import _INTERVALS as INTERVALS
from surveyloom.functions import scores, text
from surveyloom.functions.formula import compile_formula
from surveyloom.operators import audit, cases, categorise, drivers, endpoints, forecast, org, privacy, reports, usage
from surveyloom.sources.surveys import SURVEYS_SQL, analyses, categories, surveys, table, with_verbatim

_KPI = f"count(*) AS survey_volume, {r4(MEAN.format('nps_score'))} AS nps, {r4(CLAMPED_MEAN.format('csat_score'))} AS csat, {r4(CLAMPED_MEAN.format('professionalism_score'))} AS professionalism"


def _daily(metric: str, key: str = "'all'") -> str:
    m = MEAN.format("nps_score").replace("count(nps_score)", "count(*)") if metric == "nps" else TOP_MEAN.format(f"{metric}_score")
    return f"daily AS (SELECT {key} AS series, survey_date AS date, {m} AS value, count(*) AS n FROM surveys GROUP BY 1, 2)"


def _series(spark, sf, metric: str, key: str | None = None):
    s = surveys(spark, sf)
    return forecast.series(s if key else s.withColumn("__all", F.lit("all")), metric, key or "__all")


_GATE = """SELECT series, count(*) AS periods, count_if(n >= 20) AS eligible, count_if(n < 20) AS excluded, avg(CASE WHEN n >= 20 THEN n END) AS avg_volume, max(date) AS last_date,
  CAST(greatest(1, floor(count_if(n >= 20) / 3)) AS BIGINT) AS max_horizon,
  CASE WHEN count_if(n >= 20) < 28 THEN 'INSUFFICIENT_HISTORY' WHEN 14 > greatest(1, floor(count_if(n >= 20) / 3)) THEN 'EXCESSIVE_HORIZON' WHEN coalesce(var_samp(CASE WHEN n >= 20 THEN value END), 0) <= 1e-7 THEN 'LOW_VARIANCE' ELSE 'ELIGIBLE' END AS status FROM daily GROUP BY 1"""


@query("forecast_gate", f"{_daily('nps', 'wave')} {_GATE}")
def forecast_gate(spark, sf):
    return forecast.gate(_series(spark, sf, "nps", "wave"), 14).drop("variance")


@query("forecast_series", f"{_daily('csat', 'wave')} SELECT * FROM daily")
def forecast_series(spark, sf):
    return _series(spark, sf, "csat", "wave")


@query("forecast_naive", f"{_daily('nps', 'wave')} SELECT series, max_by(value, date) AS forecast FROM daily GROUP BY 1")
def forecast_naive(spark, sf):
    return forecast.naive(_series(spark, sf, "nps", "wave"))


def _mae(k: int) -> str:
    return f"floor(avg(CASE WHEN i > {k} THEN abs(value - m{k}) END) * 1000000 + 0.5) / 1000000 AS mae_{k}"


@query("forecast_moving_average", f"""{_daily('csat')},
w AS (SELECT *, row_number() OVER o AS i, avg(value) OVER (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m3, avg(value) OVER (ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS m5, avg(value) OVER (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m7 FROM daily WINDOW o AS (ORDER BY date))
SELECT series, {_mae(3)}, {_mae(5)}, {_mae(7)} FROM w GROUP BY 1""")
def forecast_moving_average(spark, sf):
    out = forecast.moving_average_backtest(_series(spark, sf, "csat"))
    return out.select("series", *(scores.round_to(F.col(f"mae_{k}"), 6).alias(f"mae_{k}") for k in (3, 5, 7)))


@query("forecast_linear_trend", f"""{_daily('nps', 'wave')},
i AS (SELECT *, CAST(row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS DOUBLE) AS i FROM daily),
g AS (SELECT series, regr_slope(value, i) AS slope, regr_intercept(value, i) AS intercept, count(*) AS n FROM i GROUP BY 1),
e AS (SELECT i.series, sum((value - g.intercept - g.slope * i) ** 2) AS sse, sum((value - m.mean) ** 2) AS sst FROM i JOIN g USING (series) JOIN (SELECT series, avg(value) AS mean FROM i GROUP BY 1) m USING (series) GROUP BY 1)
SELECT series, sign(slope) * floor(abs(slope) * 1000000 + 0.5) / 1000000 AS slope, sign(intercept) * floor(abs(intercept) * 1000000 + 0.5) / 1000000 AS intercept, n,
  floor(CASE WHEN sst <= 0.00001 THEN 1.0 ELSE least(greatest(1 - sse / sst, 0), 1) END * 1000000 + 0.5) / 1000000 AS r2, floor(sse / greatest(1, n - 2) * 1000000 + 0.5) / 1000000 AS variance FROM g JOIN e USING (series)""")
def forecast_linear_trend(spark, sf):
    out = forecast.linear_trend(_series(spark, sf, "nps", "wave"))
    return out.select("series", "n", *(scores.round_to(F.col(c), 6).alias(c) for c in ("slope", "intercept", "r2", "variance")))


@query("forecast_historical_points", f"SELECT survey_date AS date, {r4(TOP_MEAN.format('csat_score'))} AS value, count(*) AS sample_count FROM surveys WHERE wave = 'BUILDING' AND survey_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY 1")
def forecast_historical_points(spark, sf):
    return forecast.historical_points(surveys(spark, sf), "csat", "2024-01-05", "2024-01-25", "wave", "BUILDING")


def _holt_step() -> str:
    """One value of Holt's recursion on {level, trend, sse}; e.l is the value, al and be the weights."""
    guess = "(acc.l + acc.t)"
    level = f"(al * e.l + (1 - al) * {guess})"
    return f"{{'l': {level}, 't': be * ({level} - acc.l) + (1 - be) * acc.t, 's': acc.s + (e.l - {guess}) * (e.l - {guess})}}"


def _better(one: str, two: str) -> str:
    """The second model if its error is smaller, or as good with a smaller squared one; else the first."""
    return f"CASE WHEN {two}.mae < {one}.mae - 0.001 OR (abs({two}.mae - {one}.mae) <= 0.001 AND {two}.rmse < {one}.rmse - 0.001) THEN {two} ELSE {one} END"


def _points(x: str, sign: str, limits: list[tuple[float, int]], otherwise: int) -> str:
    return "CASE " + " ".join(f"WHEN {x} {sign} {limit} THEN {p}" for limit, p in limits) + f" ELSE {otherwise} END"


_SIX = "sign({0}) * floor(abs({0}) * 1000000 + 0.5) / 1000000"
_MOVING = "CASE WHEN {k} < t THEN list_avg(list_transform(range({k} + 1, t + 1), lambda i: abs(ys[i] - list_avg(ys[i - {k}:i - 1])))) END"


@query("forecast_selected_model", f"""{_daily('nps', 'wave')},
gate AS ({_GATE.replace("14 > greatest", "7 > greatest")}),
s AS (SELECT series, list(value ORDER BY date) FILTER (n >= 20) AS y FROM daily JOIN gate USING (series) WHERE status IN ('ELIGIBLE', 'LOW_VARIANCE') GROUP BY 1),
st AS (SELECT *, len(y) AS n, CASE WHEN len(y) - k < 5 THEN greatest(2, len(y) - 5) ELSE k END AS steps FROM (SELECT *, CAST(greatest(3, least(14, floor(len(y) * 0.25 + 0.5))) AS BIGINT) AS k FROM s)),
pf AS (SELECT series, n, t, y[1:t] AS ys, y[t + 1] AS actual FROM (SELECT *, unnest(range(greatest(1, n - steps), n + 1)) AS t FROM st)),
mv AS (SELECT *, {_MOVING.format(k=3)} AS m3, {_MOVING.format(k=5)} AS m5, {_MOVING.format(k=7)} AS m7 FROM pf),
wd AS (SELECT *, CASE WHEN m7 < m3 AND m7 < m5 THEN 7 WHEN m5 < m3 THEN 5 ELSE least(3, t) END AS width, list_avg(ys) AS my, (t - 1) / 2.0::DOUBLE AS mx, t * (t * t - 1) / 12.0::DOUBLE AS spread FROM mv),
sl AS (SELECT *, CASE WHEN spread > 0 THEN list_sum(list_transform(range(0, t), lambda i: (i - mx) * (ys[i + 1] - my))) / spread ELSE 0 END AS slope FROM wd),
ln AS (SELECT *, my - slope * mx AS lev, list_sum(list_transform(range(0, t), lambda i: (ys[i + 1] - (my - slope * mx) - slope * i) ** 2)) AS lsse FROM sl),
grid AS (SELECT x / 10.0::DOUBLE AS al, b AS be FROM range(1, 10) r(x), (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6]::DOUBLE[]) AS b)),
hs AS (
  SELECT series, t, al, be, list_reduce(list_prepend({{'l': ys[1], 't': CASE WHEN t > 1 THEN ys[2] - ys[1] ELSE 0 END, 's': 0.0::DOUBLE}}, list_transform(ys[2:], lambda v: {{'l': v, 't': 0.0::DOUBLE, 's': 0.0::DOUBLE}})), lambda acc, e: {_holt_step()}) AS h
  FROM pf, grid
),
hb AS (SELECT series, t, arg_min(struct_pack(al, be, h), (h.s, al, be)) AS b FROM hs GROUP BY 1, 2),
al4 AS (SELECT ln.*, round(ys[t], 4) AS f1, round(list_avg(ys[t - width + 1:t]), 4) AS f2, round(lev + slope * t, 4) AS f3, round(b.h.l + b.h.t, 4) AS f4, b FROM ln JOIN hb USING (series, t)),
er AS (
  SELECT series, {", ".join(f"struct_pack(model := '{m}', mae := round(avg(abs(actual - f{i})), 4), rmse := round(sqrt(avg((actual - f{i}) ** 2)), 4)) AS e{i}" for i, m in enumerate(forecast.MODELS, 1))}
  FROM al4 WHERE t < n GROUP BY 1
),
b2 AS (SELECT *, {_better("e1", "e2")} AS x2 FROM er), b3 AS (SELECT *, {_better("x2", "e3")} AS x3 FROM b2), best AS (SELECT series, {_better("x3", "e4")} AS x FROM b3),
sc AS (
  SELECT g.*, x, {_points("eligible", ">=", [(60, 30), (45, 24), (35, 18)], 12)} + {_points("avg_volume", ">=", [(50, 25), (30, 20), (20, 15)], 5)} + {_points("x.mae", "<=", [(0.035, 25), (0.06, 18), (0.09, 12)], 5)}
    + {_points("7.0::DOUBLE / greatest(1, eligible)", "<=", [(0.20, 20), (0.28, 15), (0.34, 10)], 0)} AS raw_score FROM gate g LEFT JOIN best USING (series)
),
rel AS (SELECT *, CASE WHEN excluded::DOUBLE / greatest(1, eligible + excluded) > 0.2 THEN greatest(0, raw_score - 15) ELSE raw_score END AS score FROM sc),
fc AS (
  SELECT series, h, CASE x.model WHEN 'naive' THEN f1 WHEN 'moving_average' THEN f2 WHEN 'linear_trend' THEN round(lev + slope * (t - 1 + h), 4) ELSE round(b.h.l + b.h.t * h, 4) END AS raw,
    CASE x.model WHEN 'linear_trend' THEN 1.96 * sqrt(greatest(0.0001, lsse / greatest(1, t - 2))) * sqrt(1 + 1 / t::DOUBLE + (t - 1 + h - mx) ** 2 / spread)
      WHEN 'holt_linear' THEN 1.96 * sqrt(greatest(0.0001, b.h.s / greatest(1, t - 1)) * (1 + coalesce(list_sum(list_transform(range(1, h), lambda j: (b.al + j * b.al * b.be) ** 2)), 0))) END AS half
  FROM al4 JOIN best USING (series), (SELECT unnest(range(1, 8)) AS h) WHERE t = n
)
SELECT series, status, coalesce(x.model, 'none') AS model, x.mae AS mae, x.rmse AS rmse, CASE WHEN x IS NULL THEN NULL WHEN score >= 78 THEN 'HIGH' WHEN score >= 55 THEN 'MODERATE' ELSE 'LOW' END AS level, CAST(CASE WHEN x IS NOT NULL THEN score END AS INTEGER) AS score,
  CAST(last_date + CAST(h AS INTEGER) AS DATE) AS date, raw, CASE WHEN raw IS NOT NULL THEN least(greatest(raw, -1.0), 1.0) END AS value, CASE WHEN half IS NOT NULL THEN {_SIX.format("least(greatest(raw - half, -1.0), 1.0)")} END AS low, CASE WHEN half IS NOT NULL THEN {_SIX.format("least(greatest(raw + half, -1.0), 1.0)")} END AS high, CASE WHEN raw IS NOT NULL THEN abs(raw - least(greatest(raw, -1.0), 1.0)) > 0.00001 END AS was_bounded
FROM rel LEFT JOIN fc USING (series)""")
def forecast_selected_model(spark, sf):
    """Walk-forward selection and bounded projections for every wave."""
    out = forecast.forecast(_series(spark, sf, "nps", "wave"), "nps", 7)
    return out.withColumns({c: scores.round_to(F.col(c), 6) for c in ("low", "high")})


@query("driver_frequencies", "SELECT coalesce(category_name, 'Uncategorized') AS level, count(*) AS n FROM surveys GROUP BY 1")
def driver_frequencies(spark, sf):
    return drivers.frequencies(drivers.driver_input(surveys(spark, sf), "nps_score"), "category")


_PREDICTORS = """
dr AS (SELECT coalesce(c.name, 'Uncategorized') AS category, coalesce(nullif(trim(wave), ''), 'General') AS wave, coalesce(nullif(trim(supervisor), ''), 'General') AS supervisor, coalesce(tenure_days, 30) AS tenure,
  survey_date - min(survey_date) OVER () AS day, nps_score AS y
  FROM surveys s LEFT JOIN analyses a USING (survey_id) LEFT JOIN categories c USING (category_id) WHERE survey_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-28'),
lv AS (
  SELECT f, level, count(*) AS n FROM (SELECT unnest(['category', 'wave', 'supervisor']) AS f, unnest([category, wave, supervisor]) AS level FROM dr) GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY n DESC, level) AS k FROM lv),
terms AS (SELECT f || ':' || level AS term, f, level FROM rk WHERE k > 1 AND (f <> 'supervisor' OR k <= 8) UNION ALL SELECT unnest(['intercept', 'tenure', 'day']), unnest(['intercept', 'tenure', 'day']), NULL)"""


def _drivers(spark, sf):
    return drivers.driver_input(surveys(spark, sf), "nps_score", {"date_from": "2024-01-03", "date_to": "2024-01-28", "wave": None}, analyses(spark, sf), categories(spark, sf))


@query("driver_design", f"{_PREDICTORS} SELECT term FROM terms")
def driver_design(spark, sf):
    """Columns of the design over joined categories and a period: eight supervisors at most, without each field's reference."""
    d = drivers.design(drivers._patterns(_drivers(spark, sf)))
    return spark.createDataFrame([(n,) for n in d.names], "term string")


@query("driver_normal_equations", f"""{_PREDICTORS},
num AS (SELECT row_number() OVER () AS i, * FROM dr),
x AS (
  SELECT i, y, term, CASE f WHEN 'intercept' THEN 1.0::DOUBLE WHEN 'tenure' THEN tenure / 100.0::DOUBLE WHEN 'day' THEN day / 30.0::DOUBLE ELSE 1.0::DOUBLE END AS v
  FROM num JOIN terms ON f IN ('intercept', 'tenure', 'day') OR (f = 'category' AND level = category) OR (f = 'wave' AND level = wave) OR (f = 'supervisor' AND level = supervisor)
),
g AS (SELECT a.term AS a, b.term AS b, sum(a.v * b.v) AS s FROM x a JOIN x b ON a.i = b.i GROUP BY 1, 2 UNION ALL SELECT term, 'y', sum(v * y) FROM x GROUP BY 1)
SELECT a, b, floor(s * 1000 + 0.5) / 1000 AS s FROM g WHERE s <> 0""")
def driver_normal_equations(spark, sf):
    """What least squares are solved from: products of all columns of the design with one another and with the score."""
    patterns = drivers._patterns(_drivers(spark, sf))
    d = drivers.design(patterns)
    g, b, *_ = drivers.gram(patterns, d)
    cells = [(x, y, float(g[i, j])) for i, x in enumerate(d.names) for j, y in enumerate(d.names)] + [(x, "y", float(b[i])) for i, x in enumerate(d.names)]
    return spark.createDataFrame(cells, "a string, b string, v double").filter("v <> 0").select("a", "b", (F.floor(F.col("v") * 1000 + 0.5) / 1000).alias("s"))


@query("query_data_minimised", """
g AS (SELECT supervisor, count(*) AS survey_volume FROM surveys WHERE tenure_days >= 50 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 9)
SELECT survey_volume, floor(survey_volume * 10000.0::DOUBLE / (SELECT sum(survey_volume) FROM g) + 0.5) / 100 AS percentage, TRUE AS well_formed, (SELECT count(*) FROM g) AS made FROM g""")
def query_data_minimised(spark, sf):
    """A query's result with shares and with references instead of names."""
    vault = spark.createDataFrame([], "scope string, type string, internal_id string, pseudonym string")
    out, made = endpoints.query_data({"metrics": ["survey_volume"], "group_by": ["supervisor"], "filters": [{"field": "tenure", "operator": ">=", "value": 50}], "limit": 9}, surveys(spark, sf), vault, "run")
    return out.select("survey_volume", "percentage", F.col("supervisor_ref").rlike("^SUP_[A-Z0-9]{6}$").alias("well_formed")).crossJoin(made.agg(F.count(F.lit(1)).alias("made")))


_PLAIN_PREDICTORS = _PREDICTORS.replace("coalesce(c.name, 'Uncategorized')", "coalesce(category_name, 'Uncategorized')").replace("FROM surveys s LEFT JOIN analyses a USING (survey_id) LEFT JOIN categories c USING (category_id) WHERE survey_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-28'", "FROM surveys")


def _inverse(ridge: float) -> str:
    """Gauss-Jordan elimination: ``aug`` holds X'X with a ridge beside the unit matrix, ``step`` one column after the other; ``inv`` is the last one."""
    return f"""
ix AS (SELECT term, row_number() OVER (ORDER BY term) AS i FROM terms),
cell AS (SELECT x.i, y.i AS j, coalesce(s, 0) + CASE WHEN x.i = y.i THEN {ridge} ELSE 0 END AS v FROM ix x CROSS JOIN ix y LEFT JOIN g ON g.a = x.term AND g.b = y.term),
line AS (SELECT i, list(v ORDER BY j) AS v FROM cell GROUP BY i),
aug AS (SELECT list(list_concat(v, list_transform(range(1, k + 1), lambda j: CASE WHEN j = i THEN 1.0::DOUBLE ELSE 0 END)) ORDER BY i) AS m, max(k) AS k FROM line, (SELECT count(*) AS k FROM ix)),
step AS (
  SELECT CAST(0 AS BIGINT) AS c, m, k FROM aug
  UNION ALL
  SELECT c + 1, list_transform(m, lambda r, i: CASE WHEN i = c + 1 THEN list_transform(r, lambda v: v / r[c + 1]) ELSE list_transform(r, lambda v, j: v - r[c + 1] * m[c + 1][j] / m[c + 1][c + 1]) END), k FROM step WHERE c < k
),
inv AS (SELECT list_transform(m, lambda r: r[k + 1:]) AS m, k FROM step WHERE c = k)"""


_FOUR = "sign({0}) * floor(abs({0}) * 10000 + 0.5) / 10000"
_P_VALUE = f"greatest(0.0001, least(1.0, {scores.erf_complement_sql('u')} * exp(-z * z)))"


@query("driver_least_squares", f"""WITH RECURSIVE {SURVEYS_SQL}, {_PLAIN_PREDICTORS},
num AS (SELECT row_number() OVER () AS i, * FROM dr),
x AS (
  SELECT i, y, term, CASE f WHEN 'tenure' THEN tenure / 100.0::DOUBLE WHEN 'day' THEN day / 30.0::DOUBLE ELSE 1.0::DOUBLE END AS v
  FROM num JOIN terms ON f IN ('intercept', 'tenure', 'day') OR (f = 'category' AND level = category) OR (f = 'wave' AND level = wave) OR (f = 'supervisor' AND level = supervisor)
),
g AS (SELECT a.term AS a, b.term AS b, sum(a.v * b.v) AS s FROM x a JOIN x b ON a.i = b.i GROUP BY 1, 2),
xy AS (SELECT term, sum(v * y) AS b FROM x GROUP BY 1),
tot AS (SELECT count(*) AS n, sum(y * y) AS syy FROM dr), {_inverse(1e-6)},
bs AS (SELECT list(coalesce(b, 0) ORDER BY i) AS b FROM ix LEFT JOIN xy USING (term)),
be AS (SELECT list_transform(m, lambda r: list_sum(list_transform(r, lambda v, j: v * b[j]))) AS beta, m, k, b FROM inv, bs),
fit AS (
  SELECT beta, m, k, greatest(0, syy - 2 * list_sum(list_transform(beta, lambda v, j: v * b[j])) + (SELECT sum(v * beta[i] * beta[j]) FROM (SELECT i, j, coalesce(s, 0) AS v FROM ix x CROSS JOIN (SELECT term AS t2, i AS j FROM ix) LEFT JOIN g ON g.a = x.term AND g.b = t2))) / greatest(1, n - k) AS variance
  FROM be, tot
),
co AS (SELECT ix.term, beta[ix.i] AS coefficient, sqrt(variance * greatest(0.00000001, m[ix.i][ix.i])) AS se, floor(g.s) AS cnt FROM fit, ix JOIN g ON g.a = ix.term AND g.b = ix.term),
pv AS (SELECT *, {_P_VALUE} AS p FROM (SELECT *, 1.0::DOUBLE / (1.0 + 0.3275911 * z) AS u FROM (SELECT *, abs(coefficient / se) / sqrt(2.0) AS z FROM co)))
SELECT term, {_SIX.format("coefficient")} AS coefficient, {_SIX.format("se")} AS se, {_SIX.format("(coefficient / se)")} AS t, {_SIX.format("p")} AS p, {_SIX.format("(coefficient - 1.96 * se)")} AS low, {_SIX.format("(coefficient + 1.96 * se)")} AS high,
  CASE WHEN cnt < 10 THEN 'INSUFFICIENT' WHEN cnt < 30 THEN 'LOW' WHEN p > 0.08 THEN 'MODERATE' ELSE 'SUPPORTED' END AS confidence, CASE WHEN coefficient > 0.01 THEN 'positive' WHEN coefficient < -0.01 THEN 'negative' ELSE 'neutral' END AS direction FROM pv""", surveys=False)
def driver_least_squares(spark, sf):
    """Coefficients with inference; the SQL solves the same normal equations by elimination."""
    out = drivers.ols(drivers.driver_input(surveys(spark, sf), "nps_score"))[0]
    return out.withColumns({c: scores.round_to(F.col(c), 6) for c in ("coefficient", "se", "t", "p", "low", "high")})


def _newton(i: int) -> str:
    """Step i of the logistic fit, by tables: probabilities, X'WX beside the unit matrix, its elimination, and the moved coefficients."""
    eliminated = "list_transform(acc.m, lambda r, i: CASE WHEN i = e.c THEN list_transform(r, lambda v: v / r[e.c]) ELSE list_transform(r, lambda v, j: v - r[e.c] * acc.m[e.c][j] / acc.m[e.c][e.c]) END)"
    return f"""
z{i} AS MATERIALIZED (SELECT pid, greatest(0.00001, least(1.0 - 0.00001, 1.0 / (1.0 + exp(-greatest(-20.0, least(20.0, sum(v * beta[i]))))))) AS p FROM xl, s{i - 1} GROUP BY pid),
w{i} AS MATERIALIZED (SELECT pid, n * p * (1 - p) AS w, sy - n * p AS res FROM z{i} JOIN pt USING (pid)),
h{i} AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v * w) AS s FROM xl a JOIN xl b USING (pid) JOIN w{i} USING (pid) GROUP BY 1, 2),
l{i} AS (SELECT x.i, list(coalesce(s, 0) + CASE WHEN x.i = y.i THEN 0.00001 ELSE 0 END ORDER BY y.i) AS v FROM ix x CROSS JOIN ix y LEFT JOIN h{i} h ON h.i = x.i AND h.j = y.i GROUP BY x.i),
a{i} AS (SELECT list(list_concat(v, list_transform(range(1, k + 1), lambda j: CASE WHEN j = i THEN 1.0::DOUBLE ELSE 0 END)) ORDER BY i) AS m, max(k) AS k FROM l{i}, (SELECT count(*) AS k FROM ix)),
e{i} AS MATERIALIZED (SELECT list_transform(list_reduce(list_prepend({{'m': m, 'c': CAST(0 AS BIGINT)}}, list_transform(range(1, k + 1), lambda c: {{'m': m, 'c': c}})), lambda acc, e: {{'m': {eliminated}, 'c': e.c}}).m, lambda r: r[k + 1:]) AS inv FROM a{i}),
r{i} AS (SELECT list(coalesce(s, 0) ORDER BY ix.i) AS r FROM ix LEFT JOIN (SELECT i, sum(v * res) AS s FROM xl JOIN w{i} USING (pid) GROUP BY 1) q ON q.i = ix.i),
v{i} AS MATERIALIZED (SELECT inv, list_transform(inv, lambda row: list_sum(list_transform(row, lambda v, j: v * r[j]))) AS move FROM e{i}, r{i}),
s{i} AS MATERIALIZED (
  SELECT CASE WHEN o.done THEN o.beta ELSE list_transform(o.beta, lambda b, j: b + move[j]) END AS beta, CASE WHEN o.done THEN o.inv ELSE v.inv END AS inv, o.done OR list_max(list_transform(move, lambda x: abs(x))) < 0.0001 AS done FROM s{i - 1} o, v{i} v
)"""


_LOGISTIC_ROWS = _PLAIN_PREDICTORS.replace("nps_score AS y", "CAST(csat_score >= 0.5 AS DOUBLE) AS y")


@query("driver_logistic", f"""{_LOGISTIC_ROWS},
pt AS MATERIALIZED (SELECT row_number() OVER () AS pid, * FROM (SELECT category, wave, supervisor, tenure, day, count(*) AS n, sum(y) AS sy FROM dr GROUP BY ALL)),
ix AS MATERIALIZED (SELECT term, f, level, row_number() OVER (ORDER BY term) AS i FROM terms),
xl AS MATERIALIZED (
  SELECT pid, i, CASE f WHEN 'tenure' THEN tenure / 100.0::DOUBLE WHEN 'day' THEN day / 30.0::DOUBLE ELSE 1.0::DOUBLE END AS v
  FROM pt JOIN ix ON f IN ('intercept', 'tenure', 'day') OR (f = 'category' AND level = category) OR (f = 'wave' AND level = wave) OR (f = 'supervisor' AND level = supervisor)
),
s0 AS (SELECT list(0.0::DOUBLE ORDER BY i) AS beta, CAST(NULL AS DOUBLE[][]) AS inv, FALSE AS done FROM ix), {", ".join(_newton(i) for i in range(1, 16))},
cn AS (SELECT i, sum(n) FILTER (v <> 0) AS cnt FROM xl JOIN pt USING (pid) GROUP BY 1),
co AS (SELECT term, beta[ix.i] AS coefficient, sqrt(greatest(0.00000001, inv[ix.i][ix.i])) AS se, cnt, (SELECT avg(y) FROM dr) AS share FROM s15, ix JOIN cn USING (i)),
pv AS (SELECT *, {_P_VALUE} AS p, coefficient * share * (1 - share) * 100 AS pp FROM (SELECT *, 1.0::DOUBLE / (1.0 + 0.3275911 * z) AS u FROM (SELECT *, abs(coefficient / se) / sqrt(2.0) AS z FROM co)))
SELECT term, {_FOUR.format("coefficient")} AS coefficient, {_FOUR.format("se")} AS se, {_FOUR.format("(coefficient / se)")} AS t, {_FOUR.format("p")} AS p, {_FOUR.format("(coefficient - 1.96 * se)")} AS low, {_FOUR.format("(coefficient + 1.96 * se)")} AS high,
  CASE WHEN cnt < 10 THEN 'INSUFFICIENT' WHEN cnt < 30 THEN 'LOW' WHEN p > 0.08 THEN 'MODERATE' ELSE 'SUPPORTED' END AS confidence,
  round(exp(coefficient), 2) AS odds_ratio, round(pp, 1) AS marginal_pp, CASE WHEN round(pp, 1) > 0.5 THEN 'positive' WHEN round(pp, 1) < -0.5 THEN 'negative' ELSE 'neutral' END AS direction FROM pv""")
def driver_logistic(spark, sf):
    """Odds of a high score by reweighted least squares; the SQL takes the same fifteen steps at most."""
    out = drivers.logistic(drivers.driver_input(surveys(spark, sf), "csat_score"))[0]
    return out.withColumns({c: scores.round_to(F.col(c), 4) for c in ("coefficient", "se", "t", "p", "low", "high")})


@query("normal_p_values", """
SELECT survey_id, floor(greatest(0.0001, least(1.0, 1.0 - (1.0 - ((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t * exp(-x * x)))) * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS p
FROM (SELECT survey_id, x, 1.0 / (1.0 + 0.3275911::DOUBLE * x) AS t FROM (SELECT survey_id, abs(tenure_days / 100.0::DOUBLE) / sqrt(2.0::DOUBLE) AS x FROM surveys))""")
def normal_p_values(spark, sf):
    return surveys(spark, sf).select("survey_id", scores.round_to(scores.normal_p_value(F.col("tenure_days") / 100.0), 6).alias("p"))


@query("case_baseline_deltas", f"""
b AS (SELECT supervisor, {_KPI} FROM surveys WHERE survey_date BETWEEN DATE '2024-01-10' - 30 AND DATE '2024-01-10' GROUP BY 1),
c AS (SELECT supervisor, {_KPI} FROM surveys WHERE survey_date > DATE '2024-01-10' GROUP BY 1)
SELECT c.*, {r4('(c.nps - b.nps)')} AS nps_delta, {r4('(c.csat - b.csat)')} AS csat_delta, {r4('(c.professionalism - b.professionalism)')} AS professionalism_delta FROM c LEFT JOIN b USING (supervisor)""")
def case_baseline_deltas(spark, sf):
    from surveyloom.operators import kpi

    s = surveys(spark, sf)
    return cases.deltas(kpi.kpis(s.filter("survey_date > date'2024-01-10'"), "supervisor"), cases.baseline(s, "2024-01-10", "supervisor"), "supervisor")


@query("case_version_comparison", f"""
a AS (SELECT agent_bms, survey_date, {_KPI} FROM surveys WHERE event_id % 3 <> 0 GROUP BY 1, 2),
b AS (SELECT agent_bms, survey_date, {_KPI} FROM surveys WHERE event_id % 5 <> 0 GROUP BY 1, 2)
SELECT agent_bms, survey_date, CASE WHEN a.survey_volume IS NULL THEN 'added' WHEN b.survey_volume IS NULL THEN 'removed' WHEN a.nps IS NOT DISTINCT FROM b.nps AND a.csat IS NOT DISTINCT FROM b.csat THEN 'same' ELSE 'changed' END AS change,
  a.nps AS nps_a, b.nps AS nps_b, a.csat AS csat_a, b.csat AS csat_b, {r4('(b.nps - a.nps)')} AS nps_delta, {r4('(b.csat - a.csat)')} AS csat_delta FROM a FULL OUTER JOIN b USING (agent_bms, survey_date)""")
def case_version_comparison(spark, sf):
    from surveyloom.operators import kpi

    s = surveys(spark, sf)
    a, b = (kpi.daily(s.filter(f"event_id % {k} <> 0"), "agent_bms") for k in (3, 5))
    return cases.compare_versions(a, b, ["agent_bms", "survey_date"], ["nps", "csat"])


@query("case_numbers", "SELECT o_orderkey, printf('CAS-%d-%04d', year(o_orderdate), row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey)) AS case_number FROM orders", surveys=False)
def case_numbers(spark, sf):
    return cases.numbered(table(spark, sf, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", "case_number")


_EFFECTIVE = "(SELECT max_by(m.supervisor, m.effective_from) FROM memberships m WHERE m.agent_bms = d.agent_bms AND m.effective_from <= d.survey_date AND (m.effective_to IS NULL OR m.effective_to >= d.survey_date)) AS effective_supervisor"


@query("case_member_days", f"{DENSE},{INTERVALS} SELECT d.*, {_EFFECTIVE} FROM dense d")
def case_member_days(spark, sf):
    s = surveys(spark, sf)
    return cases.member_days(s, s, org.membership_intervals(s), "2024-01-05", "2024-01-20")


@query("case_recalculation", f"""{DENSE}
SELECT agent_bms, CAST(sum(survey_volume) AS BIGINT) AS survey_volume, {weighted('nps')}, {weighted('csat')}, {weighted('professionalism')}, count_if(has_sample) AS sampled_days,
  coalesce(CASE WHEN CAST(substr(agent_bms, 5) AS INTEGER) % 2 = 0 THEN CAST(substr(agent_bms, 5) AS INTEGER) % 5 + 1 END, 1) AS version FROM dense GROUP BY 1""")
def case_recalculation(spark, sf):
    s = surveys(spark, sf)
    n = F.substring("agent_bms", 5, 5).cast("int")
    versions = s.select("agent_bms").distinct().filter(n % 2 == 0).withColumn("version", n % 5)
    return cases.recalculated(cases.member_days(s, s, org.membership_intervals(s), "2024-01-05", "2024-01-20").drop("effective_supervisor"), versions)


@query("case_next_version", "SELECT o_custkey, max(o_orderkey % 9) + 1 AS version FROM orders GROUP BY 1", surveys=False)
def case_next_version(spark, sf):
    return cases.new_version(table(spark, sf, "orders").select("o_custkey", (F.col("o_orderkey") % 9).alias("version")), "o_custkey")


@query("team_with_fallback", f"""
p AS (SELECT agent_bms, {_KPI} FROM surveys WHERE survey_date <= DATE '2024-01-03' GROUP BY 1), f AS (SELECT agent_bms, {_KPI} FROM surveys GROUP BY 1)
SELECT * FROM p UNION ALL SELECT * FROM f WHERE agent_bms NOT IN (SELECT agent_bms FROM p)""")
def team_with_fallback(spark, sf):
    from surveyloom.operators import kpi

    s = surveys(spark, sf)
    return cases.primary_or_fallback(kpi.kpis(s.filter("survey_date <= date'2024-01-03'"), "agent_bms"), kpi.kpis(s, "agent_bms"), "agent_bms").drop("has_sample")


_TOP3 = """cc AS (SELECT agent_bms, category_name, count(*) AS n FROM surveys WHERE category_name IS NOT NULL GROUP BY 1, 2),
rr AS (SELECT *, row_number() OVER (PARTITION BY agent_bms ORDER BY n DESC, category_name) AS k FROM cc),
tt AS (SELECT agent_bms, string_agg(category_name, ',' ORDER BY k) AS top_categories FROM rr WHERE k <= 3 GROUP BY 1)"""


@query("report_agent_reviews", f"""{_TOP3},
a AS (SELECT supervisor, agent_bms, {_KPI}, count_if(nps_score > 0) AS promoters, count_if(nps_score < 0) AS detractors FROM surveys GROUP BY 1, 2)
SELECT a.*, coalesce(top_categories, '') AS top_categories, CASE WHEN survey_volume < 5 THEN 'low_sample' WHEN nps < 0.2 OR csat < 0.7 OR professionalism < 0.75 THEN 'critical' WHEN nps < 0.5 OR csat < 0.8 OR professionalism < 0.85 THEN 'warning' ELSE 'on_target' END AS status, CAST(row_number() OVER (PARTITION BY supervisor ORDER BY survey_volume DESC, agent_bms) AS INTEGER) AS place FROM a LEFT JOIN tt USING (agent_bms)""")
def report_agent_reviews(spark, sf):
    return reports.agent_reviews(surveys(spark, sf))


@query("report_team_summary", f"""
a AS (SELECT supervisor, agent_bms, {_KPI} FROM surveys GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY supervisor ORDER BY nps DESC, agent_bms DESC) AS hi, row_number() OVER (PARTITION BY supervisor ORDER BY nps, agent_bms) AS lo FROM a WHERE survey_volume >= 5),
e AS (SELECT supervisor, max(CASE WHEN hi = 1 THEN agent_bms END) AS best_agent, max(CASE WHEN lo = 1 THEN agent_bms END) AS worst_agent FROM r GROUP BY 1),
n AS (SELECT supervisor, count(*) AS agents FROM a GROUP BY 1)
SELECT t.*, agents, best_agent, worst_agent FROM (SELECT supervisor, {_KPI} FROM surveys GROUP BY 1) t JOIN n USING (supervisor) LEFT JOIN e USING (supervisor)""")
def report_team_summary(spark, sf):
    return reports.team_summary(surveys(spark, sf))


_PERIOD = "survey_date BETWEEN DATE '2024-01-11' AND DATE '2024-01-20'"


@query("report_team_dataset", f"""
k AS (SELECT supervisor, {_KPI} FROM surveys WHERE {_PERIOD} GROUP BY 1),
b AS (SELECT supervisor, {_KPI} FROM surveys WHERE survey_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-10' GROUP BY 1),
ag AS (SELECT supervisor, agent_bms, {_KPI} FROM surveys WHERE {_PERIOD} GROUP BY 1, 2),
cr AS (SELECT supervisor, count_if(survey_volume >= 5 AND (nps < 0.2 OR csat < 0.7 OR professionalism < 0.75)) AS critical_agents FROM ag GROUP BY 1),
ct AS (SELECT supervisor, category_name, row_number() OVER (PARTITION BY supervisor ORDER BY count(*) DESC, category_name) AS place FROM surveys WHERE {_PERIOD} AND category_name IS NOT NULL GROUP BY 1, 2),
j AS (SELECT k.*, k.survey_volume - b.survey_volume AS volume_delta, {r4('(k.nps - b.nps)')} AS nps_delta, {r4('(k.csat - b.csat)')} AS csat_delta, {r4('(k.professionalism - b.professionalism)')} AS professionalism_delta,
  k.survey_volume < 15 AS low_sample, coalesce(k.nps >= 0.5, FALSE) AS n, coalesce(k.csat >= 0.8, FALSE) AS c, coalesce(k.professionalism >= 0.85, FALSE) AS p, critical_agents, category_name
  FROM k LEFT JOIN b USING (supervisor) LEFT JOIN cr USING (supervisor) LEFT JOIN (SELECT * FROM ct WHERE place = 1) USING (supervisor))
SELECT supervisor, survey_volume, nps, csat, professionalism, volume_delta, nps_delta, csat_delta, professionalism_delta, low_sample, CAST(n AS INTEGER) + CAST(c AS INTEGER) + CAST(p AS INTEGER) AS goals_met,
  CASE WHEN n AND c AND p THEN 'all' WHEN n OR c OR p THEN 'some' ELSE 'none' END AS summary,
  coalesce(nullif(concat_ws(',', CASE WHEN p THEN 'professionalism' END, CASE WHEN c THEN 'csat' END, CASE WHEN n THEN 'nps' END, CASE WHEN volume_delta > 0 THEN 'volume' END), ''), 'daily_service') AS strengths,
  coalesce(nullif(concat_ws(',', CASE WHEN low_sample THEN 'sample' END, CASE WHEN NOT n AND nps IS NOT NULL THEN 'nps' END, CASE WHEN NOT c AND csat IS NOT NULL THEN 'csat' END), ''), 'consistency') AS risks,
  concat_ws(',', CASE WHEN critical_agents > 0 THEN 'coaching' END, CASE WHEN NOT c OR NOT n THEN 'calls' END, 'category:' || category_name, 'monitor') AS actions FROM j""")
def report_team_dataset(spark, sf):
    """A team report's data: the period, the one before it, goals, and the rules' findings."""
    return reports.team_report(surveys(spark, sf), "2024-01-11", "2024-01-20")


_F4 = "printf('%.4f', {0})"
_CASES_SQL = """cases AS (
  SELECT 'BMS-' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS agent_bms, 'CAS-' || c_custkey AS case_number, CASE WHEN c_custkey % 2 = 0 THEN 'coaching' ELSE 'quality' END AS type,
    CASE WHEN c_custkey % 5 = 0 THEN 'high' ELSE 'normal' END AS priority, CASE WHEN c_custkey % 4 = 0 THEN 'closed' ELSE 'open' END AS status, DATE '2024-01-01' + CAST(c_custkey % 30 AS INTEGER) AS opened_at
  FROM customer WHERE c_custkey % 3 = 0)"""


def _cases(spark, sf):
    """Performance cases of a third of the agents, of which a quarter is closed."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").filter(k % 3 == 0).select(
        F.concat(F.lit("BMS-"), F.lpad(k.cast("string"), 5, "0")).alias("agent_bms"), F.concat(F.lit("CAS-"), k).alias("case_number"), F.when(k % 2 == 0, "coaching").otherwise("quality").alias("type"),
        F.when(k % 5 == 0, "high").otherwise("normal").alias("priority"), F.when(k % 4 == 0, "closed").otherwise("open").alias("status"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int")).alias("opened_at"),
    )


_AGENTS_SQL = f"""
i AS (SELECT *, coalesce(trim(verbatim) <> '', FALSE) AS spoken FROM surveys WHERE {_PERIOD}),
ak AS (SELECT supervisor, agent_bms, {_KPI}, count_if(nps_score > 0) AS promoters, count_if(nps_score < 0) AS detractors, count_if(spoken) AS comments,
  count_if(spoken AND nps_score > 0) AS praised, count_if(spoken AND nps_score < 0) AS blamed FROM i GROUP BY 1, 2),
st AS (SELECT *, CASE WHEN survey_volume < 5 THEN 'low_sample' WHEN nps < 0.2 OR csat < 0.7 OR professionalism < 0.75 THEN 'critical' WHEN nps < 0.5 OR csat < 0.8 OR professionalism < 0.85 THEN 'warning' ELSE 'on_target' END AS status FROM ak),
au AS (
  SELECT *, CASE status WHEN 'critical' THEN 'critical' WHEN 'warning' THEN 'below_target' WHEN 'low_sample' THEN 'small_sample' ELSE 'aligned' END AS assessment,
    CASE status WHEN 'critical' THEN 'urgent_session' WHEN 'warning' THEN 'reinforce' WHEN 'low_sample' THEN 'monitor_more' ELSE 'recognise' END AS action,
    CASE WHEN comments = 0 THEN 'none' WHEN praised > 0 AND blamed = 0 THEN 'only_praise' WHEN praised > 0 THEN 'mixed' WHEN blamed > 0 THEN 'only_blame' ELSE 'neutral' END AS comment_tone,
    coalesce(nullif(concat_ws(',', CASE WHEN praised > 0 THEN 'praise' END, CASE WHEN praised > 0 AND professionalism >= 0.85 THEN 'professional' END, CASE WHEN comments = 0 AND status = 'on_target' THEN 'solid_figures' END), ''), 'presence') AS strengths,
    coalesce(nullif(concat_ws(',', CASE WHEN blamed > 0 THEN 'response_times' END, CASE WHEN blamed > 0 AND csat < 0.8 THEN 'hard_cases' END, CASE WHEN comments = 0 AND status <> 'on_target' THEN 'no_comments' END), ''), 'keep_consistent') AS friction
  FROM st)"""


def _period_surveys(spark, sf):
    return with_verbatim(surveys(spark, sf), spark, sf).withColumn("record_hash", F.md5("survey_id"))


@query("report_agent_assessments", f"{_AGENTS_SQL} SELECT supervisor, agent_bms, status, comments, assessment, action, comment_tone, strengths, friction FROM au")
def report_agent_assessments(spark, sf):
    """What the rules say about each agent of each team in the period."""
    made = reports.team_dataset(_period_surveys(spark, sf), _cases(spark, sf), "2024-01-11", "2024-01-20").select("supervisor", F.explode("agents").alias("a"))
    return made.select("supervisor", "a.agent_bms", "a.status", "a.comments", "a.assessment", "a.action", "a.comment_tone", "a.strengths", "a.friction")


@query("report_narrative", f"""{_CASES_SQL},
k AS (SELECT supervisor, {_KPI} FROM surveys WHERE {_PERIOD} GROUP BY 1),
o AS (SELECT supervisor, count(*) AS n_open_cases FROM cases JOIN (SELECT DISTINCT supervisor, agent_bms FROM surveys WHERE {_PERIOD}) USING (agent_bms) WHERE status <> 'closed' GROUP BY 1),
j AS (SELECT k.*, coalesce(n_open_cases, 0) AS n_open_cases, coalesce(nps >= 0.5, FALSE) AS n, coalesce(csat >= 0.8, FALSE) AS c, coalesce(professionalism >= 0.85, FALSE) AS p FROM k LEFT JOIN o USING (supervisor))
SELECT supervisor, CASE WHEN n AND c AND p THEN 'all' WHEN n OR c OR p THEN 'some' ELSE 'none' END AS summary,
  coalesce(nullif(concat_ws(',', CASE WHEN survey_volume < 15 THEN 'sample' END, CASE WHEN NOT n AND nps IS NOT NULL THEN 'nps' END, CASE WHEN NOT c AND csat IS NOT NULL THEN 'csat' END, CASE WHEN n_open_cases > 0 THEN 'open_cases' END), ''), 'consistency') AS risks,
  CASE WHEN survey_volume < 15 THEN 'limited' ELSE 'representative' END AS data_quality FROM j""")
def report_narrative(spark, sf):
    """The rules over a team's dataset: summary of goals, risks with open cases, and how far the sample carries."""
    made = reports.team_dataset(_period_surveys(spark, sf), _cases(spark, sf), "2024-01-11", "2024-01-20")
    return made.select("supervisor", "summary", "risks", F.when(F.col("low_sample"), "limited").otherwise("representative").alias("data_quality"))


@query("report_nested_dataset", f"""{_CASES_SQL}, {_AGENTS_SQL},
pl AS (SELECT *, row_number() OVER (PARTITION BY supervisor ORDER BY survey_volume DESC, agent_bms) AS place FROM au),
ad AS (SELECT supervisor, agent_bms, survey_date, {_KPI} FROM i GROUP BY 1, 2, 3),
al AS (SELECT supervisor, agent_bms, string_agg(survey_date || '=' || survey_volume || '/' || {_F4.format('nps')}, ' ' ORDER BY survey_date) AS days FROM ad GROUP BY 1, 2),
ga AS (SELECT supervisor, string_agg(agent_bms || ':' || survey_volume || ':' || {_F4.format('csat')} || ':' || (survey_volume - promoters - detractors) || ':' || al.days, ';' ORDER BY place) AS agents,
  coalesce(string_agg(agent_bms, ',' ORDER BY agent_bms) FILTER (status = 'critical'), '') AS attention FROM pl JOIN al USING (supervisor, agent_bms) GROUP BY 1),
td AS (SELECT supervisor, survey_date, {_KPI} FROM i GROUP BY 1, 2),
gd AS (SELECT supervisor, string_agg(survey_date || ':' || survey_volume || ':' || {_F4.format('nps')} || ':' || {_F4.format('csat')} || ':' || {_F4.format('professionalism')}, ';' ORDER BY survey_date) AS days FROM td GROUP BY 1),
vol AS (SELECT supervisor, count(*) AS volume FROM i GROUP BY 1),
cc AS (SELECT supervisor, category_name, count(*) AS n FROM i WHERE category_name IS NOT NULL GROUP BY 1, 2),
gc AS (SELECT supervisor, string_agg(category_name || ':' || n || ':' || printf('%.1f', floor(n * 100.0::DOUBLE / volume * 10 + 0.5) / 10), ';' ORDER BY n DESC, category_name) AS categories FROM cc JOIN vol USING (supervisor) GROUP BY 1),
go AS (SELECT supervisor, string_agg(case_number || ':' || agent_bms || ':' || type || ':' || priority || ':' || opened_at, ';' ORDER BY case_number) AS open_cases, count(*) AS n_open_cases
  FROM cases JOIN (SELECT DISTINCT supervisor, agent_bms FROM i) USING (agent_bms) WHERE status <> 'closed' GROUP BY 1),
gv AS (SELECT supervisor, sha256(supervisor || ':2024-01-11:2024-01-20:' || string_agg(md5(survey_id), ':' ORDER BY md5(survey_id))) AS data_version FROM i GROUP BY 1)
SELECT supervisor, md5(days) AS days, md5(coalesce(categories, '')) AS categories, md5(agents) AS agents, md5(attention) AS attention, md5(coalesce(open_cases, '')) AS open_cases, CAST(coalesce(n_open_cases, 0) AS INTEGER) AS n_open_cases, data_version
FROM gd LEFT JOIN gc USING (supervisor) JOIN ga USING (supervisor) LEFT JOIN go USING (supervisor) JOIN gv USING (supervisor)""")
def report_nested_dataset(spark, sf):
    """One nested row per team; its arrays are compared as digests of their written form."""
    made = reports.team_dataset(_period_surveys(spark, sf), _cases(spark, sf), "2024-01-11", "2024-01-20")
    line = lambda x, *parts: F.concat_ws(":", *(x[p].cast("string") if isinstance(p, str) else p for p in parts))
    four = lambda v: F.format_string("%.4f", v)
    listed = lambda xs, f: F.md5(F.coalesce(F.array_join(F.transform(xs, f), ";"), F.lit("")))
    own_days = lambda a: F.array_join(F.transform(a["days"], lambda d: F.concat(d["date"].cast("string"), F.lit("="), d["survey_volume"], F.lit("/"), four(d["nps"]))), " ")
    return made.select(
        "supervisor", listed("days", lambda d: line(d, "date", "survey_volume", four(d["nps"]), four(d["csat"]), four(d["professionalism"]))).alias("days"), listed("categories", lambda c: line(c, "category", "count", F.format_string("%.1f", c["percentage"]))).alias("categories"),
        listed("agents", lambda a: line(a, "agent_bms", "survey_volume", four(a["csat"]), "passives", own_days(a))).alias("agents"), F.md5(F.array_join("attention", ",")).alias("attention"),
        listed("open_cases", lambda c: line(c, "case_number", "agent_bms", "type", "priority", "opened_at")).alias("open_cases"), "n_open_cases", "data_version",
    )


@query("report_top_share", f"SELECT supervisor, CAST(row_number() OVER (ORDER BY count(*) DESC, supervisor) AS INTEGER) AS rank, count(*) AS volume, {r4('(count(*) / (SELECT count(*) FROM surveys))')} AS share FROM surveys GROUP BY 1 ORDER BY volume DESC, supervisor LIMIT 10")
def report_top_share(spark, sf):
    return reports.share_of_top(surveys(spark, sf), "supervisor")


_SCRUB = "regexp_replace(regexp_replace(regexp_replace(text, '" + text.EMAIL + "', '[EMAIL_REDACTED]', 'g'), '" + text.PHONE + "', '[PHONE_REDACTED]', 'g'), '" + text.ACCOUNT + "', '[ACCOUNT_REDACTED]', 'g')"


@query("privacy_scrub", f"SELECT doc_id, md5({_SCRUB}) AS digest, CAST(len(regexp_extract_all(text, '{text.EMAIL}')) AS BIGINT) AS emails FROM documents", surveys=False)
def privacy_scrub(spark, sf):
    return privacy.scrub(table(spark, sf, "documents"), "text").select("doc_id", F.md5("scrubbed").alias("digest"), "emails")


@query("privacy_references", """SELECT survey_id LIKE 'SRV-%' AS had_id, count(*) AS n, count(DISTINCT agent_bms) AS agents, count(*) AS records, TRUE AS well_formed FROM surveys GROUP BY 1""")
def privacy_references(spark, sf):
    """Minimised rows under two scopes' vaults: as many references of one scope as there were identities."""
    s = surveys(spark, sf).select("survey_id", "agent_bms", "nps_score")
    ids = s.select(F.lit("agent").alias("type"), F.col("agent_bms").alias("internal_id")).union(s.select(F.lit("record"), "survey_id"))
    vault = spark.createDataFrame([("other", "agent", "BMS-00001", "AGT_ZZZZZZ")], "scope string, type string, internal_id string, pseudonym string")
    made = vault.union(privacy.new_pseudonyms(ids, vault, "report"))
    out = privacy.minimised(s, made, "report", ["survey_id", "agent_bms"])
    fits = F.col("record_ref").rlike("^REC_[A-Z0-9]{6}$") & F.col("agent_ref").rlike("^AGT_[A-Z0-9]{6}$")
    return out.groupBy(F.col("record_ref").isNotNull().alias("had_id")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("agent_ref").alias("agents"), F.countDistinct("record_ref").alias("records"), F.min(fits).alias("well_formed"))


@query("raw_keyword_search", "SELECT survey_id, supervisor FROM surveys WHERE verbatim LIKE '%idiot%'")
def raw_keyword_search(spark, sf):
    return usage.search(with_verbatim(surveys(spark, sf), spark, sf), ["verbatim"], "idiot").select("survey_id", "supervisor")


@query("raw_page", "SELECT survey_id, nps_score FROM surveys ORDER BY survey_date DESC, survey_id LIMIT 25 OFFSET 50")
def raw_page(spark, sf):
    return usage.page(surveys(spark, sf).select("survey_id", "nps_score", "survey_date"), [F.col("survey_date").desc(), "survey_id"], 25, 50).drop("survey_date")


_EVENT = """'"event_id":' || CAST({0}event_id AS VARCHAR) || ',"user_id":' || CAST({0}user_id AS VARCHAR) || ',"event_type":"' || {0}event_type || '"}}'"""
_CHAIN = f"""WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
c AS (
  SELECT event_id, user_id, k, CAST(NULL AS VARCHAR) AS previous_hash, sha256('{{"previous_hash":"",' || {_EVENT.format('')}) AS event_hash FROM e WHERE k = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.k, c.event_hash, sha256('{{"previous_hash":"' || c.event_hash || '",' || {_EVENT.format('e.')}) FROM c JOIN e ON e.user_id = c.user_id AND e.k = c.k + 1
)"""
_PARTS = ("event_id", "user_id", "event_type")


@query("audit_chain", f"{_CHAIN} SELECT event_id, user_id, previous_hash, event_hash FROM c", surveys=False)
def audit_chain(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return audit.linked(e, "user_id", "event_id", *_PARTS).drop("event_type")


@query("audit_verification", """SELECT event_id, 'event_hash payload mismatch' AS reason FROM events WHERE event_id % 500 = 7
UNION ALL SELECT event_id, 'previous_hash mismatch' FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p % 500 IN (8, 9) AND event_id % 500 <> 8""", surveys=False)
def audit_verification(spark, sf):
    """Some events are altered, some removed, and some forged with a hash that fits: their successors show."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    chain = audit.linked(e, "user_id", "event_id", *_PARTS).filter("event_id % 500 <> 8")
    chain = chain.withColumn("event_type", F.when(F.col("event_id") % 500 == 7, "altered").when(F.col("event_id") % 500 == 9, "forged").otherwise(F.col("event_type")))
    chain = chain.withColumn("event_hash", F.when(F.col("event_id") % 500 == 9, audit.event_hash(F.col("previous_hash"), audit.canonical(*_PARTS))).otherwise(F.col("event_hash")))
    return audit.broken_links(chain, "user_id", "event_id", *_PARTS)


@query("run_kpis", """WITH r AS (SELECT user_id, sum((event_id * 7919) % 90000) AS tokens, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS latency, count_if(event_type = 'purchase') AS tools FROM events GROUP BY 1)
SELECT count(*) AS total_runs, CAST(sum(tokens) AS BIGINT) AS total_tokens, CAST(floor(avg(tokens) + 0.5) AS BIGINT) AS avg_tokens, CAST(max(tokens) AS BIGINT) AS max_tokens, CAST(floor(avg(latency) + 0.5) AS BIGINT) AS avg_latency_ms, floor(count_if(tools > 0) / count(*) * 1000.0::DOUBLE + 0.5) / 10.0::DOUBLE AS tool_call_rate FROM r""", surveys=False)
def run_kpis(spark, sf):
    runs = table(spark, sf, "events").groupBy("user_id").agg(F.sum((F.col("event_id") * 7919) % 90_000).alias("tokens"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("latency_ms"), F.count_if(F.col("event_type") == "purchase").alias("tools"))
    return usage.run_kpis(runs)


_ANSWER = "CASE event_id % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'Probably VIEW, I think' WHEN 2 THEN 'nothing of this' END"


@query("categorisation_merge", f"""
k AS (SELECT list(name ORDER BY category_id) AS names FROM categories),
w AS (SELECT survey_id, event_id, {_ANSWER} AS answer FROM surveys WHERE survey_id NOT IN (SELECT survey_id FROM analyses WHERE status = 'completed')),
m AS (SELECT w.*, coalesce((SELECT min(category_id) FROM categories WHERE name = answer), (SELECT min(category_id) FROM categories WHERE contains(lower(answer), lower(name))), 1) AS category_id FROM w)
SELECT survey_id, CASE WHEN event_id % 4 <> 3 THEN category_id END AS category_id, CASE WHEN event_id % 4 = 3 THEN 0.0::DOUBLE WHEN event_id % 3 = 0 THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END AS confidence, CASE WHEN event_id % 4 = 3 THEN 'failed' ELSE 'completed' END AS status FROM m""")
def categorisation_merge(spark, sf):
    s = surveys(spark, sf).select("survey_id", "event_id")
    names = [(r["category_id"], r["name"]) for r in categories(spark, sf).orderBy("category_id").collect()]
    answers = s.filter("event_id % 4 <> 3").select("survey_id", F.expr(_ANSWER).alias("category"), F.when(F.col("event_id") % 3 != 0, 0.5).alias("confidence"))
    return categorise.merged_answers(s, answers, names, analyses(spark, sf))


@query("json_extraction", "SELECT event_id, CAST(json_extract_string(regexp_extract('Sure: ' || props || ' done', '(?s)\\{.*\\}'), '$.k') AS BIGINT) AS k, regexp_extract('Sure: ' || props || ' ok', '(?s)\\{.*\\}') AS body FROM events", surveys=False)
def json_extraction(spark, sf):
    e = table(spark, sf, "events")
    inside = text.json_object(F.concat(F.lit("Sure: "), "props", F.lit(" ok")))
    return e.select("event_id", F.get_json_object(text.json_object(F.concat(F.lit("Sure: "), "props", F.lit(" done"))), "$.k").cast("long").alias("k"), inside.alias("body"))


@query("percent_display", f"SELECT supervisor, printf('%.1f', floor(abs({r4(CLAMPED_MEAN.format('csat_score'))} * 100.0::DOUBLE) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE) || '%' AS csat FROM surveys GROUP BY 1")
def percent_display(spark, sf):
    from surveyloom.operators import kpi

    return kpi.kpis(surveys(spark, sf), "supervisor").select("supervisor", scores.percent_text(F.col("csat")).alias("csat"))


def _calls(spark, sf):
    return table(spark, sf, "events").select("user_id", F.col("event_type").alias("tool_name"), F.col("value").alias("duration_ms"), F.when(F.col("event_id") % 9 == 0, "error").otherwise("completed").alias("status"), ((F.col("event_id") * 7919) % 90_000).alias("tokens"))


@query("usage_tool_statistics", "SELECT event_type AS tool_name, count(*) AS calls, floor(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(*) * 100 + 0.5) / 100 AS avg_ms, count_if(event_id % 9 = 0) AS errors FROM events GROUP BY 1", surveys=False)
def usage_tool_statistics(spark, sf):
    return usage.tool_statistics(_calls(spark, sf))


@query("usage_token_tiers", """WITH t AS (SELECT (event_id * 7919) % 90000 AS tokens FROM events)
SELECT 'small' AS tier, count_if(tokens <= 9999) AS runs FROM t UNION ALL SELECT 'medium', count_if(tokens BETWEEN 10000 AND 30000) FROM t UNION ALL SELECT 'large', count_if(tokens BETWEEN 30000 AND 60000) FROM t UNION ALL SELECT 'huge', count_if(tokens >= 60000) FROM t""", surveys=False)
def usage_token_tiers(spark, sf):
    return usage.tier_counts(_calls(spark, sf), "tokens")


@query("usage_run_diagnostics", """WITH t AS (SELECT user_id, event_type, count(*) AS n, sum((event_id * 7919) % 90000) AS tokens FROM events GROUP BY 1, 2),
r AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, max(CASE WHEN event_type = 'click' THEN n END) AS queries, max(CASE WHEN event_type = 'view' THEN n END) AS metrics FROM t GROUP BY 1)
SELECT user_id, calls, tokens, queries, metrics, concat_ws(',', CASE WHEN tokens > 50000 THEN 'many_tokens' END, CASE WHEN calls >= 5 THEN 'many_tools' END, CASE WHEN queries >= 4 THEN 'repeated_queries' END, CASE WHEN metrics >= 3 THEN 'repeated_metrics' END) AS diagnostics FROM r""", surveys=False)
def usage_run_diagnostics(spark, sf):
    return usage.run_diagnostics(_calls(spark, sf), "user_id", "tokens", "click", "view").drop("tools")


@query("formula_column", "SELECT survey_id, (nps_score + csat_score * 2.0::DOUBLE) / 3.0::DOUBLE - -professionalism_score AS value, round((csat_score + csat_score + nps_score) / 3.0::DOUBLE * 10.0::DOUBLE) AS rounded FROM surveys")
def formula_column(spark, sf):
    s = surveys(spark, sf).withColumn("xs", F.array("csat_score", "csat_score", "nps_score"))
    names = {k: F.col(v) for k, v in (("nps", "nps_score"), ("csat", "csat_score"), ("prof", "professionalism_score"), ("xs", "xs"))}
    return s.select("survey_id", compile_formula("(nps + csat * 2) / 3 - -prof", names).alias("value"), compile_formula("ROUND(AVG(xs) * 10)", names, frozenset({"xs"})).alias("rounded"))


@query("text_normalisation", """SELECT p_partkey, substr('TEAM-' || regexp_replace(upper(p_name), '[^A-Z0-9]+', '-', 'g'), 1, 50) AS code, substr(md5(p_name), 1, 8) AS short_hash,
  trim(regexp_replace(lower(p_name), '[_.\\s%-]+', ' ', 'g')) AS header, CAST(ceil(strlen(p_name) / 4.0) AS BIGINT) AS tokens FROM part""", surveys=False)
def text_normalisation(spark, sf):
    n = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", text.code("TEAM", n).alias("code"), text.short_hash(n).alias("short_hash"), text.header(n).alias("header"), text.token_estimate(n).alias("tokens"))


@query("string_similarity", "SELECT s_suppkey, levenshtein(s_name, 'Supplier#000000042') AS distance FROM supplier", surveys=False)
def string_similarity(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.levenshtein("s_name", F.lit("Supplier#000000042")).cast("long").alias("distance"))


@query("json_path_predicate", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) < 10", surveys=False)
def json_path_predicate(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").select("event_id", k.alias("k")).filter("k < 10")
