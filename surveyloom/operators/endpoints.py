"""Analytic endpoints composed from DSL queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.operators import drivers, forecast, privacy
from surveyloom.plans.dsl import run, with_share
from surveyloom.plans.metrics import METRICS, metric


def calculate_metric(name: str, surveys: DataFrame, filters: list[dict] | None = None) -> DataFrame:
    """One value (0 without rows) and the number of surveys."""
    out = run({"metrics": [name], "filters": filters or []}, surveys)
    total = "survey_volume" if name == "survey_volume" else "sample_count"
    return out.select(F.coalesce(F.col(name).cast("double"), F.lit(0.0)).alias("value"), F.col(total).alias("total_surveys"))


def compare_metrics(metrics: list[str], dimension: str, values: list[str], surveys: DataFrame) -> DataFrame:
    """The metrics for some values of a dimension, side by side."""
    return run({"metrics": metrics, "group_by": [dimension], "filters": [{"field": dimension, "operator": "in", "value": values}]}, surveys)


def category_distribution(surveys: DataFrame, analyses: DataFrame, categories: DataFrame) -> DataFrame:
    """Volume by category with its share; surveys with several analyses count for each."""
    return with_share(run({"metrics": ["survey_volume"], "group_by": ["category"]}, surveys, analyses, categories))


def dimension_values(surveys: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value): distinct, without null and blank."""
    parts = [surveys.select(F.lit(d).alias("dimension"), F.col(d).alias("value")).filter("value is not null and value <> ''") for d in dimensions]
    return reduce(DataFrame.union, parts).distinct()


#: Query templates of the dashboard's widgets.
WIDGETS = {
    "metric": {"metrics": ["nps"]},
    "trend": {"metrics": ["nps", "survey_volume"], "group_by": ["survey_date"], "sort_by": "survey_date", "sort_order": "asc"},
    "comparison": {"metrics": ["nps"], "group_by": ["supervisor"], "limit": 12},
    "category_breakdown": {"metrics": ["survey_volume"], "group_by": ["category"]},
    "distribution": {"metrics": ["survey_volume"], "group_by": ["supervisor"]},
    "table": {"metrics": ["nps", "csat", "professionalism", "survey_volume"], "group_by": ["agent"]},
}


def widget(kind: str, surveys: DataFrame, analyses: DataFrame | None = None, categories: DataFrame | None = None, **changes: object) -> DataFrame:
    """A widget's query, with parts of its template replaced."""
    if kind not in WIDGETS:
        raise ValueError(f"unknown widget {kind!r}")
    return run(WIDGETS[kind] | changes, surveys, analyses, categories)


def custom_tool(template: dict, arguments: dict) -> dict:
    """A stored template with a call's arguments: filters add up, other keys are replaced."""
    merged = template | {k: v for k, v in arguments.items() if k != "filters" and v is not None}
    merged["filters"] = [*(template.get("filters") or []), *(arguments.get("filters") or [])]
    return merged


def metric_definition(name: str) -> dict:
    """What the registry says about a metric, or that there is none."""
    try:
        m = metric(name)
    except ValueError:
        return {"error": "Metric not found", "known": sorted(METRICS)}
    return {"key": m.key, "aggregation": m.aggregation, "range": [m.low, m.high], "format": m.format, "source": m.column}


def sandbox(query: dict, default: int = 20, cap: int = 50) -> dict:
    """A query for trying things out: limited to ``default`` groups, and to ``cap`` at most."""
    return query | {"limit": max(1, min(cap, int(query.get("limit") or default)))}


def authorised(permissions: set[str] | None) -> bool:
    """Whether a user may query: with one of two permissions; calls without a user may."""
    return permissions is None or bool(permissions & {"data.view", "dashboard.view"})


def envelope(query: dict, surveys: DataFrame, permissions: set[str] | None = None, **tables: DataFrame) -> dict:
    """A limited query's result as one answer: success, the query, number of rows and the rows."""
    if not authorised(permissions):
        raise PermissionError("data.view or dashboard.view is needed")
    rows = [r.asDict() for r in run(sandbox(query, 1000, 1000), surveys, **tables).collect()]
    return {"success": True, "dsl": query, "count": len(rows), "data": rows}


def query_data(dsl: dict, surveys: DataFrame, vault: DataFrame, scope: str, analyses: DataFrame | None = None, categories: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(minimised result with shares, new rows of the vault): a query of the DSL as a caller without names may see it.

    Pseudonyms in its filters mean the scope's identities; identities in the result become
    references, made where the vault has none; volumes get their share.
    """
    held = vault.filter(F.col("scope") == scope)
    named = {str(v) for f in dsl.get("filters") or [] for v in (f.get("value") if isinstance(f.get("value"), list) else [f.get("value")])}
    meant = {r["pseudonym"]: r["internal_id"] for r in held.filter(F.col("pseudonym").isin(sorted(named))).collect()} if named else {}
    out = run(privacy.resolved(dsl, meant), surveys, analyses, categories)
    out = with_share(out) if "survey_volume" in out.columns else out
    kinds = [(kind, c) for kind, c in (("supervisor", "supervisor"), ("agent", "agent_bms")) if c in out.columns]
    if not kinds:
        return privacy.minimised(out.drop("agent"), held, scope), held.limit(0)
    identities = out.select(F.explode(F.array(*(F.struct(F.lit(kind).alias("type"), F.col(c).cast("string").alias("internal_id")) for kind, c in kinds))).alias("x")).select("x.*").filter("internal_id is not null")
    made = privacy.new_pseudonyms(identities, vault, scope)
    return privacy.minimised(out.drop("agent"), held.unionByName(made), scope), made


def run_forecast(surveys: DataFrame, metric_name: str = "nps", horizon: int = 7, filters: list[dict] | None = None, by: str | None = None) -> DataFrame:
    """Selected model and projections of a metric over all surveys, or for each value of a dimension.

    ``filters`` are those of the DSL without categories.
    """
    from surveyloom.plans.dsl import _predicate, validate

    for f in validate({"metrics": ["survey_volume"], "filters": filters or []}).filters:
        surveys = surveys.filter(_predicate(f))
    key = by or "__all"
    rows = surveys if by else surveys.withColumn(key, F.lit("all"))
    return forecast.forecast(forecast.series(rows, metric_name, key), metric_name, horizon)


def run_driver_analysis(surveys: DataFrame, metric_name: str = "nps", supervisor: str | None = None, wave: str | None = None, date_from: str | None = None, date_to: str | None = None, **tables: DataFrame) -> tuple[DataFrame, dict]:
    """Drivers of a score: least squares for nps, the odds of a high score for the others."""
    rows = drivers.driver_input(surveys, f"{metric_name}_score", {"supervisor": supervisor, "wave": wave, "date_from": date_from, "date_to": date_to}, **tables)
    return drivers.ols(rows) if metric_name == "nps" else drivers.logistic(rows)
