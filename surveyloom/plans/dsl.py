"""The query DSL: a validated dict becomes one lazy DataFrame.

``validate`` turns a dict into a ``Query`` and raises on anything it does not know.
``plan`` joins the categories only where they are used, filters, groups, sorts and limits.
Deviations on purpose: ``sort_by`` must name an output column, filters need a value of the
right shape, and ``sort_order`` counts without ``sort_by`` as well.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.scores import exact, top_box
from surveyloom.plans.metrics import METRICS, metric

AGGREGATIONS = ("avg", "count", "sum", "min", "max")
DIMENSIONS = {
    "agent": "agent_name", "agent_name": "agent_name", "agent_bms": "agent_bms", "supervisor": "supervisor", "survey_date": "survey_date",
    "wave": "wave", "tenure": "tenure_days", "tenure_days": "tenure_days", "category": "category",
}
OPERATORS = ("=", "!=", "<>", ">", "<", ">=", "<=", "in", "between", "like")
UNCATEGORISED = "Uncategorized"
LARGEST_LIMIT = 1000


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: object


@dataclass(frozen=True)
class Query:
    metrics: tuple[str, ...]
    aggregation: str | None = None
    group_by: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    date_from: str | None = None
    date_to: str | None = None
    sort_by: str | None = None
    descending: bool = True
    limit: int | None = None
    extra: dict = field(default_factory=dict, compare=False)

    @property
    def uses_category(self) -> bool:
        return "category" in self.group_by or any(f.field == "category" for f in self.filters)


def _day(value: object) -> str:
    try:
        return dt.date.fromisoformat(str(value)[:10]).isoformat()
    except ValueError as e:
        raise ValueError(f"not a date: {value!r}") from e


def validate(dsl: dict) -> Query:
    """The normalised query, or a ValueError that names what is wrong."""
    named = dsl.get("metrics") or dsl.get("metric")
    if not named:
        raise ValueError("a metric is required")
    metrics = tuple(metric(m).key for m in ([named] if isinstance(named, str) else named))
    aggregation = dsl.get("aggregation")
    if aggregation is not None and (aggregation := str(aggregation).lower()) not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {aggregation!r}")
    groups = dsl.get("group_by") or []
    groups = tuple(str(g).lower() for g in ([groups] if isinstance(groups, str) else groups))
    if unknown := [g for g in groups if g not in DIMENSIONS]:
        raise ValueError(f"unknown dimension {unknown[0]!r}")
    filters = []
    for f in dsl.get("filters") or []:
        name, op, value = str(f.get("field", "")).lower(), str(f.get("operator", "=")).lower(), f.get("value")
        if name not in DIMENSIONS:
            raise ValueError(f"unknown filter field {name!r}")
        if op not in OPERATORS:
            raise ValueError(f"unknown operator {op!r}")
        listed = isinstance(value, (list, tuple))
        if value is None or listed != (op in ("in", "between")) or (op == "between" and len(value) != 2):
            raise ValueError(f"operator {op!r} on {name!r} needs another value than {value!r}")
        filters.append(Filter(name, op, tuple(value) if listed else value))
    days = dsl.get("date_range") or {}
    order = str(dsl.get("sort_order") or "desc").lower()
    if order not in ("asc", "desc"):
        raise ValueError(f"unknown sort order {order!r}")
    outputs = {*metrics, *groups, "sample_count"}
    if (sort_by := dsl.get("sort_by")) is not None and sort_by not in outputs:
        raise ValueError(f"cannot sort by {sort_by!r}")
    limit = dsl.get("limit")
    if limit is not None:
        limit = max(1, min(LARGEST_LIMIT, int(limit)))
    return Query(metrics, aggregation, groups, tuple(filters), _day(days["from"]) if days.get("from") else None, _day(days["to"]) if days.get("to") else None, sort_by, order == "desc", limit)


def _column(dimension: str) -> Column:
    return F.coalesce(F.col("category_name"), F.lit(UNCATEGORISED)) if dimension == "category" else F.col(DIMENSIONS[dimension])


def _predicate(f: Filter) -> Column:
    c, v = _column(f.field), f.value
    if f.field == "survey_date" and f.operator != "like":
        v = [F.lit(x).cast("date") for x in v] if isinstance(v, tuple) else F.lit(v).cast("date")
    if f.operator == "in":
        return c.isin(*v)
    if f.operator == "between":
        return c.between(*v)
    if f.operator == "like":
        return c.like(v)
    return {"=": c == v, "!=": c != v, "<>": c != v, ">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v}[f.operator]


def _measure(key: str, aggregation: str | None) -> Column:
    m = METRICS[key]
    if m.column is None:
        return F.count(F.lit(1))
    x = F.col(m.column)
    if aggregation is None and key in ("csat", "professionalism"):
        return F.sum(exact(top_box(x))).cast("double") / F.count(F.lit(1))
    kind = aggregation or m.aggregation
    if kind == "avg":
        return F.try_divide(F.sum(exact(x)).cast("double"), F.count(x))
    return {"sum": F.sum(exact(x)).cast("double"), "min": F.min(x), "max": F.max(x), "count": F.count(x)}[kind]


def plan(q: Query, surveys: DataFrame, analyses: DataFrame | None = None, categories: DataFrame | None = None) -> DataFrame:
    """One DataFrame for the query.

    With ``analyses`` and ``categories`` the category comes from a left join (a survey with
    two analyses counts twice); else ``surveys`` has category_name.
    """
    rows = surveys
    if q.uses_category and analyses is not None and categories is not None:
        rows = rows.drop("category_name").join(analyses.select("survey_id", "category_id"), "survey_id", "left").join(categories.select("category_id", F.col("name").alias("category_name")), "category_id", "left")
    wanted = [_predicate(f) for f in q.filters]
    if q.date_from:
        wanted.append(F.col("survey_date") >= F.lit(q.date_from).cast("date"))
    if q.date_to:
        wanted.append(F.col("survey_date") <= F.lit(q.date_to).cast("date"))
    if wanted:
        rows = rows.filter(reduce(lambda a, b: a & b, wanted))
    measures = [_measure(m, q.aggregation).alias(m) for m in q.metrics]
    if "survey_volume" not in q.metrics:
        measures.append(F.count(F.lit(1)).alias("sample_count"))
    if {"agent", "agent_bms"} & set(q.group_by) and "agent_name" not in q.group_by:
        measures.append(F.max("agent_name").alias("agent_name"))
    out = rows.groupBy(*(_column(g).alias(g) for g in q.group_by)).agg(*measures)
    if q.group_by:
        key = F.col(q.sort_by or q.metrics[0])
        # groups as a tie-break make a limit reproducible
        out = out.orderBy(key.desc_nulls_last() if q.descending else key.asc_nulls_last(), *q.group_by)
    return out.limit(q.limit) if q.limit else out


def run(dsl: dict, surveys: DataFrame, analyses: DataFrame | None = None, categories: DataFrame | None = None) -> DataFrame:
    return plan(validate(dsl), surveys, analyses, categories)


def with_share(result: DataFrame, measure: str = "survey_volume") -> DataFrame:
    """Percentage of each returned row in the returned total (after any limit); the total is one row."""
    total = result.agg(F.sum(measure).alias("__total"))
    joined = result.crossJoin(F.broadcast(total))
    return joined.withColumn("percentage", F.floor(F.col(measure) * 10000.0 / F.greatest(F.lit(1), "__total") + 0.5) / 100.0).drop("__total")
