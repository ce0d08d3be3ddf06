"""Usage analytics: tool statistics, run tiers, diagnostics and listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions.scores import round_to

#: Inclusive token ranges; neighbours share their edge on purpose.
TIERS = {"small": (None, 9_999), "medium": (10_000, 30_000), "large": (30_000, 60_000), "huge": (60_000, None)}


def tool_statistics(calls: DataFrame) -> DataFrame:
    """Calls, mean duration and errors of each tool."""
    return calls.groupBy("tool_name").agg(F.count(F.lit(1)).alias("calls"), round_to(F.sum(F.col("duration_ms").cast("decimal(18,4)")).cast("double") / F.count(F.lit(1)), 2).alias("avg_ms"), F.count_if(F.col("status") == "error").alias("errors"))


def tool_listing(tools: DataFrame, calls: DataFrame) -> DataFrame:
    """All tools, those without calls too."""
    return tools.join(tool_statistics(calls), "tool_name", "left").fillna({"calls": 0, "errors": 0})


def tier_counts(runs: DataFrame, tokens: str) -> DataFrame:
    """Runs in each token range; a run on a shared edge counts in both."""
    t = F.col(tokens)
    parts = [runs.agg(F.count_if((t >= lo if lo is not None else F.lit(True)) & (t <= hi if hi is not None else F.lit(True))).alias("runs")).select(F.lit(k).alias("tier"), "runs") for k, (lo, hi) in TIERS.items()]
    return reduce(DataFrame.union, parts)


def run_diagnostics(calls: DataFrame, run: str, tokens: str, query_tool: str = "query_metrics", metric_tool: str = "calculate_metric") -> DataFrame:
    """Frequency of tools in each run, and what stands out about it."""
    per = calls.groupBy(run, "tool_name").agg(F.count(F.lit(1)).alias("n"), F.sum(tokens).alias("tokens"))
    runs = per.groupBy(run).agg(F.sum("n").alias("calls"), F.sum("tokens").alias("tokens"), F.max(F.when(F.col("tool_name") == query_tool, F.col("n"))).alias("queries"), F.max(F.when(F.col("tool_name") == metric_tool, F.col("n"))).alias("metrics"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool_name", "n")))).alias("tools"))
    flags = F.array_compact(F.array(F.when(F.col("tokens") > 50_000, F.lit("many_tokens")), F.when(F.col("calls") >= 5, F.lit("many_tools")), F.when(F.col("queries") >= 4, F.lit("repeated_queries")), F.when(F.col("metrics") >= 3, F.lit("repeated_metrics"))))
    return runs.withColumn("diagnostics", F.concat_ws(",", flags))


def run_kpis(runs: DataFrame) -> DataFrame:
    """One row over all runs: number, tokens (sum, mean of those known, largest), mean latency, percentage that called tools."""
    n = F.count(F.lit(1))
    return runs.agg(n.alias("total_runs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), F.coalesce(round_to(F.avg("tokens"), 0), F.lit(0.0)).cast("long").alias("avg_tokens"), F.coalesce(F.max("tokens"), F.lit(0)).alias("max_tokens"), F.coalesce(round_to(F.avg("latency_ms"), 0), F.lit(0.0)).cast("long").alias("avg_latency_ms"), F.coalesce(round_to(F.count_if(F.col("tools") > 0) / n * 100, 1), F.lit(0.0)).alias("tool_call_rate"))


def catalogue(tools: DataFrame) -> DataFrame:
    """Built-in tools first, then by place and name; ``rank`` has that order."""
    order = [F.col("builtin").desc(), F.col("sort_order"), F.col("name")]
    return tools.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


#: Fields that raw records may be filtered by, and ordered by.
RAW_FIELDS = ("survey_date", "nps_score", "csat_score", "professionalism_score", "tenure_days", "wave", "supervisor", "agent_bms", "agent_name", "category_name", "survey_id")
RAW_ORDER = ("survey_date", "nps_score", "csat_score", "professionalism_score", "tenure_days", "wave")
CEILING = 5000


def raw_filter(rows: DataFrame, filters: list[dict]) -> DataFrame:
    """Rows that fit all filters; ``like`` means contains, in any letters; unknown fields are refused."""
    compare = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
    for f in filters:
        field = {"agent": "agent_name", "category": "category_name"}.get(f.get("field"), f.get("field"))
        operator, value = str(f.get("operator", "=")).lower(), f.get("value")
        if field not in RAW_FIELDS:
            raise ValueError(f"records cannot be filtered by {field!r}")
        c = F.col(field)
        if operator == "in" and isinstance(value, list):
            rows = rows.filter(c.isin(value))
        elif operator == "between" and isinstance(value, list) and len(value) >= 2:
            rows = rows.filter(c.between(value[0], value[1]))
        elif operator == "like":
            rows = rows.filter(F.lower(c.cast("string")).contains(str(value).lower()))
        elif operator in compare:
            rows = rows.filter(getattr(c, compare[operator])(F.lit(value)))
        else:
            raise ValueError(f"unknown operator {operator!r}")
    return rows


def raw_records(rows: DataFrame, filters: list[dict], sort_by: str = "survey_date", descending: bool = True, limit: int = 200, offset: int = 0, include_all: bool = False) -> tuple[DataFrame, DataFrame]:
    """(page, one row with ``total`` before paging); with ``include_all`` up to CEILING records."""
    found = raw_filter(rows, filters)
    key = F.col(sort_by if sort_by in RAW_ORDER else "survey_date")
    order = [key.desc() if descending else key.asc(), F.col("survey_id")]
    part = page(found, order, CEILING, 0, CEILING) if include_all else page(found, order, limit, max(0, offset))
    return part, found.agg(F.count(F.lit(1)).alias("total"))


def page(rows: DataFrame, order: list, limit: int = 200, offset: int = 0, largest: int = 2000) -> DataFrame:
    """A page of an ordered listing."""
    return rows.orderBy(*order).offset(offset).limit(max(1, min(largest, limit)))


def search(rows: DataFrame, columns: list[str], keyword: str) -> DataFrame:
    """Rows in which any of the columns contains the keyword."""
    return rows.filter(reduce(lambda a, b: a | b, (F.coalesce(F.col(c).contains(keyword), F.lit(False)) for c in columns)))
