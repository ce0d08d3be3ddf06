"""Queries over tables of prompts, and listings with filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.catalog._base import query
from surveyloom.plans import prompts
from surveyloom.sources.surveys import table


def _has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


_METRIC = "CASE " + " ".join(f"WHEN {_has(w)} THEN '{k}'" for k, w in prompts.METRIC_WORDS.items()) + " ELSE 'nps' END"
_GROUPS = "concat_ws(',', " + ", ".join(f"CASE WHEN {_has(w)} THEN '{d}' END" for d, w in prompts.DIMENSION_WORDS.items()) + ")"
_WORDS = f"""l AS (SELECT *, lower(text) AS low FROM p),
q AS (
  SELECT *, {_METRIC} AS metric, coalesce(nullif({_GROUPS}, ''), 'supervisor') AS group_by, regexp_extract(low, 'wave\\s*(\\d+|[a-z0-9_-]+)', 1) AS wave,
    coalesce(nullif(regexp_extract(low, 'top\\s*(\\d+)', 1), ''), nullif(regexp_extract(low, 'l[ií]mite\\s*(\\d+)', 1), '')) AS top, CASE WHEN {_has(prompts.ASCENDING_WORDS)} THEN 'asc' ELSE 'desc' END AS sort_order FROM l
)"""


def _shown(rows, *keys):
    q = F.col("query")
    wanted = F.array_join(F.transform(q["filters"], lambda f: F.concat_ws(" ", f["field"], f["operator"], f["value"])), ";")
    return rows.select(*keys, "origin", q["metric"].alias("metric"), q["aggregation"].alias("aggregation"), F.array_join(q["group_by"], ",").alias("group_by"), wanted.alias("filters"), q["limit"].alias("limit_"), q["sort_order"].alias("sort_order"))


@query("prompt_words", rf"""WITH p AS (SELECT conv_id, turn, text FROM conversations WHERE trim(coalesce(text, '')) <> '' AND NOT (contains(text, '{{') AND contains(text, '}}'))), {_WORDS}
SELECT conv_id, turn, 'words' AS origin, metric, CASE WHEN metric = 'survey_volume' THEN 'count' ELSE 'avg' END AS aggregation, group_by, CASE WHEN wave <> '' THEN 'wave = Wave ' || wave ELSE '' END AS filters,
  CAST(CASE WHEN top IS NULL THEN 10 ELSE greatest(1, least(100, coalesce(TRY_CAST(top AS BIGINT), 100))) END AS INTEGER) AS limit_, sort_order FROM q""", surveys=False)
def prompt_words(spark, sf):
    """What each turn of each conversation asks for by its words."""
    turns = table(spark, sf, "conversations").filter("trim(coalesce(text, '')) <> ''").filter(~(F.col("text").contains("{") & F.col("text").contains("}")))
    return _shown(prompts.asked(turns, "text"), "conv_id", "turn")


@query("prompt_objects", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN 'words' ELSE 'object' END AS origin, CASE o_orderkey % 5 WHEN 0 THEN 'csat' WHEN 3 THEN 'survey_volume' ELSE 'nps' END AS metric,
  CASE o_orderkey % 5 WHEN 0 THEN 'avg' WHEN 3 THEN 'count' WHEN 4 THEN 'avg' END AS aggregation, CASE o_orderkey % 5 WHEN 0 THEN 'agent,supervisor' WHEN 1 THEN 'supervisor' WHEN 2 THEN '' WHEN 3 THEN 'wave' ELSE 'category' END AS group_by,
  CASE o_orderkey % 5 WHEN 0 THEN 'supervisor = ' || o_custkey WHEN 3 THEN 'wave in ["' || o_orderstatus || '"]' ELSE '' END AS filters, CAST(CASE o_orderkey % 5 WHEN 0 THEN 1 + o_custkey % 50 WHEN 4 THEN 1 + o_custkey % 50 END AS INTEGER) AS limit_,
  CASE o_orderkey % 5 WHEN 0 THEN 'asc' WHEN 4 THEN 'desc' END AS sort_order FROM orders""", surveys=False)
def prompt_objects(spark, sf):
    """Objects inside answers, with other names, unknown names and missing parts, repaired; one in five has words only."""
    k, limit = F.col("o_orderkey"), 1 + F.col("o_custkey") % 50
    text = F.when(k % 5 == 0, F.concat(F.lit('Here you are: {"metric": " CSAT ", "aggregation": "AVG", "group_by": ["agents", "team", "Agent", "planet"], "filters": [{"field": "Team", "operator": "~", "value": '), F.col("o_custkey"), F.lit('}, {"field": "wave"}], "limit": "'), limit, F.lit('", "sort_order": "ASC"} done')))
    text = text.when(k % 5 == 1, '{"metric": "happiness", "group_by": ["planet"]}').when(k % 5 == 2, '{"metric": "nps"}')
    text = text.when(k % 5 == 3, F.concat(F.lit('{"metric": "survey_volume", "aggregation": "count", "group_by": "waves", "filters": [{"field": "wave", "operator": "in", "value": ["'), F.col("o_orderstatus"), F.lit('"]}]}')))
    text = text.otherwise(F.concat(F.lit("nps por categoria, top "), limit))
    return _shown(prompts.asked(table(spark, sf, "orders").select("o_orderkey", text.alias("text")), "text"), "o_orderkey")
