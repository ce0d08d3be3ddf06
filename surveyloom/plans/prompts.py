"""From a text to a query of the DSL: by an object in the text, repaired, or by the words of the text.

All of it is columns, so a table of prompts is read in one pass.  No model is asked; this is
what remains when one gave an answer that has to be repaired, or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.text import json_object

# fixed values: words that ask for a metric, a dimension, or ascending order; the first metric that is asked for counts
METRIC_WORDS = {"csat": ["csat"], "professionalism": ["profesionalismo", "professionalism"], "survey_volume": ["volumen", "cantidad", "volume"]}
DIMENSION_WORDS = {
    "supervisor": ["supervisor", "equipo"],
    "agent": ["agente", "agent"],
    "category": ["categor", "verbatim"],
    "wave": ["ola", "wave"],
    "tenure": ["tenure", "antigüedad"],
    "survey_date": ["fecha", "dia", "temporal", "date"],
}
ASCENDING_WORDS = ["peor", "menor", "bajo", "ascendente"]
# fixed values: other names of dimensions
OTHER_NAMES = {"agent_bms": "agent", "agents": "agent", "supervisors": "supervisor", "team": "supervisor", "team_leader": "supervisor", "categories": "category", "waves": "wave", "date": "survey_date"}
OPERATORS = ["=", "!=", "<>", ">", "<", ">=", "<=", "in", "between", "like"]

QUERY = "struct<metric:string,aggregation:string,group_by:array<string>,filters:array<struct<field:string,operator:string,value:string>>,limit:int,sort_order:string>"
_LOOSE = "metric string, aggregation string, group_by string, filters array<struct<field:string,operator:string,value:string>>, limit string, sort_order string"


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def by_words(text: Column) -> Column:
    """The query that the words of a text ask for; every text gives one."""
    low = F.lower(text)
    metric = F.lit("nps")
    for key, words in reversed(METRIC_WORDS.items()):
        metric = F.when(_any(low, words), key).otherwise(metric)
    named = F.array_compact(F.array(*(F.when(_any(low, words), F.lit(d)) for d, words in DIMENSION_WORDS.items())))
    wave = F.regexp_extract(low, r"wave\s*(\d+|[a-z0-9_-]+)", 1)
    wanted = F.when(wave != "", F.array(F.struct(F.lit("wave").alias("field"), F.lit("=").alias("operator"), F.concat(F.lit("Wave "), wave).alias("value")))).otherwise(F.array().cast("array<struct<field:string,operator:string,value:string>>"))
    top = F.coalesce(F.nullif(F.regexp_extract(low, r"top\s*(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(low, r"l[ií]mite\s*(\d+)", 1), F.lit("")))
    limit = F.when(top.isNull(), 10).otherwise(F.greatest(F.lit(1), F.least(F.lit(100), F.coalesce(top.try_cast("long"), F.lit(100)))))
    return F.struct(
        metric.alias("metric"), F.when(metric == "survey_volume", "count").otherwise("avg").alias("aggregation"), F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("supervisor"))).alias("group_by"),
        wanted.alias("filters"), limit.cast("int").alias("limit"), F.when(_any(low, ASCENDING_WORDS), "asc").otherwise("desc").alias("sort_order"),
    ).cast(QUERY)


def by_object(text: Column) -> Column:
    """The query that a JSON object inside a text states, repaired; null without such an object or without a metric in it.

    An unknown metric becomes nps; other names of dimensions become ours, unknown and repeated
    ones go, and nothing left means supervisor; filters without field or value go, and an
    unknown operator becomes equality.  A single dimension may stand without brackets.
    """
    stated = F.from_json(json_object(text), _LOOSE)
    plain = lambda x: F.lower(F.trim(x))
    other = F.create_map(*(F.lit(x) for pair in OTHER_NAMES.items() for x in pair))
    metric = plain(stated["metric"])
    groups = F.coalesce(F.from_json(stated["group_by"], "array<string>"), F.when(stated["group_by"].isNotNull(), F.array(stated["group_by"])))
    known = F.array_distinct(F.filter(F.transform(groups, lambda g: F.coalesce(F.try_element_at(other, plain(g)), plain(g))), lambda g: g.isin(list(DIMENSION_WORDS))))
    # a null list becomes no grouping; one without known names becomes supervisor
    group_by = F.when(groups.isNull() | (F.size(groups) == 0), F.array().cast("array<string>")).when(F.size(known) > 0, known).otherwise(F.array(F.lit("supervisor")))
    sound = F.filter(stated["filters"], lambda f: f["field"].isNotNull() & f["value"].isNotNull())
    mended = F.transform(sound, lambda f: F.struct(F.when(plain(f["field"]) == "team", "supervisor").otherwise(plain(f["field"])).alias("field"), F.when(f["operator"].isin(OPERATORS), f["operator"]).otherwise("=").alias("operator"), f["value"].alias("value")))
    query = F.struct(
        F.when(metric.isin("nps", *METRIC_WORDS), metric).otherwise("nps").alias("metric"), F.lower(stated["aggregation"]).alias("aggregation"), group_by.alias("group_by"),
        F.coalesce(mended, F.array().cast("array<struct<field:string,operator:string,value:string>>")).alias("filters"), stated["limit"].try_cast("int").alias("limit"), F.lower(stated["sort_order"]).alias("sort_order"),
    )
    return F.when(F.coalesce(metric, F.lit("")) != "", query.cast(QUERY))


def asked(prompts: DataFrame, column: str) -> DataFrame:
    """Adds ``query`` (a struct, or null for blank prompts) and ``origin`` (object or words)."""
    text = F.col(column).cast("string")
    stated = by_object(text)
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    return prompts.withColumns({"query": F.when(~blank, F.coalesce(stated, by_words(text))), "origin": F.when(blank, None).when(stated.isNotNull(), "object").otherwise("words")})


def as_dsl(query: dict) -> dict:
    """A row of ``query`` as the dict that the DSL takes: lists and pairs of values are read from their JSON."""
    import json

    def value(f: dict) -> object:
        if f["operator"] in ("in", "between"):
            try:
                got = json.loads(f["value"])
            except ValueError:
                got = [f["value"]]
            return got if isinstance(got, list) else [got]
        return f["value"]

    out = {k: v for k, v in query.items() if v not in (None, [])}
    if "filters" in out:
        out["filters"] = [{"field": f["field"], "operator": f["operator"], "value": value(f)} for f in out["filters"]]
    return out
