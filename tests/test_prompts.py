"""Texts that become queries."""

import pytest

from surveyloom.plans import prompts
from surveyloom.plans.dsl import validate


def asked(spark, texts):
    rows = prompts.asked(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t").orderBy("i").collect()
    return [(r.origin, r.query.asDict(recursive=True) if r.query else None) for r in rows]


def test_words(spark):
    texts = ["CSAT por agente y ola, wave 3, top 5, los peores: el peor", "volumen por fecha límite 500", "Profesionalismo del equipo", "hola", "", None, "top 99999999999999999999"]
    got = [q for _, q in asked(spark, texts)]
    assert got[0] == {"metric": "csat", "aggregation": "avg", "group_by": ["agent", "wave"], "filters": [{"field": "wave", "operator": "=", "value": "Wave 3"}], "limit": 5, "sort_order": "asc"}
    assert (got[1]["metric"], got[1]["aggregation"], got[1]["group_by"], got[1]["limit"]) == ("survey_volume", "count", ["survey_date"], 100)
    assert (got[2]["metric"], got[2]["group_by"], got[2]["limit"], got[2]["sort_order"]) == ("professionalism", ["supervisor"], 10, "desc")
    assert got[3]["group_by"] == ["wave"] and got[4:6] == [None, None] and got[6]["limit"] == 100
    assert all(validate(prompts.as_dsl(q)) for q in got if q)


def test_objects_are_repaired(spark):
    texts = [
        'Sure: {"metric": "NPS ", "group_by": ["agent_bms", "agents", "supervisors", "nothing"], "filters": [{"field": "TEAM", "operator": "==", "value": "x"}, {"field": "wave"}, {"field": "wave", "operator": "in", "value": ["a", "b"]}], "limit": 7}',
        '{"metric": "joy", "group_by": ["nothing"]}', '{"metric": "csat", "group_by": "date"}', '{"group_by": ["agent"]} csat', "{broken csat}", '{"metric": "csat", "group_by": null, "filters": []}',
    ]
    got = asked(spark, texts)
    assert [o for o, _ in got] == ["object", "object", "object", "words", "words", "object"]
    q = got[0][1]
    assert q["metric"] == "nps" and q["group_by"] == ["agent", "supervisor"] and [(f["field"], f["operator"]) for f in q["filters"]] == [("supervisor", "="), ("wave", "in")]
    assert prompts.as_dsl(q)["filters"][1]["value"] == ["a", "b"] and validate(prompts.as_dsl(q)).limit == 7
    assert (got[1][1]["metric"], got[1][1]["group_by"]) == ("nps", ["supervisor"]) and got[2][1]["group_by"] == ["survey_date"] and got[5][1]["group_by"] == []
    with pytest.raises(ValueError):
        validate({"metric": "nps", "filters": [{"field": "wave", "operator": "in", "value": "a"}]})
