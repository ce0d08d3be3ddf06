"""Ingest: column mapping, row validation, versioned upsert and summaries."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions.scores import excel_date, percentage_to_share, round4
from surveyloom.sources.stored import Store

REQUIRED = ("survey_id", "nps_score", "csat_score", "professionalism_score", "agent_bms", "supervisor", "survey_date")
SCORES = ("nps_score", "csat_score", "professionalism_score")
OPTIONAL = ("verbatim", "agent_name", "wave", "tenure_days")
FIELDS = (*REQUIRED, *OPTIONAL)

# fixed values: header names by field, in the order in which they are tried
ALIASES = {
    "survey_id": ["survey_id", "survey id", "surveyid", "survey identifier", "survey_identifier", "id", "record_id", "response_id", "response id", "encuesta_id", "id_encuesta"],
    "nps_score": ["nps_score", "nps score", "nps", "net promoter score", "net_promoter_score", "nps %", "nps_val", "score_nps"],
    "csat_score": ["csat_score", "csat score", "csat", "csat %", "customer satisfaction", "satisfaction", "satisfaction_score", "satisfaccion"],
    "professionalism_score": ["professionalism_score", "professionalism score", "professionalism", "prof", "prof score", "prof_score", "professionalism %", "profesionalismo"],
    "verbatim": ["verbatim", "comment", "customer comment", "customer comments", "comments", "feedback", "text", "open_text", "comentarios", "comentario", "opinion"],
    "agent_bms": ["agent_bms", "agent bms", "bms", "agent id", "agent_id", "employee id", "employee_id", "rep id", "rep_id", "bms_id", "id_agente", "id agente"],
    "agent_name": ["agent_name", "agent name", "nombre del agente", "nombre agente", "nombre_agente", "advisor name", "advisor", "rep name", "representative", "agent", "ejecutivo", "nombre"],
    "supervisor": ["supervisor", "supervisor name", "team leader", "team_leader", "sup", "leader", "tl", "sup_name", "supervisor_name", "lider"],
    "survey_date": ["survey_date", "survey date", "date", "response_date", "response date", "fecha", "fecha_encuesta", "created_date", "timestamp"],
    "wave": ["wave", "wave name", "wave_name", "cohort", "batch", "oleada", "grupo"],
    "tenure_days": ["tenure_days", "tenure days", "tenure", "days in production", "days_in_production", "antiguedad", "dias_produccion", "dias"],
}


def plain_header(x: str) -> str:
    return re.sub(r"[_\-.\s%]+", " ", str(x or "").lower()).strip()


def suggest_mapping(headers: list[str]) -> dict[str, str]:
    """Field to header: equal names first, then names that contain one another; each header once."""
    plain, used, out = [plain_header(h) for h in headers], set(), {}
    tests = (lambda h, a: h == a, lambda h, a: a in h or h in a)
    for test in tests:
        for name, aliases in ALIASES.items():
            if name in out:
                continue
            hit = next((i for i, h in enumerate(plain) if h and i not in used and any(test(h, plain_header(a)) for a in aliases)), None)
            if hit is not None:
                out[name] = headers[hit]
                used.add(hit)
    return out


def number(text: Column) -> Column:
    """A number, also with a percent sign, a dollar sign or commas; else null."""
    text = F.trim(text)
    return F.coalesce(text.try_cast("double"), F.regexp_replace(text, "[%$,]", "").try_cast("double"))


def day(text: Column) -> Column:
    """A date: ISO, a spreadsheet serial, or one of the written forms (month first); else null."""
    text = F.trim(text)
    serial = text.try_cast("double")
    written = [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy", "d-M-yyyy", "yyyy/MM/dd")]
    return F.when((serial > 25000) & (serial < 65000), excel_date(serial)).otherwise(F.coalesce(*written))


def validated(raw: DataFrame, percentages: tuple[str, ...] = ()) -> DataFrame:
    """Normalised fields, ``errors``, ``warnings`` and ``valid``; completely blank rows are left out.

    ``raw`` has the fields as text (missing ones count as blank) and is not cut short: every
    row is judged.  Scores must lie in [-1, 1] and keep four decimals; a score in
    ``percentages`` beyond 1 is divided by 100 first, with a warning.
    """
    for f in FIELDS:
        if f not in raw.columns:
            raw = raw.withColumn(f, F.lit(None).cast("string"))
    text = {f: F.nullif(F.trim(F.col(f).cast("string")), F.lit("")) for f in FIELDS}
    rows = raw.filter(reduce(lambda a, b: a | b, (text[f].isNotNull() for f in FIELDS)))
    out, errors, warnings = {}, [], []
    for f in ("survey_id", "agent_bms", "supervisor"):
        out[f] = text[f]
        errors.append(F.when(text[f].isNull(), F.lit(f"{f} is required")))
    for f in SCORES:
        v = number(text[f])
        if f in percentages:
            warnings.append(F.when(F.abs(v) > 1, F.lit(f"{f} converted from percentage")))
            v = percentage_to_share(v)
        out[f] = round4(v)
        errors.append(F.when(text[f].isNull(), F.lit(f"{f} is required")).when(v.isNull(), F.lit(f"{f} is not a number")).when((v < -1) | (v > 1), F.lit(f"{f} is out of range")))
    out["survey_date"] = day(text["survey_date"])
    errors.append(F.when(text["survey_date"].isNull(), F.lit("survey_date is required")).when(out["survey_date"].isNull(), F.lit("survey_date is not a date")))
    for f in ("verbatim", "agent_name", "wave"):
        out[f] = text[f]
    tenure = number(text["tenure_days"])
    out["tenure_days"] = F.when(tenure >= 0, F.floor(tenure).cast("int"))
    keep = [c for c in raw.columns if c not in FIELDS]
    return rows.select(*keep, *(c.alias(f) for f, c in out.items()), F.array_compact(F.array(*errors)).alias("errors"), F.array_compact(F.array(*warnings, F.lit(None).cast("string"))).alias("warnings")).withColumn("valid", F.size("errors") == 0)


def record_hash(*columns: str) -> Column:
    """Digest of a record's fields in a fixed order; null and blank differ."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def classify(incoming: DataFrame, stored: DataFrame, key: str, order: str, digest: str) -> DataFrame:
    """Insert, duplicate or update for every incoming row, in the order of ``order``.

    A row compares with the row before it of the same key, and the first with what is stored.
    """
    before = F.lag(digest).over(Window.partitionBy(key).orderBy(order))
    rows = incoming.join(stored.select(F.col(key).alias("__key"), F.col(digest).alias("__stored")), F.col(key) == F.col("__key"), "left")
    rows = rows.withColumn("previous_hash", F.coalesce(before, F.col("__stored"))).drop("__key", "__stored")
    action = F.when(F.col("previous_hash").isNull(), "insert").when(F.col("previous_hash") == F.col(digest), "duplicate").otherwise("update")
    return rows.withColumn("action", action)


def upsert(classified: DataFrame, stored: DataFrame, key: str, order: str) -> DataFrame:
    """Stored rows without an incoming one, and the last incoming row of each key."""
    columns = stored.columns
    last = classified.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("x")).select("x.*")
    return stored.join(classified.select(key).distinct(), key, "left_anti").select(*columns).union(last.select(*columns))


def import_summary(validated_rows: DataFrame, classified: DataFrame) -> DataFrame:
    """Counts by outcome; failed when rows were rejected and none accepted."""
    rejected = validated_rows.agg(F.count_if(~F.col("valid")).alias("rejected"), F.count(F.lit(1)).alias("total"))
    done = classified.agg(*(F.count_if(F.col("action") == a).alias(n) for a, n in (("insert", "inserted"), ("duplicate", "duplicates"), ("update", "updated"))))
    out = rejected.crossJoin(F.broadcast(done))
    accepted = F.col("inserted") + F.col("duplicates") + F.col("updated")
    return out.withColumn("status", F.when((F.col("rejected") > 0) & (accepted == 0), "failed").otherwise("completed"))


def preflight(raw: DataFrame, order: str, percentages: tuple[str, ...] = (), rows: int = 100) -> DataFrame:
    """One row about the first ``rows`` rows: ready, with warnings, errors, whether to import, and up to ten rejected rows.

    Judging a file's first rows is the feature here; ``validated`` judges all of them.
    """
    seen = validated(raw.orderBy(order).limit(rows), percentages)
    bad = F.array_sort(F.collect_list(F.when(~F.col("valid"), F.struct(F.col(order).alias("row"), F.col("errors")))))
    out = seen.agg(F.count_if("valid").alias("ready_count"), F.count_if(F.size("warnings") > 0).alias("warning_count"), F.count_if(~F.col("valid")).alias("error_count"), F.slice(bad, 1, 10).alias("sample_errors"))
    return out.withColumn("can_import", (F.col("error_count") == 0) & (F.col("ready_count") > 0))


def first_errors(validated_rows: DataFrame, order: str, n: int = 100) -> DataFrame:
    """The first ``n`` rejected rows with their errors, as an import keeps them."""
    return validated_rows.filter(~F.col("valid")).orderBy(order).limit(n).select(order, "errors")


def changed_fields(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, changed): names of the fields that differ between two states, null-safe."""
    o = old.select(key, *(F.col(f).alias(f"__old_{f}") for f in fields))
    differs = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"__old_{f}")), F.lit(f)) for f in fields)))
    return new.join(o, key).select(key, F.concat_ws(",", differs).alias("changed")).filter("changed <> ''")


def without_import(table: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """A table after the rows of some imports are gone."""
    return table.join(removed.select(key).distinct(), key, "left_anti")


#: Tables that hold what imports brought, children first.
IMPORTED = ("analyses", "versions", "surveys", "imports")


def delete_import(store: Store, import_id: int) -> int:
    """An import goes with its surveys, their versions and analyses, as one version of the store; returns the number of surveys gone.

    Analyses go by the surveys' ids.  Where the change breaks off, or another one comes
    first, the old version stays whole.
    """
    tables = {name: store.read(name) for name in IMPORTED}
    mine = F.col("import_id") == F.lit(import_id)
    gone = tables["surveys"].filter(mine).select("survey_id")
    n = gone.count()
    stays = ~F.coalesce(mine, F.lit(False))
    after = {"analyses": without_import(tables["analyses"], gone, "survey_id"), **{k: tables[k].filter(stays) for k in ("versions", "surveys")}, "imports": tables["imports"].filter(~F.coalesce(F.col("id") == F.lit(import_id), F.lit(False)))}
    store.replace(after, {"event": "IMPORT_DELETED", "import_id": import_id, "deleted_surveys": n})
    return n


def clear_all(store: Store) -> tuple[int, int]:
    """All imported tables become empty together; returns the numbers of surveys and imports gone."""
    n = store.read("surveys").count(), store.read("imports").count()
    store.replace({name: store.read(name).limit(0) for name in IMPORTED}, {"event": "DATASET_CLEARED", "deleted_surveys": n[0], "deleted_imports": n[1]})
    return n


def save_template(store: Store, name: str, mapping: dict[str, str], percentages: tuple[str, ...] = (), description: str | None = None) -> int:
    """Keep a mapping (field to header) under a name; each save is a new version of it, which is returned."""
    if not name or len(name) > 100:
        raise ValueError("a template needs a name of at most 100 letters")
    unknown = sorted((set(mapping) | set(percentages)) - set(FIELDS))
    if unknown or not mapping:
        raise ValueError(f"no such fields: {unknown}" if unknown else "a template needs fields")
    known = templates(store)
    version = (known.filter(F.col("name") == name).agg(F.max("version")).first()[0] or 0) + 1
    row = known.sparkSession.createDataFrame([(name, version, description, json.dumps(mapping), list(percentages))], _TEMPLATE)
    store.replace({"templates": known.union(row)}, {"event": "TEMPLATE_SAVED", "name": name, "version": version})
    return version


_TEMPLATE = "name string, version int, description string, mapping string, percentages array<string>"


def templates(store: Store) -> DataFrame:
    """All versions of all templates."""
    if "templates" not in store.manifest()["tables"]:
        return store.spark.createDataFrame([], _TEMPLATE)
    return store.read("templates")


def with_template(raw: DataFrame, store: Store, name: str, version: int | None = None) -> DataFrame:
    """``validated`` over a file's columns as a template maps them; the newest version unless said otherwise.

    The template becomes a projection when the plan is made.  Headers meet in any letters and
    with single spaces; other columns are kept beside the fields.
    """
    known = templates(store).filter(F.col("name") == name)
    row = (known.filter(F.col("version") == version) if version else known.orderBy(F.col("version").desc())).first()
    if row is None:
        raise KeyError(name)
    by_header = {plain_header(c): c for c in reversed(raw.columns)}
    found = {f: by_header.get(plain_header(h)) for f, h in json.loads(row["mapping"]).items()}
    missing = sorted(f for f, c in found.items() if c is None and f in REQUIRED)
    if missing:
        raise ValueError(f"no column for {missing}")
    used = {c for c in found.values() if c}
    kept = [F.col(f"`{c}`") for c in raw.columns if c not in used and c not in FIELDS]
    return validated(raw.select(*kept, *(F.col(f"`{c}`").cast("string").alias(f) for f, c in found.items() if c)), tuple(row["percentages"]))
