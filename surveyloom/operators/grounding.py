"""Grounded calls: records without people, and a log of what each call ran and returned."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from surveyloom.operators import people, privacy, usage
from surveyloom.sources.stored import written

LOG = "call long, tool string, arguments string, status string, rows long, digest string, duration_ms long, message string"


def grounded_records(surveys: DataFrame, analyses: DataFrame, categories: DataFrame, known: DataFrame, vault: DataFrame, scope: str, arguments: dict, texts: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, one row with ``total``, new rows of the vault): raw records without personal data.

    ``arguments`` may name a category, a supervisor (a pseudonym of the scope, or a text that
    means one), a keyword, filters, sort_by, sort_direction, limit, offset and include_all.
    A record has the category of the survey's first analysis, or 'Uncategorized'; filters by
    category keep surveys with any such analysis.  Of the page's records emails, phones and
    accounts go from the text, then known people (``known``: kind, name, pseudonym);
    identities become pseudonyms, made where the vault has none.  Only the page, 5,000
    records at most, is read for its texts: where they are in another table, ``texts`` adds
    them (``verbatim``) to some surveys, and gets no more than the page unless there is a keyword.
    """
    spark = surveys.sparkSession
    held = vault.filter(F.col("scope") == scope)
    named = analyses.join(categories, "category_id")
    rows = surveys
    filters = privacy.resolved(arguments.get("filters") or [], _meant(held, arguments.get("filters") or []))
    wanted = [f for f in filters if f.get("field") == "category"]
    if arguments.get("category"):
        wanted.append({"field": "category", "operator": "=", "value": arguments["category"]})
    for f in wanted:
        value, operator = f.get("value"), str(f.get("operator", "=")).lower()
        fits = F.col("name").isin(value) if operator == "in" and isinstance(value, list) else F.lower("name").contains(str(value).lower()) if operator == "like" else F.col("name") == F.lit(value)
        rows = rows.join(named.filter(fits).select("survey_id").distinct(), "survey_id", "left_semi")
    if arguments.get("supervisor"):
        rows = rows.filter(F.col("supervisor") == F.lit(supervisor_named(arguments["supervisor"], surveys, held)))
    if arguments.get("keyword"):
        rows, texts = usage.search(texts(rows) if texts else rows, ["verbatim"], arguments["keyword"]), None
    others = [f for f in filters if f.get("field") != "category"]
    page, total = usage.raw_records(rows, others, arguments.get("sort_by", "survey_date"), str(arguments.get("sort_direction", "desc")).lower() != "asc", int(arguments.get("limit", 200)), int(arguments.get("offset", 0)), bool(arguments.get("include_all")))
    page = written(page)
    if texts:
        page = written(texts(page))

    identities = page.select(F.explode(F.array(*(F.struct(F.lit(kind).alias("type"), F.col(column).cast("string").alias("internal_id")) for kind, column in (("record", "survey_id"), ("supervisor", "supervisor"), ("agent", "agent_bms"))))).alias("x")).select("x.*").filter("internal_id is not null")
    made = privacy.new_pseudonyms(identities, vault, scope)
    clean = privacy.scrub(page, "verbatim").drop("verbatim").withColumnRenamed("scrubbed", "verbatim")
    clean = people.without_people(clean, "survey_id", "verbatim", known).drop("verbatim", "agents", "supervisors").withColumnRenamed("replaced", "verbatim")
    first = named.join(page.select("survey_id").distinct(), "survey_id", "left_semi").groupBy("survey_id").agg(F.min(F.struct("category_id", "name")).alias("x")).select("survey_id", F.col("x.name").alias("category"))
    whole = clean.join(first, "survey_id", "left").withColumn("category", F.coalesce("category", F.lit("Uncategorized")))
    out = privacy.minimised(whole, held.unionByName(made), scope, allow_text=True)
    shown = ["record_ref", "survey_date", "nps_score", "csat_score", "professionalism_score", "verbatim", "category", "supervisor_ref", "agent_ref", "wave", "tenure_days"]
    return out.select(*shown), total, made if made.columns else spark.createDataFrame([], vault.schema)


def _meant(held: DataFrame, arguments: object) -> dict[str, str]:
    """The scope's pseudonyms among some arguments and what they stand for."""
    texts: set[str] = set()

    def gather(value: object) -> None:
        if isinstance(value, dict):
            list(map(gather, value.values()))
        elif isinstance(value, list):
            list(map(gather, value))
        elif isinstance(value, str):
            texts.add(value)

    gather(arguments)
    return {r["pseudonym"]: r["internal_id"] for r in held.filter(F.col("pseudonym").isin(sorted(texts))).collect()} if texts else {}


def supervisor_named(text: str, surveys: DataFrame, held: DataFrame) -> str:
    """The supervisor that a pseudonym or a text means; the text itself if none."""
    meant = _meant(held, [text])
    if text in meant:
        return meant[text]
    asked = surveys.sparkSession.createDataFrame([(text,)], "q string")
    found = people.best_matches(asked, "q", surveys.select("supervisor").distinct(), "supervisor").first()
    return found["matched"] if found else text


def result_digest(rows: DataFrame) -> list:
    """Aggregates of a result: its rows, and a number that changes with any value but not with their order.

    Numbers count with six decimals.
    """
    shown = [F.coalesce(F.format_string("%.6f", F.col(f"`{c}`").cast("double")) if kind in ("double", "float") or kind.startswith("decimal") else F.col(f"`{c}`").cast("string"), F.lit("\\N")) for c, kind in sorted(rows.dtypes)]
    part = F.conv(F.substring(F.md5(F.concat_ws("|", *shown)), 1, 12), 16, 10).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest")]


class CallLog:
    """Runs tools and remembers each call: redacted arguments, duration, rows and digest.

    Rows and digest are observed while the result is written, not by a second run.  Each
    result is kept as a table, and ``cite`` gives what an answer needs to refer to it.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.entries = spark, []
        self.results: dict[int, DataFrame] = {}

    def run(self, tool: str, arguments: dict, make: Callable[[dict], DataFrame]) -> DataFrame | None:
        """The tool's result, or None if it failed; the log tells why."""
        begun, call = time.perf_counter(), len(self.entries) + 1
        entry = {"call": call, "tool": tool, "arguments": json.dumps(privacy.redacted(arguments), sort_keys=True, default=str), "status": "completed", "rows": None, "digest": None, "message": None}
        try:
            rows = make(arguments)
            seen = Observation()
            result = written(rows.observe(seen, *result_digest(rows)))
            entry |= {"rows": seen.get["rows"], "digest": seen.get["digest"]}
            self.results[call] = result
        except Exception as error:  # a failed call is an entry too
            entry |= {"status": "error", "message": f"{type(error).__name__}: {str(error).splitlines()[0][:500] if str(error) else ''}"}
        entry["duration_ms"] = int((time.perf_counter() - begun) * 1000)
        self.entries.append(entry)
        return self.results.get(call)

    def table(self) -> DataFrame:
        """The log, one row per call."""
        names = [part.split()[0] for part in LOG.split(", ")]
        return self.spark.createDataFrame([tuple(e[n] for n in names) for e in self.entries], LOG)

    def cite(self, calls: list[int]) -> list[dict]:
        """Citations of calls that completed: number, tool, arguments, rows and digest."""
        return [{k: e[k] for k in ("call", "tool", "arguments", "rows", "digest")} for e in self.entries if e["call"] in calls and e["status"] == "completed"]
