"""Team report data: agent reviews, status, narrative facts and review merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions.scores import round4, sentiment
from surveyloom.operators import kpi


def agent_reviews(surveys: DataFrame, goals: dict[str, tuple[float, float]] = kpi.GOALS) -> DataFrame:
    """KPIs, true sentiment split, top categories and status of each agent under a supervisor.

    Fewer than five surveys are a low sample; else one score below its warning threshold is
    critical, and one below its target a warning.  ``place`` orders a supervisor's agents by
    volume, the largest first.
    """
    by = ["supervisor", "agent_bms"]
    s = surveys.withColumn("__s", sentiment(F.col("nps_score")))
    base = s.groupBy(*by).agg(*kpi.kpi_columns(), F.count_if(F.col("__s") == "promoter").alias("promoters"), F.count_if(F.col("__s") == "detractor").alias("detractors")).drop("has_sample")
    below = lambda at: reduce(lambda a, b: a | b, (F.coalesce(F.col(k) < g[at], F.lit(False)) for k, g in goals.items()))
    status = F.when(F.col("survey_volume") < 5, "low_sample").when(below(1), "critical").when(below(0), "warning").otherwise("on_target")
    return base.join(kpi.top_categories(surveys, "agent_bms"), "agent_bms", "left").withColumn("status", status).select(*by, "survey_volume", "nps", "csat", "professionalism", "promoters", "detractors", F.coalesce("top_categories", F.lit("")).alias("top_categories"), "status", F.row_number().over(Window.partitionBy("supervisor").orderBy(F.col("survey_volume").desc(), "agent_bms")).alias("place"))


def team_summary(surveys: DataFrame) -> DataFrame:
    """KPIs by supervisor with the number of agents, and each one's best and worst agent."""
    agents = surveys.groupBy("supervisor", "agent_bms").agg(*kpi.kpi_columns())
    edge = agents.filter("survey_volume >= 5").groupBy("supervisor").agg(F.max_by("agent_bms", F.struct("nps", "agent_bms")).alias("best_agent"), F.min_by("agent_bms", F.struct("nps", "agent_bms")).alias("worst_agent"))
    count = agents.groupBy("supervisor").agg(F.count(F.lit(1)).alias("agents"))
    return kpi.kpis(surveys, "supervisor").drop("has_sample").join(count, "supervisor").join(edge, "supervisor", "left")


def team_report(surveys: DataFrame, start: str, end: str, goals: dict[str, tuple[float, float]] = kpi.GOALS, least: int = 15) -> DataFrame:
    """One row per supervisor with a survey in the period: its KPIs, the change against the period before, goals met, and what the rules say.

    Strengths are the goals met and a growing volume, risks a small sample and the goals of
    recommendation and satisfaction missed; actions follow from critical agents, from
    those goals, and from the most frequent category.  Lists hold names in the rules' order.
    """
    periods = kpi.previous_period(surveys, start, end, "supervisor")
    now, before = (periods.filter(F.col("period") == p).drop("period") for p in ("current", "previous"))
    b = before.select("supervisor", F.col("survey_volume").alias("__volume"), *(F.col(k).alias(f"__{k}") for k in kpi.KPIS))
    inside = surveys.filter(F.col("survey_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    critical = agent_reviews(inside, goals).groupBy("supervisor").agg(F.count_if(F.col("status") == "critical").alias("critical_agents"))
    top = kpi.top_categories(inside, "supervisor", 1).withColumnRenamed("top_categories", "top_category")
    met = {k: F.coalesce(F.col(k) >= g[0], F.lit(False)) for k, g in goals.items()}
    missed = lambda k: ~met[k] & F.col(k).isNotNull()
    names = lambda default, *found: F.coalesce(F.nullif(F.concat_ws(",", *(F.when(c, F.lit(n)) for n, c in found)), F.lit("")), F.lit(default))
    rows = now.join(b, "supervisor", "left").join(critical, "supervisor", "left").join(top, "supervisor", "left")
    rows = rows.withColumns({"volume_delta": F.col("survey_volume") - F.col("__volume"), **{f"{k}_delta": round4(F.col(k) - F.col(f"__{k}")) for k in kpi.KPIS}, "low_sample": F.col("survey_volume") < least, "goals_met": sum(m.cast("int") for m in met.values())})
    return rows.select(
        "supervisor", "survey_volume", *kpi.KPIS, "volume_delta", *(f"{k}_delta" for k in kpi.KPIS), "low_sample", "goals_met",
        F.when(F.col("goals_met") == len(goals), "all").when(F.col("goals_met") > 0, "some").otherwise("none").alias("summary"),
        names("daily_service", ("professionalism", met["professionalism"]), ("csat", met["csat"]), ("nps", met["nps"]), ("volume", F.coalesce(F.col("volume_delta") > 0, F.lit(False)))).alias("strengths"),
        names("consistency", ("sample", F.col("low_sample")), ("nps", missed("nps")), ("csat", missed("csat"))).alias("risks"),
        F.concat_ws(",", F.when(F.col("critical_agents") > 0, F.lit("coaching")), F.when(~met["csat"] | ~met["nps"], F.lit("calls")), F.concat(F.lit("category:"), "top_category"), F.lit("monitor")).alias("actions"),
    )


def _series(inside: DataFrame, *by: str) -> DataFrame:
    """``days``: KPIs of each day with surveys, in order, as one array for each group."""
    days = kpi.daily(inside, *by).select(*by, F.struct(F.col("survey_date").alias("date"), "survey_volume", *kpi.KPIS).alias("__d"))
    return days.groupBy(*by).agg(F.array_sort(F.collect_list("__d")).alias("days"))


def agent_assessments(reviews: DataFrame, goals: dict[str, tuple[float, float]] = kpi.GOALS) -> DataFrame:
    """Adds what the rules say about each agent, as codes: assessment, action, strengths and friction.

    ``reviews`` has status, csat, professionalism, and the numbers of comments, of those by
    promoters and by detractors.  Assessment and action follow the status.  Strengths are
    praise (a comment by a promoter), and with it a professionalism at its goal; friction is
    a comment by a detractor, and with it satisfaction below its goal.  Agents without
    comments are judged by status alone.  Lists are never empty.
    """
    status, some = F.col("status"), F.col("comments") > 0
    by_status = lambda critical, warning, low, else_: F.when(status == "critical", critical).when(status == "warning", warning).when(status == "low_sample", low).otherwise(else_)
    listed = lambda default, *found: F.coalesce(F.nullif(F.concat_ws(",", *(F.when(c, F.lit(n)) for n, c in found)), F.lit("")), F.lit(default))
    praise, blame = some & (F.col("promoter_comments") > 0), some & (F.col("detractor_comments") > 0)
    return reviews.withColumns(
        {
            "assessment": by_status("critical", "below_target", "small_sample", "aligned"),
            "action": by_status("urgent_session", "reinforce", "monitor_more", "recognise"),
            "comment_tone": F.when(~some, "none").when(praise & ~blame, "only_praise").when(praise, "mixed").when(blame, "only_blame").otherwise("neutral"),
            "strengths": listed("presence", ("praise", praise), ("professional", praise & (F.col("professionalism") >= goals["professionalism"][0])), ("solid_figures", ~some & (status == "on_target"))),
            "friction": listed("keep_consistent", ("response_times", blame), ("hard_cases", blame & (F.col("csat") < goals["csat"][0])), ("no_comments", ~some & (status != "on_target"))),
        }
    )


def team_dataset(surveys: DataFrame, cases: DataFrame, start: str, end: str, goals: dict[str, tuple[float, float]] = kpi.GOALS, verbatims: bool = False) -> DataFrame:
    """One row per team with a survey in the period: everything its report shows.

    The figures and rules of ``team_report``, open cases among the risks, and arrays of
    structs: days (KPIs by date), categories (count and percentage), agents (KPIs, status,
    sentiment, their own days and categories, and what the rules say), attention (critical
    agents) and open_cases.  ``data_version`` is a digest of the period and of all record
    hashes in order.  ``surveys`` needs record_hash and verbatim beside the usual columns;
    ``cases`` has agent_bms, case_number, type, priority, status and opened_at, and no notes
    of a case are taken over.  With ``verbatims`` each agent has its comments too.  Each
    grain is aggregated once and joined once; no array is longer than a team's period.
    """
    inside = surveys.filter(F.col("survey_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    feeling = sentiment(F.col("nps_score"))
    spoken = F.coalesce(F.trim("verbatim") != "", F.lit(False))
    comments = inside.groupBy("supervisor", "agent_bms").agg(
        F.count_if(spoken).alias("comments"), F.count_if(spoken & (feeling == "promoter")).alias("promoter_comments"), F.count_if(spoken & (feeling == "detractor")).alias("detractor_comments"), F.min("agent_name").alias("agent_name"),
        *([F.array_sort(F.collect_list(F.when(spoken, F.struct("survey_id", F.col("survey_date").alias("date"), F.trim("verbatim").alias("verbatim"), feeling.alias("sentiment"), "category_name")))).alias("verbatims")] if verbatims else []),
    )
    agents = agent_assessments(agent_reviews(inside, goals).join(comments, ["supervisor", "agent_bms"]), goals).join(_series(inside, "supervisor", "agent_bms"), ["supervisor", "agent_bms"])
    shown = ["agent_bms", "agent_name", "survey_volume", *kpi.KPIS, "promoters", (F.col("survey_volume") - F.col("promoters") - F.col("detractors")).alias("passives"), "detractors", "status", "top_categories", "comments", "assessment", "action", "comment_tone", "strengths", "friction", "days", *(["verbatims"] if verbatims else [])]
    agents = agents.select("supervisor", "status", "agent_bms", F.struct("place", *shown).alias("agent"))
    attention = F.array_sort(F.array_compact(F.collect_list(F.when(F.col("status") == "critical", F.col("agent_bms")))))
    agents = agents.groupBy("supervisor").agg(F.array_sort(F.collect_list("agent")).alias("agents"), attention.alias("attention"))

    shares = kpi.category_share(inside, "supervisor").select("supervisor", F.struct((-F.col("n")).alias("order"), F.col("category_name").alias("category"), F.col("n").alias("count"), "percentage").alias("c"))
    shares = shares.groupBy("supervisor").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.dropFields("order")).alias("categories"))
    members = inside.select("supervisor", "agent_bms").distinct()
    opened = cases.filter("status <> 'closed'").join(members, "agent_bms").groupBy("supervisor").agg(F.array_sort(F.collect_list(F.struct("case_number", "agent_bms", "type", "priority", "status", "opened_at"))).alias("open_cases"))
    version = inside.groupBy("supervisor").agg(F.concat_ws(":", F.array_sort(F.collect_list("record_hash"))).alias("__hashes"))
    version = version.select("supervisor", F.sha2(F.concat_ws(":", "supervisor", F.lit(start), F.lit(end), "__hashes"), 256).alias("data_version"))

    rows = team_report(surveys, start, end, goals)
    for part in (_series(inside, "supervisor"), shares, agents, opened, version):
        rows = rows.join(part, "supervisor", "left")
    risks = F.when(F.size("open_cases") > 0, F.concat_ws(",", F.nullif("risks", F.lit("consistency")), F.lit("open_cases"))).otherwise(F.col("risks"))
    return rows.withColumns({"risks": risks, "n_open_cases": F.greatest(F.size("open_cases"), F.lit(0))})


def share_of_top(surveys: DataFrame, by: str, k: int = 10) -> DataFrame:
    """The k largest groups by volume, newest rules first: rank, volume and share of all."""
    counts = surveys.groupBy(by).agg(F.count(F.lit(1)).alias("volume")).orderBy(F.col("volume").desc(), by).limit(k)
    total = surveys.agg(F.count(F.lit(1)).alias("total"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.orderBy(F.col("volume").desc(), by)))
    return ranked.crossJoin(F.broadcast(total)).select(by, "rank", "volume", round4(F.col("volume") / F.col("total")).alias("share"))


def merged_reviews(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Each review with the comment that means its agent, if any, and the way it was found.

    In this order: the same name in any letters (1), the same id (2), the same words of the
    name in any order (3), one plain name inside the other (4).  ``extra`` has name (a name or
    an id) and comment; of several the smallest comment counts.

    Containment goes through ``contained``.  Names are made from short columns and parts of
    them, so their size is not what the planner takes it for: joins are sort-merge joins, and
    no table of names is sent to the driver.
    """
    from surveyloom.functions.text import normalised, token_set

    b = base.select("agent_bms", "agent_name", F.lower(F.trim("agent_name")).alias("low"), normalised(F.col("agent_name")).alias("clean"), token_set(F.col("agent_name")).alias("tokens"))
    e = extra.select("name", "comment", F.lower(F.trim("name")).alias("low"), normalised(F.col("name")).alias("clean"), token_set(F.col("name")).alias("tokens")).hint("merge")
    found = [
        b.join(e, "low").select("agent_bms", F.lit(1).alias("way"), "comment"),
        b.join(e, F.trim("agent_bms") == F.trim("name")).select("agent_bms", F.lit(2).alias("way"), "comment"),
        b.filter("tokens <> ''").join(e, "tokens").select("agent_bms", F.lit(3).alias("way"), "comment"),
    ]
    mine, theirs = b.select("agent_bms", F.col("clean").alias("mine")).hint("merge"), e.select("comment", F.col("clean").alias("theirs")).hint("merge")
    for part, whole in (("mine", "theirs"), ("theirs", "mine")):
        pairs = contained(b.select("clean") if part == "mine" else e.select("clean"), e.select("clean") if part == "mine" else b.select("clean")).toDF(part, whole)
        found.append(pairs.join(mine, "mine").join(theirs, "theirs").select("agent_bms", F.lit(4).alias("way"), "comment"))
    best = reduce(DataFrame.union, found).groupBy("agent_bms").agg(F.min(F.struct("way", "comment")).alias("x"))
    return base.join(best.select("agent_bms", "x.comment", "x.way").hint("merge"), "agent_bms", "left")


#: Lengths of the pieces by which ``contained`` looks texts up.
WIDTHS = (1, 2, 3, 6, 12, 24)


def contained(parts: DataFrame, wholes: DataFrame | None = None) -> DataFrame:
    """(part, whole) of different texts, one inside the other; both from the first one-column table if there is no second.

    A part is looked up by one of its pieces, all of the greatest of ``WIDTHS`` letters that it
    has: the one that the fewest wholes hold.  Long pieces tell names apart however many there
    are.  Pieces are hashes, wholes are fetched for what is found, and every pair is looked at.
    """
    p = parts.toDF("part").filter("part <> ''").distinct()
    w = (parts if wholes is None else wholes).toDF("whole").filter("whole <> ''").distinct()
    pieces = lambda t, n: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.xxhash64(F.substring(t, i, n)))).otherwise(F.array().cast("array<long>"))
    width = F.element_at(F.filter(F.array(*map(F.lit, WIDTHS)), lambda n: n <= F.length("part")), -1)
    p = p.withColumn("width", width)
    used = p.agg(F.collect_set("width").alias("widths"))
    index = w.crossJoin(F.broadcast(used)).select(F.xxhash64("whole").alias("id"), F.explode(F.array_distinct(F.flatten(F.transform("widths", lambda n: pieces(F.col("whole"), n))))).alias("piece"))
    counts = index.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    own = p.select("part", F.explode(F.array_distinct(pieces(F.col("part"), F.col("width")))).alias("piece"))
    # a piece that no whole holds comes first, and then no whole holds the part
    rarest = own.join(counts.hint("merge"), "piece", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("x")).filter("x.n > 0").select("part", "x.piece")
    may = rarest.join(index.hint("merge"), "piece").select("part", "id")
    return may.join(w.select(F.xxhash64("whole").alias("id"), "whole").hint("merge"), "id").filter(F.col("whole").contains(F.col("part")) & (F.col("whole") != F.col("part"))).select("part", "whole")
