"""Lists, searches, statistics and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import events as E
from ..functions.base import fmt_ts, text
from ..operators.classify import classify_events
from ..operators.scoring import not_exempt_people
from ..schema import WRITE_ACTIONS, Rules
from ..vocab import DEFAULT, Vocabulary


# ----------------------------------------------------------------- lists and searches

def alert_list(alerts: DataFrame, as_of: str, severity: str | None = None, status: str | None = None,
               when: str | None = None, most: int | None = 200) -> DataFrame:
    """Alerts by score, newest first; `when` is today, yesterday or week, `status` NEW or handled."""
    out = alerts
    if severity:
        out = out.filter(F.col("severity") == severity)
    if status == "NEW":
        out = out.filter("status = 'NEW'")
    elif status == "handled":
        out = out.filter("status <> 'NEW'")
    today = E.day_start(as_of)
    start = F.col("window_start")
    if when == "today":
        out = out.filter(start >= today)
    elif when == "yesterday":
        out = out.filter((start >= E.day_start(as_of, 1)) & (start < today))
    elif when == "week":
        out = out.filter(start >= E.day_start(as_of, 7))
    order = [F.desc("risk_score"), F.desc("created_at"), F.col("dedup_key")]
    return out.orderBy(*order) if most is None else out.orderBy(*order).limit(most)


def verdict_list(verdicts: DataFrame, employee: str | None = None, most: int = 100) -> DataFrame:
    out = verdicts if employee is None else verdicts.filter(F.col("employee_id") == employee)
    return out.orderBy(F.desc("window_start"), "verdict_id").limit(most)


def evidence(verdicts: DataFrame, windowed: DataFrame, most: int = 50) -> DataFrame:
    """Events of each verdict in time order, at most `most` per verdict.

    `windowed` are events with `window_start`; the window is the link, so no
    list of hashes is kept in a verdict row.
    """
    rows = windowed.join(verdicts.select("verdict_id", "employee_id", "window_start"), ["employee_id", "window_start"])
    order = Window.partitionBy("verdict_id").orderBy("occurred_at", "event_hash")
    return (rows.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= most)
            .select("verdict_id", "pos", "employee_id", "occurred_at", "category", "action", "target_value",
                    "size_bytes", "source", "channel", "event_hash"))


def raw_log_search(raw: DataFrame, start: str | None = None, end: str | None = None, log_type: str | None = None,
                   user: str | None = None, word: str | None = None, most: int = 500,
                   page_cap: int | None = 5000) -> tuple[DataFrame, DataFrame]:
    """(total, page) of raw messages, newest first; a page holds at most `page_cap` rows (None: no cap)."""
    out = raw
    if start:
        out = out.filter(F.col("received_at") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        out = out.filter(F.col("received_at") <= F.lit(end).cast("timestamp_ntz"))
    if log_type:
        out = out.filter(F.col("log_type") == log_type)
    if user:
        out = out.filter(F.col("user").contains(user))
    if word:
        out = out.filter(F.col("msg").contains(word))
    page = out.orderBy(F.desc("received_at"), "msg").limit(most if page_cap is None else min(most, page_cap))
    return out.agg(F.count("*").alias("total")), page


def global_search(events: DataFrame, query: str, as_of: str, most: int = 20, v: Vocabulary = DEFAULT) -> DataFrame:
    """People, domains and file names of the last week that contain the query."""
    q = query.strip().lower()
    week = E.since(events, as_of, days=7)
    people = events.filter(F.lower("employee_id").contains(q)).groupBy("employee_id").agg(
        F.count_if(F.col("occurred_at") >= E.ago(as_of, days=7)).alias("n"))
    out = people.select(F.lit("person").alias("kind"), F.col("employee_id").alias("value"),
                        F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("label")).orderBy("value").limit(most)
    if "." in q:
        doms = week.filter((F.col("category") == "WEB") & F.lower(text("domain")).contains(q)).select(
            F.lower("domain").alias("value")).distinct()
        out = out.unionByName(doms.select(F.lit("domain").alias("kind"), "value", F.coalesce(
            D.risk_class("value", v), F.lit("normal")).alias("label")).orderBy("value").limit(most))
    if len(q) >= 3:
        files = week.filter((F.col("category") == "DOC") & F.lower(text("target_value")).contains(q))
        out = out.unionByName(files.orderBy(F.desc("occurred_at"), "event_hash").limit(most).select(
            F.lit("file").alias("kind"), F.substring("target_value", 1, 60).alias("value"),
            F.concat_ws(" ", "employee_id", "action", fmt_ts("occurred_at", "MM-dd HH:mm")).alias("label")))
    return out


# Action words of the timeline.
ACTION_WORDS = {"OPEN": "opened", "READ": "read", "MODIFY": "changed", "DELETE": "deleted", "COPY": "copied",
                "RENAME": "renamed", "SEND": "sent", "UPLOAD": "uploaded", "PRINT": "printed",
                "ARCHIVE": "archived", "DOWNLOAD": "downloaded"}


def timelines(events: DataFrame, as_of: str, days: int = 7, per_day: int = 80, per_person: int = 2000,
              v: Vocabulary = DEFAULT) -> DataFrame:
    """What people did, oldest first: classed visits, documents and searches.

    Newest `per_person` rows, then newest `per_day` of each day.
    """
    recent = E.since(events, as_of, days=days).withColumn("_day", E.day("occurred_at"))
    newest = [F.desc("occurred_at"), F.desc("event_hash")]
    # The rank over all rows of a person is the rank in the day plus the rows of newer days, so the only
    # ranking is per day, cut before the shuffle, and no person's rows meet in one task.
    counts = recent.groupBy("employee_id", "_day").agg(F.count("*").alias("_n"))
    newer = Window.partitionBy("employee_id").orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("employee_id", "_day", F.coalesce(F.sum("_n").over(newer), F.lit(0)).alias("_before"))
    kept = (recent.withColumn("_d", F.row_number().over(Window.partitionBy("employee_id", "_day").orderBy(*newest)))
            .filter(F.col("_d") <= per_day).join(before, ["employee_id", "_day"])
            .filter(F.col("_before") + F.col("_d") <= per_person))
    e = classify_events(kept, v)
    from ..functions.base import choose
    title = F.substring(F.trim(text("title")), 1, 40)
    web = F.concat(F.lit("visited "), "site", F.lit(" ×"), F.col("count").cast("string"),
                   F.when(~title.isin("", "-"), F.concat(F.lit(" '"), title, F.lit("'"))).otherwise(""))
    dest = F.substring(D.dest_root("dest_path"), 1, 30)
    where = (F.when((dest != "") & F.col("action").isin("SEND", "UPLOAD"), F.concat(F.lit(" → "), dest))
             .when(~text("channel").isin("", "LOCAL"), F.concat(F.lit(" ["), "channel", F.lit("]"))).otherwise(""))
    doc = F.concat(choose("action", ACTION_WORDS, F.col("action")), F.lit(" "),
                   F.substring(text("target_value"), 1, 44), where)
    search = F.concat(F.lit("searched '"), F.substring("target_value", 1, 40), F.lit("'"))
    is_web, is_doc = F.col("category") == "WEB", F.col("category") == "DOC"
    shown = e.filter((is_web & F.col("risk_class").isNotNull()) | is_doc
                     | ((F.col("category") == "SEARCH") & (text("target_value") != "")))
    return shown.select(
        "employee_id", "occurred_at",
        F.when(is_web, "web_risk").when(is_doc, F.concat(F.lit("doc_"), F.lower("action"))).otherwise("search").alias("kind"),
        F.when(is_web, web).when(is_doc, doc).otherwise(search).alias("text"),
        F.when(is_web, F.col("risk_class")).when(is_doc, D.risk_class(dest, v)).alias("risk"), "event_hash")


def risk_evidence(events: DataFrame, windowed: DataFrame, verdicts: DataFrame, most: int = 30, recent: int = 300,
                  v: Vocabulary = DEFAULT) -> DataFrame:
    """Up to `most` risky rows per person: rows of judged windows first, then the newest `recent`."""
    judged = windowed.join(verdicts.select("employee_id", "window_start"), ["employee_id", "window_start"], "left_semi")
    newest = Window.partitionBy("employee_id").orderBy(F.desc("occurred_at"), "event_hash")
    latest = (events.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= recent).drop("_n"))
    cols = ["employee_id", "occurred_at", "category", "action", "target_value", "domain", "source", "event_hash"]
    both = (judged.select(*cols, F.lit(0).alias("prio")).unionByName(latest.select(*cols, F.lit(1).alias("prio")))
            .withColumn("risk_class", F.when(F.col("category") == "WEB", D.risk_class("domain", v)))
            .filter(F.col("risk_class").isNotNull()
                    | ((F.col("category") == "DOC") & F.col("action").isin(*WRITE_ACTIONS))))
    once = both.groupBy(*cols, "risk_class").agg(F.min("prio").alias("prio"))
    order = Window.partitionBy("employee_id").orderBy("prio", F.desc("occurred_at"), "event_hash")
    return once.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most)


# ----------------------------------------------------------------- statistics

def stats(events: DataFrame, verdicts: DataFrame, alerts: DataFrame, as_of: str) -> DataFrame:
    """Headline numbers in one row."""
    today = F.col("occurred_at") >= E.day_start(as_of)
    ev = events.agg(F.count("*").alias("events"), F.count_if(today).alias("events_today"))
    people = (events.filter(today).select("employee_id").distinct()
              .agg(F.count("*").alias("employees"), F.count_if(E.is_named("employee_id")).alias("employees_named")))
    vr = verdicts.agg(F.count("*").alias("verdicts"))
    al = alerts.agg(F.count("*").alias("alerts"), F.count_if(F.col("status") != "CLOSED").alias("alerts_open"))
    return one_row(ev, people, vr, al)


def one_row(*parts: DataFrame) -> DataFrame:
    """One-row tables side by side; all but the first are scalar subqueries, so nothing is joined."""
    out = parts[0]
    for p in parts[1:]:
        out = out.withColumn("_s", p.select(F.struct(*p.columns)).scalar()).select("*", "_s.*").drop("_s")
    return out


def _periods(ts: str, as_of: str) -> dict[str, Column]:
    t, today = F.col(ts), E.day_start(as_of)
    return {"today": t >= today, "yesterday": (t >= E.day_start(as_of, 1)) & (t < today),
            "week": t >= E.day_start(as_of, 7), "total": F.lit(True)}


def source_stats(events: DataFrame, as_of: str) -> DataFrame:
    """Rows per feed and period; an empty source counts as proxy."""
    src = F.coalesce(F.nullif("source", F.lit("")), F.lit("proxy"))
    return events.groupBy(src.alias("source")).agg(*[
        F.count_if(cond).alias(name) for name, cond in _periods("occurred_at", as_of).items()])


def system_stats(events: DataFrame, verdicts: DataFrame, alerts: DataFrame, exemptions: DataFrame, as_of: str) -> DataFrame:
    """Event, verdict and alert counts per period in one row."""
    ep, vp, ap = _periods("occurred_at", as_of), _periods("window_start", as_of), _periods("window_start", as_of)
    ev = events.agg(*[F.count_if(c).alias(f"events_{k}") for k, c in ep.items()],
                    F.count_if(F.col("category") == "WEB").alias("web_total"))
    vr = verdicts.agg(*[F.count_if(vp[k]).alias(f"verdicts_{k}") for k in ("today", "yesterday", "total")],
                      F.count_if(F.col("ai_participated") == 1).alias("verdicts_model"),
                      F.count_if(F.col("ai_participated") == 0).alias("verdicts_rule"))
    al = alerts.agg(*[F.count_if(ap[k]).alias(f"alerts_{k}") for k in ("today", "yesterday", "total")],
                    F.count_if(ap["today"] & (F.col("risk_score") >= 76)).alias("alerts_today_critical"),
                    F.count_if(ap["today"] & (F.col("status") == "NEW")).alias("alerts_today_new"))
    people = alerts.filter(ap["today"]).select("employee_id").distinct().agg(F.count("*").alias("alerts_today_people"))
    from ..operators.scoring import valid_exemptions
    ex = valid_exemptions(exemptions, as_of).agg(F.count("*").alias("exemptions"))
    return one_row(ev, vr, al, people, ex)


def alert_breakdown(alerts: DataFrame, as_of: str) -> DataFrame:
    """Alerts by scenario and status, all and today."""
    today = F.col("window_start") >= E.day_start(as_of)
    return alerts.groupBy(F.coalesce(F.nullif("scenario", F.lit("")), F.lit("unknown")).alias("scenario"), "status").agg(
        F.count("*").alias("n"), F.count_if(today).alias("n_today"))


def alerts_by_day(alerts: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Alerts per day, zero-filled: past days by creation, today by latest window."""
    spark = alerts.sparkSession
    today = E.day_start(as_of).cast("date")
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day"))
    past = (alerts.filter((F.col("created_at") >= E.day_start(as_of, days - 1)) & (E.day("created_at") < today))
            .select(E.day("created_at").alias("day")))
    now = alerts.filter(F.col("window_start") >= E.day_start(as_of)).select(today.alias("day"))
    counted = past.unionByName(now).groupBy("day").agg(F.count("*").alias("n"))
    return calendar.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_alerts"))


def top_active(alerts: DataFrame, most: int = 10) -> DataFrame:
    """Newest open alert per person, highest score first, then by scenario priority."""
    newest = F.max_by(F.struct("scenario", "risk_score", "status", "window_start", "summary"), F.struct("window_start", "dedup_key"))
    per = alerts.filter("status = 'NEW'").groupBy("employee_id").agg(newest.alias("a")).select("employee_id", "a.*")
    prio = F.when(F.col("scenario") == "job_seeking", 0).when(F.col("scenario") == "data_exfiltration", 1).otherwise(2)
    return per.withColumn("priority", prio).orderBy(F.desc("risk_score"), "priority", "employee_id").limit(most)


def site_class_stats(events: DataFrame, as_of: str) -> DataFrame:
    """Visits per site class, today and yesterday."""
    web = events.filter((F.col("category") == "WEB") & (F.col("occurred_at") >= E.day_start(as_of, 1)))
    today = F.col("occurred_at") >= E.day_start(as_of)
    return web.groupBy(F.coalesce(F.nullif("site_class", F.lit("")), F.lit("unrecognised")).alias("site_class")).agg(
        F.count_if(today).alias("today"), F.count_if(~today).alias("yesterday"))


def daily_trend(verdicts: DataFrame, alerts: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Alerts by creation day and verdicts by window day."""
    t0 = E.ago(as_of, days=days)
    al = alerts.filter(F.col("created_at") >= t0).groupBy(E.day("created_at").alias("day")).agg(F.count("*").alias("n_alerts"))
    vr = verdicts.filter(F.col("window_start") >= t0).groupBy(E.day("window_start").alias("day")).agg(F.count("*").alias("n_verdicts"))
    zero = F.lit(0).cast("bigint")
    return al.join(vr, "day", "full_outer").select("day", F.coalesce("n_alerts", zero).alias("n_alerts"),
                                                   F.coalesce("n_verdicts", zero).alias("n_verdicts"))


def today_overview(events: DataFrame, verdicts: DataFrame, alerts: DataFrame, as_of: str) -> DataFrame:
    t0 = E.day_start(as_of)
    day = events.filter(F.col("occurred_at") >= t0)
    return one_row(day.select("employee_id").distinct().agg(F.count("*").alias("people")),
                   day.agg(F.count("*").alias("events")),
                   verdicts.filter(F.col("window_start") >= t0).agg(F.count("*").alias("verdicts")),
                   alerts.filter(F.col("window_start") >= t0).agg(F.count("*").alias("alerts")))


def category_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("employee_id", "category", text("source").alias("source")).agg(F.count("*").alias("n_rows"))


def fallback_ratio(verdicts: DataFrame, last: int = 100, need: int = 20, limit: float = 0.5) -> DataFrame:
    """Share of rule verdicts among the newest ones, and whether that is an alarm."""
    newest = verdicts.orderBy(F.desc("window_start"), "verdict_id").limit(last)
    rules = F.count_if(F.col("ai_participated") == 0)
    return newest.agg(F.count("*").alias("n"), rules.alias("n_rule")).withColumn(
        "alarm", (F.col("n") >= need) & (F.col("n_rule") > F.col("n") * limit))


def latest_or_clues(alerts: DataFrame, verdicts: DataFrame, exemptions: DataFrame, intent: str, as_of: str,
                    days: int = 30, first: int = 15, most: int = 5) -> DataFrame:
    """Top alerts of an intent; without any, the best verdicts of non-exempt people as clues."""
    cols = ["employee_id", "risk_score", "window_start", "text", "kind"]
    top = (alerts.filter(F.col("scenario") == intent).withColumn("text", F.col("summary")).withColumn("kind", F.lit("alert"))
           .orderBy(F.desc("risk_score"), F.desc("created_at"), "dedup_key").limit(10).select(*cols))
    scoped = verdicts.filter((F.col("intent") == intent) & (F.col("window_start") >= E.day_start(as_of, days)))
    pool = scoped.orderBy(F.desc("risk_score"), "verdict_id").limit(first)
    clues = (not_exempt_people(pool, exemptions, intent, as_of).orderBy(F.desc("risk_score"), "verdict_id").limit(most)
             .withColumn("text", F.col("explanation")).withColumn("kind", F.lit("clue")).select(*cols))
    n_alerts = alerts.filter(F.col("scenario") == intent).agg(F.count("*")).scalar()
    return top.unionByName(clues.filter(n_alerts == 0))


def weekly_digest(events: DataFrame, verdicts: DataFrame, alerts: DataFrame, board: DataFrame, efficiency: DataFrame,
                  as_of: str, days: int = 7) -> DataFrame:
    """One row with the numbers of the week, the top of the risk board and of the leisure board."""
    since = E.ago(as_of, days=days)
    al = alerts.filter(F.col("created_at") >= since)
    top = (board.orderBy(F.desc("score"), "employee_id").limit(5)
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "employee_id", "stage"))),
                                         lambda x: F.concat_ws(":", x["employee_id"], (-x["o"]).cast("string"), x["stage"])), ", ").alias("board_top")))
    fun = (efficiency.filter("slack_avg > 0").orderBy(F.desc("slack_avg"), "employee_id").limit(3)
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("slack_avg")).alias("o"), "employee_id"))),
                                         lambda x: F.concat_ws(":", x["employee_id"], (-x["o"]).cast("string"))), ", ").alias("leisure_top")))
    scenarios = (al.groupBy("scenario").agg(F.count("*").alias("n"))
                 .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("scenario", "n"))),
                                               lambda x: F.concat_ws(":", x["scenario"], x["n"].cast("string"))), ", ").alias("scenarios")))
    return one_row(
        al.agg(F.count("*").alias("alerts"), F.count_if(F.col("status") == "NEW").alias("alerts_new")),
        verdicts.filter(F.col("window_start") >= since).agg(F.count("*").alias("verdicts")),
        events.filter(F.col("occurred_at") >= since).agg(
            F.count("*").alias("events"),
            F.count_if((text("source") == "endpoint") & F.col("action").isin("SEND", "UPLOAD")).alias("sends")),
        scenarios, top, fun)


# ----------------------------------------------------------------- exports

def alert_export(alerts: DataFrame) -> DataFrame:
    """Rows of the alert report."""
    return alerts.select("employee_id", "scenario", "severity", "risk_score", "status", "window_start", "summary")


# Scenario names in the alert report.
SCENARIO_LABELS = {
    "job_seeking": "求职离职", "data_exfiltration": "数据外发", "baseline_deviation": "行为偏离", "policy_violation": "违规",
}


def alert_report(alerts: DataFrame) -> DataFrame:
    """The alert report with scenario names, and the place of each row (highest score first, then key)."""
    known = F.create_map(*[F.lit(x) for pair in SCENARIO_LABELS.items() for x in pair])
    label = F.coalesce(F.try_element_at(known, F.col("scenario")), F.col("scenario"), F.lit(""))
    return alerts.select("dedup_key", "employee_id", label.alias("scenario"), "severity", "risk_score", "status", "window_start", "summary")


def write_alert_report(alerts: DataFrame, path: str) -> None:
    """Report files in order: sorted by ranges, so file names follow the order of rows."""
    from ..sources.sinks import write_csv_report
    rows = alert_report(alerts).withColumn("window_start", fmt_ts("window_start", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    write_csv_report(rows.orderBy(F.desc("risk_score"), "dedup_key").drop("dedup_key"), path)


def profile_export(alerts: DataFrame, verdicts: DataFrame, stages: DataFrame, per_person: int = 50) -> DataFrame:
    """Report rows of all people: alerts, latest verdicts, stage of the signal timeline."""
    order = Window.partitionBy("employee_id").orderBy(F.desc("window_start"), "verdict_id")
    last = verdicts.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= per_person)
    return (alerts.select("employee_id", F.lit("alert").alias("kind"), fmt_ts("window_start", "yyyy-MM-dd HH:mm").alias("at"),
                          F.col("scenario").alias("what"), F.col("risk_score").alias("score"), "status",
                          F.substring("summary", 1, 80).alias("text"))
            .unionByName(last.select("employee_id", F.lit("verdict").alias("kind"), fmt_ts("window_start", "yyyy-MM-dd HH:mm").alias("at"),
                                     F.col("intent").alias("what"), F.col("risk_score").alias("score"), F.lit("").alias("status"),
                                     F.substring("explanation", 1, 80).alias("text")))
            .unionByName(stages.select("employee_id", F.lit("story").alias("kind"), F.lit("").alias("at"), F.col("stage").alias("what"),
                                       F.lit(None).cast("int").alias("score"), F.lit("").alias("status"),
                                       F.substring("story", 1, 120).alias("text"))))


def parsed_export(events: DataFrame) -> DataFrame:
    """The eleven columns of the parsed-event export, with what only the raw record says."""
    raw = lambda name: F.try_element_at("raw", F.lit(name))
    return events.select("occurred_at", "employee_id", "device_id", "category", "action", "target_value", "size_bytes", F.coalesce("channel", raw("channel")).alias("channel"),
                         F.coalesce("app", raw("application")).alias("application"), F.coalesce("src_path", raw("path")).alias("path"), raw("op_type").alias("op_type"))


def people_stats(events: DataFrame, profiles: DataFrame, as_of: str) -> DataFrame:
    """People seen today, yesterday and ever, and when the latest profile was built; `profiles` has built_at."""
    periods = _periods("occurred_at", as_of)
    seen = events.groupBy("employee_id").agg(*[F.max(F.coalesce(periods[k], F.lit(False))).alias(k) for k in ("today", "yesterday")])
    people = seen.agg(F.count_if("today").alias("people_today"), F.count_if("yesterday").alias("people_yesterday"), F.count("*").alias("people_total"))
    return one_row(people, profiles.agg(F.max("built_at").alias("latest_profile"), F.count("*").alias("profiles")))


def event_export(events: DataFrame) -> DataFrame:
    return events.select("occurred_at", "employee_id", "device_id", "category", "action", "target_value", "size_bytes",
                         "channel", F.col("app").alias("application"), F.col("src_path").alias("path"))
