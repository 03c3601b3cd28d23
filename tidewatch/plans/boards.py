"""Boards: risk, efficiency, attendance, night work, who visited what."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import domains as D
from ..functions import events as E
from ..functions.base import fmt_ts, from_micros, starts_with_any, text
from ..operators.classify import classify_events
from ..operators.digest import ranked_list
from ..operators.patterns import sends, shared_files
from ..operators.windows import leisure_segments, leisure_visits, slice_index, slice_seconds, slices_of
from ..schema import SEND_ACTIONS, Rules
from ..vocab import DEFAULT, Vocabulary


def who_visited(events: DataFrame, as_of: str, risk_class: str, days: int = 30, most: int | None = 20,
                v: Vocabulary = DEFAULT) -> DataFrame:
    """People by rows on sites of a risk class."""
    web = E.since(events, as_of, days=days).filter((F.col("category") == "WEB"))
    hits = (web.filter(D.risk_class("domain", v) == risk_class).groupBy("employee_id")
            .agg(F.count("*").alias("n_rows")))
    return hits if most is None else hits.orderBy(F.desc("n_rows"), "employee_id").limit(most)


def attendance(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Per person: seen today, days seen, earliest hour, and why the pattern is unusual."""
    today = F.lit(as_of).cast("timestamp_ntz").cast("date")
    per_day = (E.since(events, as_of, days=days).filter(E.is_person("employee_id"))
               .groupBy("employee_id", E.day("occurred_at").alias("day")).agg(F.min(F.hour("occurred_at")).alias("h")))
    return (per_day.groupBy("employee_id")
            .agg(F.bool_or(F.col("day") == today).alias("active_today"), F.count("*").alias("active_days"),
                 F.min("h").alias("earliest_hour"))
            .withColumn("remark", F.when(F.col("active_days") <= 1, "one day or less")
                        .when(F.col("earliest_hour") < 7, "early activity")))


def absent_people(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """People of the period without activity today."""
    people = (E.since(events, as_of, days=days).filter(E.is_person("employee_id"))
              .select("employee_id").distinct())
    today = events.filter(F.col("occurred_at") >= E.day_start(as_of)).select("employee_id").distinct()
    return people.join(today, "employee_id", "left_anti")


def efficiency(events: DataFrame, as_of: str, days: int = 7, rules: Rules = Rules(),
               v: Vocabulary = DEFAULT) -> DataFrame:
    """Work-hours visits and leisure time per person; addresses are no people."""
    web = events.filter((F.col("category") == "WEB") & (F.col("occurred_at") >= E.day_start(as_of, days - 1))
                        & ~E.is_ip("employee_id"))
    label = F.coalesce("site_class", "app")
    rows = (web.withColumn("leisure", D.leisure_class("domain", label, v))
            .withColumn("is_work", D.is_work_domain("domain", v) & D.risk_class("domain", v).isNull())
            .withColumn("wh", E.is_work_hours("occurred_at")))
    n = F.col("count").cast("bigint")
    zero = F.lit(0).cast("bigint")
    wh, fun = F.col("wh"), F.col("leisure").isNotNull()
    per_day = rows.groupBy("employee_id", E.day("occurred_at").alias("day")).agg(
        F.sum(F.when(wh, n).otherwise(zero)).alias("total"), F.sum(F.when(wh & fun, n).otherwise(zero)).alias("slack"),
        F.sum(F.when(wh & ~fun & F.col("is_work"), n).otherwise(zero)).alias("work"),
        F.bool_or(wh).alias("on_duty"), F.min(F.hour("occurred_at")).alias("h0"), F.max(F.hour("occurred_at")).alias("h1"))
    people = per_day.groupBy("employee_id").agg(
        F.sum("total").alias("total"), F.sum("slack").alias("slack"), F.sum("work").alias("work"),
        F.count_if("on_duty").alias("active_days"), F.min("h0").alias("hour_min"), F.max("h1").alias("hour_max"))
    visits = leisure_visits(web, v)
    days_slack = (leisure_segments(visits, ["employee_id"], rules).groupBy("employee_id", "day")
                  .agg(F.sum("seconds").alias("sec"), F.count("*").alias("segs"), F.count_if(F.col("n") == 1).alias("single"))
                  .groupBy("employee_id").agg(F.sum("sec").alias("sec"), F.max("sec").alias("max_sec"),
                                              F.sum("segs").alias("segs"), F.sum("single").alias("single")))
    cats = (leisure_segments(visits, ["employee_id", "leisure"], rules).groupBy("employee_id", "leisure")
            .agg(F.bround(F.sum("seconds") / 60).cast("bigint").alias("m"))
            .groupBy("employee_id").agg(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("leisure", "m"))),
                lambda x: F.concat(x["leisure"], F.lit(":"), x["m"].cast("string"))), ",").alias("cats")))
    duty = F.greatest("active_days", F.lit(1))
    minutes = F.coalesce("sec", F.lit(0.0)) / 60
    return (people.join(days_slack, "employee_id", "left").join(cats, "employee_id", "left")
            .select("employee_id", "total", "slack", "work", "active_days", "hour_min", "hour_max",
                    F.bround(minutes / duty).cast("bigint").alias("slack_avg"),
                    F.bround(F.coalesce("max_sec", F.lit(0.0)) / 60).cast("bigint").alias("max_span"),
                    F.bround(F.least(minutes / (duty * rules.work_minutes_per_day) * 100, F.lit(100.0)), 1).alias("pct"),
                    F.when(F.col("total") > 0, F.bround(F.col("work") / F.col("total") * 100, 1)).otherwise(F.lit(0.0)).alias("work_pct"),
                    text("cats").alias("cats"),
                    F.coalesce((F.col("segs") >= 8) & (F.col("single") / F.col("segs") >= 0.7), F.lit(False)).alias("sparse"),
                    (F.col("slack") + F.col("work")).alias("classified")))


def leisure_sessions(events: DataFrame, as_of: str, days: int = 14, most: int = 20, rules: Rules = Rules(),
                     v: Vocabulary = DEFAULT) -> DataFrame:
    """Longest leisure segments per person with main category and hosts."""
    visits = leisure_visits(E.since(events, as_of, days=days), v)
    segs = leisure_segments(visits, ["employee_id"], rules).filter("n > 0")
    longest = (segs.withColumn("minutes", F.floor(F.col("seconds") / 60))
               .withColumn("rn", F.row_number().over(Window.partitionBy("employee_id").orderBy(
                   F.desc("minutes"), "seg_start"))).filter(F.col("rn") <= most))
    gap = rules.leisure_gap_seconds
    by_day = visits.withColumn("day", E.day("occurred_at"))
    starts = (slices_of(by_day, ["employee_id", "day"], gap)
              .select("employee_id", "day", "slice", from_micros("start").alias("seg_start")))
    per = (by_day.groupBy("employee_id", "day", slice_index("occurred_at", slice_seconds(gap)).alias("slice"),
                          "domain", "leisure").agg(F.count("*").alias("k")))
    inside = (per.join(starts, ["employee_id", "day", "slice"])
              .join(longest.select("employee_id", "seg_start"), ["employee_id", "seg_start"], "left_semi"))
    key = ["employee_id", "seg_start"]
    by_cat = inside.groupBy(*key, "leisure").agg(F.sum("k").alias("k"))
    main = by_cat.groupBy(*key).agg(F.min(F.struct((-F.col("k")).alias("o"), "leisure")).alias("m")).select(
        *key, F.col("m.leisure").alias("category"))
    hosts = ranked_list(inside.groupBy(*key, "domain").agg(F.sum("k").alias("k")), key, F.col("domain"),
                        [F.desc("k"), F.col("domain")], 3, "hosts", ",")
    return (longest.join(main, key).join(hosts, key)
            .select("employee_id", "seg_start", "seg_end", "minutes", "n", "category", "hosts",
                    (F.col("n") == 1).alias("sparse")))


def night_board(events: DataFrame, as_of: str, days: int = 7, min_rows: int = 20, most: int | None = 20,
                v: Vocabulary = DEFAULT) -> DataFrame:
    """People by night rows with their three main hosts."""
    night = E.since(events, as_of, days=days).filter(E.is_off_hours("occurred_at"))
    people = night.groupBy("employee_id").agg(F.count("*").alias("night_events")).filter(F.col("night_events") >= min_rows)
    if most is not None:
        people = people.orderBy(F.desc("night_events"), "employee_id").limit(most)
    dom = F.lower(text("domain"))
    hosts = (night.withColumn("host", dom)
             .filter((F.col("host") != "") & D.risk_class("host", v).isNull()
                     & ~starts_with_any("host", vocab.NIGHT_HOST_PREFIXES))
             .groupBy("employee_id", "host").agg(F.count("*").alias("k")))
    top = ranked_list(hosts.join(people.select("employee_id"), "employee_id", "left_semi"), ["employee_id"],
                      F.col("host"), [F.desc("k"), F.col("host")], 3, "top_domains", ",")
    return people.join(top, "employee_id", "left").withColumn("top_domains", text("top_domains"))


def shared_file_board(events: DataFrame, as_of: str | None, days: int = 7, actions=("SEND", "UPLOAD", "COPY"),
                      min_people: int = 2, most: int | None = 20) -> DataFrame:
    files = shared_files(events, as_of, days, actions, min_people)
    return files if most is None else files.orderBy(F.desc("n_people"), "file").limit(most)


def risk_board(events: DataFrame, verdicts: DataFrame, alerts: DataFrame, profiles: DataFrame,
               exemptions: DataFrame, as_of: str, days: int = 7, most: int | None = 30,
               v: Vocabulary = DEFAULT) -> DataFrame:
    """Combined departure-risk score per person from five kinds of signals."""
    since = E.ago(as_of, days=days)
    ex = exemptions.select("employee_id", F.col("signal_type").alias("kind")).distinct()

    def signal(df: DataFrame, name: str, score) -> DataFrame:
        return df.groupBy("employee_id").agg(score.cast("int").alias("score")).select(
            "employee_id", F.lit(name).alias("signal"), "score")

    job = (verdicts.filter((F.col("window_start") >= since) & (F.col("intent") == "job_seeking"))
           .withColumn("kind", F.col("intent")))
    strong = job.filter("risk_score >= 50").join(ex, ["employee_id", "kind"], "left_anti")
    hinted = job.filter((F.col("risk_score") >= 30) & text("explanation").rlike("search|resume"))
    leak = (alerts.filter((F.col("created_at") >= since) & (F.col("scenario") == "data_exfiltration"))
            .withColumn("kind", F.col("scenario")).join(ex, ["employee_id", "kind"], "left_anti"))
    rows = events.filter((text("source") == "endpoint") & (F.col("occurred_at") >= since) & (D.dest_root("dest_path") != ""))
    sent = sends(rows, v).select("employee_id").distinct().withColumn("risk_score", F.lit(60))
    deleted = alerts.filter((F.col("created_at") >= since) & (F.col("scenario") == "mass_delete"))
    listed = (signal(strong, "job", F.max("risk_score"))
              .unionByName(signal(leak.select("employee_id", "risk_score").unionByName(sent), "exfil", F.max("risk_score")))
              .unionByName(signal(deleted, "delete", F.coalesce(F.max_by("risk_score", F.struct("created_at", "dedup_key")), F.lit(70))))
              .unionByName(signal(hinted, "search", F.max("risk_score"))))
    kinds = ["job", "exfil", "delete", "search"]
    wide = listed.groupBy("employee_id").agg(*[
        F.coalesce(F.max(F.when(F.col("signal") == k, F.col("score"))), F.lit(0)).alias(k) for k in kinds])
    late = (profiles.filter(F.col("rhythm.late_night_days") >= 3).select("employee_id", F.lit(50).alias("night")))
    wide = wide.join(late, "employee_id", "left").withColumn("night", F.coalesce("night", F.lit(0)))
    types = sum([(F.col(k) > 0).cast("int") for k in [*kinds, "night"]], F.lit(0))
    weighted = F.floor((30 * F.col("job") + 25 * F.col("exfil") + 20 * F.col("delete") + 15 * F.col("search")
                        + 10 * F.col("night")) / 100)
    wide = (wide.withColumn("signals", types)
            .withColumn("score", F.least(weighted + F.when(types > 1, (types - 1) * 8).otherwise(0), F.lit(100)).cast("int")))
    stage = (F.when((F.col("signals") >= 4) | (F.col("score") >= 80), "high")
             .when((F.col("signals") >= 3) | (F.col("score") >= 65), "warn")
             .when((F.col("signals") >= 2) | (F.col("score") >= 45), "watch").otherwise("observe"))
    board = wide.withColumn("stage", stage).select("employee_id", "score", "stage", "signals", *kinds, "night")
    return board if most is None else board.orderBy(F.desc("score"), "employee_id").limit(most)


def signal_timeline(events: DataFrame, verdicts: DataFrame, alerts: DataFrame, as_of: str, days: int = 30,
                    min_kinds: int = 2, per_kind: int = 8) -> DataFrame:
    """People with several kinds of signals, each with its latest entries, and a rule-based stage."""
    since = E.ago(as_of, days=days)
    target, hm = text("target_value"), lambda c: fmt_ts(c, "MM-dd HH")
    rows = events.filter((text("source") == "endpoint") & (F.col("occurred_at") >= since))
    job = verdicts.filter((F.col("window_start") >= since) & (F.col("intent") == "job_seeking") & (F.col("risk_score") >= 50))
    new = alerts.filter(F.col("created_at") >= since)
    parts = [
        job.select("employee_id", F.lit("job_visit").alias("kind"), F.col("window_start").alias("at"),
                   F.concat(hm("window_start"), F.lit(" score "), F.col("risk_score").cast("string")).alias("entry")),
        new.filter("scenario = 'mass_delete'").select(
            "employee_id", F.lit("mass_delete").alias("kind"), F.col("created_at").alias("at"), hm("created_at").alias("entry")),
        new.filter("scenario = 'data_exfiltration'").select(
            "employee_id", F.lit("exfil_alert").alias("kind"), F.col("window_start").alias("at"),
            F.concat(hm("window_start"), F.lit(" score "), F.col("risk_score").cast("string")).alias("entry")),
        rows.filter((F.col("category") == "DOC") & F.col("action").isin(*SEND_ACTIONS) & ~text("channel").isin("", "LOCAL")).select(
            "employee_id", F.lit("network_send").alias("kind"), F.col("occurred_at").alias("at"),
            F.concat(hm("occurred_at"), F.lit(" "), F.substring(target, 1, 36), F.lit("→"),
                     F.substring(D.dest_root("dest_path"), 1, 30)).alias("entry")),
        rows.filter((F.col("category") == "SEARCH") & (target != "")).select(
            "employee_id", F.lit("search").alias("kind"), F.col("occurred_at").alias("at"),
            F.concat(hm("occurred_at"), F.lit(" "), F.substring(target, 1, 20)).alias("entry")),
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    order = Window.partitionBy("employee_id", "kind").orderBy(F.desc("at"), "entry")
    kept = (union.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= per_kind)
            .groupBy("employee_id", "kind")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rn")).alias("o"), "entry"))),
                                          lambda x: x["entry"]), "; ").alias("entries")))
    wide = kept.groupBy("employee_id").agg(
        F.count("*").alias("n_kinds"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "entries"))),
                                 lambda x: F.concat(F.lit("["), x["kind"], F.lit("] "), x["entries"])), "\n").alias("story"),
        *[F.bool_or(F.col("kind") == k).alias(k) for k in ("job_visit", "mass_delete", "exfil_alert", "network_send", "search")])
    linked = F.col("job_visit") & (F.col("network_send") | F.col("search"))
    out = F.col("mass_delete") | F.col("exfil_alert")
    chain = F.col("job_visit") & F.col("search") & F.col("mass_delete") & (F.col("network_send") | F.col("exfil_alert"))
    stage = F.when(chain, "high").when(linked & out, "warn").when(linked, "watch").otherwise("observe")
    return wide.filter(F.col("n_kinds") >= min_kinds).select("employee_id", "n_kinds", stage.alias("stage"), "story")


def user_overview(events: DataFrame, verdicts: DataFrame, alerts: DataFrame, as_of: str) -> DataFrame:
    """Rows, rows today, last seen, week's highest score and alerts per person; no addresses."""
    today, week = E.day_start(as_of), E.ago(as_of, days=7)
    ev = (events.filter(~E.is_ip("employee_id")).groupBy("employee_id")
          .agg(F.count("*").alias("event_count"), F.count_if(F.col("occurred_at") >= today).alias("event_count_today"),
               F.max("occurred_at").alias("last_seen")))
    vr = verdicts.filter(F.col("window_start") >= week).groupBy("employee_id").agg(F.max("risk_score").alias("max_risk"))
    al = alerts.filter(F.col("window_start") >= week).groupBy("employee_id").agg(F.count("*").alias("alert_count"))
    return (ev.join(vr, "employee_id", "left").join(al, "employee_id", "left")
            .withColumn("alert_count", F.coalesce("alert_count", F.lit(0).cast("bigint"))))


def person_cards(events: DataFrame, verdicts: DataFrame, alerts: DataFrame) -> DataFrame:
    """Counts by category and source, verdict count, highest score and top alerts per person."""
    src = text("source")
    ev = events.groupBy("employee_id").agg(
        *[F.count_if(F.col("category") == c).alias(f"n_{c.lower()}") for c in ("DOC", "WEB", "SEARCH")],
        F.count_if(src == "endpoint").alias("n_endpoint"), F.count_if(src != "endpoint").alias("n_proxy"))
    vr = verdicts.groupBy("employee_id").agg(F.count("*").alias("verdict_count"), F.max("risk_score").alias("max_risk"))
    al = alerts.groupBy("employee_id").agg(F.count("*").alias("alert_count"))
    # Alert keys are unique, so a person has at most one row per scenario and day.
    entry = F.struct((-F.col("risk_score")).alias("o"), "dedup_key",
                     F.concat_ws(":", "scenario", F.col("risk_score").cast("string"), "status").alias("t"))
    listed = alerts.groupBy("employee_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(entry)), lambda x: x["t"]), ",").alias("alert_list"))
    zero = F.lit(0).cast("bigint")
    return (ev.join(vr, "employee_id", "left").join(al, "employee_id", "left").join(listed, "employee_id", "left")
            .withColumn("verdict_count", F.coalesce("verdict_count", zero))
            .withColumn("alert_count", F.coalesce("alert_count", zero)))


def judged_sites(verdicts: DataFrame, sites: DataFrame, most: int = 15) -> DataFrame:
    """Risk sites behind each person's verdicts, most rows first."""
    hits = (sites.join(verdicts.select("employee_id", "window_start"), ["employee_id", "window_start"], "left_semi")
            .groupBy("employee_id", "risk_class", "site").agg(F.sum("n_rows").alias("n_rows")))
    order = Window.partitionBy("employee_id").orderBy(F.desc("n_rows"), "site")
    return hits.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most)
