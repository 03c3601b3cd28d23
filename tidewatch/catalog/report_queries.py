"""Lists, statistics and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.base import text
from ..operators import identity as ID
from ..operators import patterns as X
from ..operators import profiles as P
from ..operators import windows as W
from ..plans import boards as B
from ..plans import reports as R
from .base import *
from .board_queries import EFF
from .detect_queries import BOARD, TIMELINE, all_alerts

ALERTS = "alerts verdicts due valid_ex"


def frames(spark, sf):
    events, facts, v = verdict_frames(spark, sf)
    return events, facts, v.withColumn("ai_participated", (F.col("n") % 2).cast("int")), alert_frame(spark, v)


def alert_query(name, where, order="", **args):
    @register(name, with_(ALERTS, f"select dedup_key, risk_score, status, severity from alerts {where} {order}"))
    def run(spark, sf):
        return R.alert_list(frames(spark, sf)[3], TODAY, **args).select("dedup_key", "risk_score", "status", "severity")


alert_query("p01_alert_list_open_week", "where status = 'NEW' and window_start >= timestamp '2024-01-23'", status="NEW", when="week", most=None)
alert_query("p01_alert_list_handled", "where status <> 'NEW' and severity = 'CRITICAL'", status="handled", severity="CRITICAL", most=None)
alert_query("p01_alert_list_yesterday", "where window_start >= timestamp '2024-01-29' and window_start < timestamp '2024-01-30'", when="yesterday", most=None)
alert_query("o1_top_alerts", "", "order by risk_score desc, created_at desc, dedup_key limit 50", most=50)


@register("p02_verdict_list", with_("verdicts", "select verdict_id, window_start, risk_score from verdicts order by window_start desc, verdict_id limit 100"))
def p02(spark, sf):
    return R.verdict_list(frames(spark, sf)[2]).select("verdict_id", "window_start", "risk_score")


@register("j09_evidence", with_("verdicts win", """select verdict_id, pos, event_hash from (select v.verdict_id, w.event_hash, row_number() over (partition by v.verdict_id order by w.occurred_at, w.event_hash)::int as pos from verdicts v join win w using (employee_id, window_start)) where pos <= 50"""))
def j09(spark, sf):
    events, _, v, _ = frames(spark, sf)
    return R.evidence(v, W.assign_windows(events)).select("verdict_id", "pos", "event_hash")


@register("j09_verdict_devices", with_("verdicts canon", "select verdict_id, arg_min(device_id, event_hash) as device_id from verdicts v join canon c on c.employee_id = v.employee_id and c.occurred_at = v.window_start group by 1"))
def j09d(spark, sf):
    from ..operators.scoring import with_devices
    events, _, v, _ = frames(spark, sf)
    return with_devices(v, events).select("verdict_id", "device_id")


def raw_logs(events):
    return events.select(F.col("occurred_at").alias("received_at"), F.col("category").alias("log_type"), F.col("employee_id").alias("user"),
                         F.concat_ws(" ", "action", text("target_value"), "event_hash").alias("msg"))


RAW = "raw as (select occurred_at as received_at, category as log_type, employee_id as \"user\", concat_ws(' ', action, coalesce(target_value, ''), event_hash) as msg from canon)"
RAW_WHERE = "received_at >= timestamp '2024-01-10' and received_at <= timestamp '2024-01-20' and log_type = 'DOC' and contains(\"user\", '1') and contains(msg, 'SEND')"


@register("p03_raw_log_total", with_("canon", "").rstrip() + ", " + RAW + f" select count(*) as total from raw where {RAW_WHERE}")
def p03t(spark, sf):
    return R.raw_log_search(raw_logs(ev(spark, sf)), "2024-01-10 00:00:00", "2024-01-20 00:00:00", "DOC", "1", "SEND")[0]


@register("p03_raw_log_page", with_("canon", "").rstrip() + ", " + RAW + f" select * from raw where {RAW_WHERE} order by received_at desc, msg limit 50")
def p03p(spark, sf):
    return R.raw_log_search(raw_logs(ev(spark, sf)), "2024-01-10 00:00:00", "2024-01-20 00:00:00", "DOC", "1", "SEND", 50)[1]


@register("p04_search_people", with_("canon", f"select 'person' as kind, employee_id as value, count(*) filter (occurred_at >= timestamp '{AS_OF}' - interval 7 day) || ' rows' as label from canon where contains(employee_id, 'u1') group by 2 order by 2 limit 20"))
def p04a(spark, sf):
    return R.global_search(ev(spark, sf), "U1", AS_OF)


@register("p04_search_domains", with_("canon", f"select distinct 'domain' as kind, domain as value, coalesce({sql_risk('domain')}, 'normal') as label from canon where category = 'WEB' and contains(domain, 'qq.com') and occurred_at >= timestamp '{AS_OF}' - interval 7 day"))
def p04b(spark, sf):
    return R.global_search(ev(spark, sf), "qq.com", AS_OF)


@register("p04_search_files", with_("canon", f"""select 'file' as kind, target_value as value, concat_ws(' ', employee_id, action, strftime(occurred_at, '%m-%d %H:%M')) as label from canon where category = 'DOC' and contains(lower(target_value), 'report_') and occurred_at >= timestamp '{AS_OF}' - interval 7 day
 order by occurred_at desc, event_hash limit 20"""))
def p04c(spark, sf):
    return R.global_search(ev(spark, sf), "report_", AS_OF)


WORDS = "case action " + " ".join(f"when '{k}' then '{v}'" for k, v in R.ACTION_WORDS.items()) + " else action end"


@register("p05_timelines", with_("cls", f"""select employee_id, occurred_at, case category when 'WEB' then 'web_risk' when 'DOC' then 'doc_' || lower(action) else 'search' end as kind,
 case category when 'WEB' then 'visited ' || site || ' ×' || "count" || case when coalesce(title, '') not in ('', '-') then ' ''' || title || '''' else '' end
  when 'DOC' then {WORDS} || ' ' || left(coalesce(target_value, ''), 44) || case when coalesce(dest_path, '') <> '' and action in ('SEND','UPLOAD') then ' → ' || left(lower(split_part(dest_path, '/', 1)), 30) when coalesce(channel, '') not in ('', 'LOCAL') then ' [' || channel || ']' else '' end
  else 'searched ''' || left(target_value, 40) || '''' end as text, event_hash from (select *, row_number() over (partition by employee_id, cast(occurred_at as date) order by occurred_at desc, event_hash desc) as d from cls where occurred_at >= timestamp '{AS_OF}' - interval 7 day) where d <= 2
 and (category <> 'WEB' or risk_class is not null)"""))
def p05(spark, sf):
    return R.timelines(ev(spark, sf), AS_OF, per_day=2).select("employee_id", "occurred_at", "kind", "text", "event_hash")


@register("o3_newest_then_ascending", with_("canon", "select event_id, occurred_at from canon order by occurred_at desc, event_id desc limit 500"))
def o3(spark, sf):
    newest = ev(spark, sf).select("event_id", "occurred_at").orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(500)
    return newest.orderBy("occurred_at", "event_id")


@register("p06_risk_evidence", with_("verdicts win cls", f"""select employee_id, event_hash, prio, rn from (select *, row_number() over (partition by employee_id order by prio, occurred_at desc, event_hash)::int as rn from (select employee_id, occurred_at, event_hash, min(prio)::int as prio from
 (select w.employee_id, w.occurred_at, w.event_hash, w.category, w.action, w.risk_class, 0 as prio from win w join verdicts v using (employee_id, window_start)
  union all select employee_id, occurred_at, event_hash, category, action, risk_class, 1 from (select *, row_number() over (partition by employee_id order by occurred_at desc, event_hash) as n from cls) where n <= 20)
 where risk_class is not null or (category = 'DOC' and action in {WRITE}) group by 1, 2, 3)) where rn <= 30"""))
def p06(spark, sf):
    events, _, v, _ = frames(spark, sf)
    return R.risk_evidence(events, W.assign_windows(events), v, recent=20).select("employee_id", "event_hash", "prio", "rn")


# ------------------------------------------------------------------ statistics

@register("a07_category_counts", with_("canon", "select employee_id, category, source, count(*) as n_rows from canon group by 1, 2, 3"))
def a07(spark, sf):
    return R.category_counts(ev(spark, sf))


@register("a08_stats", with_("canon " + ALERTS, """select (select count(*) from canon) as events, (select count(*) from canon where occurred_at >= timestamp '2024-01-30') as events_today, (select count(distinct employee_id) from canon where occurred_at >= timestamp '2024-01-30') as employees,
 0::bigint as employees_named, (select count(*) from verdicts) as verdicts, (select count(*) from alerts) as alerts, (select count(*) from alerts where status <> 'CLOSED') as alerts_open"""))
def a08(spark, sf):
    events, _, v, a = frames(spark, sf)
    return R.stats(events, v, a, TODAY)


def periods(col):
    return f"""count(*) filter ({col} >= timestamp '2024-01-30') as {{p}}today, count(*) filter ({col} >= timestamp '2024-01-29' and {col} < timestamp '2024-01-30') as {{p}}yesterday"""


@register("a09_source_stats", with_("canon", "select source, " + periods("occurred_at").format(p="") + ", count(*) filter (occurred_at >= timestamp '2024-01-23') as week, count(*) as total from canon group by 1"))
def a09(spark, sf):
    return R.source_stats(ev(spark, sf), TODAY)


@register("a09_system_stats", with_("canon " + ALERTS, "select * from (select " + periods("occurred_at").format(p="events_") + """, count(*) filter (occurred_at >= timestamp '2024-01-23') as events_week, count(*) as events_total, count(*) filter (category = 'WEB') as web_total from canon),
 (select """ + periods("window_start").format(p="verdicts_") + ", count(*) as verdicts_total, count(*) filter (n % 2 = 1) as verdicts_model, count(*) filter (n % 2 = 0) as verdicts_rule from verdicts), (select " + periods("window_start").format(p="alerts_") + """, count(*) as alerts_total,
 count(*) filter (window_start >= timestamp '2024-01-30' and risk_score >= 76) as alerts_today_critical, count(*) filter (window_start >= timestamp '2024-01-30' and status = 'NEW') as alerts_today_new, count(distinct employee_id) filter (window_start >= timestamp '2024-01-30') as alerts_today_people from alerts),
 (select count(*) as exemptions from valid_ex)"""))
def a09s(spark, sf):
    events, _, v, a = frames(spark, sf)
    return R.system_stats(events, v, a, exemptions(spark), TODAY)


@register("a09_alert_breakdown", with_(ALERTS, "select scenario, status, count(*) as n, count(*) filter (window_start >= timestamp '2024-01-30') as n_today from alerts group by 1, 2"))
def a09b(spark, sf):
    return R.alert_breakdown(frames(spark, sf)[3], TODAY)


@register("a10_alerts_by_day", with_(ALERTS, """select d::varchar as day, case when d = date '2024-01-30' then (select count(*) from alerts where window_start >= timestamp '2024-01-30') else (select count(*) from alerts where cast(created_at as date) = d) end as n_alerts
 from (select cast(unnest(generate_series(timestamp '2024-01-24', timestamp '2024-01-30', interval 1 day)) as date) as d)"""))
def a10(spark, sf):
    return R.alerts_by_day(frames(spark, sf)[3], TODAY).withColumn("day", F.col("day").cast("string"))


@register("a11_top_active", with_(ALERTS, """select employee_id, scenario, risk_score, window_start from (select *, row_number() over (partition by employee_id order by window_start desc, dedup_key desc) as rn from alerts where status = 'NEW') where rn = 1
 order by risk_score desc, case scenario when 'job_seeking' then 0 when 'data_exfiltration' then 1 else 2 end, employee_id limit 10"""))
def a11(spark, sf):
    return R.top_active(frames(spark, sf)[3]).select("employee_id", "scenario", "risk_score", "window_start")


@register("a12_site_class_stats", with_("canon", """select coalesce(nullif(site_class, ''), 'unrecognised') as site_class, count(*) filter (occurred_at >= timestamp '2024-01-30') as today, count(*) filter (occurred_at < timestamp '2024-01-30') as yesterday
 from canon where category = 'WEB' and occurred_at >= timestamp '2024-01-29' group by 1"""))
def a12(spark, sf):
    return R.site_class_stats(ev(spark, sf), TODAY)


@register("a17_daily_trend", with_(ALERTS, f"""select coalesce(a.day, v.day)::varchar as day, coalesce(n_alerts, 0) as n_alerts, coalesce(n_verdicts, 0) as n_verdicts from (select cast(created_at as date) as day, count(*) as n_alerts from alerts where created_at >= timestamp '{AS_OF}' - interval 14 day group by 1) a
 full join (select cast(window_start as date) as day, count(*) as n_verdicts from verdicts where window_start >= timestamp '{AS_OF}' - interval 14 day group by 1) v on a.day = v.day"""))
def a17(spark, sf):
    _, _, v, a = frames(spark, sf)
    return R.daily_trend(v, a, AS_OF).withColumn("day", F.col("day").cast("string"))


@register("a18_today_overview", with_("canon " + ALERTS, """select (select count(distinct employee_id) from canon where occurred_at >= timestamp '2024-01-30') as people, (select count(*) from canon where occurred_at >= timestamp '2024-01-30') as events,
 (select count(*) from verdicts where window_start >= timestamp '2024-01-30') as verdicts, (select count(*) from alerts where window_start >= timestamp '2024-01-30') as alerts"""))
def a18(spark, sf):
    events, _, v, a = frames(spark, sf)
    return R.today_overview(events, v, a, TODAY)


@register("a25_weekly_digest", with_("cls exempt " + ALERTS, "").rstrip() + ", " + BOARD + ", " + EFF.replace("lower(domain)", "lower(domain)") + f""", wk as (select * from alerts where created_at >= timestamp '{AS_OF}' - interval 7 day)
 select (select count(*) from wk) as alerts, (select count(*) from wk where status = 'NEW') as alerts_new, (select count(*) from verdicts where window_start >= timestamp '{AS_OF}' - interval 7 day) as verdicts,
 (select count(*) from canon where occurred_at >= timestamp '{AS_OF}' - interval 7 day) as events, (select count(*) from canon where occurred_at >= timestamp '{AS_OF}' - interval 7 day and source = 'endpoint' and action in ('SEND','UPLOAD')) as sends,
 (select string_agg(scenario || ':' || n, ', ' order by scenario) from (select scenario, count(*) as n from wk group by 1)) as scenarios,
 (select string_agg(employee_id || ':' || score || ':' || stage, ', ' order by score desc, employee_id) from (select * from staged order by score desc, employee_id limit 5)) as board_top,
 (select string_agg(employee_id || ':' || slack_avg, ', ' order by slack_avg desc, employee_id) from (select * from eff where slack_avg > 0 order by slack_avg desc, employee_id limit 3)) as leisure_top""")
def a25(spark, sf):
    events, _, v, a = frames(spark, sf)
    board = B.risk_board(events, v, all_alerts(spark, events, v), P.rhythms(events, AS_OF), exemptions(spark), AS_OF)
    return R.weekly_digest(events, v, a, board, B.efficiency(events, AS_OF), AS_OF)


@register("a28_account_activity", with_("canon", f"select employee_id, count(*) as n_rows, max(occurred_at) as last_seen from canon where occurred_at >= timestamp '{AS_OF}' - interval 30 day group by 1"))
def a28(spark, sf):
    return ID.account_activity(ev(spark, sf), AS_OF)


@register("a29_fallback_ratio", with_("verdicts", "select count(*) as n, count(*) filter (n % 2 = 0) as n_rule, count(*) >= 20 and count(*) filter (n % 2 = 0) > count(*) * 0.5 as alarm from (select n from verdicts order by window_start desc, verdict_id limit 100) as x(n)"))
def a29(spark, sf):
    return R.fallback_ratio(frames(spark, sf)[2])


@register("j15_latest_or_clues", with_(ALERTS, """select employee_id, risk_score, 'alert' as kind from (select * from alerts where scenario = 'job_seeking' order by risk_score desc, created_at desc, dedup_key limit 10)"""))
def j15(spark, sf):
    _, _, v, a = frames(spark, sf)
    return R.latest_or_clues(a, v, exemptions(spark), "job_seeking", AS_OF).select("employee_id", "risk_score", "kind")


@register("j15_clues_without_alerts", with_("verdicts valid_ex", f"""select verdict_start as window_start, employee_id, risk_score, 'clue' as kind from (select * from (select window_start as verdict_start, employee_id, risk_score, verdict_id from verdicts where intent = 'baseline_deviation' and window_start >= timestamp '{AS_OF}' - interval 30 day order by risk_score desc, verdict_id limit 15) p
 where not exists (select 1 from valid_ex x where x.employee_id = p.employee_id and x.signal_type = 'baseline_deviation') order by risk_score desc, verdict_id limit 5)"""))
def j15b(spark, sf):
    _, _, v, a = frames(spark, sf)
    return R.latest_or_clues(a, v, exemptions(spark), "baseline_deviation", AS_OF).select("window_start", "employee_id", "risk_score", "kind")


@register("o5_distinct_ids", with_("canon " + ALERTS, "select employee_id from canon union select employee_id from verdicts union select employee_id from alerts"))
def o5(spark, sf):
    events, _, v, a = frames(spark, sf)
    return ID.distinct_ids(events, v, a)


@register("o8_distinct_employees", with_("canon", "select distinct employee_id from canon"))
def o8(spark, sf):
    return ev(spark, sf).select("employee_id").distinct()


@register("k04_alert_export", with_(ALERTS, "select employee_id, scenario, severity, risk_score, status, window_start, summary from alerts"))
def k04(spark, sf):
    return R.alert_export(frames(spark, sf)[3])


@register("k05_profile_export", with_(ALERTS, """select employee_id, 'alert' as kind, strftime(window_start, '%Y-%m-%d %H:%M') as at_time, scenario as what, risk_score as score, status, left(summary, 80) as text from alerts
 union all select employee_id, 'verdict', strftime(window_start, '%Y-%m-%d %H:%M'), intent, risk_score, '', left(explanation, 80) from (select *, row_number() over (partition by employee_id order by window_start desc, verdict_id) as rn from verdicts) where rn <= 50"""))
def k05(spark, sf):
    events, _, v, a = frames(spark, sf)
    stages = B.signal_timeline(events, v, a, AS_OF, min_kinds=99)
    return R.profile_export(a, v, stages).withColumnRenamed("at", "at_time")


K05_STORY = with_(ALERTS + " cls", "").rstrip() + ", " + TIMELINE + """ select employee_id, 'alert' as kind, strftime(window_start, '%Y-%m-%d %H:%M') as at_time, scenario as what, risk_score as score, status, left(summary, 80) as text from alerts
 union all select employee_id, 'verdict', strftime(window_start, '%Y-%m-%d %H:%M'), intent, risk_score, '', left(explanation, 80) from (select *, row_number() over (partition by employee_id order by window_start desc, verdict_id) as rn from verdicts) where rn <= 50
 union all select employee_id, 'story', '', case when j and s and m and (ns or x) then 'high' when j and (ns or s) and (m or x) then 'warn' when j and (ns or s) then 'watch' else 'observe' end, null, '', left(story, 120) from tl where n_kinds >= 2"""


@register("k05_profile_export_story", K05_STORY)
def k05_story(spark, sf):
    """The whole export: alerts, verdicts and the stage of the signal timeline."""
    events, _, v, a = frames(spark, sf)
    return R.profile_export(a, v, B.signal_timeline(events, v, all_alerts(spark, events, v), AS_OF)).withColumnRenamed("at", "at_time")


# ------------------------------------------------------------------ exports and histories in full

LABEL_SQL = "case scenario " + " ".join(f"when {q(k)} then {q(x)}" for k, x in R.SCENARIO_LABELS.items()) + " else coalesce(scenario, '') end"


@register("k04_alert_report", with_(ALERTS, f"select employee_id, {LABEL_SQL} as scenario, severity, risk_score, status, window_start, summary, row_number() over (order by risk_score desc, dedup_key)::int as place from alerts"))
def k04_report(spark, sf):
    """The report with scenario names, read back from its files in their order."""
    import os
    import uuid

    from ..session import checkpoint_dir
    out = os.path.join(checkpoint_dir(spark), "reports", uuid.uuid4().hex)
    R.write_alert_report(frames(spark, sf)[3], out)
    rows = spark.read.option("header", True).csv(out).select(F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("i"), "*")
    named = rows.withColumnRenamed([c for c in rows.columns if c.endswith("employee_id")][0], "employee_id")
    from pyspark.sql import Window
    return named.select("employee_id", "scenario", "severity", F.col("risk_score").cast("int").alias("risk_score"), "status", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "summary",
                        F.row_number().over(Window.orderBy("f", "i")).alias("place"))


@register("k06_parsed_export", with_("canon", "select occurred_at, employee_id, device_id, category, action, target_value, size_bytes, coalesce(channel, 'c' || event_id % 3) as channel, app as application, src_path as path, 'op' || event_id % 5 as op_type from canon"))
def k06_parsed(spark, sf):
    raw = F.create_map(F.lit("op_type"), F.concat(F.lit("op"), (F.col("event_id") % 5).cast("string")), F.lit("channel"), F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")))
    return R.parsed_export(ev(spark, sf).withColumn("raw", raw))


@register("a09_people_stats", with_("canon", """select count(distinct employee_id) filter (occurred_at >= timestamp '2024-01-30') as people_today,
 count(distinct employee_id) filter (occurred_at >= timestamp '2024-01-29' and occurred_at < timestamp '2024-01-30') as people_yesterday, count(distinct employee_id) as people_total,
 max(occurred_at) as latest_profile, count(distinct employee_id) as profiles from canon"""))
def a09_people(spark, sf):
    e = ev(spark, sf)
    return R.people_stats(e, e.groupBy("employee_id").agg(F.max("occurred_at").alias("built_at")), TODAY)


@register("a06_person_history", with_("verdicts cls", f"""select employee_id, 'verdict' as kind, intent as what, null::date as day, count(*) as n, max(risk_score)::int as top, null::int as days, false as lasting
  from verdicts where window_start >= timestamp '{AS_OF}' - interval 7 day group by 1, 3
 union all select employee_id, 'class', risk_class, day, n, null, count(*) over (partition by employee_id, risk_class)::int, count(*) over (partition by employee_id, risk_class) >= 4
  from (select employee_id, risk_class, cast(occurred_at as date) as day, count(*) as n from cls where risk_class is not null and occurred_at >= timestamp '{AS_OF}' - interval 7 day group by 1, 2, 3)
 union all select employee_id, 'document', left(target_value, 40), cast(occurred_at as date), 1, null, null, false
  from (select *, row_number() over (partition by employee_id order by occurred_at, event_hash) as rn from cls where category = 'DOC' and occurred_at >= timestamp '{AS_OF}' - interval 7 day
   and {sql_contains("coalesce(target_value, '')", V.get('sensitive_keywords'))}) where rn <= 5""").replace("select employee_id, 'verdict'", "select employee_id, 'verdict'", 1))
def a06_person(spark, sf):
    from ..operators import scoring as S
    events, _, v, _ = frames(spark, sf)
    return S.person_history(events, v, AS_OF)


@register("k03_stored_verdicts", with_("verdicts", "select verdict_id, employee_id, window_start, risk_score, cast(window_start as date) as window_date from verdicts"))
def k03(spark, sf):
    """Verdicts appended by day in two batches and read back."""
    import os
    import uuid

    from ..session import checkpoint_dir
    from ..sources.sinks import append_verdicts
    out = os.path.join(checkpoint_dir(spark), "verdicts", uuid.uuid4().hex)
    v = frames(spark, sf)[2]
    half = F.col("window_start") < F.lit("2024-01-15").cast("timestamp_ntz")
    for part in (v.filter(half), v.filter(~half)):
        append_verdicts(part, out)
    return spark.read.parquet(out).select("verdict_id", "employee_id", "window_start", "risk_score", "window_date")


# ------------------------------------------------------------------ jobs by the hour, day and week

def job_store(spark):
    import os
    import uuid

    from ..plans.pipeline import Store
    from ..session import checkpoint_dir
    return Store(spark, os.path.join(checkpoint_dir(spark), "jobs", uuid.uuid4().hex))


@register("t06_weekly_job", ORACLES["a25_weekly_digest"])
def t06_weekly(spark, sf):
    from ..plans.pipeline import weekly_job
    store = job_store(spark)
    events, _, v, a = frames(spark, sf)
    weekly_job(store, events, v, a, exemptions(spark), AS_OF, "1", all_alerts(spark, events, v))
    return spark.read.parquet(store.path("digest/version=1"))


@register("t06_nightly_job", with_("verdicts", "select verdict_id, employee_id, window_start, window_end, n, visits from verdicts where window_end + interval 60 minute < timestamp '2024-01-31 00:00:00'"))
def t06_nightly(spark, sf):
    """All days up to the 29th in one night, then a night that reads one day."""
    import datetime as dt

    from ..operators.alerts import no_alerts
    from ..plans.pipeline import nightly_job
    store, events, alerts = job_store(spark), stored_ev(spark, sf), no_alerts(spark)
    for day in (29, 30):
        nightly_job(store, events, alerts, exemptions(spark), dt.date(2024, 1, day), str(day), suppress=False)
        alerts = spark.read.parquet(store.path(f"alerts/version={day}"))
    return spark.read.parquet(store.path("verdicts")).select("verdict_id", "employee_id", "window_start", "window_end", "n", "visits")


@register("t06_hourly_job", with_("canon", """select employee_id as feed, max(occurred_at) as last_at from canon where occurred_at <= timestamp '2024-01-30 12:00:00'
 group by 1 having epoch_us(timestamp '2024-01-30 12:00:00') - epoch_us(max(occurred_at)) > 2 * 3600000000"""))
def t06_hourly(spark, sf):
    from ..plans.pipeline import hourly_job
    store = job_store(spark)
    events, _, _, a = frames(spark, sf)
    raw = events.select(F.col("employee_id").alias("feed"), F.col("occurred_at").alias("received_at"))
    return hourly_job(store, raw, a, "2024-01-30 12:00:00", "1").select("feed", "last_at")
