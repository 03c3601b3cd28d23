"""Patterns, risk boards and suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import patterns as X
from ..operators import profiles as P
from ..operators import scoring as S
from ..operators import windows as W
from ..plans import boards as B
from ..plans import rules as R
from .base import *

DOCS = "docs as (select *, lower(coalesce(target_value, '')) as name, cast(occurred_at as date) as day from cls where category = 'DOC' and source = 'endpoint')"
SENDS = DOCS + ", sends as (select * from docs where action in ('SEND','UPLOAD') and not wl)"
RELATED = r"""rel as (select s.event_id, min(a.occurred_at) as archived_at from sends s join docs a on a.employee_id = s.employee_id and a.action = 'ARCHIVE' and a.name <> '' and s.name <> ''
 and (contains(s.name, a.name) or contains(a.name, s.name) or (regexp_replace(s.name, '\.(zip|rar|7z|tar|gz)$', '') <> '' and contains(a.name, regexp_replace(s.name, '\.(zip|rar|7z|tar|gz)$', ''))))
 group by 1)"""


def archive_sql(order: str) -> str:
    return with_("cls", "").rstrip() + ", " + SENDS + ", " + RELATED + f""" select employee_id, 'archive_exfil' as scenario, 85 as risk_score, 'CRITICAL' as severity,
 employee_id || '|archive_send|' || day as dedup_key, min(occurred_at) as window_start, count(*) as n_sends
 from sends join rel using (event_id) {order} group by employee_id, day"""


@register("d03_archive_then_send", archive_sql(""))
def d03(spark, sf):
    return X.archive_then_send(ev(spark, sf)).select("employee_id", "scenario", "risk_score", "severity", "dedup_key", "window_start", "n_sends")


@register("d03_archive_then_send_ordered", archive_sql("where archived_at <= occurred_at"))
def d03o(spark, sf):
    return X.archive_then_send(ev(spark, sf), require_order=True).select(
        "employee_id", "scenario", "risk_score", "severity", "dedup_key", "window_start", "n_sends")


@register("j10_related_names", with_("cls", "").rstrip() + ", " + SENDS + """ select distinct s.employee_id, a.name as needle, s.name from sends s join docs a on a.employee_id = s.employee_id
 and a.action = 'ARCHIVE' and a.name <> '' and contains(s.name, a.name)""")
def j10(spark, sf):
    docs = X.recent_docs(ev(spark, sf), None).withColumn("name", F.lower("target_value"))
    return X.contained_names(docs.filter("action = 'ARCHIVE'").select("employee_id", F.col("name").alias("needle")), X.sends(docs))


RENAMES = SENDS + r""", ren as (select *, lower(split_part(coalesce(nullif(src_path, ''), target_value), '\', -1)) as old, lower(split_part(coalesce(dest_path, ''), '\', -1)) as new
 from docs where action = 'RENAME'), dis as (select * from ren where old <> '' and new <> '' and len(new) < len(old) * 0.5 and not regexp_matches(new, '[一-鿿]')),
 pairs as (select d.event_id, d.employee_id, d.occurred_at, d.day, d.old, d.new, min(s.occurred_at) as sent_at from dis d join sends s on s.employee_id = d.employee_id and contains(s.name, d.new) group by all)"""


@register("j11_rename_pairs", with_("cls", "").rstrip() + ", " + RENAMES + " select distinct d.employee_id, d.new as needle, s.name from dis d join sends s on s.employee_id = d.employee_id and contains(s.name, d.new)")
def j11(spark, sf):
    docs = X.recent_docs(ev(spark, sf), None)
    leaf = lambda c: F.lower(F.substring_index(c, "\\", -1))
    ren = docs.filter("action = 'RENAME'").select("employee_id", leaf("src_path").alias("old"), leaf("dest_path").alias("needle"))
    ren = ren.filter("needle <> '' and length(needle) * 2 < length(old)").filter(~F.col("needle").rlike("[一-鿿]"))
    return X.contained_names(ren, X.sends(docs).withColumn("name", F.lower("target_value")))


@register("d04_rename_disguise", with_("cls", "").rstrip() + ", " + RENAMES + """ select employee_id, 'rename_exfil' as scenario, 80 as risk_score, employee_id || '|rename_exfil|' || day as dedup_key,
 arg_min(sent_at, (occurred_at, new)) as window_start, arg_min(old, (occurred_at, new)) as old, arg_min(new, (occurred_at, new)) as new from pairs group by employee_id, day""")
def d04(spark, sf):
    return X.rename_disguise(ev(spark, sf)).select("employee_id", "scenario", "risk_score", "dedup_key", "window_start", "old", "new")


@register("d05_trend_spike", with_("cls", """select employee_id, cur, prev, 75 as risk_score, employee_id || '|trend_exfil|2024-01-31' as dedup_key from (select employee_id,
 count(*) filter (occurred_at >= timestamp '2024-01-24') as cur, count(*) filter (occurred_at < timestamp '2024-01-24') as prev from cls
 where source = 'endpoint' and action in ('SEND','UPLOAD') and not wl and occurred_at >= timestamp '2024-01-17' group by 1) where prev >= 1 and cur >= prev * 2"""))
def d05(spark, sf):
    return X.trend_spike(ev(spark, sf), AS_OF, min_prev=1, factor=2).select("employee_id", "cur", "prev", "risk_score", "dedup_key")


@register("d06_mass_delete", with_("cls", "").rstrip() + ", " + DOCS + """, g as (select employee_id, day, count(*) as ops, count(distinct trim(target_value)) as files, max(occurred_at) as window_start,
 min(hour(occurred_at))::int as hour_from, max(hour(occurred_at))::int as hour_to from docs where action = 'DELETE' and not noise_doc group by 1, 2 having count(*) >= 2)
 select employee_id, ops, files, window_start, hour_from, hour_to, case when ops >= 3 then 80 else 70 end as risk_score, employee_id || '|mass_delete|' || day as dedup_key,
 (select string_agg(f, '; ' order by f) from (select distinct trim(target_value) as f from docs d where d.employee_id = g.employee_id and d.day = g.day and action = 'DELETE' and not noise_doc order by 1 limit 4)) as samples from g""")
def d06(spark, sf):
    return X.mass_delete(ev(spark, sf), min_ops=2, min_files=1, high_ops=3, by_day=True).select(
        "employee_id", "ops", "files", "window_start", "hour_from", "hour_to", "risk_score", "dedup_key", "samples")


@register("d07_mass_exfil", with_("cls", "").rstrip() + ", " + SENDS + """ select employee_id, count(*) as ops, sum(size_bytes)::bigint as bytes, max(occurred_at) as window_start,
 case when count(*) >= 4 or sum(size_bytes) >= 40 * 1048576 then 85 else 75 end as risk_score, employee_id || '|mass_exfil|' || day as dedup_key
 from sends group by employee_id, day having count(*) >= 2 or sum(size_bytes) >= 20 * 1048576""")
def d07(spark, sf):
    return X.mass_exfil(ev(spark, sf), min_ops=2, min_mb=20, by_day=True).select(
        "employee_id", "ops", "bytes", "window_start", "risk_score", "dedup_key")


@register("a24_shared_files", with_("cls", """select lower(trim(target_value)) as file, count(distinct employee_id) as n_people from cls where category = 'DOC' and source = 'endpoint'
 and action in ('SEND', 'ARCHIVE') and len(trim(target_value)) >= 5 group by 1 having count(distinct employee_id) >= 2 order by 2 desc, 1 limit 20"""))
def a24(spark, sf):
    return B.shared_file_board(ev(spark, sf), None, actions=("SEND", "ARCHIVE"))


# ------------------------------------------------------------------ verdict post-processing

@register("d12_reconcile", with_("verdicts", """select verdict_id, case when risk_score >= 50 and r is not null then case when r >= 50 then coalesce(anchored, greatest(risk_score, r)) when anchored is not null then risk_score else greatest(r, 30) end else risk_score end::int as risk_score,
 case when risk_score >= 50 and coalesce(r, 0) >= 50 then 'policy_violation' else intent end as intent from (select *, case when visits % 3 < 2 then ((n * 37 + visits * 11 + len(employee_id) * 5) % 100)::int end as r from verdicts)"""))
def d12(spark, sf):
    v = verdict_frames(spark, sf)[2]
    review = v.filter("visits % 3 < 2").select("verdict_id", ((F.col("n") * 37 + F.col("visits") * 11 + F.length("employee_id") * 5) % 100).cast("int").alias("review_score"),
                                               F.lit("policy_violation").alias("review_intent"), F.lit("second opinion").alias("review_text"))
    return S.reconcile(v, review).select("verdict_id", "risk_score", "intent")


@register("d13_annotate_exempt", with_("verdicts valid_ex", """select v.verdict_id, case when x.employee_id is not null then '[exempt:' || coalesce(nullif(x.reason, ''), 'role') || '] ' || v.explanation else v.explanation end as explanation
 from verdicts v left join valid_ex x on x.employee_id = v.employee_id and x.signal_type = v.intent"""))
def d13(spark, sf):
    return S.annotate_exempt(verdict_frames(spark, sf)[2], exemptions(spark), AS_OF).select("verdict_id", "explanation")


@register("d14_prefix_facts", with_("verdicts wsite", "").rstrip() + """, hit as (select v.verdict_id, s.*, row_number() over (partition by v.verdict_id order by s.visits desc, s.site) as rn from verdicts v join wsite s using (employee_id, window_start)
 where (v.intent = 'job_seeking' and s.risk_class = 'recruitment') or (v.intent = 'policy_violation' and s.risk_class in ('netdisk','personal_email')) or (v.intent = 'data_exfiltration' and s.risk_class in ('file_helper','netdisk','personal_email'))),
 txt as (select verdict_id, string_agg(risk_class || '(' || site || ')×' || visits, ', ' order by rn) as t from hit where rn <= 3 group by 1)
 select v.verdict_id, case when t is not null then 'Visited ' || t || '. ' || v.explanation else v.explanation end as explanation from verdicts v left join txt using (verdict_id)""")
def d14(spark, sf):
    events, facts, v = verdict_frames(spark, sf)
    return S.prefix_facts(v, W.window_sites(facts)).select("verdict_id", "explanation")


# ------------------------------------------------------------------ boards over verdicts

ALERTS_ALL = """mass as (select employee_id, day, count(*) as ops from (select *, cast(occurred_at as date) as day from cls where category = 'DOC' and source = 'endpoint' and action = 'DELETE' and not noise_doc) group by 1, 2 having count(*) >= 2),
 massa as (select employee_id || '|mass_delete|' || day as dedup_key, employee_id, 'mass_delete' as scenario, case when ops >= 3 then 80 else 70 end as risk_score, cast(day as timestamp) as created_at from mass)"""


def all_alerts(spark, events, verdicts):
    """Merged alerts plus the mass-delete rows of every day, dated by their day."""
    merged = alert_frame(spark, verdicts)
    mass = X.mass_delete(events, min_ops=2, min_files=1, high_ops=3, by_day=True)
    rows = (mass.select(*X.ALERT_COLUMNS, F.col("day").cast("timestamp_ntz").alias("created_at"))
            .withColumn("status", F.lit("NEW")).withColumn("verdict_id", F.lit(None).cast("string")))
    return merged.unionByName(rows.select(*A.ALERT_COLUMNS))


BOARD = ALERTS_ALL + f""", t7 as (select timestamp '{AS_OF}' - interval 7 day as s),
 sig as (
  select v.employee_id, 'job' as k, max(risk_score) as sc from verdicts v, t7 where window_start >= s and intent = 'job_seeking' and risk_score >= 50 and not exists (select 1 from exempt x where x.employee_id = v.employee_id and x.signal_type = 'job_seeking') group by 1
  union all select employee_id, 'exfil', max(sc) from (select a.employee_id, risk_score as sc from alerts a, t7 where created_at >= s and scenario = 'data_exfiltration' and not exists (select 1 from exempt x where x.employee_id = a.employee_id and x.signal_type = 'data_exfiltration')
    union all select employee_id, 60 from cls, t7 where source = 'endpoint' and occurred_at >= s and action in ('SEND','UPLOAD') and not wl and coalesce(dest_path, '') <> '') group by 1
  union all select employee_id, 'delete', arg_max(risk_score, (created_at, dedup_key)) from massa, t7 where created_at >= s group by 1
  union all select employee_id, 'search', max(risk_score) from verdicts, t7 where window_start >= s and intent = 'job_seeking' and risk_score >= 30 and (contains(explanation, 'search') or contains(explanation, 'resume')) group by 1),
 wide as (select employee_id, coalesce(max(sc) filter (k = 'job'), 0)::int as job, coalesce(max(sc) filter (k = 'exfil'), 0)::int as exfil, coalesce(max(sc) filter (k = 'delete'), 0)::int as "delete", coalesce(max(sc) filter (k = 'search'), 0)::int as search from sig group by 1),
 late as (select employee_id from (select employee_id, cast(occurred_at as date) as d, min(hour(occurred_at)) as h from cls where occurred_at >= timestamp '{AS_OF}' - interval 30 day group by 1, 2) where h < 7 group by 1 having count(*) >= 3),
 wn as (select *, case when exists (select 1 from late l where l.employee_id = wide.employee_id) then 50 else 0 end as night from wide),
 sc as (select *, ((job > 0)::int + (exfil > 0)::int + ("delete" > 0)::int + (search > 0)::int + (night > 0)::int) as signals from wn),
 board as (select *, least(((30 * job + 25 * exfil + 20 * "delete" + 15 * search + 10 * night) // 100) + case when signals > 1 then (signals - 1) * 8 else 0 end, 100)::int as score from sc),
 staged as (select employee_id, score, case when signals >= 4 or score >= 80 then 'high' when signals >= 3 or score >= 65 then 'warn' when signals >= 2 or score >= 45 then 'watch' else 'observe' end as stage, signals, job, exfil, "delete", search, night from board)"""


def board(spark, sf, most):
    events, _, v = verdict_frames(spark, sf)
    return B.risk_board(events, v, all_alerts(spark, events, v), P.rhythms(events, AS_OF), exemptions(spark), AS_OF, most=most)


@register("d17_risk_board", with_("verdicts alerts exempt cls", "").rstrip() + ", " + BOARD + " select * from staged")
def d17(spark, sf):
    return board(spark, sf, None)


@register("o2_top_boards", with_("verdicts alerts exempt cls", "").rstrip() + ", " + BOARD + " select employee_id, score, stage from staged order by score desc, employee_id limit 10")
def o2(spark, sf):
    return board(spark, sf, 10).select("employee_id", "score", "stage")


@register("d17_risk_board_top", with_("verdicts alerts exempt cls", "").rstrip() + ", " + BOARD + " select * from staged order by score desc, employee_id limit 30")
def d17_top(spark, sf):
    return board(spark, sf, 30)


TIMELINE = ALERTS_ALL + f""", t30 as (select timestamp '{AS_OF}' - interval 30 day as s),
 ent as (select employee_id, 'job_visit' as kind, window_start as seen, strftime(window_start, '%m-%d %H') || ' score ' || risk_score as entry from verdicts, t30 where window_start >= s and intent = 'job_seeking' and risk_score >= 50
  union all select employee_id, 'mass_delete', created_at, strftime(created_at, '%m-%d %H') from massa, t30 where created_at >= s
  union all select employee_id, 'exfil_alert', window_start, strftime(window_start, '%m-%d %H') || ' score ' || risk_score from alerts, t30 where created_at >= s and scenario = 'data_exfiltration'
  union all select employee_id, 'network_send', occurred_at, strftime(occurred_at, '%m-%d %H') || ' ' || left(coalesce(target_value, ''), 36) || '→' || left(lower(split_part(coalesce(dest_path, ''), '/', 1)), 30) from cls, t30 where source = 'endpoint' and occurred_at >= s and category = 'DOC' and action in ('SEND','UPLOAD') and away
  union all select employee_id, 'search', occurred_at, strftime(occurred_at, '%m-%d %H') || ' ' || left(target_value, 20) from cls, t30 where source = 'endpoint' and occurred_at >= s and category = 'SEARCH' and coalesce(target_value, '') <> ''),
 rk as (select *, row_number() over (partition by employee_id, kind order by seen desc, entry) as rn from ent),
 kt as (select employee_id, kind, string_agg(entry, '; ' order by rn desc) as entries from rk where rn <= 8 group by 1, 2),
 tl as (select employee_id, count(*) as n_kinds, bool_or(kind = 'job_visit') as j, bool_or(kind = 'mass_delete') as m, bool_or(kind = 'exfil_alert') as x, bool_or(kind = 'network_send') as ns, bool_or(kind = 'search') as s,
   string_agg('[' || kind || '] ' || entries, chr(10) order by kind) as story from kt group by 1)"""


@register("d18_signal_timeline", with_("verdicts alerts cls", "").rstrip() + ", " + TIMELINE + """ select employee_id, n_kinds, case when j and s and m and (ns or x) then 'high' when j and (ns or s) and (m or x) then 'warn' when j and (ns or s) then 'watch' else 'observe' end as stage, story
 from tl where n_kinds >= 2""")
def d18(spark, sf):
    events, _, v = verdict_frames(spark, sf)
    return B.signal_timeline(events, v, all_alerts(spark, events, v), AS_OF)


# ------------------------------------------------------------------ dictionary maintenance

LAB = "coalesce(site_class, app, '')"
UNCL = f"""cnt as (select trim(domain) as dom, count(*) as n_rows, min({LAB}) as label from cls where category = 'WEB' group by 1),
 free as (select *, {sql_contains('lower(dom)', vocab.REVIEW_KEYWORDS)} as hinted, row_number() over (order by n_rows desc, dom) as rn from cnt where ({sql_risk('dom')}) is null and ({sql_leisure('dom', 'label')}) is null and not {sql_suffix('dom', V.get('work_domains'))}),
 uncl as (select dom as domain, n_rows, label from free where (rn <= 60 or hinted) and len(dom) < 90 and not {sql_contains('lower(dom)', vocab.REVIEW_NOISE)} order by (rn > 60), n_rows desc, dom limit 20)"""
TRANS = f"""trans as (select lower(trim(domain)) as domain, count(*) as n_hits, count(distinct employee_id) as n_people from cls where category = 'WEB' and occurred_at >= timestamp '{AS_OF}' - interval 30 day
 and {sql_contains('url', vocab.TRANSFER_FRAGMENTS)} group by 1 having count(*) >= 3 and count(distinct employee_id) <= {{most}}),
 ftrans as (select * from trans where domain not in (select domain from uncl) order by n_people, n_hits desc, domain limit 10)"""
HEART = f"""hg as (select trim(domain) as dom, employee_id, cast(occurred_at as date) as d, count(*) as n, epoch_us(max(occurred_at)) - epoch_us(min(occurred_at)) as span from cls
 where category = 'WEB' and occurred_at >= timestamp '{AS_OF}' - interval 7 day and ({sql_leisure('domain', LAB)}) is not null group by 1, 2, 3),
 heart as (select dom as domain, sum(n)::bigint as n_rows, count(*) filter (n >= 1) as n_groups, count(*) filter (n >= 1 and span >= n * 60000000) as n_sparse from hg group by 1
 having sum(n) >= 3 and count(*) filter (n >= 1) >= 2 and count(*) filter (n >= 1 and span >= n * 60000000) >= greatest(2, count(*) filter (n >= 1) // 2 * 0 + 2) order by n_groups desc, domain limit 8)"""


@register("a19_unclassified_domains", with_("cls", "").rstrip() + ", " + UNCL + " select * from uncl")
def a19(spark, sf):
    return R.unclassified_domains(ev(spark, sf))


# Hosts of at most ten people each, so that the rule "few people" decides at its default.
RARE_SQL = "case when category = 'WEB' and len(employee_id) <= 3 then '1cdn-drop' || right(employee_id, 1) || '.example' else domain end"
RARE_CLS = with_("cls", "").rstrip().replace(f"canon as ({CTES['canon']})", f"canon as (select * replace ({RARE_SQL} as domain) from ({CTES['canon']}))")


def rare_hosts(spark, sf):
    rare = F.concat(F.lit("1cdn-drop"), F.right("employee_id", F.lit(1)), F.lit(".example"))
    return ev(spark, sf).withColumn("domain", F.when((F.col("category") == "WEB") & (F.length("employee_id") <= 3), rare).otherwise(F.col("domain")))


@register("a20_transfer_domains", RARE_CLS + ", " + UNCL + ", " + TRANS.format(most=10) + " select * from ftrans")
def a20(spark, sf):
    e = rare_hosts(spark, sf)
    return R.transfer_domains(e, AS_OF, listed=R.unclassified_domains(e))


HEART_SQL = HEART.replace(" >= greatest(2, count(*) filter (n >= 1) // 2 * 0 + 2)", " >= greatest(2, count(*) filter (n >= 1) // 2)").replace("n >= 1", "n >= 2").replace("span >= n * 60000000", "span >= n * 15 * 60000000")


@register("a21_heartbeat_domains", with_("cls", "").rstrip() + ", " + HEART_SQL + " select * from heart")
def a21(spark, sf):
    return R.heartbeat_domains(ev(spark, sf), AS_OF, min_rows=3, min_group=2)


@register("d19_rule_suggestions", RARE_CLS + ", " + UNCL + ", " + TRANS.format(most=10) + ", " + HEART_SQL + """
 select domain, 'suspect_new' as target, n_rows as hits, 'unclassified domain' as reason from uncl
 union all select domain, 'suspect_new', n_hits, 'upload-like requests by few people' from ftrans
 union all select domain, 'slack_sdk_domains', n_groups, 'regular sparse background traffic' from heart""")
def d19(spark, sf):
    e = rare_hosts(spark, sf)
    listed = R.unclassified_domains(e)
    return R.rule_suggestions(listed, R.transfer_domains(e, AS_OF, listed=listed),
                              R.heartbeat_domains(e, AS_OF, min_rows=3, min_group=2))


@register("l14_suggestion_triage", RARE_CLS + ", " + UNCL + ", " + TRANS.format(most=10) + ", " + HEART_SQL + """
 select domain, 'hot' as urgency from uncl union all select domain, 'hot' from ftrans union all select domain, 'risk' from heart""")
def l14(spark, sf):
    e = rare_hosts(spark, sf)
    listed = R.unclassified_domains(e)
    return R.triage(R.rule_suggestions(listed, R.transfer_domains(e, AS_OF, listed=listed), R.heartbeat_domains(e, AS_OF, min_rows=3, min_group=2))).select("domain", "urgency")
