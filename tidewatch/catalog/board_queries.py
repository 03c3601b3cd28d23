"""Boards about people."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.base import text
from ..operators import digest as G
from ..operators import fold as FO
from ..operators import windows as W
from ..plans import boards as B
from .base import *
from .window_queries import FOLDED, PROFILE_SQL, SEGS


@register("a15_who_visited", with_("cls", f"""select employee_id, count(*) as n_rows from cls where risk_class = 'netdisk' and occurred_at >= timestamp '{AS_OF}' - interval 30 day group by 1 order by 2 desc, 1 limit 20"""))
def a15(spark, sf):
    return B.who_visited(ev(spark, sf), AS_OF, "netdisk")


@register("a15_who_visited_folded", with_("canon", "").rstrip() + ", " + FOLDED + f""" select employee_id, count(*) as n_rows from folded where ({sql_risk('lower(domain)')}) = 'netdisk' and occurred_at >= timestamp '{AS_OF}' - interval 30 day group by 1 order by 2 desc, 1 limit 20""")
def a15f(spark, sf):
    return B.who_visited(FO.fold_web(ev(spark, sf)), AS_OF, "netdisk")


@register("a16_attendance", with_("canon", f"""select employee_id, bool_or(d = date '2024-01-30') as active_today, count(*) as active_days, min(h)::int as earliest_hour, case when count(*) <= 1 then 'one day or less' when min(h) < 7 then 'early activity' end as remark
 from (select employee_id, cast(occurred_at as date) as d, min(hour(occurred_at)) as h from canon where occurred_at >= timestamp '{TODAY}' - interval 30 day group by 1, 2) group by 1"""))
def a16(spark, sf):
    return B.attendance(ev(spark, sf), TODAY)


@register("o7_absent_people", with_("canon", f"""select distinct employee_id from canon where occurred_at >= timestamp '{TODAY}' - interval 30 day except select employee_id from canon where occurred_at >= timestamp '2024-01-30'"""))
def o7(spark, sf):
    return B.absent_people(ev(spark, sf), TODAY)


EFF_SINCE = "occurred_at >= timestamp '2024-01-25'"
CAT_SEGS = SEGS.replace("from canon where category = 'WEB'", f"from canon where category = 'WEB' and {EFF_SINCE}")
CAT2 = """cseq as (select *, case when lag(occurred_at) over w is null or occurred_at - lag(occurred_at) over w > interval 15 minute then 1 else 0 end as cb from fun window w as (partition by employee_id, leisure, cast(occurred_at as date) order by occurred_at, event_id)),
 cnum as (select *, sum(cb) over (partition by employee_id, leisure, cast(occurred_at as date) order by occurred_at, event_id rows unbounded preceding) as cno from cseq),
 cseg as (select employee_id, leisure, cast(occurred_at as date) as day, cno, greatest(least(epoch_us(max(occurred_at)) - epoch_us(min(occurred_at)), count(*) * 600000000), 300000000) as us from cnum group by 1, 2, 3, 4),
 ccap as (select *, sum(us) over (partition by employee_id, leisure, day) as dus from cseg),
 cats as (select employee_id, string_agg(leisure || ':' || m, ',' order by leisure) as cats from (select employee_id, leisure, round_even(sum(case when dus > 25200000000 then floor(us * 25200 / dus) else us / 1000000.0 end)::double / 60, 0)::bigint as m from ccap group by 1, 2) group by 1)"""
EFF = CAT_SEGS + ", " + CAT2 + f""", wv as (select *, {sql_leisure('lower(domain)', "coalesce(site_class, app, '')")} as lz, ({sql_suffix('lower(domain)', V.get('work_domains'))} and ({sql_risk('lower(domain)')}) is null) as wk, {WORK.format(t='occurred_at')} as wh from canon where category = 'WEB' and {EFF_SINCE}),
 pp as (select employee_id, coalesce(sum("count") filter (wh), 0)::bigint as total, coalesce(sum("count") filter (wh and lz is not null), 0)::bigint as slack, coalesce(sum("count") filter (wh and lz is null and wk), 0)::bigint as work,
  count(distinct cast(occurred_at as date)) filter (wh) as active_days, min(hour(occurred_at))::int as hour_min, max(hour(occurred_at))::int as hour_max from wv group by 1),
 ds as (select employee_id, sum(sec) as sec, max(sec) as mx, sum(k) as segs, sum(one) as single from (select employee_id, day, sum(seconds) as sec, count(*) as k, count(*) filter (n = 1) as one from segs group by 1, 2) group by 1),
 eff as (select p.employee_id, total, slack, work, active_days, hour_min, hour_max, round_even(coalesce(sec, 0) / 60 / greatest(active_days, 1), 0)::bigint as slack_avg, round_even(coalesce(mx, 0) / 60, 0)::bigint as max_span,
  round_even(least(coalesce(sec, 0) / 60 / (greatest(active_days, 1) * 420) * 100, 100), 1) as pct, case when total > 0 then round_even(work / total * 100, 1) else 0.0 end::double as work_pct, coalesce(cats, '') as cats,
  coalesce(segs >= 8 and single / segs >= 0.7, false) as sparse, slack + work as classified from pp p left join ds using (employee_id) left join cats using (employee_id))"""


@register("a13_efficiency", with_("canon", "").rstrip() + ", " + EFF + " select * from eff")
def a13(spark, sf):
    return B.efficiency(ev(spark, sf), AS_OF)


@register("a14_efficiency_digest", with_("canon", "").rstrip() + ", " + CAT_SEGS + """, per as (select employee_id, cast(occurred_at as date) as day, leisure, sum("count")::bigint as v, count(*) as k from fun group by 1, 2, 3),
 dt as (select employee_id, day, sum(k) as k, string_agg(leisure || ' ' || v, ', ' order by v desc, leisure) as t from per group by 1, 2),
 pt as (select employee_id, sum(k)::bigint as n_rows, string_agg(strftime(day, '%m-%d') || ' ' || t, '; ' order by day) as days from dt group by 1 having sum(k) >= 1)
 select employee_id, n_rows, (select floor(sum(seconds) / 60)::bigint from segs s where s.employee_id = pt.employee_id) as minutes, days from pt""")
def a14(spark, sf):
    return G.efficiency_digest(ev(spark, sf), AS_OF, min_rows=1)


@register("a22_night_board", with_("cls", f"""select p.employee_id, night_events, coalesce(t, '') as top_domains from (select employee_id, count(*) as night_events from cls where off and occurred_at >= timestamp '{AS_OF}' - interval 7 day group by 1 having count(*) >= 5 order by 2 desc, 1 limit 20) p
 left join (select employee_id, string_agg(site, ',' order by rn) as t from (select *, row_number() over (partition by employee_id order by k desc, site) as rn from (select employee_id, site, count(*) as k from cls where off and occurred_at >= timestamp '{AS_OF}' - interval 7 day and site is not null and risk_class is null
  and not {sql_prefix('site', vocab.NIGHT_HOST_PREFIXES)} group by 1, 2)) where rn <= 3 group by 1) d on d.employee_id = p.employee_id"""))
def a22(spark, sf):
    return B.night_board(ev(spark, sf), AS_OF, min_rows=5)


@register("j14_user_overview", with_("canon verdicts alerts", f"""select e.*, max_risk, coalesce(alert_count, 0) as alert_count from (select employee_id, count(*) as event_count, count(*) filter (occurred_at >= timestamp '2024-01-30') as event_count_today, max(occurred_at) as last_seen from canon group by 1) e
 left join (select employee_id, max(risk_score) as max_risk from verdicts where window_start >= timestamp '{TODAY}' - interval 7 day group by 1) v using (employee_id)
 left join (select employee_id, count(*) as alert_count from alerts where window_start >= timestamp '{TODAY}' - interval 7 day group by 1) a using (employee_id)"""))
def j14(spark, sf):
    events, _, v = verdict_frames(spark, sf)
    return B.user_overview(events, v, alert_frame(spark, v), TODAY)


@register("j16_person_cards", with_("canon verdicts alerts", """select e.*, coalesce(verdict_count, 0) as verdict_count, max_risk, coalesce(alert_count, 0) as alert_count, alert_list from
 (select employee_id, count(*) filter (category = 'DOC') as n_doc, count(*) filter (category = 'WEB') as n_web, count(*) filter (category = 'SEARCH') as n_search, count(*) filter (source = 'endpoint') as n_endpoint, count(*) filter (source <> 'endpoint') as n_proxy from canon group by 1) e
 left join (select employee_id, count(*) as verdict_count, max(risk_score) as max_risk from verdicts group by 1) v using (employee_id)
 left join (select employee_id, count(*) as alert_count, string_agg(scenario || ':' || risk_score || ':' || status, ',' order by risk_score desc, dedup_key) as alert_list from alerts group by 1) a using (employee_id)"""))
def j16(spark, sf):
    events, _, v = verdict_frames(spark, sf)
    return B.person_cards(events, v, alert_frame(spark, v))


@register("a31_judged_sites", with_("verdicts wsite", """select * from (select employee_id, risk_class, site, sum(n_rows)::bigint as n_rows, row_number() over (partition by employee_id order by sum(n_rows) desc, site)::int as rn
 from wsite s join verdicts v using (employee_id, window_start) group by employee_id, risk_class, site) where rn <= 15""".replace("s.employee_id", "employee_id")))
def a31(spark, sf):
    _, facts, v = verdict_frames(spark, sf)
    return B.judged_sites(v, W.window_sites(facts))


NL = "chr(10)"
SITE_LINE = ("site || ' ×' || v || case when " + sql_prefix("site", vocab.TELEMETRY_PREFIXES)
             + " then ' (background traffic)' else '' end || coalesce(' [' || label || ']', '')")
DIGEST_SQL = with_("win", "").rstrip() + f""", ws as (select employee_id, window_start, site, risk_class, sum("count")::bigint as v, min(coalesce(nullif(app, ''), nullif(site_class, ''))) as label from win where category = 'WEB' group by 1, 2, 3, 4),
 rk as (select *, row_number() over (partition by employee_id, window_start, risk_class is null order by v desc, site) as rn from ws),
 strong as (select employee_id, window_start, string_agg('[!' || risk_class || '] ' || {SITE_LINE}, {NL} order by rn) as t from rk where risk_class is not null and rn <= 10 group by 1, 2),
 plain as (select employee_id, window_start, string_agg('[web] ' || {SITE_LINE}, {NL} order by rn) filter (rn <= 15) as t, count(*) as n from rk where risk_class is null group by 1, 2),
 oth as (select *, row_number() over (partition by employee_id, window_start order by occurred_at, event_hash) as rn from win where category <> 'WEB'),
 other as (select employee_id, window_start, count(*) as n, string_agg(strftime(occurred_at, '%m-%d %H:%M') || ' [' || source || '] [' || action || '] ' || coalesce(target_value, '') || case when category = 'DOC' then ' (channel=' || coalesce(channel, '') || ')' else '' end
   || case when action in ('SEND','UPLOAD','PRINT') and coalesce(dest_path, '') <> '' then ' → ' || left(dest_path, 60) else '' end, {NL} order by rn) filter (rn <= 12) as t from oth group by 1, 2),
 h as (select employee_id, window_start, min(hour(occurred_at)) filter (category = 'WEB') as h0, max(hour(occurred_at)) filter (category = 'WEB') as h1 from win group by 1, 2),
 body as (select h.employee_id, h.window_start, concat_ws({NL}, case when h0 < 7 or h1 >= 22 then '[night] visits between ' || h0 || ' and ' || h1 end, s.t, p.t, case when p.n > 15 then '... and ' || (p.n - 15) || ' more hosts' end, o.t,
   case when o.n > 12 then '... and ' || (o.n - 12) || ' more rows' end) as b from h left join strong s using (employee_id, window_start) left join plain p using (employee_id, window_start) left join other o using (employee_id, window_start))
 select employee_id, window_start, case when len(b) > 1500 then left(b, 1500) || {NL} || '... cut' else b end as digest from body"""


@register("d15_window_digest", DIGEST_SQL)
def d15(spark, sf):
    return G.window_digest(W.assign_windows(ev(spark, sf)))


def listed(col: str, n: int, pattern: str = r":(\d+)$", to: str = r"×\1") -> str:
    return f"array_to_string(list_transform(string_split({col}, ',')[1:{n}], lambda x: regexp_replace(x, '{pattern}', '{to}')), ', ')"


PROFILE_TEXT = f"""select employee_id, sample_count, case when sample_count >= 15 then '[baseline ' || case when sample_count >= 50 then 'mature' else 'thin' end || ', ' || sample_count || ' rows] hours '
 || list_min(list_transform(string_split(hours, ','), lambda x: x::int)) || '-' || list_max(list_transform(string_split(hours, ','), lambda x: x::int)) || '; per day ~' || daily_median || ' max ' || daily_max
 || '; channels ' || replace(channels, ',', '/') || '; hosts ' || array_to_string(string_split(domains, ',')[1:8], ', ') || '; ' || concat_ws('; ', case when exts <> '' then 'file types ' || {listed('exts', 5)} end,
 case when codes <> '' then 'codes ' || {listed('codes', 6, ':[0-9]+$', '')} end, case when sends <> '' then 'sends ' || {listed('sends', 4)} end,
 'rhythm ' || start_median || '-' || end_median || ', night days ' || late_night_days, case when topics <> '' then 'searches ' || array_to_string(string_split(topics, ',')[1:5], ', ') end) end as digest from ({PROFILE_SQL})"""


@register("d16_profile_digest", PROFILE_TEXT)
def d16(spark, sf):
    from ..operators.profiles import profiles
    return G.profile_digest(profiles(ev(spark, sf), AS_OF))


@register("a26_document_digest", with_("cls", "").rstrip() + f""", r as (select *, action || case when off then '(night)' else '' end as kind, left(coalesce(target_value, ''), 40) || ' → ' || coalesce(nullif(left(coalesce(dest_path, ''), 50), ''), '-') as item from cls
 where source = 'endpoint' and category = 'DOC' and action in ('SEND','ARCHIVE','DELETE') and occurred_at >= timestamp '{AS_OF}' - interval 7 day),
 p as (select employee_id, count(*) as person_rows from r group by 1 order by 2 desc, 1 limit 40), x as (select r.*, person_rows, row_number() over (partition by employee_id, kind order by occurred_at, event_hash) as rn from r join p using (employee_id))
 select employee_id, person_rows, kind, count(*) as n_rows, string_agg(item, '; ' order by rn) filter (rn <= 6) as samples from x group by 1, 2, 3""")
def a26(spark, sf):
    return G.document_digest(ev(spark, sf), AS_OF, actions=("SEND", "ARCHIVE", "DELETE"))


DAY_C = """c as (select employee_id from verdicts where cast(window_start as date) = date '2024-01-30' and risk_score >= 50 union select employee_id from cls where cast(occurred_at as date) = date '2024-01-30' and source = 'endpoint' and action in ('SEND','UPLOAD','DELETE'))"""


@register("o6_day_candidates", with_("verdicts cls", "").rstrip() + ", " + DAY_C + " select * from c")
def o6(spark, sf):
    events, _, v = verdict_frames(spark, sf)
    return G.day_candidates(v, events, "2024-01-30", most=None)


@register("a27_day_digest", with_("verdicts cls", "").rstrip() + ", " + DAY_C + """, c20 as (select * from c order by 1 limit 20), d as (select cls.*, row_number() over (partition by employee_id, category, action in ('SEND','UPLOAD'), action = 'DELETE' and not noise_doc order by occurred_at, event_hash) as rn from cls join c20 using (employee_id) where cast(occurred_at as date) = date '2024-01-30'),
 b as (select employee_id, count(*) filter (category = 'DOC' and action in ('SEND','UPLOAD')) as n_sends, count(*) filter (category = 'DOC' and action = 'DELETE' and not noise_doc) as n_deletes,
  count(*) filter (category = 'DOC' and action not in ('SEND','UPLOAD') and not (action = 'DELETE' and not noise_doc)) as n_docs, min(hour(occurred_at))::int as hour_from, max(hour(occurred_at))::int as hour_to,
  string_agg(left(target_value, 30) || '→' || coalesce(nullif(left(lower(split_part(coalesce(dest_path, ''), '/', 1)), 30), ''), channel), '; ' order by rn) filter (category = 'DOC' and action in ('SEND','UPLOAD') and rn <= 8) as sends,
  string_agg(left(target_value, 30), '; ' order by rn) filter (category = 'DOC' and action = 'DELETE' and not noise_doc and rn <= 8) as deletes,
  string_agg(action || ':' || left(target_value, 24), '; ' order by rn) filter (category = 'DOC' and action not in ('SEND','UPLOAD') and not (action = 'DELETE' and not noise_doc) and rn <= 6) as docs,
  string_agg(left(target_value, 24), '; ' order by rn) filter (category = 'SEARCH' and rn <= 6) as searches from d group by 1),
 s as (select employee_id, string_agg(site || '×' || v, '; ' order by v desc, site) as risk_sites from (select employee_id, site, sum("count")::bigint as v from d where risk_class is not null group by 1, 2) group by 1),
 vv as (select employee_id, string_agg(intent || ' ' || risk_score, '; ' order by window_start) filter (rn <= 6) as verdicts from (select *, row_number() over (partition by employee_id order by window_start) as rn from verdicts where cast(window_start as date) = date '2024-01-30') group by 1)
 select b.*, risk_sites, vv.verdicts from b left join s using (employee_id) left join vv using (employee_id)""")
def a27(spark, sf):
    events, _, v = verdict_frames(spark, sf)
    return G.day_digest(events, v, "2024-01-30")
