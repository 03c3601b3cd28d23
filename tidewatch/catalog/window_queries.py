"""Folding, classification, windows, profiles, triggers and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions.base import text
from ..operators import classify as C
from ..operators import fold as FO
from ..operators import profiles as P
from ..operators import scoring as S
from ..operators import windows as W
from ..plans import boards as B
from .base import *

FOLDED = f"""folded as (select employee_id, domain, time_bucket(interval 10 minute, occurred_at) as occurred_at, count(*)::int as "count",
  arg_min(device_id, (occurred_at, event_hash)) as device_id, arg_min(url, (occurred_at, event_hash)) as url,
  arg_min(site_class, (occurred_at, event_hash)) filter (coalesce(site_class, '') <> '') as site_class
  from canon where category = 'WEB' and not {sql_contains('lower(domain)', vocab.NOISE_HINTS)} group by 1, 2, 3)"""


@register("a01_fold_web", with_("canon", "").rstrip() + ", " + FOLDED + f"""
 select employee_id, domain, occurred_at, "count" as n_visits, device_id, url, site_class, {sql_hash(cat="'WEB'", act="'VISIT'", target='domain')} as event_hash, 'WEB' as category from folded
 union all select employee_id, domain, occurred_at, "count", device_id, url, site_class, event_hash, category from canon where category <> 'WEB'""")
def a01(spark, sf):
    return FO.fold_web(ev(spark, sf)).select("employee_id", "domain", "occurred_at", F.col("count").alias("n_visits"),
                                             "device_id", "url", "site_class", "event_hash", "category")


@register("k08_fold_report", with_("canon", "").rstrip() + ", " + FOLDED + """
 select (select count(*) from canon) as raw_rows, (select count(*) from canon where category = 'WEB') as raw_web_rows,
  (select count(*) from canon where category = 'WEB') - (select sum("count") from folded)::bigint as noise_rows,
  (select count(*) from folded) as folded_web_rows,
  (select count(*) from canon where category <> 'WEB') + (select count(*) from folded) as stored_rows""")
def k08(spark, sf):
    return FO.fold_report(ev(spark, sf))


@register("j01_classify_domains", with_("canon", f"""select domain, label, n_rows, risk_class, {TIER.format(c='risk_class')} as tier,
 {sql_leisure('domain', 'label')} as leisure, {sql_suffix('domain', V.get('work_domains'))} as is_work
 from (select *, {sql_risk('domain')} as risk_class from (select lower(domain) as domain, coalesce(site_class, '') as label, count(*) as n_rows
 from canon where category = 'WEB' group by 1, 2))"""))
def j01(spark, sf):
    return C.classify_domains(ev(spark, sf))


@register("j01_classify_with_table", f"""select distinct domain, risk_class, {TIER.format(c='risk_class')} as tier from
 (select domain, {sql_risk('domain')} as risk_class from (select distinct regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), '^www\\.', '') as domain from pages
  union select domain from ({canonical_sql('duckdb', 'events')}) where category = 'WEB') where domain <> '')""")
def j01_table(spark, sf):
    pages = read_table(spark, sf, "pages").select(D.url_domain("url").alias("domain"))
    visited = ev(spark, sf).filter("category = 'WEB'").select("domain")
    return C.classify_with_table(pages.unionByName(visited), C.dictionary_table(spark))


FILLER = 20_000


@register("j01_classes_from_rules", with_("cls", "").rstrip() + f""", p as (select lower(domain) as domain, trim(coalesce(site_class, '')) as label, count(*) as n_rows from cls where category = 'WEB' group by 1, 2)
 select domain, label, n_rows, {sql_risk('domain')} as risk_class, {sql_leisure('domain', 'label')} as leisure, {sql_suffix('domain', V.get('work_domains'))} as is_work from p""")
def j01_rules(spark, sf):
    """Risk, leisure and work classes from a rule table with 20,000 entries besides the default ones."""
    from ..operators import matching as M
    number = F.col("id").cast("string")
    more = spark.range(FILLER).select(F.element_at(F.array(*map(F.lit, ("netdisk_domains", "work_domains", "recruitment_sites", "slack_whitelist_domains"))), (F.col("id") % 4 + 1).cast("int")).alias("dict_name"),
                                      F.lit("").alias("category"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("h"), number, F.lit(".filler.invalid"))).otherwise(F.concat(F.lit("~filler~"), number)).alias("pattern"))
    rules = M.dictionary_rules(C.dictionary_table(spark).select("dict_name", "category", "pattern").unionByName(more)).unionByName(M.label_rules(spark))
    web = ev(spark, sf).filter("category = 'WEB'")
    rows = M.with_classes(web, rules, F.col("domain"), F.col("site_class"))
    return (rows.groupBy(F.lower("domain").alias("domain"), F.trim(F.coalesce("site_class", F.lit(""))).alias("label"), "risk_class", "leisure", "is_work")
            .agg(F.count("*").alias("n_rows")).select("domain", "label", "n_rows", "risk_class", "leisure", "is_work"))


@register("w1_windows", with_("win", """select employee_id, window_start, max(occurred_at) as window_end, count(*) as n_events from win group by 1, 2"""))
def w1(spark, sf):
    return W.build_windows(ev(spark, sf))


@register("w1_window_members", with_("win", "select event_id, employee_id, window_start from win"))
def w1_members(spark, sf):
    return W.assign_windows(ev(spark, sf)).select("event_id", "employee_id", "window_start")


SEGS = f"""fun as (select * from (select *, {sql_leisure('lower(domain)', "coalesce(site_class, app, '')")} as leisure from canon where category = 'WEB') where leisure is not null and {WORK.format(t='occurred_at')}),
 fseq as (select *, case when lag(occurred_at) over w is null or occurred_at - lag(occurred_at) over w > interval 15 minute then 1 else 0 end as fb
  from fun window w as (partition by employee_id, cast(occurred_at as date) order by occurred_at, event_id)),
 fnum as (select *, sum(fb) over (partition by employee_id, cast(occurred_at as date) order by occurred_at, event_id rows unbounded preceding) as sno from fseq),
 seg0 as (select employee_id, cast(occurred_at as date) as day, sno, min(occurred_at) as seg_start, max(occurred_at) as seg_end, count(*) as n,
  greatest(least(epoch_us(max(occurred_at)) - epoch_us(min(occurred_at)), count(*) * 600000000), 300000000) as us from fnum group by 1, 2, 3),
 seg1 as (select *, sum(us) over (partition by employee_id, day) as day_us from seg0),
 segs as (select *, case when day_us > 25200000000 then floor(us * 25200 / day_us)::double else us / 1000000.0::double end as seconds from seg1)"""


@register("w2_leisure_segments", with_("canon", "").rstrip() + ", " + SEGS + " select employee_id, day::varchar as day, seg_start, seg_end, n, seconds from segs")
def w2(spark, sf):
    return W.leisure_segments(W.leisure_visits(ev(spark, sf))).withColumn("day", F.col("day").cast("string"))


@register("w3_leisure_sessions", with_("canon", "").rstrip() + ", " + SEGS.replace("from canon where category = 'WEB'",
          f"from canon where category = 'WEB' and occurred_at >= timestamp '{AS_OF}' - interval 14 day") + """,
 longest as (select *, floor(seconds / 60)::bigint as minutes, row_number() over (partition by employee_id order by floor(seconds / 60) desc, seg_start) as rn from segs),
 cats as (select employee_id, day, sno, arg_min(leisure, (-k, leisure)) as category from (select employee_id, cast(occurred_at as date) as day, sno, leisure, count(*) as k from fnum group by 1, 2, 3, 4) group by 1, 2, 3),
 hosts as (select employee_id, day, sno, string_agg(domain, ',' order by rn) as hosts from (select *, row_number() over (partition by employee_id, day, sno order by k desc, domain) as rn from
   (select employee_id, cast(occurred_at as date) as day, sno, domain, count(*) as k from fnum group by 1, 2, 3, 4)) where rn <= 3 group by 1, 2, 3)
 select l.employee_id, l.seg_start, l.seg_end, l.minutes, l.n, c.category, h.hosts, l.n = 1 as sparse
 from longest l join cats c using (employee_id, day, sno) join hosts h using (employee_id, day, sno) where rn <= 20""")
def w3(spark, sf):
    return B.leisure_sessions(ev(spark, sf), AS_OF)


@register("w4_day_hours", with_("canon", "select employee_id, cast(occurred_at as date)::varchar as day, min(hour(occurred_at))::int as first_hour, max(hour(occurred_at))::int as last_hour from canon group by 1, 2"))
def w4(spark, sf):
    e = ev(spark, sf)
    return e.groupBy("employee_id", F.col("occurred_at").cast("date").cast("string").alias("day")).agg(
        F.min(F.hour("occurred_at")).alias("first_hour"), F.max(F.hour("occurred_at")).alias("last_hour"))


KEYS = """keys as (select distinct employee_id, window_start, site as trigger_key from rowsig where tier in ('high', 'job')
 union select distinct employee_id, window_start, 'doc:' || action || ':' || coalesce(nullif(channel, ''), 'LOCAL') from rowsig where category = 'DOC' and action in ('UPLOAD','SEND','PRINT','BURN'))"""


@register("w6_trigger_keys", with_("rowsig", "").rstrip() + ", " + KEYS + " select * from keys")
def w6(spark, sf):
    return W.trigger_keys(W.shared_facts(ev(spark, sf)))


@register("w5_suppress_repeats", with_("rowsig", "").rstrip().replace("with canon", "with recursive canon", 1) + ", " + KEYS + """,
 lists as (select employee_id, window_start, list(trigger_key) as ks, row_number() over (partition by employee_id order by window_start) as i from keys group by 1, 2),
 walk as (select employee_id, window_start, i, true as kept, ks as seen from lists where i = 1
  union all select l.employee_id, l.window_start, l.i, not list_has_any(l.ks, w.seen), case when list_has_any(l.ks, w.seen) then w.seen else list_concat(w.seen, l.ks) end
  from walk w join lists l on l.employee_id = w.employee_id and l.i = w.i + 1)
 select employee_id, window_start from walk where kept""")
def w5(spark, sf):
    return W.suppress_repeats(W.trigger_keys(W.shared_facts(ev(spark, sf))))


@register("w7_top_domains", with_("canon", """select employee_id, domain, n, rn from (select *, row_number() over (partition by employee_id order by n desc, domain)::int as rn
 from (select employee_id, domain, count(*) as n from canon where category = 'WEB' group by 1, 2)) where rn <= 3"""))
def w7(spark, sf):
    from pyspark.sql import Window
    n = ev(spark, sf).filter("category = 'WEB'").groupBy("employee_id", "domain").agg(F.count("*").alias("n"))
    order = Window.partitionBy("employee_id").orderBy(F.desc("n"), "domain")
    return n.withColumn("rn", F.row_number().over(order)).filter("rn <= 3")


@register("w8_two_weeks", with_("cls", f"""select employee_id, count(*) filter (occurred_at >= timestamp '{AS_OF}' - interval 7 day) as cur,
 count(*) filter (occurred_at < timestamp '{AS_OF}' - interval 7 day) as prev from cls where source = 'endpoint' and action in ('SEND','UPLOAD') and not wl
 and occurred_at >= timestamp '{AS_OF}' - interval 14 day group by 1"""))
def w8(spark, sf):
    from ..operators.patterns import trend_spike
    return trend_spike(ev(spark, sf), AS_OF, min_prev=0, factor=0).select("employee_id", "cur", "prev")


# ------------------------------------------------------------------ profiles

def _people(ratio: str) -> str:
    return with_("canon domclass", f"""select domain, n_people from (select c.domain, count(distinct employee_id) as n_people from canon c join domclass k on lower(c.domain) = k.d
 where category = 'WEB' and k.risk_class is null group by 1), (select count(distinct employee_id) as people from canon)
 where people >= 3 and n_people >= greatest(2, floor(people * {ratio})::int)""")


@register("a02_common_domains", _people("0.3"))
def a02(spark, sf):
    return P.common_domains(ev(spark, sf))


def topk(kind: str, source: str, k: int, order: str = "n desc, key", text_sql: str = "key || ':' || n") -> str:
    return (f"{kind} as (select employee_id, string_agg({text_sql}, ',' order by rn) as {kind} from (select *, row_number() over (partition by employee_id order by {order}) as rn "
            f"from (select employee_id, key, count(*) as n from ({source}) where key is not null and key <> '' group by 1, 2)) where rn <= {k} group by 1)")


SINCE = f"occurred_at >= timestamp '{AS_OF}' - interval 30 day"
PROFILE_SQL = with_("cls", "").rstrip() + ", " + ", ".join([
    f"src as (select * from cls where {SINCE})",
    "pday as (select employee_id, cast(occurred_at as date) as d, count(*) as n, min(hour(occurred_at)) as h0, max(hour(occurred_at)) as h1 from src group by 1, 2)",
    """pbase as (select employee_id, count(*) as active_days, sum(n)::bigint as sample_count, floor(median(n))::int as daily_median, max(n) as daily_max,
      list_sort(list(h0))[len(list(h0)) // 2 + 1]::int as start_median, list_sort(list(h1))[len(list(h1)) // 2 + 1]::int as end_median,
      count(*) filter (h0 < 7) as late_night_days from pday group by 1)""",
    topk("hours", "select employee_id, lpad(hour(occurred_at)::varchar, 2, '0') as key from src", 8, text_sql="key::int::varchar"),
    topk("channels", "select employee_id, channel as key from src", 64, order="key", text_sql="key"),
    topk("domains", "select employee_id, domain as key from src where category = 'WEB' and risk_class is null", 20, text_sql="key"),
    topk("actions", "select employee_id, action as key from src", 64, order="key", text_sql="key"),
    topk("keywords", "select employee_id, w as key from src, (select unnest([" + ", ".join(q(k) for k in V.get("sensitive_keywords")) + "]) as w) where contains(coalesce(target_value, ''), w)", 64, order="key", text_sql="key"),
    topk("exts", r"select employee_id, lower(regexp_extract(target_value, '\.([A-Za-z0-9]{1,6})$', 1)) as key from src where category = 'DOC'", 8),
    topk("codes", "select employee_id, unnest(regexp_extract_all(target_value, '[A-Z]{2,6}[-_][0-9]{2,6}')[1:3]) as key from src where category = 'DOC'", 8),
    topk("sends", "select employee_id, action || ':' || coalesce(nullif(left(split_part(coalesce(dest_path, ''), '/', 1), 40), ''), nullif(channel, ''), 'LOCAL') as key from src where category = 'DOC' and action in ('UPLOAD','SEND','PRINT','BURN')", 6),
    topk("send_days", "select employee_id, cast(occurred_at as date)::varchar as key from src where category = 'DOC' and action in ('UPLOAD','SEND','PRINT','BURN')", 14, order="key desc"),
    topk("topics", "select employee_id, left(trim(target_value), 24) as key from src where category = 'SEARCH'", 10, text_sql="key"),
]) + """ select b.*, hours, coalesce(channels, '') as channels, coalesce(domains, '') as domains, actions, coalesce(keywords, '') as keywords, coalesce(exts, '') as exts, coalesce(codes, '') as codes,
 coalesce(sends, '') as sends, coalesce(send_days, '') as send_days, coalesce(topics, '') as topics from pbase b
 left join hours using (employee_id) left join channels using (employee_id) left join domains using (employee_id) left join actions using (employee_id) left join keywords using (employee_id)
 left join exts using (employee_id) left join codes using (employee_id) left join sends using (employee_id) left join send_days using (employee_id) left join topics using (employee_id)"""


def flat_profiles(p):
    pairs = lambda c: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    join = lambda c: F.array_join(c, ",")
    return p.select("employee_id", "active_days", "sample_count", "daily_median", "daily_max", "rhythm.*",
                    join(F.col("active_hours_top").cast("array<string>")).alias("hours"), join("channels_used").alias("channels"),
                    join("common_domains").alias("domains"), join("actions_seen").alias("actions"), join("usual_keywords").alias("keywords"),
                    pairs("doc_types").alias("exts"), pairs("project_codes").alias("codes"), pairs("send_channels").alias("sends"),
                    pairs("sends_by_day").alias("send_days"), join("search_topics").alias("topics"))


@register("a03_profiles", PROFILE_SQL)
def a03(spark, sf):
    return flat_profiles(P.profiles(ev(spark, sf), AS_OF))


@register("k02_write_profiles", PROFILE_SQL)
def k02(spark, sf):
    from ..session import cut_lineage
    return flat_profiles(cut_lineage(P.profiles(ev(spark, sf), AS_OF)))


@register("a04_all_profiles", PROFILE_SQL.replace(f"where {SINCE}", "where true"))
def a04(spark, sf):
    return flat_profiles(P.profiles(ev(spark, sf)))


@register("a23_night_workers", with_("canon", f"""select employee_id, count(*) filter (h0 < 7) as late_night_days,
 list_sort(list(h0))[len(list(h0)) // 2 + 1]::int as start_median, list_sort(list(h1))[len(list(h1)) // 2 + 1]::int as end_median from
 (select employee_id, cast(occurred_at as date) as d, min(hour(occurred_at)) as h0, max(hour(occurred_at)) as h1 from canon where {SINCE} group by 1, 2)
 group by 1 having count(*) filter (h0 < 7) >= 3"""))
def a23(spark, sf):
    return P.night_workers(P.rhythms(ev(spark, sf), AS_OF))


@register("a30_people", with_("canon", "select count(distinct employee_id) as people from canon"))
def a30(spark, sf):
    return P.people_count(ev(spark, sf))


@register("j13_baseline_asof", with_("base_n base_hours base_med base_ch", """select n.employee_id, n.day::varchar as day, n.sample_count, coalesce(h.hs, '') as hours,
 coalesce(c.cs, '') as channels, coalesce(m.med, 0)::int as daily_median, coalesce(m.mx, 0) as daily_max from base_n n
 left join (select employee_id, day, string_agg(h::varchar, ',' order by h) as hs from base_hours group by 1, 2) h on h.employee_id = n.employee_id and h.day = n.day
 left join (select employee_id, day, string_agg(channel, ',' order by channel) as cs from base_ch group by 1, 2) c on c.employee_id = n.employee_id and c.day = n.day
 left join base_med m on m.employee_id = n.employee_id and m.day = n.day"""))
def j13(spark, sf):
    b = P.baseline_asof(W.shared_facts(ev(spark, sf)))
    hours = F.concat_ws(",", *[F.when(F.col("hours_mask").bitwiseAND(1 << h) != 0, F.lit(str(h))) for h in range(24)])
    return b.select("employee_id", F.col("day").cast("string").alias("day"), "sample_count", hours.alias("hours"),
                    W.mask_names("channels_mask", W.DOC_CHANNELS).alias("channels"), "daily_median", "daily_max")


# ------------------------------------------------------------------ deviation, trigger, scores

def flagged(spark, sf):
    facts = W.shared_facts(ev(spark, sf))
    return S.deviation(W.window_features(facts), P.baseline_asof(facts), W.window_sites(facts))


@register("d01_deviation", with_("dev", "select employee_id, window_start, n, channel_burst, off_hours, volume_spike, new_channel, new_risky_domain from dev"))
def d01(spark, sf):
    return flagged(spark, sf).select("employee_id", "window_start", "n", "channel_burst", "off_hours", "volume_spike",
                                     "new_channel", "new_risky_domain")


@register("d02_trigger", with_("trig", "select employee_id, window_start, night_visits, mid_visits, triggered from trig"))
def d02(spark, sf):
    return flagged(spark, sf).select("employee_id", "window_start", "night_visits", "mid_visits",
                                     S.should_trigger().alias("triggered"))


CHANNELS = """concat_ws(',', case when bool_or(away and action in ('UPLOAD','SEND','COPY') and channel = 'NETWORK') then 'NETWORK' end,
 case when bool_or(away and action in ('UPLOAD','SEND','COPY') and channel = 'USB') then 'USB' end,
 case when coalesce(bool_or(risk_class = 'file_helper'), false) then 'file_helper' end, case when coalesce(bool_or(risk_class = 'netdisk'), false) then 'netdisk' end,
 case when coalesce(bool_or(risk_class = 'personal_email'), false) then 'personal_email' end, case when coalesce(bool_or(tier = 'mid'), false) then 'remote_control' end) as channels"""


@register("d08_rule_verdict", with_("rowsig", f"""select employee_id, window_start, risk_score, channels,
 case when risk_score >= 60 then 'data_exfiltration' when risk_score >= 50 then 'job_seeking' when risk_score >= 30 then 'baseline_deviation' else 'normal_work' end as intent,
 case when risk_score >= 60 then 'major' when risk_score >= 30 then 'minor' else 'none' end as deviation from
 (select employee_id, window_start, max(row_score)::int as risk_score, {CHANNELS} from rowsig group by 1, 2)"""))
def d08(spark, sf):
    return S.rule_verdict(W.window_features(W.shared_facts(ev(spark, sf)))).select(
        "employee_id", "window_start", "risk_score", "channels", "intent", "deviation")


ANCHOR = """case when {i} in ('policy_violation', 'data_exfiltration') and evidence and not (host_rows > 0 and host_rows = telemetry_rows)
 then least(greatest((case when {i} = 'data_exfiltration' then 70 else 75 end) + case when {i} = 'data_exfiltration' then case when cnt >= 10 then 10 when cnt >= 4 then 5 else 0 end else 0 end
  + case when wrote then 10 else 0 end, case when net_send then case when rare_send then 85 else 80 end else 0 end) + case when off_any then 5 else 0 end, 90) end"""


@register("d09_anchor_score", with_("feat daytot", f"""select employee_id, window_start, ({ANCHOR.format(i="'data_exfiltration'")})::int as exfil_anchor,
 ({ANCHOR.format(i="'policy_violation'")})::int as policy_anchor from (select f.*, coalesce(nullif(d.day_visits, 0), f.visits) as cnt from feat f left join daytot d using (employee_id, window_start))"""))
def d09(spark, sf):
    facts = W.shared_facts(ev(spark, sf))
    totals = S.day_totals(W.window_sites(facts), S.day_site_totals(facts))
    f = W.window_features(facts).join(totals, ["employee_id", "window_start"], "left")
    return f.select("employee_id", "window_start",
                    S.anchor_score(F.lit("data_exfiltration"), "day_visits").alias("exfil_anchor"),
                    S.anchor_score(F.lit("policy_violation"), "day_visits").alias("policy_anchor"))


@register("d10_work_hours_cap", with_("dev", """select employee_id, window_start, case when off_any or channel_burst or tier_high then null
 else nullif(greatest(case when tier_mid then 40 else 0 end, case when tier_job then 85 else 0 end), 0) end::int as score_cap from dev"""))
def d10(spark, sf):
    return flagged(spark, sf).select("employee_id", "window_start", S.work_hours_cap().alias("score_cap"))


@register("d11_verdicts", with_("verdicts", "select verdict_id, employee_id, window_start, window_end, n, visits, intent, deviation, risk_score, primary_score, anchored, explanation from verdicts"))
def d11(spark, sf):
    return S.score_events(ev(spark, sf), AS_OF).select("verdict_id", "employee_id", "window_start", "window_end", "n", "visits",
                                                       "intent", "deviation", "risk_score", "primary_score", "anchored", "explanation")


@register("a05_day_totals", with_("daytot", "select * from daytot"))
def a05(spark, sf):
    facts = W.shared_facts(ev(spark, sf))
    return S.day_totals(W.window_sites(facts), S.day_site_totals(facts))


@register("a06_history7", with_("hist", "select *, n_days >= 4 as cross_day from hist"))
def a06(spark, sf):
    return S.history(ev(spark, sf), AS_OF)
