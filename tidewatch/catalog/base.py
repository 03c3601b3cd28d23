"""Registry, fixed inputs and the shared SQL of the oracles."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .. import vocab
from ..session import cut_lineage, prepare
from ..sources.adapter import canonical_events, canonical_sql, read_table

QUERIES: dict = {}
ORACLES: dict = {}

# The test data ends on 2024-01-30.
AS_OF = "2024-01-31 00:00:00"
TODAY = "2024-01-30 20:00:00"

EXEMPTIONS = [("u3", "job_seeking", "recruiter", None), ("u5", "data_exfiltration", "", "2024-06-01 00:00:00"),
              ("u7", "data_exfiltration", "old", "2024-01-05 00:00:00")]
ALIASES = [("u1", "林一"), ("u2", "林二")]
IGNORED = [("u9",)]


def register(name: str, sql: str | None = None):
    """Register a query; `sql` is its oracle."""
    def deco(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return deco


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_events(spark, sf_dir)


def stored_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events written once, for queries that read them many times."""
    return cut_lineage(ev(spark, sf_dir))


def exemptions(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(EXEMPTIONS, "employee_id string, signal_type string, reason string, expires_at string")
    return df.withColumn("expires_at", df.expires_at.cast("timestamp_ntz"))


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "account string, name string")


def ignored(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(IGNORED, "employee_id string")


# ------------------------------------------------------------------ oracle SQL

def q(s) -> str:
    return "null" if s is None else "'" + str(s).replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(q(x) if not isinstance(x, int) else str(x) for x in r) + ")" for r in rows)


def sql_contains(col: str, terms) -> str:
    return "(" + " or ".join(f"contains({col}, {q(t)})" for t in terms) + ")" if terms else "false"


def sql_suffix(col: str, patterns) -> str:
    return "(" + " or ".join(f"({col} = {q(p)} or ends_with({col}, {q('.' + p)}))" for p in patterns) + ")" if patterns else "false"


def sql_prefix(col: str, terms) -> str:
    return "(" + " or ".join(f"starts_with({col}, {q(t)})" for t in terms) + ")"


V = vocab.DEFAULT
RISK_ROWS = [(label, i, p) for i, (label, d, _) in enumerate(vocab.RISK_CLASSES) for p in V.get(d)]
TIER = "case {c} " + " ".join(f"when '{label}' then '{tier}'" for label, _, tier in vocab.RISK_CLASSES) + " end"
WHITE = V.get("risk_whitelist_domains")


def sql_risk(d: str) -> str:
    """Risk class of a lower-case domain expression, as nested CASE in class order."""
    out = f"case when {sql_suffix(d, WHITE)} then null "
    for label, dictionary, _ in vocab.RISK_CLASSES:
        pats = V.get(dictionary)
        dotted, plain = [p for p in pats if "." in p], [p for p in pats if "." not in p]
        out += f"when {sql_suffix(d, dotted)} or {sql_contains(d, plain)} then '{label}' "
    return out + "end"


def sql_leisure(d: str, lab: str) -> str:
    veto = (f"({d} = '' or {sql_contains(d, vocab.SDK_HINTS)} or {sql_contains(d, vocab.INFRA_HINTS)} "
            f"or {sql_contains(lab, vocab.OFFICE_CHAT_LABELS)})")
    out = f"case when {veto} then null "
    ok = f"({sql_contains(lab, vocab.LEISURE_LABELS)} and not {sql_contains(lab, vocab.LEISURE_LABEL_VETO)})"
    for kw, cat in vocab.LEISURE_LABEL_CATEGORY:
        out += f"when {ok} and contains({lab}, {q(kw)}) then '{cat}' "
    for cat, pats in V.categories["slack_domains"].items():
        out += f"when {sql_suffix(d, pats)} then '{cat}' "
    return out + "end"


def sql_hash(ts="occurred_at", emp="employee_id", cat="category", act="action", target="target_value") -> str:
    iso = (f"case when extract(microseconds from {ts}) % 1000000 = 0 then strftime({ts}, '%Y-%m-%dT%H:%M:%S') "
           f"else strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') end")
    return f"sha256(concat_ws('|', coalesce({iso}, ''), coalesce({emp}, ''), {cat}, {act}, coalesce({target}, '')))"


OFF = "(hour({t}) < 7 or hour({t}) >= 22)"
WORK = "((hour({t}) >= 9 and hour({t}) < 12) or (hour({t}) >= 14 and hour({t}) < 18))"
RISKY_TERMS = V.get("job_search_terms") + V.get("risk_search_terms") + V.get("sensitive_keywords")
OUT = "('UPLOAD', 'SEND', 'PRINT', 'BURN')"
WRITE = ("('COPY','MOVE','DELETE','UPLOAD','DOWNLOAD','SEND','PRINT','RENAME','CREATE','MODIFY','SAVE','SAVE_AS','CUT','BURN')")
ROOT = "lower(split_part(coalesce({c}, ''), '/', 1))"
MAJOR = sql_contains("site", vocab.MAJOR_RECRUITMENT)
NOISE_DOC = (f"(category = 'DOC' and action not in {OUT} and "
             + sql_contains("(lower(coalesce(src_path, '')) || lower(coalesce(target_value, '')))", vocab.NOISE_PATHS) + ")")

# Named building blocks in dependency order.
CTES = {
    "canon": f"select *, {sql_hash()} as event_hash from ({canonical_sql('duckdb', 'events')})",
    "domclass": f"""select d, {sql_risk('d')} as risk_class from (select distinct lower(domain) as d from canon where category = 'WEB')""",
    "cls": f"""select c.*, case when category = 'WEB' then lower(domain) end as site, k.risk_class, {TIER.format(c='k.risk_class')} as tier,
      {OFF.format(t='occurred_at')} as off,
      coalesce(k.risk_class = 'remote_control' and (starts_with(k.d, 'auth') or contains(k.d, 'authds')), false) as hb,
      coalesce(category = 'WEB' and {sql_prefix("coalesce(k.d, '')", vocab.TELEMETRY_PREFIXES)}, false) as tel,
      {NOISE_DOC} as noise_doc,
      {sql_suffix(ROOT.format(c='dest_path'), WHITE)} as wl,
      (category = 'DOC' and coalesce(channel, '') not in ('', 'LOCAL')) as away
      from canon c left join domclass k on c.category = 'WEB' and lower(c.domain) = k.d""",
    "seq": """select *, case when lag(occurred_at) over w is null or occurred_at - lag(occurred_at) over w > interval 60 minute then 1 else 0 end as brk
      from cls window w as (partition by employee_id order by occurred_at, event_id)""",
    "numbered": "select *, sum(brk) over (partition by employee_id order by occurred_at, event_id rows unbounded preceding) as wno from seq",
    "win": "select *, min(occurred_at) over (partition by employee_id, wno) as window_start from numbered",
    "rowsig": f"""select *, greatest(
        case when away and action in ('UPLOAD','SEND','COPY') then 70 else 0 end,
        case when category = 'DOC' and action in {WRITE} and {sql_contains("coalesce(target_value, '')", V.get('sensitive_keywords'))} then 60 else 0 end,
        case when tier = 'high' then case when off then 75 else 65 end when tier = 'job' then case when off then 75 else 55 end
             when tier = 'mid' then case when off then 55 else 35 end else 0 end,
        case when category = 'SEARCH' and {sql_contains("coalesce(target_value, '')", RISKY_TERMS)} then 50 else 0 end) as row_score,
      (category = 'SEARCH' and {sql_contains("coalesce(target_value, '')", RISKY_TERMS)}) as risky
      from win""",
    "feat": f"""select employee_id, window_start, max(occurred_at) as window_end, count(*) as n, sum("count")::bigint as visits,
        bool_or(off) as off_any, bool_or(category = 'DOC' and action in {OUT}) as outbound, bool_or(away and not noise_doc) as away_doc,
        bool_or(category = 'SEARCH') as searched, bool_or(risky) as risky_search,
        bool_or(coalesce(category = 'WEB' and not hb and tier in ('high','job'), false)) as forbidden,
        bool_or(coalesce(category = 'WEB' and not hb and tier = 'mid' and off, false)) as mid_off,
        coalesce(bool_or(tier = 'high'), false) as tier_high, coalesce(bool_or(tier = 'mid'), false) as tier_mid, coalesce(bool_or(tier = 'job'), false) as tier_job,
        count(*) filter (tier = 'mid' and not off) as mid_day_rows,
        coalesce(sum("count") filter (category = 'WEB' and not hb and not tel and off), 0)::bigint as night_visits,
        coalesce(sum("count") filter (category = 'WEB' and not hb and not tel and tier = 'mid'), 0)::bigint as mid_visits,
        count(*) filter (category = 'WEB') as host_rows, count(*) filter (category = 'WEB' and tel) as telemetry_rows,
        bool_or(coalesce(risk_class in ('netdisk','personal_email','file_helper'), false) or (category = 'DOC' and not wl and (away or action in {OUT}))) as evidence,
        bool_or(category = 'DOC' and action in {WRITE}) as wrote,
        bool_or(away and action in ('SEND','UPLOAD') and not wl) as net_send,
        bool_or(coalesce(away and action in ('SEND','UPLOAD') and not wl and ({sql_risk(ROOT.format(c='dest_path'))}) in ('netdisk','personal_email'), false)) as rare_send,
        coalesce(sum("count") filter (tier = 'job' and {MAJOR}), 0)::bigint as job_major,
        coalesce(sum("count") filter (tier = 'job' and not {MAJOR}), 0)::bigint as job_general,
        max(row_score) as rule_score, min(hour(occurred_at)) as hour_min, max(hour(occurred_at)) as hour_max
      from rowsig group by employee_id, window_start""",
    "cut": "select employee_id, cast(window_start as date) as day, min(window_start) as cutoff from feat group by 1, 2",
    "past": "select c.employee_id, c.day, r.occurred_at, r.channel, r.event_id from cut c join canon r on r.employee_id = c.employee_id and r.occurred_at < c.cutoff",
    "base_n": "select c.employee_id, c.day, count(p.event_id) as sample_count from cut c left join past p on p.employee_id = c.employee_id and p.day = c.day group by 1, 2",
    "base_hours": """select employee_id, day, h from (select employee_id, day, h, row_number() over (partition by employee_id, day order by k desc, h) as rn
        from (select employee_id, day, hour(occurred_at) as h, count(*) as k from past group by 1, 2, 3)) where rn <= 8""",
    "base_med": """select employee_id, day, cast(floor(median(k)) as int) as med, max(k) as mx from
        (select employee_id, day, cast(occurred_at as date) as d, count(*) as k from past group by 1, 2, 3) group by 1, 2""",
    "base_ch": "select distinct employee_id, day, channel from past where coalesce(channel, '') <> ''",
    "win_off": """select distinct r.employee_id, r.window_start from rowsig r left join base_hours b
        on b.employee_id = r.employee_id and b.day = cast(r.window_start as date) and b.h = hour(r.occurred_at) where b.h is null""",
    "win_ch": """select employee_id, window_start, string_agg(channel, ',' order by channel) as new_channel from
        (select distinct r.employee_id, r.window_start, r.channel from rowsig r left join base_ch b
          on b.employee_id = r.employee_id and b.day = cast(r.window_start as date) and b.channel = r.channel
          where coalesce(r.channel, '') <> '' and b.channel is null) group by 1, 2""",
    "wsite": """select employee_id, window_start, site, any_value(risk_class) as risk_class, any_value(tier) as tier, count(*) as n_rows, sum("count")::bigint as visits
        from rowsig where risk_class is not null group by 1, 2, 3""",
    "win_dom": """select employee_id, window_start, string_agg(site, ',' order by site) as sites from
        (select *, row_number() over (partition by employee_id, window_start order by site) as rn from wsite) where rn <= 5 group by 1, 2""",
    "dev": """select f.*, b.sample_count, coalesce(m.med, 0) as med, mid_day_rows >= 15 as channel_burst,
        b.sample_count >= 3 and (hour_min < 7 or hour_max >= 22) and o.window_start is not null as off_hours,
        b.sample_count >= 3 and coalesce(m.med, 0) > 0 and n > greatest(5, coalesce(m.med, 0) * 3) as volume_spike,
        case when b.sample_count >= 3 then c.new_channel end as new_channel,
        case when b.sample_count >= 3 then d.sites end as new_risky_domain
      from feat f join base_n b on b.employee_id = f.employee_id and b.day = cast(f.window_start as date)
      left join base_med m on m.employee_id = f.employee_id and m.day = cast(f.window_start as date)
      left join win_off o on o.employee_id = f.employee_id and o.window_start = f.window_start
      left join win_ch c on c.employee_id = f.employee_id and c.window_start = f.window_start
      left join win_dom d on d.employee_id = f.employee_id and d.window_start = f.window_start""",
    "trig": """select *, outbound or away_doc or searched or forbidden or mid_off or channel_burst or night_visits >= 3 or mid_visits >= 30 as triggered from dev""",
    "daysite": """select employee_id, cast(occurred_at as date) as day, site, any_value(tier) as tier, sum("count")::bigint as visits
        from rowsig where risk_class is not null group by 1, 2, 3""",
    "daytot": f"""select w.employee_id, w.window_start, sum(d.visits)::bigint as day_visits,
        coalesce(sum(d.visits) filter (d.tier = 'job' and {MAJOR.replace('site', 'd.site')}), 0)::bigint as day_job_major,
        coalesce(sum(d.visits) filter (d.tier = 'job' and not {MAJOR.replace('site', 'd.site')}), 0)::bigint as day_job_general
        from wsite w join daysite d on d.employee_id = w.employee_id and d.day = cast(w.window_start as date) and d.site = w.site group by 1, 2""",
    "hist": f"""select employee_id, risk_class, count(*) as n_rows, count(distinct cast(occurred_at as date)) as n_days
        from cls where risk_class is not null and occurred_at >= timestamp '{AS_OF}' - interval 7 day group by 1, 2""",
    "scored": """select t.*, rule_score as primary_score,
        case when rule_score >= 60 then 'data_exfiltration' when rule_score >= 50 then 'job_seeking' when rule_score >= 30 then 'baseline_deviation' else 'normal_work' end as rule_intent,
        case when rule_score >= 60 then 'major' when rule_score >= 30 then 'minor' else 'none' end as deviation,
        coalesce(nullif(d.day_visits, 0), t.visits) as cnt, coalesce(d.day_job_major, 0) as day_job_major, coalesce(d.day_job_general, 0) as day_job_general,
        exists (select 1 from hist h where h.employee_id = t.employee_id and h.n_days >= 4) as xday
        from trig t left join daytot d on d.employee_id = t.employee_id and d.window_start = t.window_start where triggered""",
    "anch": """select *, case when rule_score >= 30 and rule_intent = 'data_exfiltration' and evidence and not (host_rows > 0 and host_rows = telemetry_rows)
          then least(greatest(70 + case when cnt >= 10 then 10 when cnt >= 4 then 5 else 0 end + case when wrote then 10 else 0 end,
               case when net_send then case when rare_send then 85 else 80 end else 0 end) + case when off_any then 5 else 0 end, 90) end as anchor from scored""",
    "jobbed": """select *, case when anchor is not null then null
          when job_major >= 1 then least(case when greatest(job_major, day_job_major) >= 10 then 90 when greatest(job_major, day_job_major) >= 3 then 85 else 75 end
               + case when off_any then 5 else 0 end + case when xday then 5 else 0 end, 95)
          when job_general >= 3 or (job_general >= 1 and xday) then least(case when greatest(job_general, day_job_general) >= 10 then 60 else 55 end
               + case when off_any then 5 else 0 end + case when xday then 5 else 0 end, 65) end as job_score,
        (anchor is null and rule_intent = 'job_seeking' and job_general >= 1 and job_major = 0 and not (job_general >= 3 or xday)) as pressed from anch""",
    "verdicts": """select employee_id || '|' || strftime(window_start, '%Y-%m-%dT%H:%M:%S.%f') as verdict_id, employee_id, window_start, window_end, n, visits,
        case when job_score is not null then 'job_seeking' when pressed then 'baseline_deviation' else rule_intent end as intent, deviation,
        coalesce(anchor, job_score, case when pressed then least(rule_score, 45) end, rule_score)::int as risk_score, primary_score::int as primary_score,
        coalesce(anchor, job_score)::int as anchored,
        '[rules] ' || concat_ws('; ', case when outbound then 'outbound document' end, case when away_doc then 'document off this machine' end,
           case when tier_high then 'restricted site' end, case when tier_job then 'recruitment site' end, case when tier_mid then 'remote, code or assistant site' end,
           case when risky_search then 'job or data search' end, case when off_any then 'night activity' end) as explanation,
        off_any, channel_burst, tier_high, tier_mid, tier_job from jobbed""",
    "exempt": "select employee_id, signal_type, reason, cast(expires_at as timestamp) as expires_at from (values "
              + values(EXEMPTIONS) + ") as x(employee_id, signal_type, reason, expires_at)",
    "valid_ex": f"select * from exempt where expires_at is null or expires_at > timestamp '{AS_OF}'",
    "due": """select v.* from verdicts v where risk_score >= 50 and not exists
        (select 1 from valid_ex x where x.employee_id = v.employee_id and x.signal_type = v.intent)""",
    "alerts0": """select employee_id || '|' || intent as dedup_key, employee_id, intent as scenario, arg_max(risk_score, (window_start, verdict_id)) as risk_score,
        max(verdict_id) as verdict_id, arg_max(explanation, (window_start, verdict_id)) as summary, max(window_start) as window_start, min(window_end) as created_at
        from due group by employee_id, intent""",
    "alerts": """select dedup_key, employee_id, scenario,
        case when risk_score >= 76 then 'CRITICAL' when risk_score >= 56 then 'HIGH' when risk_score >= 31 then 'MEDIUM' else 'LOW' end as severity,
        risk_score, verdict_id, summary,
        case right(employee_id, 1) when '1' then 'CONFIRMED' when '2' then 'FP' when '3' then 'CLOSED' else 'NEW' end as status,
        window_start, created_at from alerts0""",
}


def with_(names: str, select: str) -> str:
    """SELECT preceded by the named building blocks and everything they may read."""
    import re
    need: set[str] = set()

    def add(name: str):
        if name in need:
            return
        need.add(name)
        for other in CTES:
            if other != name and re.search(rf"\b{other}\b", CTES[name]):
                add(other)

    for n in names.split():
        add(n)
    order = [n for n in CTES if n in need]
    return "with " + ",\n".join(f"{n} as ({CTES[n]})" for n in order) + "\n" + select


# ------------------------------------------------------------------ shared Spark inputs

def verdict_frames(spark: SparkSession, sf_dir: str):
    """(events, facts, verdicts); facts and verdicts are written once, as in a deployment."""
    from ..operators import scoring as S
    from ..operators.windows import shared_facts
    events = stored_ev(spark, sf_dir)
    facts = shared_facts(events)
    return events, facts, cut_lineage(S.score_events(events, AS_OF, facts=facts))


def statuses(alerts: DataFrame) -> DataFrame:
    """Spread of statuses for the test data, from the last digit of the id."""
    from pyspark.sql import functions as F
    last = F.right("employee_id", F.lit(1))
    return alerts.withColumn("status", F.when(last == "1", "CONFIRMED").when(last == "2", "FP").when(last == "3", "CLOSED")
                             .otherwise(F.col("status")))


def alert_frame(spark: SparkSession, verdicts: DataFrame) -> DataFrame:
    from ..operators import alerts as A
    merged = A.merge_alerts(A.no_alerts(spark), verdicts, exemptions(spark), AS_OF, created="window")
    return statuses(merged.select(*A.ALERT_COLUMNS))


__all__ = [n for n in globals() if not n.startswith("_")]
