"""Suppression, alert lifecycle, audit and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import audit as AU
from ..operators import identity as ID
from ..operators import patterns as X
from ..operators import scoring as S
from ..operators import windows as W
from .base import *
from .window_queries import KEYS

MID = "2024-01-20 00:00:00"


@register("j06_unjudged_windows", with_("trig", f"select employee_id, window_start from trig where triggered and window_start >= timestamp '{MID}'"))
def j06(spark, sf):
    events, facts, v = verdict_frames(spark, sf)
    judged = v.filter(F.col("window_start") < F.lit(MID).cast("timestamp_ntz")).select("employee_id", "window_start", "window_end")
    return S.score_events(events, AS_OF, facts=facts, judged=judged).select("employee_id", "window_start")


@register("j07_suppress_recent", with_("rowsig", "").rstrip() + ", " + KEYS + f""", recent as (select distinct employee_id, trigger_key from keys where window_start >= timestamp '{AS_OF}' - interval 48 hour and window_start < timestamp '{AS_OF}' - interval 12 hour)
 select distinct employee_id, window_start from keys join recent using (employee_id, trigger_key)""")
def j07(spark, sf):
    keys = W.trigger_keys(W.shared_facts(ev(spark, sf)))
    stored = keys.filter(F.col("window_start") < F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))
    return S.repeated_windows(keys, stored, AS_OF, S.Rules(suppress_hours=48))


@register("j08_not_exempt", with_("verdicts due valid_ex", "select verdict_id from due"))
def j08(spark, sf):
    v = verdict_frames(spark, sf)[2]
    return A.not_exempt(v.filter("risk_score >= 50"), exemptions(spark), AS_OF).select("verdict_id")


@register("p07_valid_exemptions", with_("valid_ex canon", "select x.employee_id, x.signal_type, count(*) as n_events from valid_ex x join canon c using (employee_id) group by 1, 2"))
def p07(spark, sf):
    return (S.valid_exemptions(exemptions(spark), AS_OF).join(ev(spark, sf), "employee_id")
            .groupBy("employee_id", "signal_type").agg(F.count("*").alias("n_events")))


ALERT_COLS = "dedup_key, employee_id, scenario, severity, risk_score, verdict_id, summary, status, window_start, created_at"


@register("l01_alerts", with_("verdicts alerts due valid_ex", f"select {ALERT_COLS} from alerts"))
def l01(spark, sf):
    return alert_frame(spark, verdict_frames(spark, sf)[2])


ROUNDS = f"""old as (select * from due where window_start < timestamp '{MID}'), fresh as (select * from due where window_start >= timestamp '{MID}'),
 o as (select employee_id || '|' || intent as dedup_key, any_value(employee_id) as employee_id, arg_max(risk_score, (window_start, verdict_id)) as risk_score, max(verdict_id) as verdict_id, max(window_start) as window_start, min(window_end) as created_at,
  case right(any_value(employee_id), 1) when '1' then 'CONFIRMED' when '2' then 'FP' when '3' then 'CLOSED' else 'NEW' end as status from old group by 1),
 f as (select employee_id || '|' || intent as dedup_key, any_value(employee_id) as employee_id, arg_max(risk_score, (window_start, verdict_id)) as risk_score, max(verdict_id) as verdict_id, max(window_start) as window_start from fresh group by 1),
 m as (select dedup_key, coalesce(o.employee_id, f.employee_id) as employee_id, coalesce(f.risk_score, o.risk_score) as risk_score, coalesce(f.verdict_id, o.verdict_id) as verdict_id, coalesce(f.window_start, o.window_start) as window_start,
  coalesce(o.created_at, timestamp '{AS_OF}') as created_at, case when f.dedup_key is not null then 'NEW' else o.status end as status, o.dedup_key is null as is_new, coalesce(f.dedup_key is not null and o.status <> 'NEW', false) as reopened
  from o full join f using (dedup_key))"""


def two_rounds(spark, sf):
    v = verdict_frames(spark, sf)[2]
    cut = F.lit(MID).cast("timestamp_ntz")
    first = alert_frame(spark, v.filter(F.col("window_start") < cut))
    return A.merge_alerts(first, v.filter(F.col("window_start") >= cut), exemptions(spark), AS_OF)


@register("l01_merge_alerts", with_("verdicts due valid_ex", "").rstrip() + ", " + ROUNDS + " select dedup_key, employee_id, risk_score, verdict_id, window_start, created_at, status, is_new, reopened from m")
def l01m(spark, sf):
    return two_rounds(spark, sf).select("dedup_key", "employee_id", "risk_score", "verdict_id", "window_start", "created_at", "status", "is_new", "reopened")


@register("k07_notifications", with_("verdicts due valid_ex", "").rstrip() + ", " + ROUNDS + " select dedup_key, employee_id, risk_score, case when reopened then 'recurrence' else 'new' end as reason from m where (is_new or reopened) and risk_score >= 75")
def k07(spark, sf):
    return A.notifications(two_rounds(spark, sf)).select("dedup_key", "employee_id", "risk_score", "reason")


@register("l02_insert_once", with_("cls", """select employee_id || '|mass_delete|' || day as dedup_key, case when ops >= 3 then 80 else 70 end as risk_score, 'NEW' as status from
 (select employee_id, cast(occurred_at as date) as day, count(*) as ops from cls where category = 'DOC' and source = 'endpoint' and action = 'DELETE' and not noise_doc group by 1, 2 having count(*) >= 2) where day >= date '2024-01-15'"""))
def l02(spark, sf):
    found = X.mass_delete(ev(spark, sf), min_ops=2, min_files=1, high_ops=3, by_day=True)
    known = found.filter(F.col("day") < F.lit("2024-01-15").cast("date")).select("dedup_key")
    return X.insert_once(known, found, AS_OF).select("dedup_key", "risk_score", "status")


# Deviation alerts are rare in the test data: verdicts from 30 on make them.
DEV_ALERTS = f"""da0 as (select employee_id || '|' || intent as dedup_key, employee_id, intent as scenario, arg_max(risk_score, (window_start, verdict_id)) as risk_score, min(window_end) as created_at from verdicts v where risk_score >= 30
 and not exists (select 1 from valid_ex x where x.employee_id = v.employee_id and x.signal_type = v.intent) group by 1, 2, 3),
 da as (select *, case right(employee_id, 1) when '1' then 'CONFIRMED' when '2' then 'FP' when '3' then 'CLOSED' else 'NEW' end as status from da0)"""


@register("l03_auto_close", with_("verdicts valid_ex", "").rstrip() + ", " + DEV_ALERTS + f""" select dedup_key, risk_score, case when scenario = 'baseline_deviation' and status = 'NEW' and (risk_score < 50 or (risk_score between 50 and 65 and created_at < timestamp '{AS_OF}' - interval 3 day)) then 'CLOSED' else status end as status from da""")
def l03(spark, sf):
    v = verdict_frames(spark, sf)[2]
    merged = A.merge_alerts(A.no_alerts(spark), v, exemptions(spark), AS_OF, S.Rules(alert_score=30), created="window")
    return A.auto_close(statuses(merged.select(*A.ALERT_COLUMNS)), AS_OF).select("dedup_key", "risk_score", "status")


@register("l06_rescore_week", with_("verdicts", f"select verdict_id, intent, risk_score from verdicts where window_start >= timestamp '{AS_OF}' - interval 7 day"))
def l06(spark, sf):
    from ..plans.pipeline import score_range
    return score_range(ev(spark, sf), AS_OF).select("verdict_id", "intent", "risk_score")


# A window is scored by the run in whose days it ends; that run's last day ends the 7-day history.
BY_RUN = "greatest(least(cast(t.window_end + interval 60 minute as date), date '2024-01-30'), date '2024-01-27')"


@register("l05_incremental_scoring", with_("verdicts", "select verdict_id, employee_id, window_start, window_end, n, visits, intent, deviation, risk_score, primary_score, anchored, explanation from verdicts")
          .replace("exists (select 1 from hist h where h.employee_id = t.employee_id and h.n_days >= 4)", f"""coalesce((select max(k) from (select count(distinct cast(c.occurred_at as date)) as k from cls c
            where c.employee_id = t.employee_id and c.risk_class is not null and cast(c.occurred_at as date) between {BY_RUN} - 6 and {BY_RUN} group by c.risk_class)), 0) >= 4"""))
def l05(spark, sf):
    """All days up to the 27th in one run, then three runs that read one new day each."""
    verdicts = [score for _, score in daily_runs(spark, stored_ev(spark, sf))]
    out = verdicts[0]
    for more in verdicts[1:]:
        out = out.unionByName(more)
    return out.select("verdict_id", "employee_id", "window_start", "window_end", "n", "visits", "intent", "deviation", "risk_score", "primary_score", "anchored", "explanation")


def daily_runs(spark, events, **options):
    """(state, verdicts) after each run."""
    import datetime as dt
    import uuid

    from ..plans.daily import ScoreState, score_days
    from ..session import checkpoint_dir
    state = ScoreState(spark, f"{checkpoint_dir(spark)}/score-{uuid.uuid4().hex}")
    first = events.agg(F.min("occurred_at")).first()[0]
    first = first.date() if first is not None else dt.date(2024, 1, 1)
    days = [(min(first, dt.date(2024, 1, 27)), dt.date(2024, 1, 27)), *[(dt.date(2024, 1, d), dt.date(2024, 1, d)) for d in (28, 29, 30)]]
    for a, b in days:
        yield state, score_days(events, state, a, b, close_all=b == days[-1][1], **options)


def feedback_rows(alerts):
    """Labels derived from the alert score: high ones false, low ones true."""
    label = F.when(F.col("risk_score") >= 85, "FP").when(F.col("risk_score") < 70, "TP").otherwise("X")
    return alerts.select("dedup_key", label.alias("label"), F.lit("checked").alias("reason"), F.col("scenario").alias("signal_type"),
                         (F.col("risk_score") % 10).cast("int").alias("expires_days"), "created_at")


@register("l07_feedback_alerts", with_("alerts verdicts due valid_ex", "select dedup_key, case when risk_score >= 85 then 'FP' when risk_score < 70 then 'CONFIRMED' else status end as status from alerts"))
def l07(spark, sf):
    a = alert_frame(spark, verdict_frames(spark, sf)[2])
    return A.apply_feedback(a, feedback_rows(a), AS_OF)[0].select("dedup_key", "status")


@register("l07_feedback_exemptions", with_("alerts verdicts due valid_ex", f"""select employee_id, scenario as signal_type, case when risk_score % 10 > 0 then timestamp '{AS_OF}' + to_days((risk_score % 10)::int) end as expires_at from alerts where risk_score >= 85"""))
def l07x(spark, sf):
    a = alert_frame(spark, verdict_frames(spark, sf)[2])
    return A.apply_feedback(a, feedback_rows(a), AS_OF)[1].select("employee_id", "signal_type", "expires_at")


@register("l08_status_update", with_("alerts verdicts due valid_ex", "select dedup_key, case when risk_score >= 80 then 'TRIAGING' else status end as status from alerts"))
def l08(spark, sf):
    a = alert_frame(spark, verdict_frames(spark, sf)[2])
    changes = a.select("dedup_key", F.when(F.col("risk_score") >= 80, "TRIAGING").otherwise("UNKNOWN").alias("new_status"))
    return A.set_status(a, changes).select("dedup_key", "status")


RENAMED = [("u1", "林一"), ("u2", "林二"), ("u10", "u20"), ("u30", "u20")]


@register("l09_rename_alerts", with_("alerts verdicts due valid_ex", "").rstrip() + f""", al as (select * from (values {values(RENAMED)}) as x(account, name)),
 mv as (select coalesce(name, employee_id) as employee_id, coalesce(name, employee_id) || substr(dedup_key, len(employee_id) + 1) as dedup_key, risk_score, window_start from alerts left join al on account = employee_id)
 select employee_id, dedup_key, risk_score from (select *, row_number() over (partition by dedup_key order by risk_score desc, window_start desc) as rn from mv) where rn = 1""")
def l09(spark, sf):
    a = alert_frame(spark, verdict_frames(spark, sf)[2])
    return ID.rename_alerts(a, spark.createDataFrame(RENAMED, "account string, name string")).select("employee_id", "dedup_key", "risk_score")


@register("l09_rename_events", with_("canon", f"""select event_id, coalesce(name, employee_id) as employee_id from canon left join (values {values(RENAMED)}) as x(account, name) on account = employee_id"""))
def l09e(spark, sf):
    return ID.rename(ev(spark, sf), spark.createDataFrame(RENAMED, "account string, name string")).select("event_id", "employee_id")


@register("l16_drop_exemption", with_("exempt canon", "select x.employee_id, x.signal_type from exempt x where not exists (select 1 from canon c where c.employee_id = x.employee_id and c.action = 'SEND' and x.signal_type = 'job_seeking')"))
def l16x(spark, sf):
    sent = ev(spark, sf).filter("action = 'SEND'").select("employee_id", F.lit("job_seeking").alias("signal_type")).distinct()
    return A.drop_exemption(exemptions(spark), sent).select("employee_id", "signal_type")


@register("j12_alert_of_verdict", with_("alerts verdicts due valid_ex", """select v.verdict_id, coalesce(a.dedup_key, b.dedup_key) as dedup_key, case when a.dedup_key is not null then 'verdict' when b.dedup_key is not null then 'person' end as matched_by
 from verdicts v left join alerts a on a.verdict_id = v.verdict_id left join alerts b on b.employee_id = v.employee_id and b.scenario = v.intent"""))
def j12(spark, sf):
    v = verdict_frames(spark, sf)[2]
    return A.alert_of_verdict(v, alert_frame(spark, v)).select("verdict_id", "dedup_key", "matched_by")


@register("l12_day_review", with_("alerts verdicts due valid_ex", """select dedup_key, case when up then case when scenario = 'job_seeking' then case when sug <= 80 then 80 when sug <= 85 then 85 when sug <= 90 then 90 else 95 end else case when sug <= 75 then 75 when sug <= 80 then 80 when sug <= 85 then 85 else 90 end end else risk_score end::int as risk_score,
 case when up then '[review: up' when ok and dir = 'downgrade' then '[review: likely false alarm, r] ' || summary when ok and dir = 'keep' then '[review: keep] ' || summary else summary end as text from
 (select *, ok and dir = 'upgrade' and sug > risk_score and scenario in ('policy_violation','data_exfiltration','job_seeking') as up from (select *, case len(employee_id) % 3 when 0 then 'upgrade' when 1 then 'downgrade' else 'keep' end as dir,
  (76 + len(employee_id) * 2)::int as sug, status not in ('FP', 'CLOSED') and window_start >= timestamp '2024-01-29' and window_start < timestamp '2024-01-30' as ok from alerts))"""))
def l12(spark, sf):
    a = alert_frame(spark, verdict_frames(spark, sf)[2])
    n = F.length("employee_id")
    reviews = a.select("employee_id").distinct().select(
        "employee_id", F.when(n % 3 == 0, "upgrade").when(n % 3 == 1, "downgrade").otherwise("keep").alias("direction"),
        (F.lit(76) + n * 2).cast("int").alias("suggested_score"), F.lit("r").alias("reason"), F.lit("story").alias("review"))
    out = A.apply_review(a, reviews, "2024-01-29")
    return out.select("dedup_key", "risk_score", F.when(F.col("summary").startswith("[review: up"), "[review: up").otherwise(F.col("summary")).alias("text"))


# ------------------------------------------------------------------ audit

AUDIT = """exr as (select employee_id, signal_type as intent, coalesce(min(nullif(reason, '')), 'role') as reason from exempt group by 1, 2),
 sg as (select employee_id, window_start, coalesce(sum("count") filter (risk_class = 'netdisk'), 0) as nd, coalesce(sum("count") filter (risk_class = 'personal_email'), 0) as pe, coalesce(sum("count") filter (risk_class = 'file_helper'), 0) as fh,
  coalesce(sum("count") filter (risk_class = 'recruitment'), 0) as rc, bool_or(category = 'DOC' and action in ('COPY','MOVE','DELETE','UPLOAD','SEND','PRINT','BURN')) as dw from win group by 1, 2),
 v1 as (select v.verdict_id, v.employee_id, v.window_start, v.explanation, s.*exclude(employee_id, window_start), x.reason, (v.intent = 'job_seeking' and x.reason is null and rc = 0) as pressed0, v.intent as intent0, v.risk_score as score0
  from verdicts v join sg s using (employee_id, window_start) left join exr x on x.employee_id = v.employee_id and x.intent = v.intent),
 v2 as (select *, case when pressed0 then 'baseline_deviation' else intent0 end as intent, case when pressed0 then least(score0, 45) else score0 end as sc from v1),
 v3 as (select verdict_id, employee_id, window_start, intent, nd, pe, fh, dw, case when intent = 'data_exfiltration' and sc >= 50 then case when sc <= 75 then 75 when sc <= 80 then 80 when sc <= 85 then 85 when sc <= 90 then 90 else sc end
   when intent = 'job_seeking' and sc between 50 and 55 then 55 else sc end::int as risk_score, case when reason is not null then '[exempt:' || reason || '] ' || explanation else explanation end as explanation from v2),
 best as (select employee_id, arg_max(verdict_id, (risk_score, -epoch_us(window_start))) as vid, max(risk_score) as bs from v3 where intent = 'data_exfiltration' and (nd + pe + fh > 0 or dw) group by 1),
 wk as (select employee_id, coalesce(sum("count") filter (risk_class in ('netdisk','personal_email','file_helper')), 0) as hits from cls where occurred_at >= timestamp '2024-01-31' - interval 7 day group by 1),
 ka as (select a.* from alerts a where not exists (select 1 from exr x where x.employee_id = a.employee_id and x.intent = a.scenario)),
 ra as (select a.dedup_key, a.scenario, case when a.scenario = 'data_exfiltration' and b.vid is not null then b.vid else a.verdict_id end as verdict_id, case when a.scenario = 'data_exfiltration' and b.vid is not null then b.bs else a.risk_score end as rs,
  case when a.scenario = 'data_exfiltration' and b.vid is null and a.status = 'NEW' and coalesce(w.hits, 0) = 0 then 'CLOSED' else a.status end as status from ka a left join best b using (employee_id) left join wk w using (employee_id))"""


def audited(spark, sf):
    events, facts, v = verdict_frames(spark, sf)
    v = v.select(*S.VERDICT_COLUMNS)
    return AU.audit(v, alert_frame(spark, v), AU.signatures(facts), exemptions(spark), events, AS_OF)


@register("l11_audit_verdicts", with_("verdicts exempt win", "").rstrip() + ", " + AUDIT[:AUDIT.index("\n best as")].rstrip(",\n ") + " select verdict_id, intent, risk_score, explanation from v3")
def l11v(spark, sf):
    return audited(spark, sf)[0].select("verdict_id", "intent", "risk_score", "explanation")


@register("l11_audit_alerts", with_("verdicts exempt win alerts due valid_ex", "").rstrip() + ", " + AUDIT + """ select dedup_key, verdict_id, status, case when status = 'NEW' and scenario = 'data_exfiltration' then case when rs <= 75 then 75 when rs <= 80 then 80 when rs <= 85 then 85 when rs <= 90 then 90 else rs end
 when status = 'NEW' and scenario = 'job_seeking' and rs <= 55 then 55 else rs end::int as risk_score from ra""")
def l11a(spark, sf):
    return audited(spark, sf)[1].select("dedup_key", "verdict_id", "status", "risk_score")


FINAL = """case when status = 'NEW' and scenario = 'data_exfiltration' then case when rs <= 75 then 75 when rs <= 80 then 80 when rs <= 85 then 85 when rs <= 90 then 90 else rs end
 when status = 'NEW' and scenario = 'job_seeking' and rs <= 55 then 55 else rs end"""
AUDIT_LOG = with_("verdicts exempt win alerts due valid_ex", "").rstrip() + ", " + AUDIT + f""", lg as (
 select 'I3' as rule, 'exempt alert removed' as fix from alerts a where exists (select 1 from exr x where x.employee_id = a.employee_id and x.intent = a.scenario)
 union all select 'I3', 'exempt verdict marked' from v1 where reason is not null
 union all select 'I4', 'job verdict without visit lowered' from v1 where pressed0
 union all select 'I1', 'alert aligned with verdict' from ka a join best b using (employee_id) where a.scenario = 'data_exfiltration' and (a.verdict_id <> b.vid or a.risk_score <> b.bs)
 union all select 'I5', case when coalesce(w.hits, 0) > 0 then 'alert restated' else 'alert closed' end from ka a left join best b using (employee_id) left join wk w using (employee_id) where a.scenario = 'data_exfiltration' and b.vid is null and a.status = 'NEW'
 union all select 'I6', 'verdict score on tier' from v3 join v2 using (verdict_id) where v3.risk_score <> v2.sc
 union all select 'I6', 'alert score on tier' from ra where rs <> {FINAL}) select rule, fix, count(*) as n from lg group by 1, 2"""


@register("l11_audit_log", AUDIT_LOG)
def l11f(spark, sf):
    return audited(spark, sf)[2].groupBy("rule", "fix").agg(F.count("*").alias("n"))
