"""What several consumers read is computed once and written, not once per consumer."""

import datetime as dt

from tidewatch.operators import alerts as A
from tidewatch.operators import profiles as P
from tidewatch.operators.audit import audit, signatures
from tidewatch.operators.scoring import VERDICT_COLUMNS, score_events
from tidewatch.operators.windows import shared_facts
from tidewatch.plans import daily as DL
from tidewatch.plans import live as L

AS_OF = "2026-07-21 00:00:00"
ROWS = [{"at": f"2026-07-20 {h:02d}:00:00", "who": who, "domain": "zhipin.com"} for h in (9, 10, 23) for who in ("p1", "p2")]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_session_facts_of_a_range(make):
    facts = DL.facts_of_days(make(ROWS), dt.date(2026, 7, 20), dt.date(2026, 7, 20))
    assert facts.count() and "Aggregate" not in plan(facts)


def test_profiles_list_their_facts_once(make):
    found = P.profiles(make(ROWS), AS_OF)
    assert "Generate" not in plan(found) and found.count() == 2


def test_logs_of_the_audit(spark, make):
    events = make(ROWS)
    verdicts = score_events(events, AS_OF).select(*VERDICT_COLUMNS)
    exempt = spark.createDataFrame([("p1", "job_seeking", "recruiter", None)], "employee_id string, signal_type string, reason string, expires_at timestamp_ntz")
    alerts = A.merge_alerts(A.no_alerts(spark), verdicts, exempt.limit(0), AS_OF).select(*A.ALERT_COLUMNS)
    judged, kept, fixes = audit(verdicts, alerts, signatures(shared_facts(events)), exempt, events, AS_OF)
    assert {r["rule"] for r in fixes.collect()} >= {"I3"} and judged.count() == verdicts.count()
    assert all("Join" not in plan(d) for d in (judged, kept, fixes))


def test_published_rows(spark, make):
    names, none = spark.createDataFrame([], "account string, name string"), spark.createDataFrame([], "employee_id string")
    folds = L.merged_folds(L.partial_folds(make(ROWS)))
    kept, rows = L.published(folds, names, none)
    assert kept.count() == rows.count() == 6 and all("Aggregate" not in plan(d) and "Join" not in plan(d) for d in (kept, rows))
