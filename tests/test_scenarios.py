"""Worked scenarios and acceptance checks from parsed event to alert."""

import datetime as dt

from pyspark.sql import functions as F

from tidewatch.operators import alerts as A
from tidewatch.operators import audit as AU
from tidewatch.operators import ingest as I
from tidewatch.operators import patterns as X
from tidewatch.operators import scoring as S
from tidewatch.operators import windows as W
from tidewatch.plans import pipeline as PL
from tidewatch.schema import CANONICAL

NOW = "2026-07-23 00:00:00"


def verdict(make, rows):
    facts = W.shared_facts(make(rows))
    return S.rule_verdict(W.window_features(facts)).collect()


def test_night_usb_copy(make):
    rows = [{"at": "2026-07-22 02:28:00", "category": "DOC", "action": "READ", "channel": "LOCAL", "target": "list_2026.xlsx"},
            {"at": "2026-07-22 02:29:00", "category": "DOC", "action": "MOUNT", "channel": "USB", "target": "E:"},
            {"at": "2026-07-22 02:30:00", "category": "DOC", "action": "COPY", "channel": "USB", "target": "list_2026.xlsx", "size": 20480000, "count": 200}]
    v, = verdict(make, rows)
    assert (v["risk_score"], v["intent"], v["channels"]) == (70, "data_exfiltration", "USB")


def test_job_seeking(make):
    rows = [{"at": "2026-07-22 09:10:00", "domain": "www.zhipin.com"}, {"at": "2026-07-22 09:25:00", "domain": "maimai.cn"},
            {"at": "2026-07-22 09:40:00", "category": "SEARCH", "target": "简历模板"}, {"at": "2026-07-22 10:00:00", "category": "SEARCH", "target": "面试"}]
    v, = verdict(make, rows)
    assert (v["risk_score"], v["intent"]) == (55, "job_seeking")
    anchored = S.score_events(make(rows), NOW).first()
    assert (anchored["risk_score"], anchored["intent"], anchored["anchored"]) == (75, "job_seeking", 75)


def test_exfil_intent(make):
    rows = [{"at": "2026-07-22 14:00:00", "category": "DOC", "action": "COPY", "channel": "LOCAL", "target": "合同.docx"},
            {"at": "2026-07-22 14:10:00", "domain": "pan.baidu.com"}, {"at": "2026-07-22 14:15:00", "category": "SEARCH", "target": "网盘"}]
    v, = verdict(make, rows)
    assert (v["risk_score"], v["intent"], v["channels"]) == (65, "data_exfiltration", "netdisk")


def test_send_to_rare_destination_scores_85(make):
    rows = [{"at": "2026-07-22 14:00:00", "category": "DOC", "action": "SEND", "channel": "NETWORK", "target": "a.pdf", "dest": "wetransfer.com/up"}]
    assert S.score_events(make(rows), NOW).first()["risk_score"] == 85
    usual = [{**rows[0], "dest": "im.example.com/f"}]
    assert S.score_events(make(usual), NOW).first()["risk_score"] == 80


def no_aliases(spark):
    return spark.createDataFrame([], "account string, name string"), spark.createDataFrame([], "employee_id string")


def test_reimport_adds_nothing_and_later_feeds_accumulate(spark, make, tmp_path):
    store = PL.Store(spark, str(tmp_path))
    al, ign = no_aliases(spark)
    rows = [{"at": f"2026-07-22 09:{m:02d}:00", "domain": "pan.baidu.com"} for m in (1, 2, 3, 15)] + [
        {"at": "2026-07-22 09:20:00", "category": "DOC", "action": "COPY", "target": "a"}]
    batch = make(rows)
    for _ in range(2):
        PL.ingest_batch(store, batch, 0, al, ign)
    events = store.read("events", CANONICAL)
    assert events.count() == 3                       # two folded visits and one document
    PL.ingest_batch(store, make([{"at": "2026-07-22 11:00:00", "domain": "mail.qq.com"}]), 1, al, ign)
    assert store.read("events", CANONICAL).count() == 4
    scored = S.score_events(store.read("events", CANONICAL), NOW)
    judged = scored.select("employee_id", "window_start", "window_end")
    assert S.score_events(store.read("events", CANONICAL), NOW, judged=judged).count() == 0   # idle rerun


def test_batches_may_cut_through_a_bucket(spark, make, tmp_path):
    """Six visits of a bucket in two batches, and a proxy row that comes after the endpoint copy it covers."""
    store = PL.Store(spark, str(tmp_path))
    al, ign = no_aliases(spark)
    visits = [{"at": f"2026-07-22 09:0{m}:00", "domain": "pan.baidu.com"} for m in range(6)]
    copy = {"at": "2026-07-22 23:58:00", "domain": "d.org", "source": "endpoint"}
    proxy = {"at": "2026-07-23 00:01:00", "domain": "d.org", "source": "proxy"}
    for part in (visits[:3] + [copy], visits[3:] + [proxy], visits[:3]):
        PL.ingest_batch(store, make(part), 0, al, ign)
    got = sorted((r["domain"], r["count"], r["source"]) for r in store.read("events", CANONICAL).collect())
    assert got == [("d.org", 1, "proxy"), ("pan.baidu.com", 6, "endpoint")]


def test_latest_status_wins(spark):
    alerts = A.merge_alerts(A.no_alerts(spark), verdict_rows(spark, [("p1", "2026-07-22 09:00:00", "job_seeking", 90)]), exemptions(spark), NOW)
    changes = spark.createDataFrame([("p1|job_seeking", "TRIAGING", 1), ("p1|job_seeking", "CLOSED", 2), ("p1|job_seeking", "LOST", 3)],
                                    "dedup_key string, new_status string, changed_at int")
    assert A.set_status(alerts, changes).first()["status"] == "CLOSED"


def test_profiles_keep_every_channel(make):
    from tidewatch.operators.profiles import profiles
    rows = [{"at": "2026-07-22 09:00:00", "category": "DOC", "action": "COPY", "channel": f"C{k}", "target": "a"} for k in range(100)]
    assert len(profiles(make(rows)).first()["channels_used"]) == 100


def test_append_skips_visitors_ignored_and_copies(spark, make):
    rows = [{"at": "2026-07-22 09:00:00", "who": w, "domain": "a.org"} for w in ("p1", "p1", "138", "p9")]
    kept = I.append_events(make(rows), make(rows[:1]).limit(0), spark.createDataFrame([("p9",)], "employee_id string"))
    assert [r["employee_id"] for r in kept.collect()] == ["p1"]


def test_one_hash_with_most_rows(make):
    df = make([{"at": "2026-07-22 09:00:00", "domain": "a.org"}] * 50 + [{"at": "2026-07-22 09:01:00", "domain": "b.org"}])
    assert I.append_events(df, df.limit(0)).count() == 2


def exemptions(spark, rows=()):
    return spark.createDataFrame(list(rows), "employee_id string, signal_type string, reason string, expires_at timestamp_ntz")


def verdict_rows(spark, rows):
    cols = "verdict_id string, employee_id string, window_start timestamp_ntz, window_end timestamp_ntz, intent string, risk_score int, explanation string"
    full = [(f"v{i}", w, dt.datetime.fromisoformat(at), dt.datetime.fromisoformat(at), intent, score, f"text {i}") for i, (w, at, intent, score) in enumerate(rows)]
    return spark.createDataFrame(full, cols)


def test_merge_takes_latest_and_reopens(spark):
    first = A.merge_alerts(A.no_alerts(spark), verdict_rows(spark, [
        ("p1", "2026-07-22 09:00:00", "job_seeking", 90), ("p1", "2026-07-22 11:00:00", "job_seeking", 75),
        ("p2", "2026-07-22 11:00:00", "job_seeking", 49), ("p3", "2026-07-22 11:00:00", "data_exfiltration", 80)]),
        exemptions(spark, [("p3", "data_exfiltration", "", None)]), NOW)
    row, = first.collect()
    assert (row["dedup_key"], row["risk_score"], row["verdict_id"], row["is_new"]) == ("p1|job_seeking", 75, "v1", True)
    handled = first.select(*A.ALERT_COLUMNS).withColumn("status", F.lit("CONFIRMED"))
    again = A.merge_alerts(handled, verdict_rows(spark, [("p1", "2026-07-22 15:00:00", "job_seeking", 60)]), exemptions(spark), NOW)
    row, = again.collect()
    assert (row["risk_score"], row["status"], row["reopened"], row["severity"]) == (60, "NEW", True, "HIGH")
    assert A.notifications(again).count() == 0
    idle, = A.merge_alerts(handled, verdict_rows(spark, []), exemptions(spark), NOW).collect()
    assert idle["status"] == "CONFIRMED"


def test_expired_exemption_does_not_hide(spark):
    v = verdict_rows(spark, [("p1", "2026-07-22 09:00:00", "job_seeking", 90)])
    old = exemptions(spark, [("p1", "job_seeking", "", dt.datetime(2026, 7, 1))])
    assert A.merge_alerts(A.no_alerts(spark), v, old, NOW).count() == 1


def test_mass_delete_thresholds(make):
    rows = [{"at": f"2026-07-22 10:{i:02d}:00", "category": "DOC", "action": "DELETE", "target": f"f{i % 8}.txt"} for i in range(15)]
    assert X.mass_delete(make(rows), NOW).first()["risk_score"] == 70
    assert X.mass_delete(make(rows[:14]), NOW).count() == 0
    many = [{**rows[0], "at": f"2026-07-22 10:00:{i:02d}", "target": f"f{i}.txt"} for i in range(40)]
    assert X.mass_delete(make(many), NOW).first()["risk_score"] == 80
    system = [{**r, "src": "C:\\Windows\\x"} for r in rows]
    assert X.mass_delete(make(system), NOW).count() == 0


def test_mass_exfil_by_size(make):
    row = {"at": "2026-07-22 10:00:00", "category": "DOC", "action": "SEND", "target": "a.bin", "dest": "wetransfer.com/x"}
    assert X.mass_exfil(make([{**row, "size": 50 * 1048576}]), NOW).first()["risk_score"] == 75
    assert X.mass_exfil(make([{**row, "size": 50 * 1048576 - 1}]), NOW).count() == 0
    assert X.mass_exfil(make([{**row, "size": 100 * 1048576}]), NOW).first()["risk_score"] == 85
    assert X.mass_exfil(make([{**row, "size": 100 * 1048576, "dest": "teams.microsoft.com/x"}]), NOW).count() == 0


def test_archive_then_send_ignores_empty_names(make):
    doc = {"category": "DOC", "dest": "wetransfer.com/x"}
    rows = [{**doc, "at": "2026-07-22 10:00:00", "action": "ARCHIVE", "target": ""}, {**doc, "at": "2026-07-22 11:00:00", "action": "SEND", "target": "plan.zip"}]
    assert X.archive_then_send(make(rows), NOW).count() == 0
    rows[0]["target"] = "plan.docx"
    assert X.archive_then_send(make(rows), NOW).count() == 1         # 'plan' of plan.zip is in plan.docx
    rows[0]["at"] = "2026-07-22 12:00:00"
    assert X.archive_then_send(make(rows), NOW).count() == 1
    assert X.archive_then_send(make(rows), NOW, require_order=True).count() == 0


def test_audit_is_idempotent(spark, data):
    from tidewatch.catalog.base import AS_OF, alert_frame, exemptions as ex, verdict_frames
    events, facts, v = verdict_frames(spark, data)
    v = v.select(*S.VERDICT_COLUMNS)
    sig = AU.signatures(facts)
    v1, a1, fixes = AU.audit(v, alert_frame(spark, v), sig, ex(spark), events, AS_OF)
    assert fixes.count() > 0
    from tidewatch.session import cut_lineage
    v1, a1 = cut_lineage(v1), cut_lineage(a1)
    assert AU.audit(v1, a1, sig, ex(spark), events, AS_OF)[2].count() == 0


def test_daily_job_writes_all_tables(spark, data, tmp_path):
    from tidewatch.catalog.base import AS_OF, ev, exemptions as ex
    store = PL.Store(spark, str(tmp_path))
    PL.daily_job(store, ev(spark, data), A.no_alerts(spark), ex(spark), AS_OF, "1")
    for table in ("verdicts", "alerts/version=1", "audit/version=1", "profiles/version=1"):
        assert spark.read.parquet(store.path(table)).count() > 0
