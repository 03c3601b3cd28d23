"""Event-time state against small replays, in any order of arrival, and from a folder without the package."""

import datetime as dt
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tidewatch.catalog import stream_queries as Q
from tidewatch.sources.ledger import Ledger
from tidewatch.streaming import jobs as J
from tidewatch.streaming import keyed as K

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def at(day, hour=0, minute=0):
    return dt.datetime(2024, 3, day, hour, minute)


def deliver(parts, schema, spark):
    return Q.in_parts([spark.createDataFrame(p, schema) for p in parts])


ROWS = "event_id long, occurred_at timestamp_ntz, agent string, hint string"


def test_identity_waits_for_earlier_rows(spark):
    """A hint that arrives after the rows it explains, and a tie that the id decides."""
    rows = [(4, at(1, 9, 30), "a", None), (3, at(1, 9, 20), "a", None), (9, at(1, 9, 0), "b", "")]
    more = [(1, at(1, 9, 10), "a", "li"), (6, at(1, 9, 40), "a", None), (5, at(1, 9, 40), "a", "wu")]
    end = [(-1, at(2), "end", None)]
    got = Q.run_deliveries(*deliver([rows, more, end], ROWS, spark), "t", lambda r: K.stream_asof(r, "agent", "hint", "2 hours")).collect()
    assert {r["id"]: r["account"] for r in got} == {1: "li", 3: "li", 4: "li", 5: "wu", 6: "wu", 9: None}


def test_identity_carries_over_batches(spark):
    """State of finished rows is one account; later batches use it."""
    first, second, end = [(1, at(1, 9), "a", "li")], [(2, at(3, 9), "a", None), (3, at(2, 9), "a", None)], [(-1, at(9), "end", None)]
    got = Q.run_deliveries(*deliver([first, second, end], ROWS, spark), "t", lambda r: K.stream_asof(r, "agent", "hint", "2 days")).collect()
    assert {r["id"]: r["account"] for r in got} == {1: "li", 2: "li", 3: "li"}


def test_rows_without_a_key_keep_no_state(spark):
    """They know their own hint at once; rows of a key wait packed, and a hint reaches later rows over them."""
    rows = [(k, at(1, k // 60, k % 60), None if k % 2 else "n1", "li" if k == 100 else "wu" if k % 50 == 1 else None) for k in range(400)]
    named = spark.createDataFrame(rows, "event_id long, occurred_at timestamp_ntz, user_no string, account_hint string").withColumn("agent_id", F.lit(""))
    source, (deliver_all,) = Q.in_parts([K.hinted(named)])
    deliver_all()
    root = Q.os.path.join(Q.checkpoint_dir(spark), "streams", Q.uuid.uuid4().hex)
    query = (K.stream_mapped(source(), "user_key", "hint", "0 seconds").writeStream.format("parquet").option("path", f"{root}/out")
             .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    # The processor keeps 200 rows of one key in a handful of state rows, and none for the 200 without a key.
    assert max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) < 20
    got = {r["id"]: r["account"] for r in spark.read.parquet(f"{root}/out").collect()}
    assert {k: a for k, a in got.items() if k % 2} == {k: "wu" if k % 50 == 1 else None for k in range(1, 400, 2)}
    assert {k: a for k, a in got.items() if k % 2 == 0} == {k: "li" if k >= 100 else None for k in range(0, 398, 2)}  # 398 is at the watermark


def test_state_runs_where_the_package_is_not(spark, tmp_path):
    """From another folder, with nothing of the package on the workers' path."""
    script = f"""
import sys
sys.path.insert(0, {ROOT!r})
from tidewatch.session import build_session
from tidewatch.catalog import load
spark = build_session("elsewhere", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}})
spark.sparkContext.setLogLevel("OFF")
print("rows", load()[0]["t07_stream_identity"](spark, "/root/testdata/sf0.001").count())
"""
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("test tables are not here")
    env = {k: x for k, x in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 701" in out.stdout, out.stderr[-2000:]


def change(key, kind, when, id_=None, score=0, start=None, expires=None):
    us = lambda t: int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    return key, when, kind, us(when), id_, score, "t", us(start) if start else -1, us(expires) if expires else -1


CHANGE = "dedup_key string, occurred_at timestamp_ntz, kind string, at long, id string, score int, text string, start long, expires long"


def alerts(spark, parts):
    got = Q.run_deliveries(*deliver([*parts, [change("end|x", "feedback", at(31))]], CHANGE, spark), "t", lambda r: K.stream_alerts(r, late="20 days"))
    return {r["dedup_key"]: r for r in K.alert_snapshot(got).collect()}, got


def test_alert_states_do_not_depend_on_arrival(spark):
    """Three deliveries in two orders: newest verdict shows, FP stays, a later verdict reopens, exemptions expire, stale ones close."""
    rows = [change("p1|job_seeking", "verdict", at(1), "v1", 80, at(1)), change("p1|job_seeking", "verdict", at(2), "v2", 60, at(2)),
            change("p2|job_seeking", "verdict", at(1), "v3", 80, at(1)), change("p2|job_seeking", "feedback", at(3), "FP"),
            change("p3|job_seeking", "verdict", at(1), "v4", 80, at(1)), change("p3|job_seeking", "feedback", at(3), "FP"), change("p3|job_seeking", "verdict", at(4), "v5", 70, at(4)),
            change("p4|job_seeking", "exempt", at(1), expires=at(5)), change("p4|job_seeking", "verdict", at(4), "v6", 80, at(4)),
            change("p5|job_seeking", "exempt", at(1), expires=at(5)), change("p5|job_seeking", "verdict", at(6), "v7", 80, at(6)),
            change("p6|baseline_deviation", "verdict", at(2), "v8", 55, at(2)), change("p7|baseline_deviation", "verdict", at(10), "v9", 55, at(10)),
            change("p8|baseline_deviation", "verdict", at(2), "w1", 40, at(2)), change("p9|job_seeking", "feedback", at(2), "FP")]
    want = {"p1|job_seeking": ("v2", 60, "NEW"), "p2|job_seeking": ("v3", 80, "FP"), "p3|job_seeking": ("v5", 70, "NEW"), "p5|job_seeking": ("v7", 80, "NEW"),
            "p6|baseline_deviation": ("v8", 55, "CLOSED"), "p7|baseline_deviation": ("v9", 55, "NEW"), "p8|baseline_deviation": ("w1", 40, "CLOSED")}
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        got, versions = alerts(spark, [rows[:5], rows[5:10], rows[10:]])
        assert {k: (r["verdict_id"], r["risk_score"], r["status"]) for k, r in got.items()} == want
        assert versions.groupBy("dedup_key", "change").count().filter("count > 1").isEmpty()
    assert got["p1|job_seeking"]["created_at"] == at(1) and got["p1|job_seeking"]["severity"] == "HIGH"


def test_silence_once_a_day_in_duty_hours(spark):
    """Gaps at night wait for the morning; a gap of several days is reported daily; a second gap of a day is not."""
    times = [at(1, 8), at(1, 13), at(1, 18), at(2, 8, 59), at(5, 10), at(5, 11, 59)]
    rows = [(k, t, "f") for k, t in enumerate(times)] + [(90, at(1, 9), "g"), (91, at(1, 9), "g")]
    parts = [rows[3:], rows[:3], [(-1, dt.datetime(2024, 3, 10, 4), "end")]]
    got = Q.run_deliveries(*deliver(parts, "event_id long, occurred_at timestamp_ntz, feed string", spark), "t",
                           lambda r: K.stream_silence(r.withColumnRenamed("occurred_at", "received_at"), late="100 hours"))
    us = lambda t: int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    found = sorted((r["feed"], r["last_us"], r["alarm_us"]) for r in got.filter("feed <> 'end'").collect())
    assert [f for f in found if f[0] == "f"] == sorted([("f", us(at(1, 8)), us(at(1, 10))), ("f", us(at(2, 8, 59)), us(at(2, 10, 59))), ("f", us(at(2, 8, 59)), us(at(3, 9))),
                                                       ("f", us(at(2, 8, 59)), us(at(4, 9))), ("f", us(at(2, 8, 59)), us(at(5, 9)))])
    assert [f[2] for f in found if f[0] == "g"] == [us(at(1, 11)), us(at(2, 9)), us(at(3, 9)), us(at(4, 9)), us(at(5, 9))]



def test_a_duplicate_two_days_late(spark, tmp_path):
    """Every batch compares hashes of its own days, however old; a compaction changes nothing."""
    ledger = Ledger(spark, str(tmp_path))
    batch = lambda *rows: spark.createDataFrame(rows, "event_hash string, occurred_at timestamp_ntz")
    assert J.dedupe_batch(ledger, batch(("a", at(1)), ("a", at(1)), ("b", at(1, 5)))).count() == 2
    assert J.dedupe_batch(ledger, batch(("c", at(3)))).count() == 1
    J.compact_hashes(ledger)
    assert [r[0] for r in J.dedupe_batch(ledger, batch(("a", at(1)), ("d", at(3)))).collect()] == ["d"]
    J.compact_hashes(ledger)
    assert J.dedupe_batch(ledger, batch(("a", at(1)), ("c", at(3)), ("d", at(3)))).count() == 0
    assert J.dedupe_batch(ledger, batch()).count() == 0


def test_pairs_within_the_period_only(make):
    rows = [{"at": "2024-03-01 09:00:00", "category": "DOC", "action": "ARCHIVE", "target": "plan.zip"},
            {"at": "2024-03-01 10:00:00", "category": "DOC", "action": "SEND", "target": "Copy of PLAN.zip", "dest": "x/y"},
            {"at": "2024-03-04 10:00:00", "category": "DOC", "action": "SEND", "target": "plan.zip", "dest": "x/y"},
            {"at": "2024-03-01 08:00:00", "category": "DOC", "action": "RENAME", "target": "customers of the year.xlsx", "dest": "c:\\ab.x"},
            {"at": "2024-03-01 12:00:00", "category": "DOC", "action": "SEND", "target": "ab.x", "dest": "x/y"},
            {"at": "2024-03-01 12:00:00", "category": "DOC", "action": "SEND", "target": "plan.zip", "dest": "x/y", "who": "p2"}]
    pairs = J.stream_pairs(make(rows).withColumn("occurred_at", F.col("occurred_at").cast("timestamp")))
    archives, renames = J.archive_pairs(pairs).collect(), J.rename_pairs(pairs).collect()
    assert [(r["employee_id"], str(r["day"]), r["n_sends"]) for r in archives] == [("p1", "2024-03-01", 1)]
    assert [(r["new"], str(r["window_start"])[:16]) for r in renames] == [("ab.x", "2024-03-01 12:00")]


def test_a_key_has_one_timer(spark):
    """Changes of one key that come in many deliveries wake it once, for the earliest of them; an alert without rows wakes when it is stale."""
    from tidewatch.streaming.keyed import alert_processor

    class Value:
        row = None
        def get(self): return self.row
        def update(self, row): self.row = row
        def clear(self): self.row = None

    class Rows(list):
        def get(self): return iter(list(self))
        def appendList(self, new): self.extend(new)
        def put(self, new): self[:] = new

    class Handle:
        def __init__(self): self.timers = []
        def getValueState(self, name, schema): return Value()
        def getListState(self, name, schema): return Rows()
        def registerTimer(self, at): self.timers.append(at)
        def deleteTimer(self, at): self.timers.remove(at)

    class Now:
        def __init__(self, ms): self.ms = ms
        def getCurrentWatermarkInMs(self): return self.ms

    handle, alerts = Handle(), alert_processor(3_000_000)
    alerts.init(handle)
    row = lambda at, id_: {"kind": "verdict", "at": at * 1_000_000, "id": id_, "score": 55, "text": "t", "start": at, "expires": -1}
    for at in (5, 3, 7, 4):
        alerts.handleInputRows(("p|baseline_deviation",), iter([row(at, f"v{at}")]), None)
    assert handle.timers == [3001]
    handle.timers.clear()
    out = list(alerts.handleExpiredTimer(("p|baseline_deviation",), Now(4500), None))
    assert [(r["change"], r["verdict_id"], r["status"]) for r in out] == [(1, "v3", "NEW"), (2, "v4", "NEW")] and handle.timers == [5001]
    handle.timers.clear()
    out = list(alerts.handleExpiredTimer(("p|baseline_deviation",), Now(9000), None))
    assert [(r["verdict_id"], r["status"]) for r in out] == [("v5", "NEW"), ("v7", "CLOSED")] and handle.timers == []
