import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from tidewatch.catalog.stream_queries import run_to_end
from tidewatch.operators import windows as W
from tidewatch.plans import pipeline as PL
from tidewatch.schema import CANONICAL, to_canonical
from tidewatch.streaming import jobs as J


@pytest.fixture
def stream_of(spark, tmp_path):
    """Stream over canonical rows; each call to `add` is one micro-batch file."""
    folder = tmp_path / "in"

    def build(*batches):
        for df in batches:
            to_canonical(df).coalesce(1).write.mode("append").parquet(str(folder))
        schema = spark.read.parquet(str(folder)).schema
        return J.read_event_stream(spark, str(folder), schema)
    return build


SENTINEL = {"at": "2030-01-01 00:00:00", "who": "zz", "domain": "sentinel.org"}


def test_stream_sessions_equal_batch_windows(make, stream_of):
    rows = [{"at": f"2024-03-01 {h:02d}:{m:02d}:00", "domain": "a.org", "who": w} for h in (8, 9, 12) for m in (0, 40) for w in ("p1", "p2")]
    got = run_to_end(J.stream_sessions(stream_of(make(rows + [SENTINEL]))), "t").filter("employee_id <> 'zz'")
    want = W.build_windows(make(rows)).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_fold_emits_a_bucket_once_and_complete(make, stream_of):
    first = make([{"at": "2024-03-01 09:01:00", "domain": "pan.baidu.com"}, {"at": "2024-03-01 09:02:00", "domain": "ocsp.x.com"}])
    second = make([{"at": "2024-03-01 09:04:00", "domain": "pan.baidu.com"}, SENTINEL])
    got = run_to_end(J.stream_fold(stream_of(first, second)), "t").filter("employee_id <> 'zz'").collect()
    assert [(r["domain"], str(r["occurred_at"]), r["count"]) for r in got] == [("pan.baidu.com", "2024-03-01 09:00:00", 2)]


def test_stream_dedupe(make, stream_of):
    rows = make([{"at": "2024-03-01 09:01:00", "domain": "a.org"}] * 3)
    assert run_to_end(J.stream_dedupe(stream_of(rows, rows)), "t").count() == 1


def test_ingest_job_is_idempotent_and_resumes(spark, make, tmp_path):
    """T1/L5: each micro-batch is stored; a restart reads only what is new."""
    inbox, store = str(tmp_path / "msgs"), PL.Store(spark, str(tmp_path / "store"))
    os.makedirs(inbox)
    al = spark.createDataFrame([], "account string, name string")
    ign = spark.createDataFrame([], "employee_id string")
    head = "<134>Aug 20 10:00:00 host tag: "

    def put(lines):
        with open(os.path.join(inbox, uuid.uuid4().hex + ".txt"), "w") as f:
            f.write("\n".join(lines))

    def save(batch, batch_id):
        numbered = batch.withColumn("event_id", F.monotonically_increasing_id())
        PL.ingest_batch(store, PL.message_batch(numbered), batch_id, al, ign)

    def run():
        q = J.start_ingest(M_stream(), save, str(tmp_path / "cp"), once=True)
        q.awaitTermination()
        return store.read("events", CANONICAL).count()

    def M_stream():
        from tidewatch.sources.messages import read_raw_stream
        return read_raw_stream(spark, inbox)

    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    line = head + "[record_time:2026-08-20 10:00:00][user:li][app:IT][url:http://pan.baidu.com/x]"
    put([line, line])
    assert run() == 1
    assert run() == 1
    put([line, line.replace("10:00:00]", "10:20:00]")])
    assert run() == 2


def test_alert_stream_merges_batches(spark, tmp_path):
    """T8: verdict batches update an alert snapshot, one version per batch."""
    from tidewatch.operators import alerts as A
    inbox = str(tmp_path / "v")
    schema = "verdict_id string, employee_id string, window_start timestamp_ntz, window_end timestamp_ntz, intent string, risk_score int, explanation string"
    ex = spark.createDataFrame([], "employee_id string, signal_type string, reason string, expires_at timestamp_ntz")
    state = {"version": None}

    def merge(batch, batch_id):
        old = A.no_alerts(spark) if state["version"] is None else spark.read.parquet(state["version"])
        out = str(tmp_path / f"alerts-{batch_id}")
        A.merge_alerts(old, batch, ex, "2026-07-23 00:00:00").select(*A.ALERT_COLUMNS).write.mode("overwrite").parquet(out)
        state["version"] = out

    for i, score in enumerate((80, 60)):
        at = dt.datetime(2026, 7, 22, 9 + i)
        spark.createDataFrame([(f"v{i}", "p1", at, at, "job_seeking", score, "t")], schema).coalesce(1).write.mode("append").parquet(inbox)
        q = (spark.readStream.schema(schema).parquet(inbox).writeStream.foreachBatch(merge)
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        q.awaitTermination()
    row, = spark.read.parquet(state["version"]).collect()
    assert (row["risk_score"], row["verdict_id"], row["status"]) == (60, "v1", "NEW")


def test_late_rows_go_to_the_side_table(make):
    df = make([{"at": "2024-03-01 09:00:00", "domain": "a.org"}, {"at": "2024-03-01 11:00:00", "domain": "a.org"}])
    on_time, late = J.split_late(df, "2024-03-01 11:00:00")
    assert (on_time.count(), late.count()) == (1, 1)
    assert J.split_late(df, None)[1].count() == 0


def test_feed_silence(spark):
    raw = spark.createDataFrame([("proxy", dt.datetime(2024, 3, 1, 9, 59)), ("endpoint", dt.datetime(2024, 3, 1, 10, 0))], "feed string, received_at timestamp_ntz")
    alarms = lambda at: {r["feed"]: r["alarm"] for r in J.feed_silence(raw, at).collect()}
    assert alarms("2024-03-01 12:00:00") == {"proxy": True, "endpoint": False}
    assert alarms("2024-03-01 21:00:00") == {"proxy": False, "endpoint": False}


def test_heartbeat_stream_alarms_after_silence(spark, tmp_path):
    import time
    spark.createDataFrame([("proxy",), ("proxy",), ("endpoint",)], "feed string").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("feed string").parquet(str(tmp_path / "in")).withColumn("received_at", F.current_timestamp())
    name = "hb" + uuid.uuid4().hex
    q = (J.stream_heartbeat(src, silence_seconds=1).writeStream.format("memory").queryName(name).outputMode("update")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start())
    try:
        for _ in range(40):
            time.sleep(1)
            if spark.table(name).count() >= 2:
                break
        assert {r["feed"] for r in spark.table(name).collect()} == {"proxy", "endpoint"}
    finally:
        q.stop()


def test_late_rows_reach_the_results(make):
    """A row days behind the watermark is in the daily result of each job, in the right bucket, once."""
    from tidewatch.catalog import stream_queries as Q
    row = lambda at, **more: {"at": f"2024-03-01 {at}:00", "domain": "pan.baidu.com", **more}
    first = make([row("09:01"), row("09:02", who="p2"), SENTINEL])
    second = make([row("09:04"), row("08:50", who="p2"), row("09:06", domain="a.org")])

    parts = [to_canonical(df) for df in (first, second)]
    got = {(r["employee_id"], r["domain"], str(r["occurred_at"])[11:16]): r["n"] for r in Q.fold_whole(*Q.in_parts(parts)).collect()}
    assert got == {("p1", "pan.baidu.com", "09:00"): 2, ("p1", "a.org", "09:00"): 1, ("p2", "pan.baidu.com", "09:00"): 1, ("p2", "pan.baidu.com", "08:50"): 1}
    sessions = {(r["employee_id"], str(r["window_start"])[11:16], str(r["window_end"])[11:16]): r["n_events"] for r in Q.sessions_whole(*Q.in_parts(parts)).collect()}
    assert sessions == {("p1", "09:01", "09:06"): 3, ("p2", "08:50", "09:02"): 2}
