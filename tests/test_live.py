"""Ingest that publishes changed buckets: bytes written, order, replays, compaction, readers."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import ingest as I
from tidewatch.plans import live
from tidewatch.schema import to_canonical
from tidewatch.sources.ledger import Ledger


@pytest.fixture
def people(spark):
    return (spark.createDataFrame([("u1", "李")], "account string, name string"), spark.createDataFrame([("u9",)], "employee_id string"))


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def shown(ledger):
    cols = ["employee_id", "category", "domain", "occurred_at", "count", "source", "site_class", "url", "event_hash"]
    return sorted(live.read_events(ledger).select(*cols).collect(), key=str)


def at_once(make, rows, people):
    df = make(rows)
    one = to_canonical(df.dropDuplicates(["event_hash"]))
    cols = ["employee_id", "category", "domain", "occurred_at", "count", "source", "site_class", "url", "event_hash"]
    return sorted(to_canonical(I.ingest(one, one.limit(0).select("event_hash"), *people)).select(*cols).collect(), key=str)


def random_rows(rnd, n):
    start = dt.datetime(2026, 7, 21, 22, 30)
    rows = []
    for _ in range(n):
        at = start + dt.timedelta(seconds=rnd.randrange(3 * 3600))
        web = rnd.random() < 0.85
        rows.append({"at": at, "who": rnd.choice(["u1", "p2", "p3", "u9", "138"]), "domain": rnd.choice(["A.org", "b.org", "c.net", ""]) if web else None,
                     "source": rnd.choice(["endpoint", "endpoint", "proxy"]), "category": "WEB" if web else "DOC", "action": "VISIT" if web else "COPY",
                     "target": f"t{rnd.randrange(10**6)}", "url": f"http://{rnd.randrange(99)}", "site_class": rnd.choice([None, "", "news", "shop"])})
    return rows


@pytest.mark.parametrize("seed", [1])
def test_any_order_of_batches(spark, make, people, tmp_path, seed):
    """Buckets, covering proxy rows and midnight cut by batches; replays and a compaction between them."""
    rnd = random.Random(seed)
    rows = random_rows(rnd, 160)
    want = at_once(make, rows, people)
    rnd.shuffle(rows)
    ledger = Ledger(spark, str(tmp_path))
    parts = [rows[:60], rows[60:61], rows[61:120], rows[30:70], rows[120:]]
    for k, part in enumerate(parts):
        live.ingest(ledger, make(part), *people)
        if k == 2:
            live.compact_days(ledger)
    assert shown(ledger) == want and len(want) > 40
    assert live.ingest(ledger, make(rows), *people) is None
    live.compact_days(ledger)
    assert live.compact_days(ledger) is None
    assert ledger.expire(live.TABLES) > 0
    assert shown(ledger) == want
    assert {r["event_hash"] for r in ledger.read("visits", "event_hash string", ledger.snapshot()).collect()} == {r["event_hash"] for r in make(rows).collect()}


def test_written_bytes_follow_the_change(spark, make, people, tmp_path):
    """A visit in one bucket of a day with 4,000 buckets writes a few rows, not the day."""
    ledger = Ledger(spark, str(tmp_path))
    base = [{"at": f"2026-07-22 {h:02d}:{m:02d}:00", "who": f"p{k}", "domain": f"d{k}.org", "url": f"http://d{k}.org/{h}/{m}"} for k in range(40) for h in range(8, 18) for m in range(0, 60, 6)]
    first = live.ingest(ledger, make(base), *people)
    whole = size(f"{tmp_path}/events/tx={first}")
    for n, later in enumerate(([{"at": "2026-07-22 09:01:30", "who": "p3", "domain": "d3.org"}],
                               [{"at": f"2026-07-22 10:0{m}:30", "who": "p3", "domain": "d3.org"} for m in range(8)])):
        tx = live.ingest(ledger, make(later), *people)
        rows = spark.read.parquet(f"{tmp_path}/events/tx={tx}")
        assert rows.count() <= 4 + 2 * n
        assert sum(size(f"{tmp_path}/{t}/tx={tx}") for t in live.TABLES) < 0.35 * whole
    assert {r["count"] for r in live.read_events(ledger).filter("employee_id = 'p3' and occurred_at = timestamp_ntz '2026-07-22 09:00:00'").collect()} == {3}


def test_a_failed_write_is_not_read_and_can_be_repeated(spark, make, people, tmp_path, monkeypatch):
    ledger = Ledger(spark, str(tmp_path))
    live.ingest(ledger, make([{"at": "2026-07-22 09:00:00", "domain": "a.org"}]), *people)
    before = live.read_events(ledger)
    batch = make([{"at": "2026-07-22 09:05:00", "domain": "a.org"}, {"at": "2026-07-22 09:05:00", "domain": "b.org"}])
    with monkeypatch.context() as m:
        m.setattr(Ledger, "publish", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            live.ingest(ledger, batch, *people)
    assert [r["count"] for r in live.read_events(ledger).collect()] == [1]
    live.ingest(ledger, batch, *people)
    assert sorted((r["domain"], r["count"]) for r in live.read_events(ledger).collect()) == [("a.org", 2), ("b.org", 1)]
    live.compact_days(ledger)
    assert [r["count"] for r in before.collect()] == [1]  # a reader that began earlier keeps its state


def test_new_names_reach_old_days(spark, make, people, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    rows = [{"at": "2026-07-22 09:00:00", "who": "zhang", "domain": "a.org"}, {"at": "2026-07-22 09:03:00", "who": "张", "domain": "a.org", "source": "proxy"},
            {"at": "2026-07-22 09:04:00", "who": "zhang", "category": "DOC", "action": "COPY"}]
    live.ingest(ledger, make(rows), *people)
    assert {r["employee_id"] for r in live.read_events(ledger).collect()} == {"zhang", "张"}
    names = spark.createDataFrame([("zhang", "张")], "account string, name string")
    live.refold_days(ledger, {dt.date(2026, 7, 22)}, names, people[1])
    got = sorted((r["employee_id"], r["category"], r["source"]) for r in live.read_events(ledger).collect())
    assert got == [("张", "DOC", "endpoint"), ("张", "WEB", "proxy")]


def test_reads_prune_folders(spark, make, people, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    live.ingest(ledger, make([{"at": "2026-07-22 09:00:00", "domain": "a.org"}, {"at": "2026-01-01 09:00:00", "domain": "b.org"}]), *people)
    live.ingest(ledger, make([{"at": "2026-07-22 10:00:00", "domain": "a.org"}]), *people)
    plan = live.read_events(ledger).filter(F.col("event_date") == "2026-01-01")._jdf.queryExecution().optimizedPlan().toString()
    assert "event_date" in plan
    assert ledger.snapshot().on({dt.date(2026, 1, 1)}).keys() == {t for t, (s, _) in ledger.snapshot().writes.items() if s == 1}
