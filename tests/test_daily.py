"""Scoring day by day: equal to one run, reads new days only, open windows, baselines, suppression."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import profiles as P
from tidewatch.operators import scoring as S
from tidewatch.operators import windows as W
from tidewatch.plans import daily as DL

D1 = dt.date(2026, 7, 20)


def day(k):
    return D1 + dt.timedelta(k)


COLUMNS = ["verdict_id", "window_end", "n", "visits", "intent", "risk_score", "deviation_flags", "channels", "anchored"]


def rows_of(rnd, days, people):
    """Rows that run over midnight, also over two midnights, and people who pause for days."""
    rows = []
    for who in people:
        for k in range(days):
            if rnd.random() < 0.25:
                continue
            for _ in range(rnd.randint(1, 12)):
                at = dt.datetime.combine(day(k), dt.time()) + dt.timedelta(minutes=rnd.choice([rnd.randrange(1440), rnd.randrange(1380, 1440), rnd.randrange(60)]))
                kind = rnd.random()
                if kind < 0.6:
                    rows.append({"at": at, "who": who, "domain": rnd.choice(["pan.baidu.com", "mail.qq.com", "zhipin.com", "a.org", "github.com"]), "count": rnd.randint(1, 9)})
                else:
                    rows.append({"at": at, "who": who, "category": "DOC", "action": rnd.choice(["COPY", "SEND", "DELETE"]), "channel": rnd.choice(["LOCAL", "USB", "NETWORK"]),
                                 "target": "f", "dest": "x/y"})
    for k in range(48):  # one window from the evening of day 1 to the night of day 3
        rows.append({"at": dt.datetime.combine(day(1), dt.time(21)) + dt.timedelta(minutes=50 * k), "who": "long", "domain": "mail.qq.com"})
    return rows


def table(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [3])
def test_day_by_day_equals_one_run(spark, make, tmp_path, seed):
    events = make(rows_of(random.Random(seed), 6, ["p1", "p2", "p3"])).cache()
    rules = S.Rules(cross_day_days=99)  # the 7-day history ends with the run
    whole = DL.score_days(events, DL.ScoreState(spark, str(tmp_path / "a")), D1, day(5), rules, close_all=True)
    want = table(whole)
    plain = table(S.score_events(events, f"{day(6)} 00:00:00", rules))
    assert want == plain and len(want) > 15
    state, got = DL.ScoreState(spark, str(tmp_path / "b")), []
    for a, b in ((0, 1), (2, 2), (3, 3), (4, 4), (5, 5)):
        if a == 3:  # a repeated run replaces its own folders
            DL.score_days(events, state, day(a), day(b), rules)
        got += table(DL.score_days(events, state, day(a), day(b), rules, close_all=b == 5))
    assert sorted(got, key=str) == want


def test_only_new_days_are_read(spark, make, tmp_path):
    from tidewatch.sources.sinks import append_partitioned
    events = make(rows_of(random.Random(1), 3, ["p1"]))
    append_partitioned(events, str(tmp_path / "e"))
    stored = spark.read.parquet(str(tmp_path / "e"))
    new = stored.filter(F.col("occurred_at").cast("date").between(F.lit(day(2)), F.lit(day(2))) & (F.col("event_date") == F.lit(day(2))))
    assert {r[0].split("event_date=")[1][:10] for r in new.select(F.input_file_name()).distinct().collect()} == {str(day(2))}
    state = DL.ScoreState(spark, str(tmp_path / "s"))
    DL.score_days(stored, state, D1, day(1))
    gone = stored.filter(F.col("event_date") == F.lit(day(2)))  # earlier days are not there any more
    left = table(DL.score_days(gone, state, day(2), day(2), close_all=True))
    again = DL.ScoreState(spark, str(tmp_path / "t"))
    DL.score_days(stored, again, D1, day(1))
    assert left == table(DL.score_days(stored, again, day(2), day(2), close_all=True))


def test_a_day_may_not_be_left_out(spark, make, tmp_path):
    events = make([{"at": f"{D1} 09:00:00", "domain": "a.org"}])
    state = DL.ScoreState(spark, str(tmp_path))
    DL.score_days(events, state, D1, D1)
    with pytest.raises(ValueError, match="day after"):
        DL.score_days(events, state, day(2), day(2))


def test_suppression_across_and_inside_runs(spark, make, tmp_path):
    at = lambda k, h: {"at": f"{day(k)} {h:02d}:10:00", "domain": "mail.qq.com"}
    events = make([at(0, 20), at(1, 1), at(1, 9), {**at(1, 12), "domain": "pan.baidu.com"}])
    for suppress, want in ((False, [1, 3]), (True, [1, 1])):
        state = DL.ScoreState(spark, str(tmp_path / str(suppress)))
        counts = [DL.score_days(events, state, day(k), day(k), suppress=suppress).count() for k in (0, 1)]
        assert counts == want if not suppress else counts[0] == 1 and counts[1] <= 1


def test_finished_verdicts(spark, make, tmp_path):
    rows = [{"at": f"{D1} 10:{m:02d}:00", "domain": "zhipin.com"} for m in range(4)] + [{"at": f"{D1} 10:05:00", "domain": "pan.baidu.com", "who": "p2"}]
    ex = spark.createDataFrame([("p1", "job_seeking", "recruiter", None)], "employee_id string, signal_type string, reason string, expires_at timestamp_ntz")
    plain = DL.score_days(make(rows), DL.ScoreState(spark, str(tmp_path / "a")), D1, D1, exemptions=ex).collect()
    done = DL.score_days(make(rows), DL.ScoreState(spark, str(tmp_path / "b")), D1, D1, exemptions=ex, finished=True).collect()
    text = {r["employee_id"]: r["explanation"] for r in done}
    assert text["p1"].startswith("[exempt:recruiter] ") and "zhipin.com" in text["p1"]
    assert {r["verdict_id"] for r in plain} == {r["verdict_id"] for r in done}
    assert all(a["risk_score"] >= b["risk_score"] for a, b in zip(sorted(plain), sorted(done)))


def test_running_median_is_exact(spark):
    """Against sorted lists, with spill rows, an earlier histogram, and batches that cut through people."""
    rnd = random.Random(2)
    days, start, want = [], [], []
    for who in [f"p{k}" for k in range(7)] + [None]:
        known = [rnd.randint(1, 6) for _ in range(rnd.choice([0, 0, 3, 8]))]
        if known and who is not None:
            start.append((who, [(x, known.count(x)) for x in sorted(set(known))]))
        seen = list(known) if who is not None else []
        for k in range(rnd.randint(1, 30)):
            rows, spill = rnd.randint(1, 9), rnd.choice([0, 0, 2, 5])
            days.append((who, day(k), rows, spill))
            have = sorted(seen + [spill] * (spill > 0))
            mid = (have[(len(have) - 1) // 2] + have[len(have) // 2]) // 2 if have else 0
            want.append((who, day(k), mid, have[-1] if have else 0))
            seen.append(rows)
    rnd.shuffle(days)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = P.running_median(spark.createDataFrame(days, "employee_id string, day date, rows long, spill long"),
                               spark.createDataFrame(start, f"employee_id string, histogram {P.HISTOGRAM}")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_baseline_keeps_no_array_per_day(spark, make):
    facts = W.with_window_start(W.session_facts(make([{"at": f"{D1} 09:00:00", "domain": "a.org"}])))
    plan = P.baseline_asof(facts)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
