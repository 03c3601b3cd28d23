"""Window operators against brute force on random and boundary data."""

import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tidewatch.operators import identity as ID
from tidewatch.operators import ingest as I
from tidewatch.operators import patterns as X
from tidewatch.operators import profiles as P
from tidewatch.operators import scoring as S
from tidewatch.operators import windows as W
from tidewatch.plans import reports as R
from tidewatch.schema import Rules

T0 = dt.datetime(2024, 3, 1)


def random_events(seed, n, people=3, span_hours=60):
    r = random.Random(seed)
    return [{"at": T0 + dt.timedelta(seconds=r.randrange(span_hours * 3600)), "who": f"p{r.randrange(people)}",
             "domain": r.choice(["pan.baidu.com", "weibo.com", "example.org", "mail.qq.com"])} for _ in range(n)]


def brute_windows(rows, gap):
    by = defaultdict(list)
    for x in rows:
        by[x["who"]].append(x["at"])
    out = set()
    for who, ts in by.items():
        ts.sort()
        start = prev = ts[0]
        n = 0
        for t in ts + [None]:
            if t is None or (t - prev).total_seconds() > gap and n:
                out.add((who, start, prev, n))
                start, n = t, 0
            n, prev = n + 1, t
    return out


def test_gap_is_inclusive(make):
    rows = [{"at": "2024-03-01 09:30:00"}, {"at": "2024-03-01 10:30:00"}, {"at": "2024-03-01 11:30:01"}]
    got = sorted((r["n_events"], str(r["window_end"])) for r in W.build_windows(make(rows)).collect())
    assert got == [(1, "2024-03-01 11:30:01"), (2, "2024-03-01 10:30:00")]


def test_windows_match_brute_force(make):
    for seed, gap in ((1, 3600), (2, 1800), (3, 5400), (4, 100)):
        rows = random_events(seed, 300)
        got = {(r["employee_id"], r["window_start"], r["window_end"], r["n_events"])
               for r in W.build_windows(make(rows), Rules(session_gap_seconds=gap)).collect()}
        assert got == brute_windows(rows, gap)


def test_one_person_with_most_rows_is_reduced_before_the_window(make):
    plan = W.build_windows(make(random_events(5, 50)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.rindex("Aggregate")  # the window reads aggregated slices


def brute_segments(ts):
    ts = sorted(ts)
    segs, cur = [], [ts[0]]
    for t in ts[1:]:
        if (t - cur[-1]).total_seconds() <= 900:
            cur.append(t)
        else:
            segs.append(cur)
            cur = [t]
    segs.append(cur)
    secs = [max(min((s[-1] - s[0]).total_seconds(), len(s) * 600), 300) for s in segs]
    total = sum(secs)
    return sorted(int(x * 25200 / total) if total > 25200 else x for x in secs)


def test_leisure_segments_floor_and_cap(make):
    one = make([{"at": "2024-03-01 09:00:00", "domain": "weibo.com"}])
    assert W.leisure_segments(one).first()["seconds"] == 300
    pair = make([{"at": "2024-03-01 09:00:00", "domain": "weibo.com"}, {"at": "2024-03-01 09:15:00", "domain": "weibo.com"}])
    assert W.leisure_segments(pair).first()["seconds"] == 900
    apart = make([{"at": "2024-03-01 09:00:00", "domain": "weibo.com"}, {"at": "2024-03-01 09:15:01", "domain": "weibo.com"}])
    assert W.leisure_segments(apart).count() == 2
    full_day = [T0 + dt.timedelta(minutes=5 * i) for i in range(200)]
    got = sorted(r["seconds"] for r in W.leisure_segments(make([{"at": t, "domain": "weibo.com"} for t in full_day])).collect())
    assert got == brute_segments(full_day) and sum(got) <= 25200


def test_near_in_time_matches_brute_force(make):
    rows = random_events(7, 200, people=2, span_hours=20)
    df = make(rows)
    left, right = df.filter("domain = 'weibo.com'"), df.filter("domain = 'example.org'")
    for seconds in (60, 600, 4000):
        got = {r["event_id"] for r in I.near_in_time(left, right, ["employee_id"], seconds, how="semi").collect()}
        want = {i for i, a in enumerate(rows) if a["domain"] == "weibo.com" and any(
            b["domain"] == "example.org" and b["who"] == a["who"] and abs((a["at"] - b["at"]).total_seconds()) <= seconds for b in rows)}
        assert got == want


def test_asof_last_matches_brute_force(spark):
    r = random.Random(3)
    rows = [(i, "a%d" % r.randrange(2), T0 + dt.timedelta(seconds=r.randrange(200_000)), r.choice([None, None, None, "x", "y", "z"])) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id bigint, agent string, occurred_at timestamp_ntz, acct string")
    got = {x["event_id"]: x["out"] for x in ID.asof_last(df, "agent", "acct", ["occurred_at", "event_id"], "out").collect()}
    for i, agent, at, _ in rows:
        past = [x for x in rows if x[1] == agent and (x[2], x[0]) <= (at, i) and x[3]]
        assert got[i] == (max(past, key=lambda x: (x[2], x[0]))[3] if past else None)


def test_contained_names_matches_brute_force(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("ab") for _ in range(r.randrange(1, n)))
    needles = [("p%d" % r.randrange(2), word(4)) for _ in range(15)]
    hay = [("p%d" % r.randrange(2), word(9)) for _ in range(40)]
    got = {tuple(x) for x in X.contained_names(spark.createDataFrame(needles, "employee_id string, needle string"),
                                              spark.createDataFrame(hay, "employee_id string, name string")).collect()}
    assert got == {(k, n, h) for k, n in needles for k2, h in hay if k == k2 and n in h}


def test_suppress_repeats_matches_brute_force(spark):
    r = random.Random(5)
    rows = [("p%d" % r.randrange(3), T0 + dt.timedelta(hours=2 * r.randrange(20)), "k%d" % r.randrange(8)) for _ in range(120)]
    got = {tuple(x) for x in W.suppress_repeats(spark.createDataFrame(rows, "employee_id string, window_start timestamp_ntz, trigger_key string")).collect()}
    want, seen = set(), defaultdict(set)
    keys = defaultdict(set)
    for who, at, k in rows:
        keys[(who, at)].add(k)
    for (who, at), ks in sorted(keys.items(), key=lambda x: x[0][1]):
        if not ks & seen[who]:
            seen[who] |= ks
            want.add((who, at))
    assert got == want


def test_timeline_limits_match_brute_force(make):
    rows = [{**x, "category": "SEARCH", "target": "t"} for x in random_events(6, 200, people=2, span_hours=96)]
    got = {r["event_hash"] for r in R.timelines(make(rows), "2024-03-05 00:00:00", days=30, per_day=10, per_person=25).collect()}
    hashes = {r["event_id"]: r["event_hash"] for r in make(rows).collect()}
    want = set()
    for who in ("p0", "p1"):
        mine = sorted([(x["at"], hashes[i]) for i, x in enumerate(rows) if x["who"] == who], reverse=True)[:25]
        per = defaultdict(int)
        for at, h in mine:
            per[at.date()] += 1
            if per[at.date()] <= 10:
                want.add(h)
    assert got == want


def test_baseline_uses_rows_strictly_before_the_first_window(make):
    rows = [{"at": f"2024-03-01 {h:02d}:00:00"} for h in (9, 12)] + [{"at": "2024-03-01 23:40:00"}] + [{"at": "2024-03-02 00:30:00"}, {"at": "2024-03-02 09:00:00"}]
    b = {str(r["day"]): r for r in P.baseline_asof(W.shared_facts(make(rows))).collect()}
    assert b["2024-03-01"]["sample_count"] == 0
    assert b["2024-03-02"]["sample_count"] == 4       # the 00:30 row belongs to the window of the evening before
    assert b["2024-03-02"]["daily_median"] == 2       # counts 3 and 1, truncated


def trigger(make, rows):
    facts = W.shared_facts(make(rows))
    d = S.deviation(W.window_features(facts), P.baseline_asof(facts), W.window_sites(facts))
    return [r["t"] for r in d.select(S.should_trigger().alias("t")).collect()]


def test_trigger_boundaries(make):
    day = lambda n, **k: [{"at": T0 + dt.timedelta(hours=10, seconds=i), **k} for i in range(n)]
    night = lambda n, **k: [{"at": T0 + dt.timedelta(hours=23, seconds=i), **k} for i in range(n)]
    assert trigger(make, day(14, domain="github.com")) == [False]
    assert trigger(make, day(15, domain="github.com")) == [True]                   # burst of mid-tier rows
    assert trigger(make, day(1, domain="github.com", count=29)) == [False]
    assert trigger(make, day(1, domain="github.com", count=30)) == [True]          # many mid-tier visits
    assert trigger(make, night(2, domain="example.org")) == [False]
    assert trigger(make, night(3, domain="example.org")) == [True]                 # night activity
    assert trigger(make, night(3, domain="update.example.org")) == [False]         # telemetry
    assert trigger(make, night(1, domain="authds.todesk.com")) == [False]          # heartbeat
    assert trigger(make, day(1, domain="mail.qq.com")) == [True]
    assert trigger(make, day(1, category="DOC", action="COPY", channel="USB", target="a")) == [True]
    assert trigger(make, day(1, category="DOC", action="COPY", channel="USB", target="a", src="C:\\Windows\\a")) == [False]
    assert trigger(make, day(1, category="DOC", action="SEND", channel="LOCAL", target="a", src="C:\\Windows\\a")) == [True]
