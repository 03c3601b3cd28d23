"""Per-person profiles, common domains and as-of baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import events as E
from ..functions import parsing as P
from ..functions.base import blank_to_null, int_div, text
from ..schema import OUTBOUND_ACTIONS, Rules
from ..session import cut_lineage
from ..vocab import DEFAULT, Vocabulary

TOP = {"hour": 8, "domain": 20, "ext": 8, "code": 8, "send": 6, "send_day": 14, "topic": 10}


def common_domains(events: DataFrame, min_ratio: float = 0.3, v: Vocabulary = DEFAULT) -> DataFrame:
    """Domains that max(2, int(people × ratio)) people visit; none below three people.

    Distinct pairs are reduced first, so a popular domain is counted from one
    row per person.
    """
    people = events.select("employee_id").distinct().agg(F.count("*").alias("people")).scalar()
    users = (events.filter((F.col("category") == "WEB") & (text("domain") != ""))
             .select("domain", "employee_id").distinct()
             .groupBy("domain").agg(F.count("*").alias("n_people"))
             .filter(D.risk_class("domain", v).isNull()))
    need = F.greatest(F.lit(2), F.floor(people * min_ratio).cast("int"))
    return users.filter((people >= 3) & (F.col("n_people") >= need)).select("domain", "n_people")


def _observations(v: Vocabulary) -> Column:
    """Array of (kind, key) facts one event contributes to its person's profile; unused places are null."""
    web, doc, search = [F.col("category") == c for c in ("WEB", "DOC", "SEARCH")]
    outbound = doc & F.col("action").isin(*OUTBOUND_ACTIONS)
    target = text("target_value")

    def one(kind: str, key: Column, cond: Column = F.lit(True)) -> Column:
        return F.when(cond & key.isNotNull(), F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key")))

    root = blank_to_null(F.substring(F.substring_index(text("dest_path"), "/", 1), 1, 40))
    send = F.concat_ws(":", "action", F.coalesce(root, blank_to_null("channel"), F.lit("LOCAL")))
    codes = P.project_codes(target)
    single = F.array(
        one("channel", blank_to_null("channel")),
        one("action", F.col("action")),
        one("domain", blank_to_null("domain"), web & D.risk_class("domain", v).isNull()),
        one("web_class", F.nullif(D.domain_class("domain", v), F.lit("other")), web & (F.col("source") == "endpoint")),
        one("ext", P.file_ext(target), doc),
        *[one("code", F.get(codes, F.lit(i)), doc) for i in range(3)],
        one("send", send, outbound),
        one("send_day", E.day("occurred_at"), outbound),
        one("topic", F.substring(F.trim(target), 1, 24), search & (target != "")),
    )
    words = F.array(*[F.lit(k) for k in v.get("sensitive_keywords")])
    named = F.transform(F.filter(words, lambda w: F.contains(target, w)),
                        lambda w: F.struct(F.lit("keyword").alias("kind"), w.alias("key")))
    return F.when(E.is_sensitive(target, v), F.concat(single, named)).otherwise(single)


def observation_counts(events: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """(employee_id, kind, key, n) of everything a profile lists except hours."""
    return (events.select("employee_id", F.explode(_observations(v)).alias("o")).filter("o is not null")
            .groupBy("employee_id", F.col("o.kind").alias("kind"), F.col("o.key").alias("key"))
            .agg(F.count("*").alias("n")))


def hour_slots(events: DataFrame) -> DataFrame:
    """Rows per person and hour of the calendar."""
    hour = int_div(F.unix_micros(F.col("occurred_at").cast("timestamp")), 3_600_000_000)
    return (events.groupBy("employee_id", hour.alias("slot")).agg(F.count("*").alias("n"))
            .withColumn("day", int_div("slot", 24)).withColumn("hour", F.pmod("slot", F.lit(24)).cast("int")))


def _rhythm(slots: DataFrame) -> DataFrame:
    """Day statistics per person; the lists hold one entry per day of the period."""
    days = (slots.groupBy("employee_id", "day")
            .agg(F.sum("n").alias("n"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour")))

    def upper_median(c: str) -> Column:
        ordered = F.array_sort(F.collect_list(c))
        return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))

    return days.groupBy("employee_id").agg(
        F.count("*").alias("active_days"), F.sum("n").alias("sample_count"),
        F.floor(F.percentile("n", F.lit(0.5))).cast("int").alias("daily_median"),
        F.max("n").alias("daily_max"),
        F.struct(upper_median("first_hour").alias("start_median"), upper_median("last_hour").alias("end_median"),
                 F.count_if(F.col("first_hour") < 7).alias("late_night_days")).alias("rhythm"))


def rhythms(events: DataFrame, as_of: str, lookback_days: int = 30) -> DataFrame:
    """The day part of a profile alone: two columns of the events, no lists."""
    return _rhythm(hour_slots(E.since(events, as_of, days=lookback_days)))


def profiles(events: DataFrame, as_of: str | None = None, lookback_days: int = 30,
             v: Vocabulary = DEFAULT) -> DataFrame:
    """One row per person; without `as_of` the whole history counts.

    Top lists break ties by key.  They are cut by a rank filter that Spark also
    applies before the shuffle, so a person with many distinct keys sends at
    most the limit from each task.
    """
    if as_of is not None:
        events = E.since(events, as_of, days=lookback_days)
    counts = cut_lineage(observation_counts(events, v))  # top lists and whole lists read it

    slots = hour_slots(events)
    base = _rhythm(slots)

    hours = (slots.groupBy("employee_id", F.lit("hour").alias("kind"),
                           F.lpad(F.col("hour").cast("string"), 2, "0").alias("key")).agg(F.sum("n").alias("n")))
    ranked = counts.unionByName(hours)
    weight = F.when(F.col("kind") == "send_day", F.unix_date(F.col("key").try_cast("date")).cast("bigint")).otherwise(F.col("n"))
    order = Window.partitionBy("employee_id", "kind").orderBy(F.desc("weight"), "key")
    ranked = ranked.withColumn("weight", weight).withColumn("rn", F.row_number().over(order))
    limit = F.lit(None).cast("int")
    for kind, k in TOP.items():
        limit = F.when(F.col("kind") == kind, F.lit(k)).otherwise(limit)
    # Only top lists are cut; channels, actions, classes and keywords are kept whole.
    listed = F.col("kind").isin(*TOP)
    top = (ranked.filter(listed).filter(F.col("rn") <= max(TOP.values())).filter(F.col("rn") <= limit)
           .unionByName(ranked.filter(~listed)))

    def entries(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rn", "key", "n"))))

    kinds = ["hour", "channel", "web_class", "domain", "action", "keyword", "ext", "code", "send",
             "send_day", "topic"]
    lists = top.groupBy("employee_id").agg(*[entries(k).alias(k) for k in kinds])

    def keys(kind: str) -> Column:
        return F.transform(kind, lambda x: x["key"])

    def pairs(kind: str) -> Column:
        return F.map_from_entries(F.transform(kind, lambda x: F.struct(x["key"], x["n"])))

    return base.join(lists, "employee_id").select(
        "employee_id", "active_days",
        F.transform("hour", lambda x: x["key"].cast("int")).alias("active_hours_top"),
        "daily_median", "daily_max",
        F.array_sort(keys("channel")).alias("channels_used"),
        pairs("web_class").alias("web_classes"),
        keys("domain").alias("common_domains"),
        F.array_sort(keys("action")).alias("actions_seen"),
        F.array_sort(keys("keyword")).alias("usual_keywords"),
        "sample_count",
        pairs("ext").alias("doc_types"), pairs("code").alias("project_codes"),
        pairs("send").alias("send_channels"), pairs("send_day").alias("sends_by_day"),
        keys("topic").alias("search_topics"),
        "rhythm")


def night_workers(profile: DataFrame, min_days: int = 3) -> DataFrame:
    """People whose first activity fell before 07:00 on at least `min_days` days."""
    r = F.col("rhythm")
    return (profile.filter(r["late_night_days"] >= min_days)
            .select("employee_id", r["late_night_days"].alias("late_night_days"),
                    r["start_median"].alias("start_median"), r["end_median"].alias("end_median"))
            .orderBy(F.desc("late_night_days"), "employee_id"))


def daily_parts(facts: DataFrame) -> DataFrame:
    """Per person and day on which windows start: rows, channels and rows by hour of those windows."""
    f = facts.withColumn("day", F.col("window_start").cast("date")).withColumn("hour", F.pmod(int_div("lo", 3_600_000_000), F.lit(24)))
    return f.groupBy("employee_id", "day").agg(
        F.sum("n").alias("n"), F.bit_or("row_channels").alias("channels"),
        *[F.sum(F.when(F.col("hour") == h, F.col("n")).otherwise(0)).alias(f"h{h}") for h in range(24)])


def day_rows(facts: DataFrame) -> DataFrame:
    """Per person and calendar day: its rows, and those of windows that started earlier."""
    on_day = F.date_from_unix_date(int_div("lo", 86_400_000_000).cast("int"))
    before = F.col("window_start").cast("date") < on_day
    return facts.groupBy("employee_id", on_day.alias("day")).agg(
        F.sum("n").alias("rows"), F.sum(F.when(before, F.col("n")).otherwise(0)).alias("spill"))


HISTOGRAM = "array<struct<rows: long, days: long>>"


def running_median(days: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(employee_id, day, daily_median, daily_max) over the days before each day, and its own spill.

    State is a person's histogram of daily row counts: it grows by one entry a day, and histograms of disjoint days can
    be added.  `start` holds (employee_id, histogram) of days before all of `days`.  A person has one row a day here,
    so a task passes over its people's days once, holding one histogram at a time.
    """
    import pandas as pd

    def scan(parts):
        from bisect import bisect_left, insort
        who, counts = None, []
        for pdf in parts:
            out = []
            for person, day, rows, spill, known in zip(pdf["employee_id"], pdf["day"], pdf["rows"], pdf["spill"], pdf["known"]):
                person = None if pd.isna(person) else person
                if who != (person,):
                    who, counts = (person,), []
                    if known is not None:
                        counts = sorted(x["rows"] for x in known for _ in range(x["days"]))
                n = len(counts) + (spill > 0)
                at = bisect_left(counts, spill)

                def nth(k):
                    if not spill > 0:
                        return counts[k]
                    return counts[k] if k < at else spill if k == at else counts[k - 1]

                out.append((person, day, (nth((n - 1) // 2) + nth(n // 2)) // 2 if n else 0, nth(n - 1) if n else 0))
                insort(counts, rows)
            yield pd.DataFrame(out, columns=["employee_id", "day", "daily_median", "daily_max"])

    known = F.lit(None).cast(HISTOGRAM)
    if start is not None:
        days = days.join(start.select("employee_id", F.col("histogram").alias("known")), "employee_id", "left")
    else:
        days = days.withColumn("known", known)
    rows = days.select("employee_id", "day", "rows", "spill", "known").repartition("employee_id").sortWithinPartitions("employee_id", "day")
    return rows.mapInPandas(scan, "employee_id string, day date, daily_median int, daily_max long")


def hours_mask(rules: Rules = Rules()) -> Column:
    """Bits of the hours with most rows (columns h0..h23), ties to the earlier hour."""
    by_count = F.array_sort(F.filter(
        F.array(*[F.struct((-F.col(f"h{h}")).alias("n"), F.lit(h).alias("h")) for h in range(24)]),
        lambda x: x["n"] < 0))
    return F.aggregate(F.slice(by_count, 1, rules.baseline_hours_top), F.lit(0),
                       lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1), x["h"])))


def baseline_asof(facts: DataFrame, rules: Rules = Rules(), start: DataFrame | None = None) -> DataFrame:
    """Baseline of everything before the first window of each person-day.

    Windows do not overlap, so "before the first window of day D" is the same as
    "in a window that started before D": the inequality join becomes a running
    sum over daily partial aggregates.  Only the per-day row counts need the part
    of D that belongs to a window from the day before.

    `facts` carry `window_start` (see operators.windows).  `start` (see `baseline_state`) stands for all windows and days
    before those of `facts`.
    """
    sums = ["n", *[f"h{h}" for h in range(24)]]
    daily = daily_parts(facts)
    earlier = Window.partitionBy("employee_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    running = daily.select("employee_id", "day", F.coalesce(F.bit_or("channels").over(earlier), F.lit(0)).alias("channels"),
                           *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in sums])
    days = day_rows(facts)
    if start is not None:
        past = start.select("employee_id", F.col("channels").alias("_channels"), *[F.col(c).alias(f"_{c}") for c in sums])
        joined = running.join(past, "employee_id", "left")
        running = joined.select("employee_id", "day", F.col("channels").bitwiseOR(F.coalesce("_channels", F.lit(0))).alias("channels"),
                                *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums])
    return (running.withColumn("hours_mask", hours_mask(rules)).join(running_median(days, start), ["employee_id", "day"])
            .select("employee_id", "day", F.col("n").alias("sample_count"), "hours_mask", F.col("channels").alias("channels_mask"),
                    "daily_median", "daily_max"))


def baseline_state(closed: DataFrame, days: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """What the baselines of later days need: (employee_id, n, channels, h0..h23, histogram), `start` carried on.

    `closed` are facts of finished windows, `days` the row counts (`day_rows`) of finished calendar days.
    """
    sums = ["n", *[f"h{h}" for h in range(24)]]
    parts = daily_parts(closed).drop("day")
    entries = F.struct("rows", "days")
    counted = days.groupBy("employee_id", "rows").agg(F.count("*").alias("days"))
    if start is not None:
        parts = parts.unionByName(start.select(*parts.columns))
        before = start.select("employee_id", F.explode("histogram").alias("x")).select("employee_id", "x.rows", "x.days")
        counted = counted.unionByName(before).groupBy("employee_id", "rows").agg(F.sum("days").alias("days"))
    # One entry per distinct daily count of a person.
    histogram = counted.groupBy("employee_id").agg(F.sort_array(F.collect_list(entries)).alias("histogram"))
    totals = parts.groupBy("employee_id").agg(F.bit_or("channels").alias("channels"), *[F.sum(c).alias(c) for c in sums])
    both = totals.join(histogram, "employee_id", "full")
    return both.select("employee_id", F.coalesce("channels", F.lit(0)).alias("channels"), *[F.coalesce(c, F.lit(0)).alias(c) for c in sums],
                       F.coalesce("histogram", F.array().cast(HISTOGRAM)).alias("histogram"))


def people_count(events: DataFrame) -> DataFrame:
    return events.select("employee_id").distinct().agg(F.count("*").alias("people"))
