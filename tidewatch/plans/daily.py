"""Scoring that reads new days only.

What a run leaves for the next one, one folder per run and state:

    open        facts of windows that may go on after the last day, and the baseline their first day has
    baseline    per person: sums over finished windows, histogram of daily row counts
    day_sites   visits per person, day and risk-classed site
    day_classes rows per person, day and risk class (for the 7-day history)
    keys        trigger keys of judged windows

A window is scored by the run in whose days it ends (its last event and the session gap lie before the end of the range),
once, with the baseline of the day on which it started.  Runs over single days, several days, or all days at once give
the same verdicts, apart from the 7-day history, which ends with the run's last day.  A run that is repeated replaces its
own folders.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import events as E
from ..functions import parsing as P
from ..functions.base import int_div
from ..operators import scoring as S
from ..operators import windows as W
from ..operators.profiles import baseline_asof, baseline_state, day_rows
from ..schema import Rules
from ..session import cut_lineage
from ..vocab import DEFAULT, Vocabulary

HISTORY_DAYS = 7


@dataclass
class ScoreState:
    """Folders of all runs under one root; a run is named by its last day."""

    spark: SparkSession
    root: str

    def path(self, name: str, day: dt.date) -> str:
        return f"{self.root}/{name}/run={day.isoformat()}"

    def exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def runs(self, name: str) -> list[dt.date]:
        """Last days of the finished runs."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(where)] if fs.exists(where) else []
        done = [p.getName() for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(dt.date.fromisoformat(n.partition("=")[2]) for n in done)

    def write(self, df: DataFrame, name: str, day: dt.date) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name, day))
        return self.spark.read.schema(df.schema).parquet(self.path(name, day))

    def read(self, name: str, days: list[dt.date]) -> DataFrame | None:
        """Rows of the given runs."""
        return self.spark.read.parquet(*[self.path(name, d) for d in days]) if days else None


def _midnight(day: dt.date) -> Column:
    return F.lit(int(dt.datetime(day.year, day.month, day.day, tzinfo=dt.timezone.utc).timestamp() * 1_000_000))


def _day_of(us) -> Column:
    return F.date_from_unix_date(int_div(us, 86_400_000_000).cast("int"))


def class_days(facts: DataFrame) -> DataFrame:
    """Rows per person, risk class and day."""
    return (facts.filter("risk_class is not null").groupBy("employee_id", "risk_class", _day_of("lo").alias("day"))
            .agg(F.sum("n").alias("n")))


def history_of(days: DataFrame, last: dt.date, rules: Rules = Rules()) -> DataFrame:
    """The 7-day history (see `scoring.history`) from daily counts."""
    first = last - dt.timedelta(HISTORY_DAYS - 1)
    return (days.filter(F.col("day").between(F.lit(first), F.lit(last))).groupBy("employee_id", "risk_class")
            .agg(F.sum("n").alias("n_rows"), F.countDistinct("day").alias("n_days"))
            .withColumn("cross_day", F.col("n_days") >= rules.cross_day_days))


def finish(verdicts: DataFrame, sites: DataFrame, exemptions: DataFrame | None, as_of: str, review: DataFrame | None = None) -> DataFrame:
    """Last touches before a verdict is stored.

    Cap of work-hours windows, second opinion (`review`, see `scoring.reconcile`) with its counts put right, sites in the
    text, exemption notes.
    """
    cap = S.work_hours_cap()
    # An anchored score is evidence; only free scores are capped.
    capped = F.when(F.col("anchored").isNull() & cap.isNotNull(), F.least("risk_score", cap)).otherwise(F.col("risk_score"))
    out = verdicts.withColumn("risk_score", capped.cast("int"))
    if review is not None:
        out = S.reconcile(out, review)
        # Hosts of a window and their visits; a window has few.
        counts = sites.groupBy(*S.WINDOW_KEY).agg(F.map_from_entries(F.collect_list(F.struct("site", "visits"))).alias("_counts"))
        claimed = P.correct_counts("explanation", F.col("_counts"))
        out = out.join(counts, S.WINDOW_KEY, "left").withColumn("explanation", F.when(F.col("_counts").isNotNull(), claimed).otherwise(F.col("explanation"))).drop("_counts")
    out = S.prefix_facts(cut_lineage(out), sites)  # which reads the verdicts three times
    return out if exemptions is None else S.annotate_exempt(out, exemptions, as_of)


def facts_of_days(events: DataFrame, first: dt.date, last: dt.date, rules: Rules = Rules(), v: Vocabulary = DEFAULT) -> DataFrame:
    """Session facts of the days `first`..`last`, written once: events are classified in one pass."""
    day = F.col("occurred_at").cast("date").between(F.lit(first), F.lit(last))
    return cut_lineage(W.session_facts(events.filter(day).filter(~E.is_visitor("employee_id", 8)), v, rules))


def score_days(events: DataFrame, state: ScoreState, first: dt.date, last: dt.date, rules: Rules = Rules(), v: Vocabulary = DEFAULT,
               close_all: bool = False, suppress: bool = False, exemptions: DataFrame | None = None, finished: bool = False, review: DataFrame | None = None,
               new: DataFrame | None = None) -> DataFrame:
    """Score the windows that end in `first`..`last` and store what the next run needs; `events` must cover these days.

    `close_all` also scores windows that are still open, as at the end of the data.  With `suppress`, windows that share a
    trigger key with an earlier one of this run, or with one judged in the last `suppress_hours` before the range, are
    left out.  With `finished`, verdicts get `finish`.  `new` are the written `facts_of_days` of the range, if the caller has them.
    """
    done = [d for d in state.runs("baseline") if d < first]
    before = done[-1] if done else None
    if before is not None and before != first - dt.timedelta(1):
        raise ValueError(f"the last run ended with {before}; this one must begin on the day after it")
    gap = rules.session_gap_seconds * 1_000_000
    begin, end = _midnight(first), _midnight(last + dt.timedelta(1))

    new = facts_of_days(events, first, last, rules, v) if new is None else new
    start = state.read("baseline", [before]) if before else None
    carried = state.read("open", [before]) if before else None
    facts = new if carried is None else new.unionByName(carried.select(*new.columns))
    facts = W.with_window_start(facts, rules)
    ends = facts.groupBy("employee_id", "window_start").agg(F.max("hi").alias("window_hi"))
    facts = cut_lineage(facts.join(ends, ["employee_id", "window_start"]).withColumn("is_open", F.lit(not close_all) & (F.col("window_hi") + gap >= end)))
    closed, still = (facts.filter(F.col("is_open") == flag).drop("is_open", "window_hi") for flag in (False, True))

    # Baselines of the days on which windows of this run start; windows from before bring theirs along.
    base = baseline_asof(facts, rules, start).filter(F.col("day") >= F.lit(first))
    if carried is not None:
        base = base.unionByName(state.read("open_baseline", [before]).select(*base.columns))
    base = cut_lineage(base)

    day_sites = state.write(S.day_site_totals(facts.filter(F.col("lo") >= begin)), "day_sites", last)
    classes = state.write(class_days(facts.filter(F.col("lo") >= begin)), "day_classes", last)
    if before is not None:
        oldest = carried.agg(F.min(_day_of("lo"))).first()[0]
        runs = state.runs("day_sites")
        if oldest is not None:
            old = state.read("day_sites", _covering(runs, oldest, before))
            day_sites = day_sites.unionByName(old.select(*day_sites.columns)).groupBy("employee_id", "day", "site", "risk_class", "tier").agg(F.sum("visits").alias("visits"))
        recent = state.read("day_classes", _covering(runs, last - dt.timedelta(HISTORY_DAYS - 1), before))
        classes = classes if recent is None else classes.unionByName(recent.select(*classes.columns))

    sites = W.window_sites(closed)
    flagged = S.deviation(W.window_features(closed, rules), base, sites, rules)
    due = flagged.filter(S.should_trigger(rules))
    keys = W.trigger_keys(closed)
    if suppress:
        known = _covering(state.runs("keys"), first - dt.timedelta(1 + rules.suppress_hours // 24), before) if before else []
        if known:
            due = due.join(S.repeated_windows(keys, state.read("keys", known), f"{first} 00:00:00", rules), S.WINDOW_KEY, "left_anti")
        own = keys.join(due.select(*S.WINDOW_KEY), S.WINDOW_KEY, "left_semi")
        due = due.join(own.select(*S.WINDOW_KEY).distinct().join(W.suppress_repeats(own), S.WINDOW_KEY, "left_anti"), S.WINDOW_KEY, "left_anti")
    due = cut_lineage(due)
    verdicts = S.with_verdict_id(S.anchored_verdicts(S.rule_verdict(due), S.day_totals(sites, day_sites), history_of(classes, last, rules)))
    if finished:
        verdicts = finish(verdicts, sites, exemptions, f"{last + dt.timedelta(1)} 00:00:00", review)

    state.write(keys.join(due.select(*S.WINDOW_KEY), S.WINDOW_KEY, "left_semi"), "keys", last)
    state.write(base.join(still.select("employee_id", F.col("window_start").cast("date").alias("day")).distinct(), ["employee_id", "day"], "left_semi"), "open_baseline", last)
    state.write(still.drop("window_start"), "open", last)
    verdicts = state.write(verdicts, "verdicts", last)
    counted = day_rows(facts).filter(F.col("day") >= F.lit(first))
    state.write(baseline_state(closed, counted, start), "baseline", last)  # last: a run without it has not ended
    return verdicts


def _covering(runs: list[dt.date], first: dt.date, last: dt.date) -> list[dt.date]:
    """Runs up to `last` that hold days from `first` on (a run holds the days after the run before it)."""
    up_to = [d for d in runs if d <= last]
    return [d for k, d in enumerate(up_to) if d >= first]
