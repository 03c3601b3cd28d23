"""End-to-end jobs: ingest a batch, score, detect, merge alerts, maintain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import events as E
from ..operators import alerts as A
from ..operators import ingest as I
from ..operators import patterns as X
from ..operators import scoring as S
from ..operators import windows as W
from ..operators.audit import audit, signatures
from ..operators.profiles import profiles
from ..schema import Rules
from ..session import cut_lineage
from ..sources import messages as M
from ..sources.ledger import Ledger
from ..sources.sinks import append_verdicts, overwrite_snapshot
from ..vocab import DEFAULT, Vocabulary
from . import live


@dataclass
class Store:
    """Table folders of a deployment under one root."""

    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def exists(self, table: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def ledger(self) -> Ledger:
        """The tables of the ingest (see plans.live)."""
        return Ledger(self.spark, self.path("ingest"))

    def read(self, table: str, schema) -> DataFrame:
        """Stored table, or an empty one before the first write."""
        if table == "events":
            return live.read_events(self.ledger())
        return self.spark.read.parquet(self.path(table)) if self.exists(table) else self.spark.createDataFrame([], schema)


def ingest_batch(store: Store, batch: DataFrame, batch_id: int, aliases: DataFrame, ignored: DataFrame) -> None:
    """Store one batch of canonical events; neither the cut between batches nor a replay changes the result."""
    live.ingest(store.ledger(), batch, aliases, ignored)


def publish_days(store: Store, days: list, aliases: DataFrame, ignored: DataFrame) -> None:
    """Publish the given days again from all their visits, after names or ignored people have changed."""
    if days:
        live.refold_days(store.ledger(), set(days), aliases, ignored)


def score_range(events: DataFrame, as_of: str, days: int = 7, rules: Rules = Rules(),
                v: Vocabulary = DEFAULT) -> DataFrame:
    """Score the windows that start in the last `days` again; baselines see the whole history."""
    verdicts = S.score_events(events, as_of, rules, v)
    return verdicts.filter(F.col("window_start") >= E.ago(as_of, days=days))


def detect_patterns(events: DataFrame, alerts: DataFrame, as_of: str, v: Vocabulary = DEFAULT) -> DataFrame:
    """New pattern alerts of the last day, whose rows are read once and written for the detectors."""
    last = cut_lineage(E.since(events, as_of, hours=24))
    found = [X.archive_then_send(last, as_of, v=v), X.rename_disguise(last, as_of, v=v),
             X.trend_spike(events, as_of, v=v), X.mass_delete(last, as_of), X.mass_exfil(last, as_of, v=v)]
    rows = found[0].select(*X.ALERT_COLUMNS)
    for f in found[1:]:
        rows = rows.unionByName(f.select(*X.ALERT_COLUMNS))
    return X.insert_once(alerts, rows, as_of)


def alert_snapshot(events: DataFrame, verdicts: DataFrame, alerts: DataFrame, exemptions: DataFrame, as_of: str,
                   rules: Rules = Rules(), v: Vocabulary = DEFAULT) -> DataFrame:
    """Alerts after verdict merge, patterns and auto-close."""
    merged = A.merge_alerts(alerts, verdicts, exemptions, as_of, rules).select(*A.ALERT_COLUMNS)
    new = detect_patterns(events, merged, as_of, v).select(*A.ALERT_COLUMNS)
    return A.auto_close(merged.unionByName(new), as_of)


def daily_job(store: Store, events: DataFrame, alerts: DataFrame, exemptions: DataFrame, as_of: str, version: str,
              rules: Rules = Rules(), v: Vocabulary = DEFAULT) -> None:
    """Profiles, verdicts and the audited alert snapshot of a day, each written to its own folder.

    Windows judged by an earlier run are not scored again: each verdict is appended once, and an alert that somebody
    has handled reopens only by a window that no run has seen.
    """
    facts = W.shared_facts(events, v, rules)
    judged = None
    if store.exists("verdicts"):
        judged = store.spark.read.parquet(store.path("verdicts")).select("employee_id", "window_start", "window_end")
    verdicts = cut_lineage(S.score_events(events, as_of, rules, v, judged=judged, facts=facts).select(*S.VERDICT_COLUMNS))
    snapshot = alert_snapshot(events, verdicts, alerts, exemptions, as_of, rules, v)
    verdicts, snapshot, fixes = audit(verdicts, snapshot, signatures(facts), exemptions, events, as_of)
    append_verdicts(verdicts, store.path("verdicts"))
    overwrite_snapshot(snapshot, store.path(f"alerts/version={version}"))
    overwrite_snapshot(fixes, store.path(f"audit/version={version}"))
    overwrite_snapshot(profiles(events, as_of, v=v), store.path(f"profiles/version={version}"))


def nightly_job(store: Store, events: DataFrame, alerts: DataFrame, exemptions: DataFrame, day, version: str, rules: Rules = Rules(), v: Vocabulary = DEFAULT,
                review: DataFrame | None = None, suppress: bool = True) -> None:
    """`daily_job` that scores the days since the last run up to `day` and reads no earlier events for it.

    Verdicts are finished (caps, second opinion, facts, exemptions); repeats of the last hours are left out; patterns and
    the audit look at the days they need.
    """
    from datetime import timedelta

    from .daily import ScoreState, facts_of_days, score_days
    state = ScoreState(store.spark, store.path("score"))
    done = [d for d in state.runs("baseline") if d < day]
    if done:
        first = done[-1] + timedelta(1)
    else:
        oldest = events.agg(F.min(F.col("occurred_at").cast("date"))).first()[0]
        first = min(oldest or day, day)
    as_of = f"{day + timedelta(1)} 00:00:00"
    facts = facts_of_days(events, first, day, rules, v)
    verdicts = score_days(events, state, first, day, rules, v, suppress=suppress, exemptions=exemptions, finished=True, review=review, new=facts).select(*S.VERDICT_COLUMNS)
    week = events.filter(F.col("occurred_at") >= E.ago(as_of, days=15))
    snapshot = alert_snapshot(week, verdicts, alerts, exemptions, as_of, rules, v)
    verdicts, snapshot, fixes = audit(verdicts, snapshot, signatures(W.with_window_start(facts, rules)), exemptions, week, as_of)
    append_verdicts(verdicts, store.path("verdicts"))
    overwrite_snapshot(snapshot, store.path(f"alerts/version={version}"))
    overwrite_snapshot(fixes, store.path(f"audit/version={version}"))
    overwrite_snapshot(profiles(events, as_of, v=v), store.path(f"profiles/version={version}"))


def hourly_job(store: Store, raw: DataFrame, alerts: DataFrame, as_of: str, version: str, silent_hours: int = 2) -> DataFrame:
    """Upkeep between scoring runs: stale alerts are closed, days with several writes compacted, silent feeds returned."""
    from ..streaming.jobs import feed_silence
    overwrite_snapshot(A.auto_close(alerts, as_of), store.path(f"alerts/version={version}"))
    live.compact_days(store.ledger())
    store.ledger().expire(live.TABLES)
    return feed_silence(raw, as_of, silent_hours).filter("alarm")


def weekly_job(store: Store, events: DataFrame, verdicts: DataFrame, alerts: DataFrame, exemptions: DataFrame, as_of: str, version: str,
               board_alerts: DataFrame | None = None) -> None:
    """The week's digest, the stories of people with several kinds of signals, and a report per person."""
    from ..operators.profiles import rhythms
    from . import boards as B
    from . import reports as R
    board = B.risk_board(events, verdicts, alerts if board_alerts is None else board_alerts, rhythms(events, as_of), exemptions, as_of)
    overwrite_snapshot(R.weekly_digest(events, verdicts, alerts, board, B.efficiency(events, as_of), as_of), store.path(f"digest/version={version}"))
    stories = cut_lineage(B.signal_timeline(events, verdicts, alerts, as_of))
    overwrite_snapshot(stories, store.path(f"stories/version={version}"))
    overwrite_snapshot(R.profile_export(alerts, verdicts, stories), store.path(f"people/version={version}"))


def retention_job(events: DataFrame, raw: DataFrame, as_of: str, event_days: int = 90,
                  raw_days: int = 7) -> tuple[DataFrame, DataFrame]:
    return I.retain(events, as_of, event_days), I.retain(raw, as_of, raw_days, "received_at")


def message_batch(raw: DataFrame) -> DataFrame:
    """Canonical events of a batch of mixed messages (needs `event_id` and `msg`)."""
    from ..operators.identity import resolve_identity
    from ..schema import to_canonical
    agent, proxy = M.route_messages(raw)
    # Identity reads the parsed rows four times: parse once.
    parsed = cut_lineage(M.parse_agent_messages(agent))
    people = resolve_identity(parsed).withColumn("event_hash", E.event_hash())
    both = to_canonical(people).unionByName(to_canonical(M.parse_proxy_messages(proxy)))
    return both.filter("occurred_at is not null")
