"""Ingest that rewrites changed buckets only.

    visits   raw events, once per hash
    folds    partial folds, one row per write and (account, domain, bucket); a bucket's fold is their merge
    events   published rows, one per hash: the newest write decides, a tombstone takes a row back

A batch adds its visits and partial folds.  Only the buckets it touches, and the buckets close enough for cross-source
removal, are merged again and published as a delta; reading merges the deltas of a day with its base (`read_events`).
`compact_days` turns a day's writes into one of each table.  Batch size, order, replays and late days do not change what
is read.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import events as E
from ..functions.base import text
from ..operators import ingest as I
from ..operators.fold import FIRST_ROW, drop_web_noise
from ..schema import CANONICAL, to_canonical
from ..session import cut_lineage
from ..sources.ledger import Ledger, Snapshot

BUCKET_SECONDS, COVER_MINUTES = 600, 10
REACH = -(-COVER_MINUTES * 60 // BUCKET_SECONDS)  # buckets within which a proxy row covers an endpoint row
TABLES = ["visits", "folds", "events"]
FOLD = ("employee_id string, domain string, occurred_at timestamp_ntz, n long, arrival struct<at: timestamp_ntz, hash: string>, "
        "first struct<device_id: string, source: string, url: string, title: string, app: string, channel: string, src_path: string, dest_path: string>, "
        "label_arrival struct<at: timestamp_ntz, hash: string>, site_class string")
KEY = ["employee_id", "domain", "occurred_at"]


def canonical_ddl() -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in CANONICAL.fields)


EVENTS = f"{canonical_ddl()}, gone boolean"


def partial_folds(web: DataFrame) -> DataFrame:
    """One row per account, domain and bucket, such that rows of a key can be merged."""
    at = F.struct(F.col("occurred_at").alias("at"), F.col("event_hash").alias("hash"))
    labelled = text("site_class") != ""
    return (web.groupBy("employee_id", text("domain").alias("domain"), E.time_bucket("occurred_at", BUCKET_SECONDS).alias("bucket"))
            .agg(F.count("*").alias("n"), F.min(at).alias("arrival"), F.min_by(F.struct(*FIRST_ROW), at).alias("first"),
                 F.min(F.when(labelled, at)).alias("label_arrival"), F.min_by(F.when(labelled, F.col("site_class")), F.when(labelled, at)).alias("site_class"))
            .withColumnRenamed("bucket", "occurred_at"))


def merged_folds(folds: DataFrame) -> DataFrame:
    return folds.groupBy(*KEY).agg(F.sum("n").alias("n"), F.min("arrival").alias("arrival"), F.min_by("first", "arrival").alias("first"),
                                   F.min("label_arrival").alias("label_arrival"), F.min_by("site_class", "label_arrival").alias("site_class"))


def visits_of(folds: DataFrame) -> DataFrame:
    """Published form of merged folds."""
    return (folds.select("employee_id", "domain", "occurred_at", F.col("n").cast("int").alias("count"), "site_class", "first.*")
            .withColumn("category", F.lit("WEB")).withColumn("action", F.lit("VISIT")).withColumn("target_type", F.lit("URL"))
            .withColumn("target_value", F.col("domain")).withColumn("size_bytes", F.lit(0).cast("bigint")))


def named(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Confirmed names instead of accounts, and the hash that follows from them."""
    return I.resolve_aliases(rows, aliases).withColumn("event_hash", E.event_hash())


def newest(rows: DataFrame) -> DataFrame:
    """The newest row of each hash, without those taken back.  A hash holds its time, so it lies on one day."""
    names = [f.name for f in CANONICAL.fields if f.name != "event_hash"]
    last = F.max_by(F.struct(*names, "gone"), "seq").alias("row")
    return rows.groupBy("event_date", "event_hash").agg(last).select("event_hash", "row.*", "event_date").filter(~F.col("gone"))


def read_events(ledger: Ledger) -> DataFrame:
    """Canonical events as published; `event_date` is kept so that day filters prune folders."""
    state = ledger.snapshot()
    times: dict[dt.date, int] = {}
    for _, own in state.writes.values():
        for d in own:
            times[d] = times.get(d, 0) + 1
    settled, moving = {d for d, n in times.items() if n == 1}, {d for d, n in times.items() if n > 1}
    columns = [f.name for f in CANONICAL.fields] + ["event_date"]
    plain = ledger.read("events", EVENTS, state, settled).filter(~F.col("gone")).select(*columns)
    return plain.unionByName(newest(ledger.read("events", EVENTS, state, moving)).select(*columns)) if moving else plain


def _days(df: DataFrame, ts: str = "occurred_at") -> set[dt.date]:
    """Calendar days of a batch."""
    return {r[0] for r in df.select(F.col(ts).cast("date")).distinct().collect()}


def _around(days: set[dt.date]) -> set[dt.date]:
    return {d + dt.timedelta(n) for d in days for n in (-1, 0, 1)}


def _steps(n: int) -> Column:
    """Buckets up to `n` before and after."""
    return F.explode(F.array(*[F.col("occurred_at") + F.make_dt_interval(secs=F.lit(k * BUCKET_SECONDS)) for k in range(-n, n + 1)]))


def _with_person(folds: DataFrame, aliases: DataFrame) -> DataFrame:
    names = aliases.select(F.col("account").alias("employee_id"), F.col("name").alias("_name"))
    return (folds.join(names, "employee_id", "left").withColumn("_person", F.coalesce("_name", "employee_id")).drop("_name")
            .withColumn("_dom", F.lower("domain")))


def published(folds: DataFrame, aliases: DataFrame, ignored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to show, all rows) of merged folds, named."""
    rows = cut_lineage(named(visits_of(folds), aliases))
    kept = I.drop_cross_source(rows, minutes=COVER_MINUTES)
    # Accounts of one name may fold into the same hash: the row with most visits stands for it.
    fields = [c for c in kept.columns if c != "event_hash"]
    kept = kept.groupBy("event_hash").agg(F.max(F.struct("count", "source", *[c for c in fields if c not in ("count", "source")])).alias("r")).select("event_hash", "r.*")
    kept = kept.filter(~E.is_visitor("employee_id")).join(ignored.select("employee_id").distinct(), "employee_id", "left_anti")
    return cut_lineage(kept), rows  # both are read several times


def _delta(kept: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows to publish, and tombstones of those that are not (or no longer) shown."""
    dead = rows.select("event_hash", "occurred_at").distinct().join(kept.select("event_hash"), "event_hash", "left_anti")
    return to_canonical(kept).withColumn("gone", F.lit(False)).unionByName(to_canonical(dead).withColumn("gone", F.lit(True)))


def ingest(ledger: Ledger, batch: DataFrame, aliases: DataFrame, ignored: DataFrame) -> str | None:
    """Store a batch and publish the buckets it changes; the write's id, or None if nothing is new."""
    state = ledger.snapshot()
    rows = to_canonical(batch).filter("occurred_at is not null").dropDuplicates(["event_hash"])
    rows = cut_lineage(rows)
    span = rows.agg(F.min("occurred_at").alias("low"), F.max("occurred_at").alias("high"), F.count("*").alias("n")).first()
    if not span["n"]:
        return None
    days = _days(rows)
    stored = ledger.read("visits", "event_hash string, occurred_at timestamp_ntz", state, days)
    # Files of one batch span little time, so their statistics leave out those of other hours.
    stored = stored.filter(F.col("occurred_at").between(F.lit(span["low"]), F.lit(span["high"])))
    fresh = cut_lineage(rows.join(stored.select("event_hash"), "event_hash", "left_anti"))
    # The id follows from the rows: a job that failed half-way writes the same folders again.
    sums = fresh.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("event_hash")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), F.col("event_hash"))).alias("b")).first()
    if not sums["n"]:
        return None
    tx, seq = uuid.uuid5(uuid.NAMESPACE_OID, f"{sums['n']} {sums['a']} {sums['b']}").hex, state.version + 1
    ledger.write(fresh, "visits", tx, seq)
    days = _days(fresh)

    ledger.write(partial_folds(drop_web_noise(fresh)), "folds", tx, seq)
    own = ledger.read("folds", FOLD, Snapshot(seq, {tx: (seq, days)}))
    changed = cut_lineage(_with_person(own, aliases).select("_person", "_dom", "occurred_at").distinct())
    near = changed.select("_person", "_dom", _steps(2 * REACH).alias("occurred_at")).distinct()
    touched = changed.select("_person", "_dom", _steps(REACH).alias("occurred_at")).distinct()
    margin = dt.timedelta(seconds=(2 * REACH + 1) * BUCKET_SECONDS)
    past = ledger.read("folds", FOLD, state, _around(days)).filter(F.col("occurred_at").between(F.lit(span["low"] - margin), F.lit(span["high"] + margin)))
    keys = ["_person", "_dom", "occurred_at"]
    context = _with_person(past.unionByName(own), aliases).join(near, keys, "left_semi").drop("_person", "_dom", "seq", "event_date")
    kept, all_rows = published(merged_folds(context), aliases, ignored)
    delta = _delta(kept, all_rows)
    # Only rows near a change may differ from what is published; the rest of the context had to be seen, not written.
    marks = touched.select(F.col("_person").alias("p"), F.col("_dom").alias("d"), F.col("occurred_at").alias("t"))
    shown = all_rows.select("event_hash", "employee_id", "domain", "occurred_at").distinct()
    shown = shown.join(marks, shown["employee_id"].eqNullSafe(marks["p"]) & (F.lower(shown["domain"]) == marks["d"]) & (shown["occurred_at"] == marks["t"]), "left_semi")
    delta = delta.join(shown.select("event_hash"), "event_hash", "left_semi")

    others = I.append_events(named(fresh.filter("category <> 'WEB'"), aliases), fresh.limit(0), ignored)
    ledger.write(delta.unionByName(to_canonical(others).withColumn("gone", F.lit(False))), "events", tx, seq)
    # Neighbours of a bucket next to midnight lie on another day.
    ledger.publish(state, tx, days | _days(ledger.spark.read.parquet(f"{ledger.root}/events/tx={tx}").select("occurred_at")))
    return tx


def refold_days(ledger: Ledger, days: set[dt.date], aliases: DataFrame, ignored: DataFrame) -> str:
    """Publish whole days again from their stored visits, after aliases or ignored people have changed."""
    state = ledger.snapshot()
    tx, seq = uuid.uuid4().hex, state.version + 1
    folds = merged_folds(ledger.read("folds", FOLD, state, _around(days)).drop("seq", "event_date"))
    kept, rows = published(folds, aliases, ignored)
    others = ledger.read("visits", canonical_ddl(), state, days).filter("category <> 'WEB'")
    others = I.append_events(named(to_canonical(others), aliases), ledger.spark.createDataFrame([], CANONICAL), ignored)
    new = to_canonical(kept).unionByName(to_canonical(others)).filter(F.col("occurred_at").cast("date").isin(list(days))).withColumn("gone", F.lit(False))
    for table, schema in (("visits", canonical_ddl()), ("folds", FOLD)):
        ledger.write(ledger.read(table, schema, state, days).drop("seq", "event_date"), table, tx, seq)
    ledger.write(new, "events", tx, seq)
    ledger.publish(state, tx, days, rewritten=True)
    return tx


def compact_days(ledger: Ledger, days: set[dt.date] | None = None) -> str | None:
    """One write per table for days that several writes hold; what is read stays the same."""
    state = ledger.snapshot()
    held = [d for _, own in state.writes.values() for d in own if days is None or d in days]
    several = {d for d in held if held.count(d) > 1}
    if not several:
        return None
    tx, seq = uuid.uuid4().hex, state.version + 1
    ledger.write(ledger.read("visits", canonical_ddl(), state, several).drop("seq", "event_date"), "visits", tx, seq)
    ledger.write(merged_folds(ledger.read("folds", FOLD, state, several).drop("seq", "event_date")), "folds", tx, seq)
    ledger.write(newest(ledger.read("events", EVENTS, state, several)).drop("event_date"), "events", tx, seq)
    ledger.publish(state, tx, several, rewritten=True)
    return tx
