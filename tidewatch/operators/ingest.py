"""From parsed events to stored events: aliases, cross-source copies, idempotent append."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import events as E
from ..functions.base import int_div, micros, text


def resolve_aliases(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """Replace accounts by their confirmed name; rekeys `event_hash` when present."""
    names = aliases.select(F.col("account").alias("employee_id"), F.col("name").alias("_name"))
    named = (events.join(names, "employee_id", "left")
             .withColumn("employee_id", F.coalesce("_name", "employee_id")).drop("_name"))
    return named.withColumn("event_hash", E.event_hash()) if "event_hash" in events.columns else named


def near_in_time(left: DataFrame, right: DataFrame, keys: list[str], seconds: int,
                 ts: str = "occurred_at", how: str = "anti") -> DataFrame:
    """Rows of `left` with (semi) or without (anti) a `right` row of the same keys within ± `seconds`.

    Times fall into slots of that length, so only the same slot and its two
    neighbours can match and their earliest and latest time decide.  `right` is
    reduced to one row per key and slot before the join, which is a plain equi
    join that cannot multiply rows.
    """
    size = F.lit(seconds * 1_000_000)
    slot = int_div(micros(ts), seconds * 1_000_000)
    spans = (right.groupBy(*keys, slot.alias("_slot"))
             .agg(F.min(micros(ts)).alias("_lo"), F.max(micros(ts)).alias("_hi")))
    reach = spans.select(*keys, "_lo", "_hi", F.col("_slot").alias("_from"),
                         F.explode(F.array(*[F.col("_slot") + d for d in (-1, 0, 1)])).alias("_slot"))
    marks = reach.groupBy(*keys, "_slot").agg(
        F.bool_or(F.col("_from") == F.col("_slot")).alias("_same"),
        F.max(F.when(F.col("_from") < F.col("_slot"), F.col("_hi"))).alias("_before"),
        F.min(F.when(F.col("_from") > F.col("_slot"), F.col("_lo"))).alias("_after"))
    probe = left.withColumn("_slot", slot).join(marks, [*keys, "_slot"], "left")
    hit = F.coalesce(F.col("_same")
                     | (micros(ts) - F.col("_before") <= size)
                     | (F.col("_after") - micros(ts) <= size), F.lit(False))
    return probe.filter(hit if how == "semi" else ~hit).select(*left.columns)


def drop_cross_source(events: DataFrame, stored: DataFrame | None = None, minutes: int = 10) -> DataFrame:
    """Drop endpoint visits that a proxy row of the same person and domain already covers.

    The distance is event time, so replays give the same answer as live runs.
    """
    proxy = text("source") != "endpoint"
    web = F.col("category") == "WEB"
    keyed = events.withColumn("_dom", F.lower(text("domain")))
    pool = events if stored is None else events.select(*stored.columns).unionByName(stored)
    covering = (pool.filter(web & proxy & (text("domain") != ""))
                .select("employee_id", F.lower("domain").alias("_dom"), "occurred_at"))
    candidates = keyed.filter(web & ~proxy)
    kept = near_in_time(candidates, covering, ["employee_id", "_dom"], minutes * 60)
    return keyed.filter(~(web & ~proxy)).unionByName(kept).drop("_dom")


def append_events(new: DataFrame, existing: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """Rows of `new` to store: not stored yet, once per hash, no visitors, nobody ignored.

    Of equal hashes inside the batch the first arrival stays.
    """
    fresh = new.filter(~E.is_visitor("employee_id"))
    if ignored is not None:
        fresh = fresh.join(ignored.select("employee_id").distinct(), "employee_id", "left_anti")
    if "event_id" in new.columns:
        first = fresh.withColumn("_rn", F.row_number().over(
            Window.partitionBy("event_hash").orderBy("event_id"))).filter("_rn = 1").drop("_rn")
    else:
        first = fresh.dropDuplicates(["event_hash"])
    return first.join(existing.select("event_hash"), "event_hash", "left_anti").select(*new.columns)


def ingest(events: DataFrame, existing: DataFrame, aliases: DataFrame, ignored: DataFrame) -> DataFrame:
    """The one ingest path: fold, name, cross-source removal, append."""
    from .fold import fold_web

    named = resolve_aliases(fold_web(events), aliases)
    return append_events(drop_cross_source(named), existing, ignored)


def retain(df: DataFrame, as_of: str, days: int, ts: str = "occurred_at") -> DataFrame:
    """Rows inside the retention period."""
    return df.filter(F.col(ts) >= E.ago(as_of, days=days))
