"""Alert lifecycle: merge, close, feedback, review, notification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import events as E
from ..functions.base import ntz, text
from ..schema import ALERT_STATUSES, SCORE_TIERS, Rules
from .scoring import valid_exemptions

ALERT_SCHEMA = ("dedup_key string, employee_id string, scenario string, severity string, risk_score int, "
                "verdict_id string, summary string, status string, window_start timestamp_ntz, "
                "created_at timestamp_ntz")
ALERT_COLUMNS = [f.strip().split(" ")[0] for f in ALERT_SCHEMA.split(",")]


def no_alerts(spark) -> DataFrame:
    return spark.createDataFrame([], ALERT_SCHEMA)


def not_exempt(verdicts: DataFrame, exemptions: DataFrame, as_of: str) -> DataFrame:
    """Verdicts whose (person, intent) has no valid exemption."""
    ex = valid_exemptions(exemptions, as_of).select("employee_id", F.col("signal_type").alias("intent")).distinct()
    return verdicts.join(ex, ["employee_id", "intent"], "left_anti")


def merge_alerts(alerts: DataFrame, verdicts: DataFrame, exemptions: DataFrame, as_of: str,
                 rules: Rules = Rules(), created: str = "as_of") -> DataFrame:
    """Snapshot of alerts after a batch of verdicts, with `is_new` and `reopened`.

    Verdicts from `rules.alert_score` on reduce to the latest per person and
    intent, in order of (window_start, verdict_id).  A known key takes time,
    verdict, text and score of that verdict and returns to NEW.
    `created="window"` dates new alerts by their first window, for replays.
    """
    due = not_exempt(verdicts.filter(F.col("risk_score") >= rules.alert_score), exemptions, as_of)
    latest = F.struct("window_start", "verdict_id", "risk_score", "explanation")
    batch = (due.groupBy("employee_id", "intent")
             .agg(F.max(latest).alias("v"), F.min("window_end").alias("first_end"))
             .select(F.concat_ws("|", "employee_id", "intent").alias("dedup_key"),
                     F.col("employee_id").alias("b_employee"), F.col("intent").alias("b_scenario"),
                     F.col("v.window_start").alias("b_start"), F.col("v.verdict_id").alias("b_verdict"),
                     F.col("v.risk_score").alias("b_score"), F.col("v.explanation").alias("b_text"), "first_end"))
    j = alerts.select(*ALERT_COLUMNS).join(batch, "dedup_key", "full_outer")
    hit, known = F.col("b_verdict").isNotNull(), F.col("employee_id").isNotNull()
    score = F.coalesce("b_score", "risk_score")
    born = F.col("first_end") if created == "window" else ntz(as_of)
    return j.select(
        "dedup_key", F.coalesce("employee_id", "b_employee").alias("employee_id"),
        F.coalesce("scenario", "b_scenario").alias("scenario"),
        F.when(hit, E.severity(score)).otherwise(F.col("severity")).alias("severity"),
        score.cast("int").alias("risk_score"), F.coalesce("b_verdict", "verdict_id").alias("verdict_id"),
        F.coalesce("b_text", "summary").alias("summary"),
        F.when(hit, F.lit("NEW")).otherwise(F.col("status")).alias("status"),
        F.coalesce("b_start", "window_start").alias("window_start"),
        F.coalesce("created_at", born).alias("created_at"),
        (hit & ~known).alias("is_new"), (hit & known & (F.col("status") != "NEW")).alias("reopened"))


def notifications(merged: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """New or reopened alerts from the notification score on."""
    return (merged.filter((F.col("is_new") | F.col("reopened")) & (F.col("risk_score") >= rules.notify_score))
            .select("dedup_key", "employee_id", "risk_score", "summary",
                    F.when(F.col("reopened"), F.lit("recurrence")).otherwise(F.lit("new")).alias("reason")))


def auto_close(alerts: DataFrame, as_of: str, stale_days: int = 3) -> DataFrame:
    """Close NEW deviation alerts: below 50 at once, 50 to 65 after `stale_days`."""
    open_deviation = (F.col("scenario") == "baseline_deviation") & (F.col("status") == "NEW")
    stale = F.col("risk_score").between(50, 65) & (F.col("created_at") < E.ago(as_of, days=stale_days))
    return alerts.withColumn("status", F.when(open_deviation & ((F.col("risk_score") < 50) | stale), "CLOSED")
                             .otherwise(F.col("status")))


def apply_feedback(alerts: DataFrame, feedback: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Alerts with TP -> CONFIRMED and FP -> FP, and the exemptions the feedback asks for.

    `feedback` has (dedup_key, label, reason, signal_type, expires_days, created_at); the last
    entry per alert decides the status.  Feedback about unknown alerts is ignored.
    """
    valid = feedback.filter(F.col("label").isin("TP", "FP")).join(alerts.select("dedup_key", "employee_id"), "dedup_key")
    last = valid.groupBy("dedup_key").agg(F.max_by("label", F.struct("created_at", "label")).alias("label"))
    marked = (alerts.join(last, "dedup_key", "left")
              .withColumn("status", F.when(F.col("label") == "TP", "CONFIRMED").when(F.col("label") == "FP", "FP")
                          .otherwise(F.col("status"))).drop("label"))
    days = F.coalesce("expires_days", F.lit(0))
    exemptions = (valid.filter((F.col("label") == "FP") & (text("signal_type") != ""))
                  .select("employee_id", "signal_type", "reason",
                          F.when(days > 0, ntz(as_of) + F.make_dt_interval(days, F.lit(0), F.lit(0), F.lit(0)))
                          .alias("expires_at")))
    return marked, exemptions


def set_status(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (dedup_key, new_status, changed_at) rows, of several for one alert the latest.

    Statuses outside the five known ones are dropped.  Without `changed_at`, or at equal times, the last name counts.
    """
    if "changed_at" not in changes.columns:
        changes = changes.withColumn("changed_at", F.lit(None).cast("timestamp_ntz"))
    valid = (changes.filter(F.col("new_status").isin(*ALERT_STATUSES))
             .groupBy("dedup_key").agg(F.max(F.struct("changed_at", "new_status")).alias("last"))
             .select("dedup_key", "last.new_status"))
    return (alerts.join(valid, "dedup_key", "left")
            .withColumn("status", F.coalesce("new_status", "status")).drop("new_status"))


def alert_of_verdict(verdicts: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alert key per verdict: by verdict id, else by person and intent."""
    by_id = (alerts.filter("verdict_id is not null").groupBy("verdict_id")
             .agg(F.min("dedup_key").alias("key_by_id")))
    by_pair = (alerts.groupBy("employee_id", F.col("scenario").alias("intent"))
               .agg(F.min("dedup_key").alias("key_by_pair")))
    return (verdicts.join(by_id, "verdict_id", "left").join(by_pair, ["employee_id", "intent"], "left")
            .select("verdict_id", "employee_id", "intent",
                    F.coalesce("key_by_id", "key_by_pair").alias("dedup_key"),
                    F.when(F.col("key_by_id").isNotNull(), "verdict")
                    .when(F.col("key_by_pair").isNotNull(), "person").alias("matched_by")))


def apply_review(alerts: DataFrame, reviews: DataFrame, day: str) -> DataFrame:
    """Write a day review back to the alerts of that day.

    `reviews` has (employee_id, direction, suggested_score, reason, review).  FP and
    CLOSED alerts stay untouched; only an upgrade of a tiered scenario changes a score.
    """
    r = reviews.select("employee_id", "direction", "suggested_score",
                       F.substring(text("reason"), 1, 80).alias("r_reason"),
                       F.substring(text("review"), 1, 160).alias("r_text"))
    j = alerts.join(r, "employee_id", "left")
    d0 = F.lit(day).cast("date").cast("timestamp_ntz")
    due = (F.col("direction").isNotNull() & ~F.col("status").isin("FP", "CLOSED") & (F.col("window_start") >= d0)
           & (F.col("window_start") < F.date_add(d0.cast("date"), 1).cast("timestamp_ntz")))
    plain = F.regexp_replace(text("summary"), r"\[review[^\]]*\]\s*", "")
    up = due & (F.col("direction") == "upgrade") & F.col("scenario").isin(*SCORE_TIERS) \
        & (F.col("suggested_score") > F.col("risk_score"))
    score = F.when(up, E.snap_tier("scenario", "suggested_score")).otherwise(F.col("risk_score")).cast("int")
    summary = (F.when(up, F.concat(F.lit("[review: up to "), score.cast("string"), F.lit(", "), "r_reason", F.lit("] "),
                                   "r_text", F.lit(" | "), plain))
               .when(due & (F.col("direction") == "downgrade"),
                     F.concat(F.lit("[review: likely false alarm, "), "r_reason", F.lit("] "), plain))
               .when(due & (F.col("direction") == "keep") & ~text("summary").startswith("[review"),
                     F.concat(F.lit("[review: keep] "), text("summary")))
               .otherwise(F.col("summary")))
    return (j.withColumn("new_score", score).withColumn("summary", summary)
            .withColumn("risk_score", F.col("new_score"))
            .select(*alerts.columns))


def drop_exemption(exemptions: DataFrame, removed: DataFrame) -> DataFrame:
    return exemptions.join(removed.select("employee_id", "signal_type"), ["employee_id", "signal_type"], "left_anti")


def replace_dictionary(stored: DataFrame, name: str, rows: DataFrame) -> DataFrame:
    """Override table with the stored list of one dictionary replaced."""
    return stored.filter(F.col("dict_name") != name).unionByName(
        rows.filter(F.col("dict_name") == name).select(*stored.columns))


def adopt_suggestions(stored: DataFrame, adopted: DataFrame) -> DataFrame:
    """Add accepted (dict_name, category, pattern) rows to the override table, lower-cased, once."""
    new = adopted.select("dict_name", "category", F.lower(F.trim("pattern")).alias("pattern")).filter("pattern <> ''")
    return stored.select("dict_name", "category", "pattern").unionByName(new).dropDuplicates()
