"""Canonical event schema and the thresholds of every rule."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Enumerations of the canonical event.
CATEGORIES = ("DOC", "WEB", "SEARCH")
SOURCES = ("endpoint", "proxy")
WRITE_ACTIONS = ("COPY", "MOVE", "DELETE", "UPLOAD", "DOWNLOAD", "SEND", "PRINT",
                 "RENAME", "CREATE", "MODIFY", "SAVE", "SAVE_AS", "CUT", "BURN")
OUTBOUND_ACTIONS = ("UPLOAD", "SEND", "PRINT", "BURN")
SEND_ACTIONS = ("SEND", "UPLOAD")
EVIDENCE_DOC_ACTIONS = ("COPY", "MOVE", "DELETE", "UPLOAD", "SEND", "PRINT", "BURN")
INTENTS = ("data_exfiltration", "job_seeking", "policy_violation", "baseline_deviation", "normal_work")
ALERT_STATUSES = ("NEW", "TRIAGING", "CONFIRMED", "FP", "CLOSED")
SCORE_TIERS = {
    "policy_violation": (75, 80, 85, 90),
    "data_exfiltration": (75, 80, 85, 90),
    "job_seeking": (55, 60, 65, 70, 75, 80, 85, 90, 95),
}

CANONICAL = T.StructType([
    T.StructField("event_hash", T.StringType()),
    T.StructField("occurred_at", T.TimestampNTZType()),
    T.StructField("employee_id", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("target_type", T.StringType()),
    T.StructField("target_value", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("count", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("app", T.StringType()),
    T.StructField("site_class", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("src_path", T.StringType()),
    T.StructField("dest_path", T.StringType()),
    T.StructField("raw", T.MapType(T.StringType(), T.StringType())),
])


def to_canonical(df: DataFrame) -> DataFrame:
    """Project onto the canonical columns, adding typed nulls for missing ones."""
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in CANONICAL.fields
    ])


@dataclass(frozen=True)
class Rules:
    """Rule thresholds; the defaults are the production values."""

    session_gap_seconds: int = 3600
    fold_bucket: str = "10 minutes"
    night_from: int = 22
    night_until: int = 7
    min_baseline_rows: int = 3
    baseline_hours_top: int = 8
    burst_rows: int = 15
    night_visits: int = 3
    mid_tier_visits: int = 30
    alert_score: int = 50
    notify_score: int = 75
    suppress_hours: int = 6
    leisure_gap_seconds: int = 900
    leisure_slot_seconds: int = 600
    leisure_floor_seconds: int = 300
    leisure_day_cap_seconds: int = 25_200
    work_minutes_per_day: int = 420
    cross_day_days: int = 4

    def with_(self, **changes) -> "Rules":
        return replace(self, **changes)
