"""Writers.  Plain Parquet has no merge, so snapshots go to a new version folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOM = "\ufeff"


def append_partitioned(df: DataFrame, path: str, ts: str = "occurred_at") -> None:
    """Append events partitioned by day and category, so time and category filters prune files.

    Hot days are split by AQE's rebalance instead of landing in one task.
    """
    (df.withColumn("event_date", F.col(ts).cast("date"))
     .hint("rebalance", "event_date", "category")
     .write.mode("append").partitionBy("event_date", "category").parquet(path))


def overwrite_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_verdicts(df: DataFrame, path: str) -> None:
    (df.withColumn("window_date", F.col("window_start").cast("date"))
     .write.mode("append").partitionBy("window_date").parquet(path))


def write_csv_report(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """CSV with a byte-order mark in front of the header of every file."""
    free = [c for c in df.columns if c not in (partition_by or [])]
    marked = df.withColumnRenamed(free[0], BOM + free[0])
    writer = marked.write.mode("overwrite").option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def export_alerts(alerts: DataFrame, path: str) -> None:
    from ..plans.reports import alert_export
    write_csv_report(alert_export(alerts).orderBy(F.desc("risk_score")), path)


def export_profiles(report: DataFrame, path: str) -> None:
    """One folder per person for all people in one job."""
    write_csv_report(report, path, ["employee_id"])
