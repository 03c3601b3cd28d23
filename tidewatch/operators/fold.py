"""Web noise removal and folding into time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import events as E
from ..functions.base import text
from ..vocab import DEFAULT, Vocabulary

FIRST_ROW = ["device_id", "source", "url", "title", "app", "channel", "src_path", "dest_path"]


def drop_web_noise(events: DataFrame, strict_reference: bool = False, v: Vocabulary = DEFAULT) -> DataFrame:
    """Keep WEB rows that are not noise.

    A host with a risk class is kept even when a broad noise hint matches it,
    unless `strict_reference` asks for the plain hint test.
    """
    noise = D.is_noise_web("domain", F.coalesce("url", "target_value"))
    if not strict_reference:
        noise = noise & D.risk_class("domain", v).isNull()
    return events.filter((F.col("category") == "WEB") & ~noise)


def fold_visits(web: DataFrame, bucket_seconds: int = 600) -> DataFrame:
    """One row per person, domain and bucket.

    `count` is the number of rows; other fields come from the earliest row.
    The aggregates combine before the shuffle, so a busy person or domain
    arrives as at most one row per bucket and input task.
    """
    arrival = F.struct("occurred_at", "event_hash")
    first = F.min_by(F.struct(*FIRST_ROW), arrival)
    labelled = text("site_class") != ""
    folded = (web.groupBy("employee_id", text("domain").alias("domain"),
                          E.time_bucket("occurred_at", bucket_seconds).alias("occurred_at"))
              .agg(F.count("*").cast("int").alias("count"),
                   first.alias("first"),
                   F.min_by(F.when(labelled, F.col("site_class")),
                            F.when(labelled, arrival)).alias("site_class")))
    return (folded.select("employee_id", "domain", "occurred_at", "count", "site_class", "first.*")
            .withColumn("category", F.lit("WEB")).withColumn("action", F.lit("VISIT"))
            .withColumn("target_type", F.lit("URL")).withColumn("target_value", F.col("domain"))
            .withColumn("size_bytes", F.lit(0).cast("bigint"))
            .withColumn("event_hash", E.event_hash()))


def fold_web(events: DataFrame, bucket_seconds: int = 600, strict_reference: bool = False,
             v: Vocabulary = DEFAULT) -> DataFrame:
    """Denoised and folded WEB rows together with the untouched other rows."""
    folded = fold_visits(drop_web_noise(events, strict_reference, v), bucket_seconds)
    return folded.unionByName(events.filter("category <> 'WEB'").select(*folded.columns))


def fold_report(events: DataFrame, bucket_seconds: int = 600, v: Vocabulary = DEFAULT) -> DataFrame:
    """Rows before and after folding, in one row."""
    raw = events.agg(F.count("*").alias("raw_rows"),
                     F.count_if(F.col("category") == "WEB").alias("raw_web_rows"))
    kept = fold_visits(drop_web_noise(events, v=v), bucket_seconds).agg(
        F.count("*").alias("folded_web_rows"), F.coalesce(F.sum("count"), F.lit(0)).alias("kept_web_rows"))
    both = raw.withColumn("kept", kept.select(F.struct(*kept.columns)).scalar()).select("*", "kept.*")
    return both.select("raw_rows", "raw_web_rows",
                       (F.col("raw_web_rows") - F.col("kept_web_rows")).alias("noise_rows"),
                       "folded_web_rows",
                       (F.col("raw_rows") - F.col("raw_web_rows") + F.col("folded_web_rows")).alias("stored_rows"))
