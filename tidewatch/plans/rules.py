"""Dictionary maintenance: domains to review and suggestions for people to accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import domains as D
from ..functions import events as E
from ..functions.base import contains_any, text
from ..vocab import DEFAULT, Vocabulary


def labelled(events: DataFrame) -> DataFrame:
    """WEB rows with trimmed `dom` and proxy `label`."""
    return (events.filter((F.col("category") == "WEB") & (F.trim(text("domain")) != ""))
            .withColumn("dom", F.trim("domain")).withColumn("label", F.coalesce("site_class", "app", F.lit(""))))


def unclassified_domains(events: DataFrame, top: int = 60, most: int = 20, v: Vocabulary = DEFAULT) -> DataFrame:
    """Frequent domains without any class, plus rare ones that carry a review keyword."""
    counts = labelled(events).groupBy("dom").agg(F.count("*").alias("n_rows"), F.min("label").alias("label"))
    free = counts.filter(D.risk_class("dom", v).isNull() & D.leisure_class("dom", "label", v).isNull()
                         & ~D.is_work_domain("dom", v))
    frequent = free.orderBy(F.desc("n_rows"), "dom").limit(top)
    hinted = free.filter(contains_any(F.lower("dom"), vocab.REVIEW_KEYWORDS))
    pool = (frequent.withColumn("prio", F.lit(0)).unionByName(hinted.withColumn("prio", F.lit(1)))
            .groupBy("dom", "n_rows", "label").agg(F.min("prio").alias("prio")))
    shown = pool.filter((F.length("dom") < 90) & ~contains_any(F.lower("dom"), vocab.REVIEW_NOISE))
    return (shown.orderBy("prio", F.desc("n_rows"), "dom").limit(most)
            .select(F.col("dom").alias("domain"), "n_rows", "label"))


def transfer_domains(events: DataFrame, as_of: str, days: int = 30, min_hits: int = 3, max_people: int = 10,
                     most: int = 10, listed: DataFrame | None = None, url: str = "url") -> DataFrame:
    """Domains whose URLs look like uploads and that few people use, fewest people first."""
    rows = E.since(events, as_of, days=days).filter((F.col("category") == "WEB")
                         & contains_any(text(url), vocab.TRANSFER_FRAGMENTS))
    pairs = (rows.withColumn("domain", F.lower(F.trim(text("domain")))).filter("domain <> ''")
             .groupBy("domain", "employee_id").agg(F.count("*").alias("k")))
    counts = (pairs.groupBy("domain").agg(F.sum("k").alias("n_hits"), F.count("*").alias("n_people"))
              .filter((F.col("n_hits") >= min_hits) & (F.col("n_people") <= max_people)))
    if listed is not None:
        counts = counts.join(listed.select("domain"), "domain", "left_anti")
    return counts.orderBy("n_people", F.desc("n_hits"), "domain").limit(most)


def heartbeat_domains(events: DataFrame, as_of: str, days: int = 7, min_rows: int = 15, min_group: int = 5,
                      min_groups: int = 2, gap_minutes: int = 15, most: int = 8, v: Vocabulary = DEFAULT) -> DataFrame:
    """Leisure domains visited at regular sparse intervals, i.e. by a background client."""
    rows = labelled(E.since(events, as_of, days=days))
    rows = rows.filter(D.leisure_class("dom", "label", v).isNotNull())
    groups = (rows.groupBy("dom", "employee_id", E.day("occurred_at").alias("day"))
              .agg(F.count("*").alias("n"), F.min("occurred_at").alias("t0"), F.max("occurred_at").alias("t1")))
    span = (F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp")))
    sparse = span >= F.col("n") * F.lit(gap_minutes * 60_000_000)
    big = F.col("n") >= min_group
    per = (groups.groupBy(F.col("dom").alias("domain"))
           .agg(F.sum("n").alias("n_rows"), F.count_if(big).alias("n_groups"), F.count_if(big & sparse).alias("n_sparse"))
           .filter((F.col("n_rows") >= min_rows) & (F.col("n_groups") >= min_groups)
                   & (F.col("n_sparse") >= F.greatest(F.lit(2), F.floor(F.col("n_groups") / 2)))))
    return per.orderBy(F.desc("n_groups"), "domain").limit(most)


def rule_suggestions(unclassified: DataFrame, transfers: DataFrame, heartbeats: DataFrame) -> DataFrame:
    """The three lists as suggestions with a proposed target; a person decides."""
    def shape(df: DataFrame, target: str, hits: str, reason: str) -> DataFrame:
        return df.select("domain", F.lit(target).alias("target"), F.col(hits).alias("hits"), F.lit(reason).alias("reason"))
    return (shape(unclassified, "suspect_new", "n_rows", "unclassified domain")
            .unionByName(shape(transfers, "suspect_new", "n_hits", "upload-like requests by few people"))
            .unionByName(shape(heartbeats, "slack_sdk_domains", "n_groups", "regular sparse background traffic")))


def triage(suggestions: DataFrame) -> DataFrame:
    """hot: suspected new risk; risk: a known risk dictionary; rest otherwise."""
    t = F.col("target")
    return suggestions.withColumn("urgency", F.when(t == "suspect_new", "hot").when(
        t.isNotNull() & ~t.isin("", "ignore", "slack_domains"), "risk").otherwise("rest"))
