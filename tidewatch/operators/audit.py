"""Invariant audit of verdicts and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import events as E
from ..functions.base import text
from ..schema import SCORE_TIERS
from ..session import cut_lineage
from .classify import classify_events
from .windows import has_flag

CLASSES = ["netdisk", "personal_email", "file_helper", "recruitment"]
# Classes that count as evidence of a scenario.
EVIDENCE = {"policy_violation": ["netdisk", "personal_email"],
            "data_exfiltration": ["file_helper", "netdisk", "personal_email"]}


def signatures(facts: DataFrame) -> DataFrame:
    """Visits per evidence class and a document flag for each window."""
    zero = F.lit(0).cast("bigint")
    return (facts.groupBy("employee_id", "window_start")
            .agg(*[F.sum(F.when(F.col("risk_class") == c, F.col("visits")).otherwise(zero)).alias(f"sig_{c}")
                   for c in CLASSES],
                 F.bool_or(has_flag("doc_evidence")).alias("sig_doc")))


def _evidence(scenario: str, col=F.col) -> Column:
    out = F.lit(False)
    for name, classes in EVIDENCE.items():
        hit = sum([F.coalesce(col(f"sig_{c}"), F.lit(0)) for c in classes], F.lit(0)) > 0
        if name == "data_exfiltration":
            hit = hit | F.coalesce(col("sig_doc"), F.lit(False))
        out = out | ((F.col(scenario) == name) & hit)
    return out


def _legal_tier(scenario: str, score: str) -> Column:
    """Smallest legal tier not below the score; the score itself when there is none."""
    top = F.lit(None).cast("int")
    for name, tiers in SCORE_TIERS.items():
        top = F.when(F.col(scenario) == name, F.lit(max(tiers))).otherwise(top)
    return F.when(F.col(score) <= top, E.snap_tier(scenario, score)).otherwise(F.col(score)).cast("int")


def audit(verdicts: DataFrame, alerts: DataFrame, sigs: DataFrame, exemptions: DataFrame, events: DataFrame,
          as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repaired verdicts, repaired alerts and the log of fixes; a second run fixes nothing.

    I3 no alert and a marked verdict for exempt scenarios, I4 a job verdict needs
    a recruitment visit, I1/I2 alert points at its best evidenced verdict, I5 an
    alert without evidence is restated from the last week or closed, I6 scores
    sit on legal tiers.
    """
    ex = exemptions.groupBy("employee_id", F.col("signal_type").alias("intent")).agg(
        F.coalesce(F.min(F.nullif("reason", F.lit(""))), F.lit("role")).alias("ex_reason"))
    v = (verdicts.join(ex, ["employee_id", "intent"], "left")
         .join(sigs.withColumn("has_events", F.lit(True)), ["employee_id", "window_start"], "left"))
    exempt = F.col("ex_reason").isNotNull()
    mark = exempt & ~text("explanation").startswith("[exempt")
    unfounded = ((F.col("intent") == "job_seeking") & ~exempt & F.coalesce("has_events", F.lit(False))
                 & (F.coalesce("sig_recruitment", F.lit(0)) == 0))
    v = (v.withColumn("fix_i3", mark).withColumn("fix_i4", unfounded)
         .withColumn("explanation", F.when(F.col("fix_i3"), F.concat(F.lit("[exempt:"), "ex_reason", F.lit("] "), text("explanation")))
                     .otherwise(F.col("explanation")))
         .withColumn("intent", F.when(F.col("fix_i4"), "baseline_deviation").otherwise(F.col("intent")))
         .withColumn("risk_score", F.when(F.col("fix_i4"), F.least("risk_score", F.lit(45))).otherwise(F.col("risk_score"))))
    snap = F.when(F.col("risk_score") >= 50, _legal_tier("intent", "risk_score")).otherwise(F.col("risk_score"))
    v = (v.withColumn("snapped", snap.cast("int")).withColumn("fix_i6", F.col("snapped") != F.col("risk_score"))
         .withColumn("risk_score", F.col("snapped")))
    v = cut_lineage(v)  # read by the result, the best verdicts and three logs

    best = (v.filter(_evidence("intent")).groupBy("employee_id", F.col("intent").alias("scenario"))
            .agg(F.max_by(F.struct("verdict_id", "risk_score", "explanation"),
                          F.struct("risk_score", F.negate(F.unix_micros(F.col("window_start").cast("timestamp"))))).alias("best")))
    week = (classify_events(events.filter((F.col("category") == "WEB")
                                          & (F.col("occurred_at") >= E.ago(as_of, days=7))))
            .filter(F.col("risk_class").isin(*CLASSES))
            .groupBy("employee_id").agg(*[F.sum(F.when(F.col("risk_class") == c, F.col("count")).otherwise(0)).alias(f"sig_{c}")
                                         for c in CLASSES]).withColumn("sig_doc", F.lit(False)))

    kept = cut_lineage(alerts.join(ex.withColumnRenamed("intent", "scenario"), ["employee_id", "scenario"], "left"))
    removed = kept.filter(exempt)
    a = (kept.filter(~exempt).drop("ex_reason").join(best, ["employee_id", "scenario"], "left")
         .join(week, "employee_id", "left"))
    scoped = F.col("scenario").isin(*EVIDENCE)
    aligned = scoped & F.col("best").isNotNull() & ~(
        F.col("verdict_id").eqNullSafe(F.col("best.verdict_id")) & (F.col("risk_score") == F.col("best.risk_score")))
    orphan = scoped & F.col("best").isNull() & (F.col("status") == "NEW")
    recent = _evidence("scenario")
    restate = orphan & recent & ~text("summary").startswith("[recheck]")
    close = orphan & ~recent
    counts = F.concat_ws(", ", *[F.when(F.coalesce(F.col(f"sig_{c}"), F.lit(0)) > 0,
                                        F.concat(F.lit(f"{c} "), F.col(f"sig_{c}").cast("string")))
                                 for c in ("netdisk", "personal_email", "file_helper")])
    # Flags first: the columns they read are replaced below.
    a = (a.withColumn("fix_i1", aligned).withColumn("restated", restate).withColumn("closed", close)
         .withColumn("summary", F.when(F.col("fix_i1"), F.coalesce(F.col("best.explanation"), "summary"))
                     .when(F.col("restated"), F.concat(F.lit("[recheck] visits of the last 7 days: "), counts))
                     .otherwise(F.col("summary")))
         .withColumn("verdict_id", F.when(F.col("fix_i1"), F.col("best.verdict_id")).otherwise(F.col("verdict_id")))
         .withColumn("risk_score", F.when(F.col("fix_i1"), F.col("best.risk_score")).otherwise(F.col("risk_score")))
         .withColumn("status", F.when(F.col("closed"), "CLOSED").otherwise(F.col("status"))))
    snapped = F.when(F.col("status") == "NEW", _legal_tier("scenario", "risk_score")).otherwise(F.col("risk_score"))
    a = (a.withColumn("snapped", snapped.cast("int")).withColumn("fix_i6", F.col("snapped") != F.col("risk_score"))
         .withColumn("risk_score", F.col("snapped")).withColumn("severity", F.when(
             F.col("fix_i1") | F.col("fix_i6"), E.severity("risk_score")).otherwise(F.col("severity"))))
    a = cut_lineage(a)  # read by the result and four logs

    def log(df: DataFrame, flag: Column, code: str, what: str, key: str) -> DataFrame:
        return df.filter(flag).select(F.lit(code).alias("rule"), F.lit(what).alias("fix"), "employee_id",
                                      F.col(key).alias("item"))

    fixes = (log(removed, F.lit(True), "I3", "exempt alert removed", "dedup_key")
             .unionByName(log(v, F.col("fix_i3"), "I3", "exempt verdict marked", "verdict_id"))
             .unionByName(log(v, F.col("fix_i4"), "I4", "job verdict without visit lowered", "verdict_id"))
             .unionByName(log(a, F.col("fix_i1"), "I1", "alert aligned with verdict", "dedup_key"))
             .unionByName(log(a, F.col("restated"), "I5", "alert restated", "dedup_key"))
             .unionByName(log(a, F.col("closed"), "I5", "alert closed", "dedup_key"))
             .unionByName(log(v, F.col("fix_i6"), "I6", "verdict score on tier", "verdict_id"))
             .unionByName(log(a, F.col("fix_i6"), "I6", "alert score on tier", "dedup_key")))
    return v.select(*verdicts.columns), a.select(*alerts.columns), fixes
