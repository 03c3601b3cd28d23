"""Deviation flags, trigger gate, rule scores and anchored verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import events as E
from ..functions.base import fmt_ts, int_div, ntz, text
from ..schema import Rules
from ..vocab import DEFAULT, Vocabulary
from .classify import classify_events
from .profiles import baseline_asof
from .windows import (DOC_CHANNEL_MASK, DOC_CHANNELS, WEB_CHANNELS, mask_names, risk_rows, shared_facts,
                      suppress_repeats, trigger_keys, window_features, window_sites)

WINDOW_KEY = ["employee_id", "window_start"]


def listed_sites(sites: DataFrame, most: int = 5) -> DataFrame:
    """First `most` risk-classed sites of each window in alphabetical order, comma separated."""
    order = Window.partitionBy(*WINDOW_KEY).orderBy("site")
    return (sites.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most)
            .groupBy(*WINDOW_KEY)
            .agg(F.array_join(F.array_sort(F.collect_list("site")), ",").alias("sites")))


def deviation(features: DataFrame, baseline: DataFrame, sites: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Window features with deviation flags against the as-of baseline.

    Risk-classed domains never enter a baseline or the common set, so every
    risk-classed site of the window counts as new.
    """
    joined = (features.withColumn("day", F.col("window_start").cast("date"))
              .join(baseline.select("employee_id", "day", "sample_count",
                                    F.col("hours_mask").alias("base_hours"),
                                    F.col("channels_mask").alias("base_channels"), "daily_median"),
                    ["employee_id", "day"], "left")
              .join(listed_sites(sites), WINDOW_KEY, "left"))
    known = F.coalesce(F.col("sample_count"), F.lit(0)) >= rules.min_baseline_rows
    late = (F.col("hour_min") < rules.night_until) | (F.col("hour_max") >= rules.night_from)
    unusual = F.col("hours_mask").bitwiseAND(F.bitwise_not(F.coalesce("base_hours", F.lit(0)))) != 0
    fresh = F.col("row_channels").bitwiseAND(F.bitwise_not(F.coalesce("base_channels", F.lit(0)))) \
        .bitwiseAND(DOC_CHANNEL_MASK)
    median = F.coalesce("daily_median", F.lit(0))
    return (joined
            .withColumn("channel_burst", F.col("mid_day_rows") >= rules.burst_rows)
            .withColumn("off_hours", known & late & unusual)
            .withColumn("volume_spike", known & (median > 0) & (F.col("n") > F.greatest(F.lit(5), median * 3)))
            .withColumn("new_channel", F.when(known & (fresh != 0), mask_names(fresh, DOC_CHANNELS)))
            .withColumn("new_risky_domain", F.when(known, F.col("sites")))
            .withColumn("deviation_flags", F.concat_ws(
                "|",
                F.when(F.col("channel_burst"), "channel_burst"),
                F.when(F.col("off_hours"), "off_hours"),
                F.when(F.col("volume_spike"), "volume_spike"),
                F.concat(F.lit("new_channel:"), "new_channel"),
                F.concat(F.lit("new_risky_domain:"), "new_risky_domain"))))


def should_trigger(rules: Rules = Rules()) -> Column:
    """Whether a window carries a real signal (columns of `deviation`)."""
    c = F.col
    return (c("outbound") | c("away_doc") | c("searched") | c("forbidden") | c("mid_off") | c("keyword_hit")
            | c("channel_burst") | (c("night_visits") >= rules.night_visits)
            | (c("mid_visits") >= rules.mid_tier_visits))


def rule_intent(score) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return (F.when(s >= 60, "data_exfiltration").when(s >= 50, "job_seeking")
            .when(s >= 30, "baseline_deviation").otherwise("normal_work"))


def rule_deviation(score) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= 60, "major").when(s >= 30, "minor").otherwise("none")


def rule_verdict(features: DataFrame) -> DataFrame:
    """Default scorer: highest row score of the window, its intent and channels."""
    reasons = F.concat_ws(
        "; ",
        F.when(F.col("outbound"), "outbound document"), F.when(F.col("away_doc"), "document off this machine"),
        F.when(F.col("tier_high"), "restricted site"), F.when(F.col("tier_job"), "recruitment site"),
        F.when(F.col("tier_mid"), "remote, code or assistant site"),
        F.when(F.col("risky_search"), "job or data search"), F.when(F.col("off_any"), "night activity"))
    return (features
            .withColumn("risk_score", F.col("rule_score"))
            .withColumn("intent", rule_intent("rule_score"))
            .withColumn("deviation", rule_deviation("rule_score"))
            .withColumn("channels", mask_names("score_channels", DOC_CHANNELS + WEB_CHANNELS))
            .withColumn("explanation", F.concat(F.lit("[rules] "), reasons))
            .withColumn("ai_participated", F.lit(0)))


def work_hours_cap() -> Column:
    """Highest score a work-hours window may get from free scoring; null means no cap."""
    free = F.col("off_any") | F.col("channel_burst") | F.col("tier_high")
    cap = F.greatest(F.when(F.col("tier_mid"), 40).otherwise(0), F.when(F.col("tier_job"), 85).otherwise(0))
    return F.when(~free & (cap > 0), cap)


def day_site_totals(facts: DataFrame) -> DataFrame:
    """Visits per person, day and risk-classed site."""
    day = F.date_from_unix_date(int_div("lo", 86_400_000_000).cast("int"))
    return (risk_rows(facts)
            .groupBy("employee_id", day.alias("day"), F.col("risk_site").alias("site"), "risk_class")
            .agg(F.sum("visits").alias("visits"))
            .withColumn("tier", D.risk_tier("risk_class")))


def day_totals(sites: DataFrame, totals: DataFrame) -> DataFrame:
    """Per window: whole-day visits of the sites the window touched."""
    job, major = F.col("tier") == "job", D.is_major_recruitment("site")
    zero = F.lit(0).cast("bigint")
    return (sites.select(*WINDOW_KEY, "site", F.col("window_start").cast("date").alias("day"))
            .join(totals.select("employee_id", "day", "site", "tier", "visits"), ["employee_id", "day", "site"])
            .groupBy(*WINDOW_KEY)
            .agg(F.sum("visits").alias("day_visits"),
                 F.sum(F.when(job & major, F.col("visits")).otherwise(zero)).alias("day_job_major"),
                 F.sum(F.when(job & ~major, F.col("visits")).otherwise(zero)).alias("day_job_general")))


def history(events: DataFrame, as_of: str, days: int = 7, rules: Rules = Rules(),
            v: Vocabulary = DEFAULT) -> DataFrame:
    """Rows and distinct days per person and risk class in the last `days`."""
    recent = classify_events(events.filter((F.col("category") == "WEB")
                                           & (F.col("occurred_at") >= E.ago(as_of, days=days))), v, rules)
    return (recent.filter("risk_class is not null")
            .groupBy("employee_id", "risk_class", E.day("occurred_at").alias("day"))
            .agg(F.count("*").alias("n"))
            .groupBy("employee_id", "risk_class")
            .agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_days"))
            .withColumn("cross_day", F.col("n_days") >= rules.cross_day_days))


def person_history(events: DataFrame, verdicts: DataFrame, as_of: str, days: int = 7, most_docs: int = 5, rules: Rules = Rules(),
                   v: Vocabulary = DEFAULT) -> DataFrame:
    """What a reviewer sees of a person's last `days`, one row per fact.

    kind `verdict`: verdicts and highest score per intent; `class`: rows per risk class and day, with the number of days
    and whether that is a lasting pattern; `document`: the first operations on sensitive documents.
    """
    since = E.ago(as_of, days=days)
    judged = (verdicts.filter(F.col("window_start") >= since).groupBy("employee_id", F.col("intent").alias("what"))
              .agg(F.count("*").alias("n"), F.max("risk_score").alias("top")))
    recent = events.filter(F.col("occurred_at") >= since)
    web = classify_events(recent.filter(F.col("category") == "WEB"), v, rules).filter("risk_class is not null")
    by_day = web.groupBy("employee_id", F.col("risk_class").alias("what"), E.day("occurred_at").alias("day")).agg(F.count("*").alias("n"))
    spans = by_day.groupBy("employee_id", "what").agg(F.count("*").alias("days"))
    order = Window.partitionBy("employee_id").orderBy("occurred_at", "event_hash")
    docs = (recent.filter((F.col("category") == "DOC") & E.is_sensitive("target_value", v)).withColumn("rn", F.row_number().over(order))
            .filter(F.col("rn") <= most_docs))
    none, false = F.lit(None).cast("int"), F.lit(False)
    rows = judged.select("employee_id", F.lit("verdict").alias("kind"), "what", F.lit(None).cast("date").alias("day"), "n", F.col("top").cast("int").alias("top"), none.alias("days"), false.alias("lasting"))
    rows = rows.unionByName(by_day.join(spans, ["employee_id", "what"]).select(
        "employee_id", F.lit("class").alias("kind"), "what", "day", "n", none.alias("top"), F.col("days").cast("int").alias("days"), (F.col("days") >= rules.cross_day_days).alias("lasting")))
    return rows.unionByName(docs.select("employee_id", F.lit("document").alias("kind"), F.substring("target_value", 1, 40).alias("what"), E.day("occurred_at").alias("day"),
                                        F.lit(1).cast("long").alias("n"), none.alias("top"), none.alias("days"), false.alias("lasting")))


def anchor_score(intent, day_visits) -> Column:
    """Fixed score of policy violations and exfiltration; null when the window has no evidence.

    Uses window feature columns.
    """
    c, i = F.col, F.col(intent) if isinstance(intent, str) else intent
    only_telemetry = (c("host_rows") > 0) & (c("host_rows") == c("telemetry_rows"))
    visits = F.coalesce(F.nullif(F.col(day_visits), F.lit(0)), c("visits"))
    leak = i == "data_exfiltration"
    frequency = F.when(leak & (visits >= 10), 10).when(leak & (visits >= 4), 5).otherwise(0)
    base = F.when(leak, 70).otherwise(75) + frequency + F.when(c("wrote"), 10).otherwise(0)
    sent = F.when(c("net_send"), F.greatest(base, F.when(c("rare_send"), 85).otherwise(80))).otherwise(base)
    score = F.least(sent + F.when(c("off_any"), 5).otherwise(0), F.lit(90))
    return F.when(i.isin("policy_violation", "data_exfiltration") & c("evidence") & ~only_telemetry, score)


def job_anchor() -> Column:
    """Struct (intent, score) that recruitment visits force on a window; null when none applies.

    Uses window features, `day_job_major`, `day_job_general`, `cross_day` and `intent`.
    """
    c = F.col
    extra = F.when(c("off_any"), 5).otherwise(0) + F.when(F.coalesce("cross_day", F.lit(False)), 5).otherwise(0)
    cross = F.coalesce("cross_day", F.lit(False))
    major = F.greatest(c("job_major"), F.coalesce("day_job_major", F.lit(0)))
    general = F.greatest(c("job_general"), F.coalesce("day_job_general", F.lit(0)))
    major_score = F.least(F.when(major >= 10, 90).when(major >= 3, 85).otherwise(75) + extra, F.lit(95))
    general_score = F.least(F.when(general >= 10, 60).otherwise(55) + extra, F.lit(65))
    repeated = (c("job_general") >= 3) | ((c("job_general") >= 1) & cross)

    def forced(intent: str, score: Column, anchored: bool) -> Column:
        return F.struct(F.lit(intent).alias("intent"), score.cast("int").alias("score"),
                        F.lit(anchored).alias("anchored"))

    # Recruitment sites that stay below every bar leave a job verdict at the deviation level.
    return (F.when(c("job_major") >= 1, forced("job_seeking", major_score, True))
            .when(repeated, forced("job_seeking", general_score, True))
            .when((c("intent") == "job_seeking") & (c("job_general") + c("job_major") > 0),
                  forced("baseline_deviation", F.least(c("risk_score"), F.lit(45)), False)))


def anchored_verdicts(verdicts: DataFrame, totals: DataFrame, hist: DataFrame) -> DataFrame:
    """Apply anchors: first D9 to scores of at least 30, then the recruitment anchor where D9 gave none."""
    cross = (hist.filter("cross_day").select("employee_id").distinct().withColumn("cross_day", F.lit(True)))
    v = verdicts.join(totals, WINDOW_KEY, "left").join(cross, "employee_id", "left")
    v = (v.withColumn("anchor", F.when(F.col("risk_score") >= 30, anchor_score("intent", "day_visits")))
         .withColumn("job", F.when(F.col("anchor").isNull(), job_anchor())))
    return (v.withColumn("primary_score", F.col("risk_score"))
            .withColumn("risk_score", F.coalesce("anchor", F.col("job.score"), "risk_score").cast("int"))
            .withColumn("intent", F.coalesce(F.col("job.intent"), "intent"))
            .withColumn("anchored", F.coalesce("anchor", F.when(F.col("job.anchored"), F.col("job.score"))).cast("int"))
            .drop("anchor", "job"))


def score_events(events: DataFrame, as_of: str, rules: Rules = Rules(), v: Vocabulary = DEFAULT,
                 suppress: bool = False, judged: DataFrame | None = None,
                 recent_keys: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """Verdicts of all triggered windows.

    events -> facts (one shuffle) -> windows, baseline, sites -> gate -> score -> anchors.
    `judged` removes windows scored before, `recent_keys` those whose keys were
    judged within the suppression period, `suppress` repeats inside this run.
    """
    events = events.filter(~E.is_visitor("employee_id", 8))
    facts = shared_facts(events, v, rules) if facts is None else facts
    sites = window_sites(facts)
    flagged = deviation(window_features(facts, rules), baseline_asof(facts, rules), sites, rules)
    due = flagged.filter(should_trigger(rules))
    if judged is not None:
        due = due.join(judged.select("employee_id", "window_start", "window_end"),
                       ["employee_id", "window_start", "window_end"], "left_anti")
    if recent_keys is not None:
        due = due.join(repeated_windows(trigger_keys(facts), recent_keys, as_of, rules), WINDOW_KEY, "left_anti")
    if suppress:
        keys = trigger_keys(facts).join(due.select(*WINDOW_KEY), WINDOW_KEY, "left_semi")
        dropped = keys.select(*WINDOW_KEY).distinct().join(suppress_repeats(keys), WINDOW_KEY, "left_anti")
        due = due.join(dropped, WINDOW_KEY, "left_anti")
    totals = day_totals(sites, day_site_totals(facts))
    return with_verdict_id(anchored_verdicts(rule_verdict(due), totals, history(events, as_of, 7, rules, v)))


VERDICT_COLUMNS = ["verdict_id", "employee_id", "window_start", "window_end", "n", "visits", "intent", "deviation",
                   "risk_score", "primary_score", "anchored", "channels", "deviation_flags", "explanation",
                   "ai_participated"]


def with_verdict_id(verdicts: DataFrame) -> DataFrame:
    key = F.concat_ws("|", "employee_id", fmt_ts("window_start", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return verdicts.withColumn("verdict_id", key)


def with_devices(verdicts: DataFrame, events: DataFrame) -> DataFrame:
    """Add the device of the first event of each window."""
    first = (events.select("employee_id", F.col("occurred_at").alias("window_start"), "device_id", "event_hash")
             .join(verdicts.select(*WINDOW_KEY), WINDOW_KEY, "left_semi")
             .groupBy(*WINDOW_KEY).agg(F.min_by("device_id", "event_hash").alias("device_id")))
    return verdicts.join(first, WINDOW_KEY, "left")


def repeated_windows(keys: DataFrame, recent_keys: DataFrame, as_of: str, rules: Rules = Rules()) -> DataFrame:
    """Windows that share a trigger key with a verdict of the suppression period.

    `recent_keys` has (employee_id, window_start, trigger_key) of stored verdicts.
    """
    recent = (recent_keys.filter(F.col("window_start") >= E.ago(as_of, hours=rules.suppress_hours))
              .select("employee_id", "trigger_key").distinct())
    return keys.join(recent, ["employee_id", "trigger_key"], "left_semi").select(*WINDOW_KEY).distinct()


def reconcile(primary: DataFrame, review: DataFrame) -> DataFrame:
    """Merge a second opinion into verdicts of at least 50.

    Agreement keeps the anchored score, else the higher one, with the review's
    text; disagreement keeps an anchored verdict and otherwise takes the review
    score, at least 30.  `review` has (verdict_id, review_score, review_intent, review_text).
    """
    j = primary.join(review, "verdict_id", "left")
    q, r, a = F.col("risk_score"), F.col("review_score"), F.col("anchored")
    applies = r.isNotNull() & (q >= 50)
    agree = applies & (r >= 50)
    score = (F.when(agree, F.coalesce(a, F.greatest(q, r)))
             .when(applies & a.isNull(), F.greatest(r, F.lit(30))).otherwise(q))
    return (j.withColumn("risk_score", score.cast("int"))
            .withColumn("intent", F.when(agree, F.coalesce("review_intent", "intent")).otherwise(F.col("intent")))
            .withColumn("explanation", F.when(agree, F.coalesce("review_text", "explanation"))
                        .otherwise(F.col("explanation")))
            .withColumn("ai_participated", F.when(agree, F.lit(1)).otherwise(F.col("ai_participated")))
            .drop("review_score", "review_intent", "review_text"))


def valid_exemptions(exemptions: DataFrame, as_of: str) -> DataFrame:
    """Exemptions without expiry or expiring after `as_of`."""
    return exemptions.filter(F.col("expires_at").isNull() | (F.col("expires_at") > ntz(as_of)))


def not_exempt_people(df: DataFrame, exemptions: DataFrame, signal_type: str, as_of: str) -> DataFrame:
    """Rows of people without a valid exemption for the signal."""
    ex = valid_exemptions(exemptions, as_of).filter(F.col("signal_type") == signal_type).select("employee_id").distinct()
    return df.join(ex, "employee_id", "left_anti")


def annotate_exempt(verdicts: DataFrame, exemptions: DataFrame, as_of: str) -> DataFrame:
    """Prefix `[exempt:reason]` to the text of exempt verdicts."""
    ex = (valid_exemptions(exemptions, as_of)
          .groupBy("employee_id", F.col("signal_type").alias("intent")).agg(F.min("reason").alias("_reason"),
                                                                          F.lit(True).alias("_hit")))
    prefix = F.concat(F.lit("[exempt:"), F.coalesce(F.nullif("_reason", F.lit("")), F.lit("role")), F.lit("] "))
    return (verdicts.join(ex, ["employee_id", "intent"], "left")
            .withColumn("explanation", F.when(F.col("_hit"), F.concat(prefix, text("explanation")))
                        .otherwise(F.col("explanation")))
            .drop("_reason", "_hit").select(*verdicts.columns))


# Risk classes that back each intent in a verdict text.
INTENT_CLASSES = {"job_seeking": ["recruitment"], "policy_violation": ["netdisk", "personal_email"],
                  "data_exfiltration": ["file_helper", "netdisk", "personal_email"]}


def prefix_facts(verdicts: DataFrame, sites: DataFrame, most: int = 3) -> DataFrame:
    """Put the visited sites in front of a text that names none of them."""
    backing = F.lit(False)
    for intent, classes in INTENT_CLASSES.items():
        backing = backing | ((F.col("intent") == intent) & F.col("risk_class").isin(*classes))
    facts = (verdicts.select("verdict_id", *WINDOW_KEY, "intent", "explanation")
             .join(sites, WINDOW_KEY).filter(backing)
             .withColumn("named", F.contains("explanation", "site")
                         | F.contains("explanation", F.substring_index("site", ".", -2))))
    order = Window.partitionBy("verdict_id").orderBy(F.desc("visits"), "site")
    named = facts.groupBy("verdict_id").agg(F.bool_or("named").alias("named"))
    top = (facts.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most)
           .groupBy("verdict_id")
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "risk_class", "site", "visits"))),
                                         lambda x: F.concat(x["risk_class"], F.lit("("), x["site"], F.lit(")×"),
                                                            x["visits"].cast("string"))), ", ").alias("fact_text")))
    return (verdicts.join(named.filter("not named").join(top, "verdict_id").select("verdict_id", "fact_text"),
                          "verdict_id", "left")
            .withColumn("explanation", F.when(F.col("fact_text").isNotNull(), F.concat(
                F.lit("Visited "), "fact_text", F.lit(". "), text("explanation"))).otherwise(F.col("explanation")))
            .select(*verdicts.columns))
