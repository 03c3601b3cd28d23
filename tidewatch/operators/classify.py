"""Risk, leisure and work classes of events and domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import domains as D
from ..functions import events as E
from ..functions.base import blank_to_null, text
from ..schema import Rules
from ..vocab import DEFAULT, Vocabulary


def classify_events(events: DataFrame, v: Vocabulary = DEFAULT, rules: Rules = Rules()) -> DataFrame:
    """Add `site`, `risk_class`, `tier`, `off_hours`, `heartbeat`, `telemetry` and `noise_doc`.

    `site` is the visited host of WEB rows and null elsewhere.
    """
    web = F.col("category") == "WEB"
    return (events
            .withColumn("site", F.when(web, F.lower(F.coalesce(blank_to_null("domain"), text("target_value")))))
            .withColumn("risk_class", D.risk_class("site", v))
            .withColumn("tier", D.risk_tier("risk_class"))
            .withColumn("off_hours", E.is_off_hours("occurred_at", rules))
            .withColumn("heartbeat", D.is_heartbeat("site", "risk_class"))
            .withColumn("telemetry", D.is_telemetry("site"))
            .withColumn("noise_doc", E.is_noise_doc()))


def classify_domains(events: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """One row per (domain, label): rows seen, risk class and tier, leisure class, work flag."""
    return (events.filter((F.col("category") == "WEB") & (text("domain") != ""))
            .groupBy(F.lower("domain").alias("domain"), text("site_class").alias("label"))
            .agg(F.count("*").alias("n_rows"))
            .withColumn("risk_class", D.risk_class("domain", v))
            .withColumn("tier", D.risk_tier("risk_class"))
            .withColumn("leisure", D.leisure_class("domain", "label", v))
            .withColumn("is_work", D.is_work_domain("domain", v)))


def classify_with_table(domains: DataFrame, entries: DataFrame) -> DataFrame:
    """Risk class per distinct domain from a dictionary table of any size.

    `entries` has (dict_name, pattern).  Dotted patterns become an equi join on
    the exploded suffixes, keywords an equi join on the substrings of the
    keyword lengths in use, so no pair is tested by comparison.
    """
    order = [(dictionary, label, i) for i, (label, dictionary, _) in enumerate(vocab.RISK_CLASSES)]
    rank = F.lit(None).cast("int")
    for dictionary, _, i in order:
        rank = F.when(F.col("dict_name") == dictionary, F.lit(i)).otherwise(rank)
    rank = F.when(F.col("dict_name") == "risk_whitelist_domains", F.lit(-1)).otherwise(rank)
    entries = (entries.withColumn("rank", rank).filter("rank is not null and pattern <> ''")
               .select(F.lower("pattern").alias("pattern"), "rank")
               .groupBy("pattern").agg(F.min("rank").alias("rank")))
    suffixes = entries.filter(F.col("pattern").contains(".") | (F.col("rank") == -1))
    keywords = entries.filter(~F.col("pattern").contains(".") & (F.col("rank") >= 0))
    # A keyword cannot be longer than a host name, so there are at most 253 lengths.
    lengths = [r[0] for r in keywords.select(F.length("pattern")).distinct().collect()]

    base = domains.select(F.lower("domain").alias("domain")).filter("domain <> ''").distinct()
    labels = F.size(F.split("domain", r"\."))
    by_suffix = base.select("domain", F.explode(F.transform(
        F.sequence(F.lit(1), labels), lambda k: F.call_function("substring_index", F.col("domain"), F.lit("."), -k))).alias("pattern"))
    hits = by_suffix.join(suffixes, "pattern").select("domain", "rank")
    for n in lengths:
        grams = (base.filter(F.length("domain") >= n)
                 .select("domain", F.explode(F.array_distinct(F.transform(
                     F.sequence(F.lit(1), F.length("domain") - n + 1),
                     lambda i: F.substring(F.col("domain"), i, F.lit(n))))).alias("pattern")))
        hits = hits.unionByName(grams.join(keywords, "pattern").select("domain", "rank"))
    best = hits.groupBy("domain").agg(F.min("rank").alias("rank"))
    label = F.lit(None).cast("string")
    for _, name, i in order:
        label = F.when(F.col("rank") == i, F.lit(name)).otherwise(label)
    return (base.join(best, "domain", "left").withColumn("risk_class", label)
            .withColumn("tier", D.risk_tier("risk_class")).select("domain", "risk_class", "tier"))


def dictionary_table(spark, v: Vocabulary = DEFAULT) -> DataFrame:
    return spark.createDataFrame(v.rows(), "dict_name string, category string, rank int, pattern string")


def merge_dictionary(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """Default entries plus stored additions.

    A stored row never removes a default.  In dictionaries that have categories
    only unknown categories are added.
    """
    defaults = defaults.select("dict_name", "category", "pattern")
    stored = stored.select("dict_name", "category", "pattern")
    grouped = defaults.filter("category <> ''").select("dict_name").distinct()
    fixed = defaults.filter("category <> ''").select("dict_name", "category").distinct()
    plain = (stored.join(grouped, "dict_name", "left_anti")
             .withColumn("category", F.lit("")))
    extra = (stored.join(grouped, "dict_name", "left_semi")
             .join(fixed, ["dict_name", "category"], "left_anti"))
    return defaults.unionByName(plain).unionByName(extra).dropDuplicates(["dict_name", "category", "pattern"])


def vocabulary_from(table: DataFrame, limit: int = 5_000) -> Vocabulary:
    """Configuration object of a dictionary table that rules can hold as literals.

    Its bound is on the plan, not on dictionaries: larger ones classify by `matching.with_classes`, which joins.
    """
    rows = table.select("dict_name", "category", "pattern").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} dictionary entries: use matching.with_classes")
    return DEFAULT.with_overrides([tuple(r) for r in rows])
