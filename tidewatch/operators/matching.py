"""Classes of hosts and labels from rule tables of any size.

A rule is a row: which family it belongs to, what it looks at (host or label), how it matches (suffix at a dot, or
anywhere), its rank in the family, and its outcome.  Matching is one join: every distinct host or label is exploded once
into keys (its suffixes, and its distinct substrings of up to GRAM characters), a rule has one key (its pattern as a
suffix, or the first GRAM characters of it), and what meets on a key is compared in full.  No pair of host and rule is
formed without a common key, and the work follows hosts and hits, not hosts times rules.

In each family the match of the lowest rank decides.  Facts never meet the rules: `with_classes` classifies the distinct
(host, label) pairs of a table and joins them back, which AQE splits for a popular host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import domains as D
from ..functions.base import text

GRAM = 4
RULES = "family string, target string, how string, pattern string, rank int, outcome string"
VETO = -1


def label_rules(spark: SparkSession) -> DataFrame:
    """The label and host hints that come with the package, as rows of a rule table."""
    rows = [("leisure", "host", "anywhere", p, VETO, None) for p in [*vocab.SDK_HINTS, *vocab.INFRA_HINTS]]
    rows += [("leisure", "label", "anywhere", p, VETO, None) for p in vocab.OFFICE_CHAT_LABELS]
    rows += [("label_is_leisure", "label", "anywhere", p, 0, "yes") for p in vocab.LEISURE_LABELS]
    rows += [("label_is_leisure", "label", "anywhere", p, VETO, None) for p in vocab.LEISURE_LABEL_VETO]
    rows += [("label_category", "label", "anywhere", p, i, c) for i, (p, c) in enumerate(vocab.LEISURE_LABEL_CATEGORY)]
    return spark.createDataFrame(rows, RULES)


def dictionary_rules(entries: DataFrame) -> DataFrame:
    """Rules of a dictionary table (dict_name, category, pattern).

    Risk dictionaries match dotted entries as suffix and others anywhere; white lists and all other dictionaries match
    as suffix.  Categories of leisure sites rank in alphabetical order after the given ones.
    """
    e = entries.filter("pattern <> ''").withColumn("pattern", F.lower("pattern"))
    risk = [(name, i, label) for i, (label, name, _) in enumerate(vocab.RISK_CLASSES)]
    plain = [("risk_whitelist_domains", "risk", VETO, None), ("slack_sdk_domains", "leisure", VETO, None), ("slack_whitelist_domains", "leisure", VETO, None),
             ("work_domains", "work", 0, "work")]
    keys = {name: (family, rank, outcome, True) for name, family, rank, outcome in plain}
    keys |= {name: ("risk", i, label, False) for name, i, label in risk}
    spark = entries.sparkSession
    kinds = spark.createDataFrame([(n, *k) for n, k in keys.items()], "dict_name string, family string, rank int, outcome string, is_suffix boolean")
    anywhere = ~F.col("is_suffix") & ~F.contains("pattern", F.lit("."))
    listed = e.join(kinds, "dict_name").select("family", F.lit("host").alias("target"), F.when(anywhere, "anywhere").otherwise("suffix").alias("how"), "pattern", "rank", "outcome")
    known = list(vocab.DEFAULT_CATEGORIES.get("slack_domains", {}))
    first = spark.createDataFrame([(c, i) for i, c in enumerate(known)], "category string, place int")
    own = e.filter("dict_name = 'slack_domains'")
    # Categories are few; their order is part of the rules.
    more = own.select("category").distinct().join(first, "category", "left_anti")
    from pyspark.sql import Window
    more = more.select("category", (F.row_number().over(Window.orderBy("category")) + len(known)).alias("place"))
    leisure = own.join(first.unionByName(more.select("category", F.col("place").cast("int").alias("place"))), "category").select(
        F.lit("site_category").alias("family"), F.lit("host").alias("target"), F.lit("suffix").alias("how"), "pattern", F.col("place").alias("rank"), F.col("category").alias("outcome"))
    return listed.unionByName(leisure)


def _grams(c: Column) -> Column:
    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.concat(F.lit("g:"), F.substring(c, i, n)))

    return F.concat(*[of(n) for n in range(1, GRAM + 1)])


def _suffixes(c: Column) -> Column:
    labels = F.size(F.split(c, r"\."))
    return F.transform(F.sequence(F.lit(1), labels), lambda k: F.concat(F.lit("s:"), F.call_function("substring_index", c, F.lit("."), -k)))


def matches(names: DataFrame, rules: DataFrame, target: str) -> DataFrame:
    """(name, family, rank, outcome): the deciding rule of each family for every distinct `name`."""
    mine = rules.filter((F.col("target") == target) & (F.col("pattern") != ""))
    mine = mine.withColumn("key", F.when(F.col("how") == "suffix", F.concat(F.lit("s:"), "pattern")).otherwise(F.concat(F.lit("g:"), F.substring("pattern", 1, GRAM))))
    # Equal rules of a family: only the first can decide.
    mine = mine.groupBy("family", "how", "pattern", "key").agg(F.min(F.struct("rank", "outcome")).alias("r")).select("family", "how", "pattern", "key", "r.*")
    keys = F.array_distinct(F.concat(_suffixes(F.col("name")), _grams(F.col("name"))))
    base = names.filter("name <> ''").distinct().withColumn("key", F.explode(keys))
    met = base.join(mine, "key").filter((F.col("how") == "suffix") | F.contains("name", "pattern"))
    best = F.min(F.struct("rank", "outcome")).alias("r")
    return met.groupBy("name", "family").agg(best).select("name", "family", "r.rank", "r.outcome")


def classify_pairs(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """(domain, label, risk_class, tier, leisure, is_work) of distinct (domain, label) rows; domains are lower-case."""
    hosts = _wide(matches(pairs.select(F.col("domain").alias("name")), rules, "host"), ["risk", "work", "leisure", "site_category"])
    labels = _wide(matches(pairs.select(F.col("label").alias("name")), rules, "label"), ["leisure", "label_is_leisure", "label_category"])
    hosts = hosts.select(F.col("name").alias("domain"), *[F.col(c).alias(f"h_{c}") for c in hosts.columns if c != "name"])
    labels = labels.select(F.col("name").alias("label"), *[F.col(c).alias(f"l_{c}") for c in labels.columns if c != "name"])
    p = pairs.select("domain", "label").distinct().join(hosts, "domain", "left").join(labels, "label", "left")
    hit = lambda c: F.coalesce(F.col(f"{c}.rank") >= 0, F.lit(False))
    barred = (F.col("domain") == "") | F.col("h_leisure").isNotNull() | F.col("l_leisure").isNotNull()
    by_label = F.when(hit("l_label_is_leisure"), F.col("l_label_category.outcome"))
    leisure = F.when(~barred, F.coalesce(by_label, F.col("h_site_category.outcome")))
    return (p.withColumn("risk_class", F.when(hit("h_risk"), F.col("h_risk.outcome"))).withColumn("tier", D.risk_tier("risk_class"))
            .withColumn("leisure", leisure).withColumn("is_work", F.col("h_work").isNotNull())
            .select("domain", "label", "risk_class", "tier", "leisure", "is_work"))


def _wide(found: DataFrame, families: list[str]) -> DataFrame:
    """One struct column per family."""
    return found.groupBy("name").agg(*[F.max(F.when(F.col("family") == f, F.struct("rank", "outcome"))).alias(f) for f in families])


def with_classes(rows: DataFrame, rules: DataFrame, domain: Column, label: Column) -> DataFrame:
    """`rows` with risk_class, tier, leisure and is_work of their host and label."""
    keyed = rows.withColumn("_domain", F.lower(text(domain))).withColumn("_label", F.trim(text(label)))
    pairs = keyed.groupBy(F.col("_domain").alias("domain"), F.col("_label").alias("label")).count()
    classes = classify_pairs(pairs, rules).withColumnsRenamed({"domain": "_domain", "label": "_label"})
    return keyed.join(classes, ["_domain", "_label"], "left").drop("_domain", "_label")
