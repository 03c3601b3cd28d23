"""Who is behind an agent id: as-of resolution, alias discovery and application."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import events as E
from ..functions import parsing as P
from ..functions.base import blank_to_null, int_div, micros, text


def asof_last(df: DataFrame, key: str, value: str, order: list[str], out: str, slice_seconds: int = 3600) -> DataFrame:
    """Latest non-null `value` of the same `key` up to and including each row.

    A key is cut into time slices: rows are ordered only inside (key, slice),
    and the value carried into a slice comes from one summary row per slice.  A
    key with a third of all rows therefore spreads over its slices.
    """
    sliced = df.withColumn("_slice", int_div(micros(order[0]), slice_seconds * 1_000_000))
    inside = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    known = F.col(value).isNotNull()
    last = (sliced.groupBy(key, "_slice")
            .agg(F.max_by(F.when(known, F.col(value)), F.when(known, F.struct(*order))).alias("_last")))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(key, "_slice", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    return (sliced.withColumn("_here", F.last(value, ignorenulls=True).over(inside))
            .join(carry, [key, "_slice"], "left")
            .withColumn(out, F.coalesce("_here", "_carry")).drop("_here", "_carry", "_slice"))


def resolve_identity(rows: DataFrame, suffixes=("corp", "example", "local")) -> DataFrame:
    """Add `employee_id`: path account, else latest account of the machine, else of the user id, else a placeholder.

    Needs agent_id, user_no, account_hint, occurred_at and event_id.
    """
    order = ["occurred_at", "event_id"]
    hinted = rows.withColumn("_acct", blank_to_null(P.clean_account("account_hint", suffixes)))
    keyed = (hinted.withColumn("_agent", F.coalesce(blank_to_null("agent_id"), F.concat(F.lit("row:"), F.col("event_id").cast("string"))))
             .withColumn("_user", F.coalesce(blank_to_null("user_no"), F.concat(F.lit("row:"), F.col("event_id").cast("string")))))
    by_agent = asof_last(keyed, "_agent", "_acct", order, "_agent_acct")
    by_user = asof_last(by_agent, "_user", "_acct", order, "_user_acct")
    placeholder = F.concat(F.lit("AGENT:"), F.coalesce(blank_to_null("agent_id"), blank_to_null("user_no")))
    return (by_user.withColumn("employee_id", F.coalesce("_acct", "_agent_acct", "_user_acct", placeholder))
            .drop("_acct", "_agent", "_user", "_agent_acct", "_user_acct"))


def distinct_ids(*tables: DataFrame) -> DataFrame:
    """Distinct person ids of several tables."""
    out = None
    for t in tables:
        ids = t.select("employee_id").filter("employee_id is not null").distinct()
        out = ids if out is None else out.unionByName(ids)
    return out.distinct()


def account_activity(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return (E.since(events, as_of, days=days).groupBy("employee_id")
            .agg(F.count("*").alias("n_rows"), F.max("occurred_at").alias("last_seen")))


def discover_aliases(ids: DataFrame, name_keys: DataFrame, decided: DataFrame | None = None) -> DataFrame:
    """Proposed mapping of unresolved accounts.

    `name_keys` maps a name to its romanised key.  An account whose comparison
    key belongs to exactly one name is settled (`auto`); several names give
    `candidates`, an IP address is to be ignored (people are never inferred from
    addresses), everything else is `pending`.  A site-prefixed name equal to a
    known name is settled too.  `decided` lists confirmed or ignored accounts.
    """
    open_ids = ids.select(F.col("employee_id").alias("account")).distinct()
    if decided is not None:
        open_ids = open_ids.join(decided.select("account"), "account", "left_anti")
    accounts = open_ids.filter(~E.is_named("account")).withColumn("key", P.account_key("account"))
    hits = (accounts.filter(~E.is_ip("account") & (F.col("key") != "")).join(name_keys, "key")
            .groupBy("account")
            .agg(F.countDistinct("name").alias("n_names"), F.min("name").alias("first_name"),
                 F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names")))
    judged = (accounts.join(hits, "account", "left")
              .select("account",
                      F.when(F.col("n_names") == 1, "auto").when(F.col("n_names") > 1, "candidates")
                      .when(E.is_ip("account"), "ignore_ip").otherwise("pending").alias("state"),
                      F.when(F.col("n_names") == 1, F.col("first_name")).alias("name"),
                      F.when(F.col("n_names") > 1, F.col("names")).alias("candidates")))
    prefixed = (open_ids.filter(E.is_named("account") & F.col("account").rlike(r"^[A-Za-z]{2,6}(?:-[A-Za-z]{2,6})+-"))
                .withColumn("name", P.strip_site_prefix("account")))
    known = ids.select(F.col("employee_id").alias("name")).filter(E.is_named("name")).distinct()
    settled = (prefixed.join(known, "name", "left_semi").filter(F.col("name") != F.col("account"))
               .select("account", F.lit("auto").alias("state"), "name", F.lit(None).cast("string").alias("candidates")))
    return judged.unionByName(settled)


def rename(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rekey `employee_id` by (account, name)."""
    names = aliases.select(F.col("account").alias("employee_id"), F.col("name").alias("_name"))
    return (df.join(names, "employee_id", "left").withColumn("employee_id", F.coalesce("_name", "employee_id"))
            .drop("_name").select(*df.columns))


def rename_alerts(alerts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rekey alerts, rebuild their keys by kind and keep the higher score of duplicates."""
    names = aliases.select(F.col("account").alias("employee_id"), F.col("name").alias("_name"))
    moved = alerts.join(names, "employee_id", "left")
    rest = F.substring(F.col("dedup_key"), F.length("employee_id") + 1, F.length("dedup_key"))
    moved = (moved.withColumn("dedup_key", F.when(F.col("_name").isNotNull(), F.concat("_name", rest))
                              .otherwise(F.col("dedup_key")))
             .withColumn("employee_id", F.coalesce("_name", "employee_id")).select(*alerts.columns))
    order = Window.partitionBy("dedup_key").orderBy(F.desc("risk_score"), F.desc("window_start"))
    return moved.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def rename_profiles(profiles: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rekey profiles; the account's own profile goes when the name has one."""
    has = profiles.select(F.col("employee_id").alias("name"))
    shadowed = aliases.join(has, "name", "left_semi").select(F.col("account").alias("employee_id"))
    return rename(profiles.join(shadowed, "employee_id", "left_anti"), aliases)


def review_aliases(confirmed: DataFrame, pending: DataFrame, ignored: DataFrame, actions: DataFrame) -> dict:
    """Apply review actions (account, op, name): confirm, ignore, undo, delete."""
    op = lambda name: actions.filter(F.col("op") == name)
    settled = op("confirm").filter((text("account") != "") & (text("name") != "")).select("account", "name")
    kept = (confirmed.join(op("delete").select("account"), "account", "left_anti")
            .join(settled.select("account"), "account", "left_anti"))
    gone = op("ignore").select("account").unionByName(settled.select("account")).distinct()
    return {
        "confirmed": kept.select("account", "name").unionByName(settled),
        "pending": pending.join(gone, "account", "left_anti"),
        "ignored": (ignored.select("account").unionByName(op("ignore").select("account"))
                    .join(op("undo").select("account"), "account", "left_anti").distinct()),
    }
