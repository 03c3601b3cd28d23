"""Text digests of windows, profiles, days and weeks.

Lists are cut by rank before they are collected, so a digest row holds a fixed
number of entries whatever the volume behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import events as E
from ..functions.base import blank_to_null, fmt_ts, text
from ..schema import SEND_ACTIONS, Rules
from ..vocab import DEFAULT, Vocabulary
from .classify import classify_events
from .windows import leisure_segments, leisure_visits


def ranked_list(df: DataFrame, keys: list[str], item: Column, order: list[Column], most: int, out: str,
                sep: str = "; ") -> DataFrame:
    """First `most` items per key in the given order, joined to one text."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (df.withColumn("_item", item).withColumn("_rn", rn).filter(F.col("_rn") <= most)
            .groupBy(*keys).agg(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("_rn", "_item"))), lambda x: x["_item"]), sep).alias(out)))


def window_digest(windowed: DataFrame, v: Vocabulary = DEFAULT, limit: int = 1500) -> DataFrame:
    """Readable summary per window from events that carry `window_start`."""
    key = ["employee_id", "window_start"]
    e = classify_events(windowed, v)
    label = F.coalesce(blank_to_null("app"), blank_to_null("site_class"))
    sites = (e.filter("category = 'WEB'").groupBy(*key, "site", "risk_class", "tier")
             .agg(F.sum("count").alias("visits"), F.min(label).alias("label")))
    tag = F.when(D.is_telemetry("site"), " (background traffic)").otherwise("")
    shown = F.concat("site", F.lit(" ×"), F.col("visits").cast("string"), tag,
                     F.coalesce(F.concat(F.lit(" ["), "label", F.lit("]")), F.lit("")))
    order = [F.desc("visits"), F.col("site")]
    strong = ranked_list(sites.filter("risk_class is not null"), key,
                         F.concat(F.lit("[!"), "risk_class", F.lit("] "), shown), order, 10, "strong", "\n")
    plain_sites = sites.filter("risk_class is null")
    plain = ranked_list(plain_sites, key, F.concat(F.lit("[web] "), shown), order, 15, "plain", "\n")
    n_plain = plain_sites.groupBy(*key).agg(F.count("*").alias("n_plain"))
    others = e.filter("category <> 'WEB'")
    line = F.concat(fmt_ts("occurred_at", "MM-dd HH:mm"), F.lit(" ["), "source", F.lit("] ["), "action", F.lit("] "),
                    text("target_value"),
                    F.when(F.col("category") == "DOC", F.concat(F.lit(" (channel="), text("channel"), F.lit(")"))).otherwise(""),
                    F.when(F.col("action").isin("SEND", "UPLOAD", "PRINT") & (text("dest_path") != ""),
                           F.concat(F.lit(" → "), F.substring("dest_path", 1, 60))).otherwise(""))
    other = ranked_list(others, key, line, [F.col("occurred_at"), F.col("event_hash")], 12, "other", "\n")
    base = e.groupBy(*key).agg(
        F.min(F.when(F.col("category") == "WEB", F.hour("occurred_at"))).alias("h0"),
        F.max(F.when(F.col("category") == "WEB", F.hour("occurred_at"))).alias("h1"),
        F.count_if(F.col("category") != "WEB").alias("n_other"))
    j = base.join(strong, key, "left").join(plain, key, "left").join(n_plain, key, "left").join(other, key, "left")
    night = F.when((F.col("h0") < 7) | (F.col("h1") >= 22),
                   F.concat(F.lit("[night] visits between "), F.col("h0").cast("string"), F.lit(" and "),
                            F.col("h1").cast("string")))
    more = F.when(F.col("n_plain") > 15, F.concat(F.lit("... and "), (F.col("n_plain") - 15).cast("string"), F.lit(" more hosts")))
    rest = F.when(F.col("n_other") > 12, F.concat(F.lit("... and "), (F.col("n_other") - 12).cast("string"), F.lit(" more rows")))
    body = F.concat_ws("\n", night, "strong", "plain", more, "other", rest)
    cut = F.when(F.length(body) > limit, F.concat(F.substring(body, 1, limit), F.lit("\n... cut"))).otherwise(body)
    return j.select(*key, cut.alias("digest"))


def profile_digest(profile: DataFrame) -> DataFrame:
    """One-line baseline text; null below 15 rows."""
    p = profile
    first = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
    pairs = lambda c, n: F.array_join(F.slice(F.transform(F.map_entries(c), lambda x: F.concat(
        x["key"], F.lit("×"), x["value"].cast("string"))), 1, n), ", ")
    hours = F.concat(F.array_min("active_hours_top").cast("string"), F.lit("-"), F.array_max("active_hours_top").cast("string"))
    extra = F.concat_ws(
        "; ",
        F.when(F.size("doc_types") > 0, F.concat(F.lit("file types "), pairs("doc_types", 5))),
        F.when(F.size("project_codes") > 0, F.concat(F.lit("codes "), F.array_join(F.slice(F.map_keys("project_codes"), 1, 6), ", "))),
        F.when(F.size("send_channels") > 0, F.concat(F.lit("sends "), pairs("send_channels", 4))),
        F.concat(F.lit("rhythm "), F.col("rhythm.start_median").cast("string"), F.lit("-"),
                 F.col("rhythm.end_median").cast("string"), F.lit(", night days "),
                 F.col("rhythm.late_night_days").cast("string")),
        F.when(F.size("search_topics") > 0, F.concat(F.lit("searches "), first("search_topics", 5))))
    body = F.concat(F.lit("[baseline "), F.when(F.col("sample_count") >= 50, "mature").otherwise("thin"), F.lit(", "),
                    F.col("sample_count").cast("string"), F.lit(" rows] hours "), hours, F.lit("; per day ~"),
                    F.col("daily_median").cast("string"), F.lit(" max "), F.col("daily_max").cast("string"),
                    F.lit("; channels "), F.array_join("channels_used", "/"), F.lit("; hosts "),
                    first("common_domains", 8), F.lit("; "), extra)
    return p.select("employee_id", "sample_count", F.when(F.col("sample_count") >= 15, body).alias("digest"))


def efficiency_digest(events: DataFrame, as_of: str, days: int = 7, min_rows: int = 3, rules: Rules = Rules(),
                      v: Vocabulary = DEFAULT) -> DataFrame:
    """Leisure visits per day and category as text, for people with at least `min_rows` rows."""
    rows = leisure_visits(events.filter((F.col("occurred_at") >= E.day_start(as_of, days - 1))
                                        & ~E.is_visitor("employee_id")), v)
    per = (rows.groupBy("employee_id", E.day("occurred_at").alias("day"), "leisure")
           .agg(F.sum("count").alias("visits"), F.count("*").alias("n")))
    order = F.struct((-F.col("visits")).alias("o"), "leisure", "visits")
    day_text = per.groupBy("employee_id", "day").agg(
        F.sum("n").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(order)),
                                 lambda x: F.concat(x["leisure"], F.lit(" "), x["visits"].cast("string"))), ", ").alias("t"))
    people = day_text.groupBy("employee_id").agg(
        F.sum("n").alias("n_rows"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "t"))),
                                 lambda x: F.concat(F.date_format(x["day"], "MM-dd"), F.lit(" "), x["t"])), "; ").alias("days"))
    minutes = (leisure_segments(rows, ["employee_id"], rules).groupBy("employee_id")
               .agg(F.floor(F.sum("seconds") / 60).alias("minutes")))
    return people.filter(F.col("n_rows") >= min_rows).join(minutes, "employee_id").select(
        "employee_id", "n_rows", "minutes", "days")


def document_digest(events: DataFrame, as_of: str, days: int = 7, most_people: int = 40, samples: int = 6,
                    actions=("SEND", "UPLOAD", "PRINT", "BURN", "COPY")) -> DataFrame:
    """Document activity of the busiest people: rows and sample files per action and time of day."""
    rows = events.filter((text("source") == "endpoint") & (F.col("category") == "DOC")
                         & F.col("action").isin(*actions) & (F.col("occurred_at") >= E.ago(as_of, days=days)))
    people = (rows.groupBy("employee_id").agg(F.count("*").alias("person_rows"))
              .orderBy(F.desc("person_rows"), "employee_id").limit(most_people))
    kind = F.concat("action", F.when(E.is_off_hours("occurred_at"), "(night)").otherwise(""))
    rows = rows.join(people, "employee_id").withColumn("kind", kind)
    item = F.concat(F.substring(text("target_value"), 1, 40), F.lit(" → "),
                    F.coalesce(blank_to_null(F.substring(text("dest_path"), 1, 50)), F.lit("-")))
    keys = ["employee_id", "kind"]
    return (rows.groupBy(*keys, "person_rows").agg(F.count("*").alias("n_rows"))
            .join(ranked_list(rows, keys, item, [F.col("occurred_at"), F.col("event_hash")], samples, "samples"), keys)
            .select("employee_id", "person_rows", "kind", "n_rows", "samples"))


def day_candidates(verdicts: DataFrame, events: DataFrame, day: str, min_score: int = 50, most: int | None = 20) -> DataFrame:
    """People to review for a day: an alert-level verdict, or a send, upload or deletion."""
    judged = E.on_day(verdicts, day, "window_start", "window_date").filter(F.col("risk_score") >= min_score).select("employee_id")
    acted = (E.on_day(events, day).filter((text("source") == "endpoint") & F.col("action").isin("SEND", "UPLOAD", "DELETE"))
             .select("employee_id"))
    people = judged.unionByName(acted).distinct()
    return people if most is None else people.orderBy("employee_id").limit(most)


def day_digest(events: DataFrame, verdicts: DataFrame, day: str, v: Vocabulary = DEFAULT,
               most_people: int | None = 20) -> DataFrame:
    """What each candidate did on a day, one column per kind."""
    people = day_candidates(verdicts, events, day, most=most_people)
    e = classify_events(E.on_day(events, day), v).join(people, "employee_id", "left_semi")
    key, order = ["employee_id"], [F.col("occurred_at"), F.col("event_hash")]
    doc = F.col("category") == "DOC"
    sent = doc & F.col("action").isin(*SEND_ACTIONS)
    deleted = doc & (F.col("action") == "DELETE") & ~F.col("noise_doc")
    other = doc & ~sent & ~deleted
    target = text("target_value")
    search = (F.col("category") == "SEARCH") & (target != "")
    base = e.groupBy("employee_id").agg(
        F.count_if(sent).alias("n_sends"), F.count_if(deleted).alias("n_deletes"), F.count_if(other).alias("n_docs"),
        F.min(F.hour("occurred_at")).alias("hour_from"), F.max(F.hour("occurred_at")).alias("hour_to"))
    sites = (e.filter("risk_class is not null").groupBy("employee_id", "site").agg(F.sum("count").alias("visits")))
    parts = [
        ranked_list(sites, key, F.concat("site", F.lit("×"), F.col("visits").cast("string")),
                    [F.desc("visits"), F.col("site")], 8, "risk_sites"),
        ranked_list(e.filter(sent), key, F.concat(F.substring(target, 1, 30), F.lit("→"), F.coalesce(
            blank_to_null(F.substring(D.dest_root("dest_path"), 1, 30)), text("channel"))), order, 8, "sends"),
        ranked_list(e.filter(deleted), key, F.substring(target, 1, 30), order, 8, "deletes"),
        ranked_list(e.filter(other), key, F.concat("action", F.lit(":"), F.substring(target, 1, 24)), order, 6, "docs"),
        ranked_list(e.filter(search), key, F.substring(target, 1, 24), order, 6, "searches"),
        ranked_list(E.on_day(verdicts, day, "window_start", "window_date"), key,
                    F.concat("intent", F.lit(" "), F.col("risk_score").cast("string")),
                    [F.col("window_start")], 6, "verdicts"),
    ]
    for part in parts:
        base = base.join(part, "employee_id", "left")
    return base
