"""Activity windows, leisure segments and the window facts behind every rule.

A person may own a third of all rows, so nothing here windows over raw rows of
a person.  Rows are first reduced to one row per person and time slice no longer
than the session gap: inside a slice two rows are always in one session, hence
first and last time of the slices decide every boundary.  What reaches a
per-person task is bounded by the number of slices, not by the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import events as E
from ..functions.base import choose, from_micros, int_div, micros, text
from ..schema import EVIDENCE_DOC_ACTIONS, OUTBOUND_ACTIONS, SEND_ACTIONS, WRITE_ACTIONS, Rules
from ..session import cut_lineage
from ..vocab import DEFAULT, Vocabulary
from .classify import classify_events

# Channel sets travel as bit masks so that aggregation stays hash based.
DOC_CHANNELS = ["LOCAL", "NETWORK", "OTHER", "USB"]
WEB_CHANNELS = ["file_helper", "netdisk", "personal_email", "remote_control"]
CHANNEL_BITS = {name: 1 << i for i, name in enumerate(DOC_CHANNELS + WEB_CHANNELS)}
DOC_CHANNEL_MASK = sum(CHANNEL_BITS[c] for c in DOC_CHANNELS)


def slice_seconds(gap_seconds: int) -> int:
    """Longest slice that fits the gap and never crosses an hour."""
    return max(d for d in range(1, 3601) if 3600 % d == 0 and d <= gap_seconds)


def slice_index(ts, seconds: int) -> Column:
    return int_div(micros(ts), seconds * 1_000_000)


def session_starts(slices: DataFrame, keys: list[str], gap_seconds: int,
                   index: str = "slice", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Add `start` (microseconds) of the session each slice belongs to."""
    order = Window.partitionBy(*keys).orderBy(index)
    before = F.lag(hi).over(order)
    opens = before.isNull() | (F.col(lo) - before > gap_seconds * 1_000_000)
    return (slices.withColumn("_open", F.when(opens, F.col(lo)))
            .withColumn("start", F.last("_open", ignorenulls=True).over(
                order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .drop("_open"))


def slices_of(events: DataFrame, keys: list[str], gap_seconds: int, ts: str = "occurred_at") -> DataFrame:
    """Per key and slice: rows, first and last time, session start."""
    base = (events.groupBy(*keys, slice_index(ts, slice_seconds(gap_seconds)).alias("slice"))
            .agg(F.count("*").alias("n"), F.min(micros(ts)).alias("lo"), F.max(micros(ts)).alias("hi")))
    return session_starts(base, keys, gap_seconds)


def build_windows(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per activity window; a gap of exactly the limit stays inside."""
    return (slices_of(events, ["employee_id"], rules.session_gap_seconds)
            .groupBy("employee_id", "start")
            .agg(F.sum("n").alias("n_events"), F.max("hi").alias("hi"))
            .select("employee_id", from_micros("start").alias("window_start"),
                    from_micros("hi").alias("window_end"), "n_events"))


def assign_windows(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Every event with the start of its window."""
    starts = (slices_of(events, ["employee_id"], rules.session_gap_seconds)
              .select("employee_id", "slice", from_micros("start").alias("window_start")))
    keyed = events.withColumn("slice", slice_index("occurred_at", slice_seconds(rules.session_gap_seconds)))
    return keyed.join(starts, ["employee_id", "slice"]).drop("slice")


# --------------------------------------------------------------------------- leisure

def leisure_visits(events: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """WEB rows of a leisure site in work hours, with `leisure` category."""
    label = F.coalesce("site_class", "app")
    return (events.filter((F.col("category") == "WEB") & E.is_work_hours("occurred_at"))
            .withColumn("leisure", D.leisure_class("domain", label, v))
            .filter("leisure is not null"))


def leisure_segments(visits: DataFrame, keys: list[str] = ("employee_id",), rules: Rules = Rules()) -> DataFrame:
    """Time segments per key and day.

    Length is the span, at most ten minutes per row and at least five minutes;
    a day over the cap is scaled down as a whole.
    """
    keys = list(keys)
    by_day = [*keys, "day"]
    slices = slices_of(visits.withColumn("day", E.day("occurred_at")), by_day, rules.leisure_gap_seconds)
    second = 1_000_000
    segments = slices.groupBy(*by_day, "start").agg(F.sum("n").alias("n"), F.max("hi").alias("hi"))
    length = F.greatest(F.least(F.col("hi") - F.col("start"),
                                F.col("n") * rules.leisure_slot_seconds * second),
                        F.lit(rules.leisure_floor_seconds * second))
    capped = (segments.withColumn("us", length)
              .withColumn("day_us", F.sum("us").over(Window.partitionBy(*by_day))))
    cap = rules.leisure_day_cap_seconds
    scaled = int_div(F.col("us") * cap, F.col("day_us"))
    return capped.select(
        *by_day, from_micros("start").alias("seg_start"), from_micros("hi").alias("seg_end"), "n",
        F.when(F.col("day_us") > cap * second, scaled.cast("double"))
        .otherwise(F.col("us") / second).alias("seconds"))


# --------------------------------------------------------------------------- window facts

# Row flags, combined with bit_or; the position in this list is the bit.
FLAGS = ["off_any", "outbound", "away_doc", "searched", "risky_search", "forbidden", "mid_off", "keyword_hit",
         "tier_high", "tier_mid", "tier_job", "evidence", "wrote", "net_send", "rare_send", "doc_evidence"]
OUTBOUND_PAIRS = [(a, c) for a in OUTBOUND_ACTIONS for c in DOC_CHANNELS]


def has_flag(name: str, mask="flags") -> Column:
    return F.col(mask).bitwiseAND(1 << FLAGS.index(name)) != 0


def _bits(conditions: list[Column]) -> Column:
    out = F.lit(0)
    for i, cond in enumerate(conditions):
        out = out.bitwiseOR(F.when(cond, F.lit(1 << i)).otherwise(F.lit(0)))
    return out


def row_signals(events: DataFrame, v: Vocabulary = DEFAULT, rules: Rules = Rules()) -> DataFrame:
    """Per event: flag bits, channel bits and rule score."""
    e = classify_events(events, v, rules)
    web, doc, search = [F.col("category") == c for c in ("WEB", "DOC", "SEARCH")]
    c = F.col
    keyword = text("raw_keyword") if "raw_keyword" in events.columns else F.lit("")
    e = (e.withColumn("wl_dest", D.is_whitelisted_dest("dest_path", v))
         .withColumn("dest_class", F.when(doc, D.risk_class(D.dest_root("dest_path"), v)))
         # Channels outside the fixed set count as OTHER.
         .withColumn("way", F.when(text("channel").isin("", *DOC_CHANNELS), text("channel")).otherwise(F.lit("OTHER")))
         .withColumn("away", doc & ~c("way").isin("", "LOCAL"))
         .withColumn("sensitive", doc & c("action").isin(*WRITE_ACTIONS) & E.is_sensitive("target_value", v))
         .withColumn("risky", (search & E.search_risky("target_value", v)))
         .withColumn("tier", text("tier")).withColumn("cls", text("risk_class"))
         .withColumn("channel_bit", choose("way", {n: CHANNEL_BITS[n] for n in DOC_CHANNELS}, 0)))
    outbound = doc & c("action").isin(*OUTBOUND_ACTIONS)
    leaks = c("away") & c("action").isin("UPLOAD", "SEND", "COPY")
    net_send = c("away") & c("action").isin(*SEND_ACTIONS) & ~c("wl_dest")
    site_visit = web & ~c("heartbeat")
    conditions = {
        "off_any": c("off_hours"), "outbound": outbound, "away_doc": c("away") & ~c("noise_doc"),
        "searched": search, "risky_search": c("risky"),
        "forbidden": site_visit & c("tier").isin("high", "job"),
        "mid_off": site_visit & (c("tier") == "mid") & c("off_hours"),
        "keyword_hit": site_visit & E.search_risky(keyword, v),
        "tier_high": c("tier") == "high", "tier_mid": c("tier") == "mid", "tier_job": c("tier") == "job",
        "evidence": c("cls").isin("netdisk", "personal_email", "file_helper")
        | (doc & ~c("wl_dest") & (c("away") | outbound)),
        "wrote": doc & c("action").isin(*WRITE_ACTIONS), "net_send": net_send,
        "rare_send": net_send & F.coalesce(c("dest_class").isin("netdisk", "personal_email"), F.lit(False)),
        "doc_evidence": doc & c("action").isin(*EVIDENCE_DOC_ACTIONS),
    }
    score = F.greatest(
        F.when(leaks, 70).otherwise(0), F.when(c("sensitive"), 60).otherwise(0),
        F.when(c("tier") == "high", F.when(c("off_hours"), 75).otherwise(65))
        .when(c("tier") == "job", F.when(c("off_hours"), 75).otherwise(55))
        .when(c("tier") == "mid", F.when(c("off_hours"), 55).otherwise(35)).otherwise(0),
        F.when(c("risky"), 50).otherwise(0))
    web_bit = F.when(c("tier") == "mid", F.lit(CHANNEL_BITS["remote_control"])).otherwise(
        choose("cls", {n: CHANNEL_BITS[n] for n in ("file_helper", "netdisk", "personal_email")}, 0))
    pair = F.lit(0)
    for i, (action, channel) in enumerate(OUTBOUND_PAIRS):
        here = F.coalesce(F.nullif("way", F.lit("")), F.lit("LOCAL"))
        pair = F.when((c("action") == action) & (here == channel), F.lit(1 << i)).otherwise(pair)
    return (e.withColumn("row_flags", _bits([conditions[f] for f in FLAGS]))
            .withColumn("row_score", score)
            .withColumn("score_bits", F.when(leaks, c("channel_bit")).otherwise(F.lit(0)).bitwiseOR(web_bit))
            .withColumn("out_bits", F.when(doc, pair).otherwise(F.lit(0))))


def session_facts(events: DataFrame, v: Vocabulary = DEFAULT, rules: Rules = Rules()) -> DataFrame:
    """Signals per person, slice and risk-classed site (null for all other rows).

    The one pass over the events: flags and sums are computed per row and
    combined before the shuffle in a hash aggregate over fixed-width buffers.
    Windows, triggers, scores, baselines and day totals all read this table.
    """
    e = row_signals(events, v, rules).withColumn("us", micros("occurred_at"))
    c = F.col
    web = c("category") == "WEB"
    visits = c("count").cast("bigint")
    risky = c("risk_class").isNotNull()
    host = web & (text("domain") != "")
    real = web & (text("site") != "") & ~c("heartbeat") & ~c("telemetry")

    def total(cond: Column, value: Column = F.lit(1).cast("bigint")) -> Column:
        return F.sum(F.when(cond, value).otherwise(F.lit(0).cast("bigint")))

    seconds = slice_seconds(rules.session_gap_seconds)
    return (e.groupBy("employee_id", slice_index("occurred_at", seconds).alias("slice"),
                      F.when(risky, c("site")).alias("risk_site"), "risk_class")
            .agg(F.count("*").alias("n"), F.sum(visits).alias("visits"),
                 F.min("us").alias("lo"), F.max("us").alias("hi"),
                 F.bit_or("row_flags").alias("flags"), F.max("row_score").alias("rule_score"),
                 F.bit_or("channel_bit").alias("row_channels"), F.bit_or("score_bits").alias("score_channels"),
                 F.bit_or("out_bits").alias("out_mask"),
                 total(c("off_hours")).alias("off_rows"), total(real & c("off_hours"), visits).alias("night_visits"),
                 total(host).alias("host_rows"), total(host & c("telemetry")).alias("telemetry_rows")))


def with_window_start(facts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Facts with `window_start`."""
    slices = facts.groupBy("employee_id", "slice").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    starts = session_starts(slices, ["employee_id"], rules.session_gap_seconds)
    return facts.join(starts.select("employee_id", "slice", from_micros("start").alias("window_start")),
                      ["employee_id", "slice"])


def shared_facts(events: DataFrame, v: Vocabulary = DEFAULT, rules: Rules = Rules()) -> DataFrame:
    """Facts with `window_start`, written once to the shared folder.

    Six consumers read them.  Without the cut each would scan and classify the
    events again, because column pruning gives every branch its own shuffle.
    The files also survive the loss of executors.
    """
    return cut_lineage(with_window_start(session_facts(events, v, rules), rules))


def site_counts(prefix: str = "") -> list[Column]:
    """Sums over fact rows that depend on the site only."""
    tier = text(D.risk_tier("risk_class"))
    major = D.is_major_recruitment("risk_site")
    quiet = D.is_heartbeat("risk_site", "risk_class") | D.is_telemetry("risk_site")
    zero = F.lit(0).cast("bigint")
    return [F.sum(F.when(tier == "mid", F.col("n") - F.col("off_rows")).otherwise(zero)).alias(f"{prefix}mid_day_rows"),
            F.sum(F.when((tier == "mid") & ~quiet, F.col("visits")).otherwise(zero)).alias(f"{prefix}mid_visits"),
            F.sum(F.when((tier == "job") & major, F.col("visits")).otherwise(zero)).alias(f"{prefix}job_major"),
            F.sum(F.when((tier == "job") & ~major, F.col("visits")).otherwise(zero)).alias(f"{prefix}job_general")]


def window_features(facts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per window from facts that carry `window_start`."""
    hour = F.pmod(int_div("lo", 3_600_000_000), F.lit(24)).cast("int")
    sums = ["n", "visits", "night_visits", "host_rows", "telemetry_rows"]
    grouped = (facts.groupBy("employee_id", "window_start")
               .agg(F.max("hi").alias("hi"), F.bit_or("flags").alias("flags"),
                    *[F.sum(c).alias(c) for c in sums], *site_counts(),
                    F.max("rule_score").alias("rule_score"),
                    F.bit_or("row_channels").alias("row_channels"),
                    F.bit_or("score_channels").alias("score_channels"),
                    F.min(hour).alias("hour_min"), F.max(hour).alias("hour_max"),
                    F.bit_or(F.call_function("shiftleft", F.lit(1), hour)).alias("hours_mask")))
    rest = [c for c in grouped.columns if c not in ("employee_id", "window_start", "hi", "flags")]
    return grouped.select("employee_id", "window_start", from_micros("hi").alias("window_end"), *rest,
                          *[has_flag(f).alias(f) for f in FLAGS])


def risk_rows(facts: DataFrame) -> DataFrame:
    """Fact rows of a risk-classed site.

    The test reads an aggregated flag, so Spark cannot push it below the
    aggregation and every consumer shares one shuffle of the events.
    """
    mask = sum(1 << FLAGS.index(f) for f in ("tier_high", "tier_mid", "tier_job"))
    return facts.filter(F.col("flags").bitwiseAND(mask) != 0)


def window_sites(facts: DataFrame) -> DataFrame:
    """Risk-classed sites of each window with rows and visits."""
    return (risk_rows(facts)
            .groupBy("employee_id", "window_start", F.col("risk_site").alias("site"), "risk_class")
            .agg(F.sum("n").alias("n_rows"), F.sum("visits").alias("visits"))
            .withColumn("tier", D.risk_tier("risk_class")))


def trigger_keys(facts: DataFrame) -> DataFrame:
    """Keys under which a window is suppressed when judged again.

    One row per key, never an array of unknown size: forbidden and recruitment
    sites, and `doc:<action>:<channel>` of outbound documents.
    """
    sites = (window_sites(facts).filter("tier in ('high', 'job')")
             .select("employee_id", "window_start", F.col("site").alias("trigger_key")))
    docs = (facts.groupBy("employee_id", "window_start").agg(F.bit_or("out_mask").alias("out_mask"))
            .filter("out_mask <> 0")
            .select("employee_id", "window_start", F.explode(F.array_compact(F.array(*[
                F.when(F.col("out_mask").bitwiseAND(1 << i) != 0, F.lit(f"doc:{a}:{c}"))
                for i, (a, c) in enumerate(OUTBOUND_PAIRS)]))).alias("trigger_key")))
    return sites.unionByName(docs)


def mask_names(mask, names: list[str], sep: str = ",") -> Column:
    """Names of the set channel bits, joined in the order of `names`."""
    m = F.col(mask) if isinstance(mask, str) else mask
    return F.concat_ws(sep, *[F.when(m.bitwiseAND(CHANNEL_BITS[n]) != 0, F.lit(n)) for n in names])


def key_components(links: DataFrame) -> DataFrame:
    """(employee_id, window_start, group): windows joined by common keys, directly or over others, share a group.

    `links` is (employee_id, window_start, trigger_key).  Each round a window takes the least group of its keys and a key
    the least group of its windows, and then the group's own group, so rounds grow with the logarithm of a chain.
    """
    links = cut_lineage(links.select("employee_id", "window_start", "trigger_key").distinct())
    who, node = ["employee_id"], ["employee_id", "window_start"]
    groups = cut_lineage(links.select(*node).distinct().withColumn("group", F.col("window_start")))
    while True:
        keys = links.join(groups, node).groupBy(*who, "trigger_key").agg(F.min("group").alias("low"))
        near = links.join(keys, [*who, "trigger_key"]).groupBy(*node).agg(F.min("low").alias("low"))
        jump = groups.select("employee_id", F.col("window_start").alias("low"), F.col("group").alias("far"))
        new = cut_lineage(groups.join(near, node).join(jump, [*who, "low"])
                          .select(*node, F.least("low", "far").alias("group"), (F.least("low", "far") != F.col("group")).alias("moved")))
        groups = new.select(*node, "group")
        if new.filter("moved").isEmpty():
            return groups


def suppress_repeats(keys: DataFrame) -> DataFrame:
    """Windows kept by the greedy pass: drop a window that shares a key with an earlier kept one.

    Input is one row per (employee_id, window_start, trigger_key).  Whether a window falls depends on which earlier ones
    stayed, but only along common keys: windows are grouped by components of shared keys, and each group is passed over
    in order of time by itself.  A person with a third of all rows is as many groups as their keys have components.  A
    key seen in one window cannot drop anything, so only keys shared by windows count; windows without one are kept.
    The pass reads a group row by row and holds its kept keys, not its rows.
    """
    import pandas as pd

    def greedy(parts):
        at = start = None
        seen, mine = set(), []
        out = []

        def close():
            """Decide on the window whose keys have been read."""
            if start is not None:
                if seen.isdisjoint(mine):
                    seen.update(mine)
                else:
                    out.append((at[0], start))

        for pdf in parts:
            for who, group, when, key in zip(pdf["employee_id"], pdf["group"], pdf["window_start"], pdf["trigger_key"]):
                who = None if pd.isna(who) else who
                if (who, group) != at or when != start:
                    close()
                    mine, start = [], when
                    if (who, group) != at:
                        at, seen = (who, group), set()
                mine.append(key)
            if out:
                yield pd.DataFrame(out, columns=["employee_id", "window_start"])
                out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=["employee_id", "window_start"])

    keys = keys.select("employee_id", "window_start", "trigger_key").distinct()
    shared = (keys.groupBy("employee_id", "trigger_key").agg(F.count("*").alias("n")).filter("n > 1")
              .select("employee_id", "trigger_key"))
    linked = cut_lineage(keys.join(shared, ["employee_id", "trigger_key"], "left_semi"))
    grouped = linked.join(key_components(linked), ["employee_id", "window_start"]).select("employee_id", "group", "window_start", "trigger_key")
    dropped = (grouped.repartition("employee_id", "group").sortWithinPartitions("employee_id", "group", "window_start")
               .mapInPandas(greedy, "employee_id string, window_start timestamp_ntz"))
    return (keys.select("employee_id", "window_start").distinct()
            .join(dropped, ["employee_id", "window_start"], "left_anti"))
