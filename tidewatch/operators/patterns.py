"""Multi-event patterns over document activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import events as E
from ..functions.base import blank_to_null, fmt_ts, text
from ..schema import SEND_ACTIONS
from ..vocab import DEFAULT, Vocabulary

ALERT_COLUMNS = ["employee_id", "scenario", "risk_score", "severity", "dedup_key", "window_start", "summary"]


def recent_docs(events: DataFrame, as_of: str | None, hours: int = 24) -> DataFrame:
    """Endpoint document rows of the scan period; the whole table without `as_of`."""
    docs = events.filter((F.col("category") == "DOC") & (text("source") == "endpoint"))
    return docs if as_of is None else E.since(docs, as_of, hours=hours)


def sends(docs: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """Sends and uploads to destinations that are not whitelisted."""
    return docs.filter(F.col("action").isin(*SEND_ACTIONS) & ~D.is_whitelisted_dest("dest_path", v))


def alert_rows(df: DataFrame, scenario: str, kind: str, score: Column, day: Column, summary: Column) -> DataFrame:
    """Shape detector output as alert rows; the key holds the full date."""
    return (df.withColumn("scenario", F.lit(scenario)).withColumn("risk_score", score.cast("int"))
            .withColumn("severity", E.severity("risk_score"))
            .withColumn("dedup_key", F.concat_ws("|", "employee_id", F.lit(kind), day.cast("string")))
            .withColumn("summary", summary))


def contained_names(needles: DataFrame, hay: DataFrame, key: str = "employee_id") -> DataFrame:
    """(key, needle, name) for each needle that is a substring of a name of the same key.

    `needles` is (key, needle), `hay` is (key, name), both reduced to distinct
    rows here.  Names are cut into their substrings of the needle lengths the key
    uses, and those meet the needles in an equi join: the work grows with the
    names, not with needles × names.
    """
    needles = needles.select(key, "needle").filter("needle <> ''").distinct()
    lengths = needles.groupBy(key).agg(F.collect_set(F.length("needle")).alias("lengths"))
    pieces = (hay.select(key, "name").filter("name <> ''").distinct().join(lengths, key)
              .select(key, "name", F.explode("lengths").alias("l"))
              .filter(F.length("name") >= F.col("l"))
              .select(key, "name", F.explode(F.array_distinct(F.transform(
                  F.sequence(F.lit(1), F.length("name") - F.col("l") + 1),
                  lambda i: F.substring(F.col("name"), i, F.col("l"))))).alias("needle")))
    return pieces.join(needles, [key, "needle"]).select(key, "needle", "name")


def archive_then_send(events: DataFrame, as_of: str | None = None, hours: int = 24, require_order: bool = False,
                      v: Vocabulary = DEFAULT) -> DataFrame:
    """Person-days on which a sent file relates by name to an archive of the same person.

    The plain rule does not compare times; `require_order` asks for an archive
    no later than the send.
    """
    docs = recent_docs(events, as_of, hours).withColumn("name", F.lower(text("target_value")))
    archives = (docs.filter("action = 'ARCHIVE' and name <> ''")
                .groupBy("employee_id", "name").agg(F.min("occurred_at").alias("archived_at")))
    sent = sends(docs, v).filter("name <> ''")
    names = sent.select("employee_id", "name").distinct()
    base = F.regexp_replace("name", r"\.(zip|rar|7z|tar|gz)$", "")

    inside_send = contained_names(archives.select("employee_id", F.col("name").alias("needle")), names)
    forms = names.select("employee_id", F.col("name").alias("sent_name"),
                         F.explode(F.array("name", base)).alias("needle"))
    inside_archive = contained_names(forms, archives).join(forms, ["employee_id", "needle"])
    related = (inside_send.select("employee_id", F.col("name").alias("sent_name"), F.col("needle").alias("archive"))
               .unionByName(inside_archive.select("employee_id", "sent_name", F.col("name").alias("archive"))))
    first = (related.join(archives.withColumnRenamed("name", "archive"), ["employee_id", "archive"])
             .groupBy("employee_id", F.col("sent_name").alias("name"))
             .agg(F.min("archived_at").alias("archived_at")))
    hits = sent.join(first, ["employee_id", "name"])
    if require_order:
        hits = hits.filter(F.col("archived_at") <= F.col("occurred_at"))
    day = E.day("occurred_at")
    picked = (hits.groupBy("employee_id", day.alias("day"))
              .agg(F.min(F.struct("occurred_at", "name", "dest_path")).alias("s"), F.count("*").alias("n_sends"))
              .select("employee_id", "day", "n_sends", F.col("s.occurred_at").alias("window_start"),
                      F.col("s.name").alias("name"), D.dest_root("s.dest_path").alias("dest")))
    return alert_rows(picked, "archive_exfil", "archive_send", F.lit(85), F.col("day"), F.concat(
        "employee_id", F.lit(" packed and sent '"), F.substring("name", 1, 30), F.lit("' to "),
        F.substring("dest", 1, 30), F.lit(" (suspected packing before taking data out)")))


def rename_disguise(events: DataFrame, as_of: str | None = None, hours: int = 24,
                    v: Vocabulary = DEFAULT) -> DataFrame:
    """Renames to a much shorter, meaningless name that a sent file then carries."""
    docs = recent_docs(events, as_of, hours)
    leaf = lambda c: F.lower(F.substring_index(c, "\\", -1))
    renamed = (docs.filter("action = 'RENAME'")
               .withColumn("old", leaf(F.coalesce(blank_to_null("src_path"), text("target_value"))))
               .withColumn("new", leaf(text("dest_path")))
               .filter((F.col("old") != "") & (F.col("new") != "")
                       & (F.length("new") * 2 < F.length("old")) & ~F.col("new").rlike("[一-鿿]")))
    sent = sends(docs, v).withColumn("name", F.lower(text("target_value")))
    first_send = sent.groupBy("employee_id", "name").agg(F.min("occurred_at").alias("sent_at"))
    pairs = contained_names(renamed.select("employee_id", F.col("new").alias("needle")), first_send)
    carried = (pairs.join(first_send, ["employee_id", "name"])
               .groupBy("employee_id", F.col("needle").alias("new")).agg(F.min("sent_at").alias("sent_at")))
    picked = (renamed.join(carried, ["employee_id", "new"])
              .groupBy("employee_id", E.day("occurred_at").alias("day"))
              .agg(F.min(F.struct("occurred_at", "new", "old", "sent_at")).alias("r"))
              .select("employee_id", "day", F.col("r.sent_at").alias("window_start"),
                      F.col("r.old").alias("old"), F.col("r.new").alias("new")))
    return alert_rows(picked, "rename_exfil", "rename_exfil", F.lit(80), F.col("day"), F.concat(
        "employee_id", F.lit(" renamed '"), F.substring("old", 1, 30), F.lit("' to '"), F.substring("new", 1, 20),
        F.lit("' and sent it (suspected disguise)")))


def trend_spike(events: DataFrame, as_of: str, days: int = 7, min_prev: int = 3, factor: int = 3,
                v: Vocabulary = DEFAULT) -> DataFrame:
    """People whose sends of the last period reach `factor` times those of the period before."""
    since, before = E.ago(as_of, days=days), E.ago(as_of, days=2 * days)
    rows = events.filter((text("source") == "endpoint") & F.col("action").isin(*SEND_ACTIONS)
                         & (F.col("occurred_at") >= before) & ~D.is_whitelisted_dest("dest_path", v))
    recent = F.col("occurred_at") >= since
    counts = (rows.groupBy("employee_id").agg(F.count_if(recent).alias("cur"), F.count_if(~recent).alias("prev"))
              .filter((F.col("prev") >= min_prev) & (F.col("cur") >= F.col("prev") * factor))
              .withColumn("window_start", E.ago(as_of)))
    return alert_rows(counts, "trend_spike", "trend_exfil", F.lit(75), E.ago(as_of).cast("date"), F.concat(
        "employee_id", F.lit(" sent "), F.col("cur").cast("string"), F.lit(" files, "),
        F.col("prev").cast("string"), F.lit(" the period before")))


def first_names(df: DataFrame, keys: list[str], name: str, most: int) -> DataFrame:
    """First `most` distinct names per key in alphabetical order, joined by '; '."""
    order = Window.partitionBy(*keys).orderBy(name)
    return (df.select(*keys, name).distinct().withColumn("rn", F.row_number().over(order))
            .filter(F.col("rn") <= most).groupBy(*keys)
            .agg(F.array_join(F.array_sort(F.collect_list(name)), "; ").alias("samples")))


def _scan_groups(docs: DataFrame, by_day: bool) -> tuple[DataFrame, list[str]]:
    """Grouping of a scan: the whole period per person, or each day of a history run."""
    if by_day:
        return docs.withColumn("day", E.day("occurred_at")), ["employee_id", "day"]
    return docs, ["employee_id"]


def mass_delete(events: DataFrame, as_of: str | None = None, hours: int = 24, min_ops: int = 15, min_files: int = 8,
                high_ops: int = 40, by_day: bool = False) -> DataFrame:
    """People who deleted many own files: 70, or 80 from `high_ops` on."""
    docs = recent_docs(events, as_of, hours).filter((F.col("action") == "DELETE") & ~E.is_noise_doc())
    docs, keys = _scan_groups(docs.withColumn("file", F.trim(text("target_value"))), by_day)
    stats = (docs.groupBy(*keys)
             .agg(F.count("*").alias("ops"), F.countDistinct(blank_to_null("file")).alias("files"),
                  F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("window_start"),
                  F.min(F.hour("occurred_at")).alias("hour_from"), F.max(F.hour("occurred_at")).alias("hour_to"))
             .filter((F.col("ops") >= min_ops) & (F.col("files") >= min_files)))
    shown = stats.join(first_names(docs.filter("file <> ''"), keys, "file", 4), keys, "left")
    day = F.col("day") if by_day else F.col("first_at").cast("date")
    return alert_rows(shown, "mass_delete", "mass_delete", F.when(F.col("ops") >= high_ops, 80).otherwise(70), day,
                      F.concat("employee_id", F.lit(" deleted "), F.col("ops").cast("string"), F.lit(" times, "),
                               F.col("files").cast("string"), F.lit(" files, e.g. "), text("samples"),
                               F.lit(" (suspected clean-up, please check)")))


def mass_exfil(events: DataFrame, as_of: str | None = None, hours: int = 24, min_ops: int = 15, min_mb: int = 50,
               by_day: bool = False, v: Vocabulary = DEFAULT) -> DataFrame:
    """People who sent many files or many bytes: 75, or 85 at twice the limits."""
    rows = events.filter(text("source") == "endpoint")
    if as_of is not None:
        rows = E.since(rows, as_of, hours=hours)
    rows, keys = _scan_groups(sends(rows, v), by_day)
    rows = rows.withColumn("label", F.concat(F.substring(text("target_value"), 1, 28), F.lit("→"),
                                             F.substring(D.dest_root("dest_path"), 1, 20)))
    mb = 1_048_576
    stats = (rows.groupBy(*keys)
             .agg(F.count("*").alias("ops"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("bytes"),
                  F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("window_start"))
             .filter((F.col("ops") >= min_ops) | (F.col("bytes") >= min_mb * mb)))
    shown = stats.join(first_names(rows, keys, "label", 5), keys, "left")
    big = (F.col("ops") >= 2 * min_ops) | (F.col("bytes") >= 2 * min_mb * mb)
    day = F.col("day") if by_day else F.col("first_at").cast("date")
    return alert_rows(shown, "mass_exfil", "mass_exfil", F.when(big, 85).otherwise(75), day,
                      F.concat("employee_id", F.lit(" sent "), F.col("ops").cast("string"), F.lit(" files, e.g. "),
                               text("samples"), F.lit(" (suspected bulk transfer)")))


def shared_files(events: DataFrame, as_of: str | None = None, days: int = 7, actions=("SEND", "UPLOAD", "COPY"),
                 min_people: int = 2, skip=None) -> DataFrame:
    """File names handled by several people, most people first."""
    from .. import vocab
    from ..functions.base import starts_with_any
    docs = recent_docs(events, as_of, 24 * days).filter(F.col("action").isin(*actions))
    names = docs.withColumn("file", F.lower(F.trim(text("target_value"))))
    names = names.filter((F.length("file") >= 5) & ~starts_with_any("file", skip or vocab.SHARED_FILE_SKIP_PREFIXES))
    pairs = names.select("file", "employee_id").distinct()
    return pairs.groupBy("file").agg(F.count("*").alias("n_people")).filter(F.col("n_people") >= min_people)


def insert_once(alerts: DataFrame, found: DataFrame, as_of: str) -> DataFrame:
    """Detector rows whose key no alert carries yet, as new alerts."""
    return (found.dropDuplicates(["dedup_key"])
            .join(alerts.select("dedup_key"), "dedup_key", "left_anti")
            .select(*ALERT_COLUMNS)
            .withColumn("status", F.lit("NEW")).withColumn("verdict_id", F.lit(None).cast("string"))
            .withColumn("created_at", E.ago(as_of)))
