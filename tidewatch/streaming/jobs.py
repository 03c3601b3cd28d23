"""Streaming versions of fold, de-duplication, sessions, detectors and pairs (keyed state is in `keyed`).

Watermarks need zoned timestamps, so readers cast `occurred_at` to `timestamp`
(session zone UTC) and sinks cast back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import events as E
from ..functions.base import text
from ..schema import SEND_ACTIONS, Rules
from ..vocab import DEFAULT, Vocabulary

LATE = "1 hour"


def read_event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Canonical Parquet events as a stream with a zoned event time."""
    raw = spark.readStream.schema(schema).parquet(path)
    return raw.withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))


def unzoned(df: DataFrame) -> DataFrame:
    """Cast zoned columns back for storage."""
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp"
                       else F.col(f.name) for f in df.schema.fields])


def fold_input(events: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    noise = D.is_noise_web("domain", F.coalesce("url", "target_value")) & D.risk_class("domain", v).isNull()
    return events.filter((F.col("category") == "WEB") & ~noise)


def stream_fold(events: DataFrame, bucket: str = "10 minutes", late: str = "10 minutes",
                v: Vocabulary = DEFAULT) -> DataFrame:
    """Fold visits by event time: a bucket is emitted once, complete, when the watermark passes it."""
    web = fold_input(events, v).withWatermark("occurred_at", late)
    folded = (web.groupBy("employee_id", text("domain").alias("domain"), F.window("occurred_at", bucket).alias("w"))
              .agg(F.count("*").cast("int").alias("count"), F.min("occurred_at").alias("first_at"),
                   F.max("occurred_at").alias("last_at")))
    return folded.select("employee_id", "domain", F.col("w.start").alias("occurred_at"), "count", "first_at", "last_at")


def stream_dedupe(events: DataFrame, late: str = LATE) -> DataFrame:
    return events.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["event_hash"])


def stream_sessions(events: DataFrame, rules: Rules = Rules(), late: str = LATE) -> DataFrame:
    """Closed activity windows; a session still open at the watermark stays in state."""
    gap = f"{rules.session_gap_seconds} seconds"
    return (events.withWatermark("occurred_at", late)
            .groupBy("employee_id", F.session_window("occurred_at", gap).alias("w"))
            .agg(F.count("*").alias("n_events"), F.min("occurred_at").alias("window_start"),
                 F.max("occurred_at").alias("window_end"))
            .select("employee_id", "window_start", "window_end", "n_events"))


def mass_kinds(v: Vocabulary = DEFAULT) -> tuple:
    """(deleted, sent) conditions."""
    doc = (F.col("category") == "DOC") & (text("source") == "endpoint")
    return (doc & (F.col("action") == "DELETE") & ~E.is_noise_doc(),
            doc & F.col("action").isin(*SEND_ACTIONS) & ~D.is_whitelisted_dest("dest_path", v))


def mass_input(events: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    deleted, sent = mass_kinds(v)
    return events.filter(deleted | sent)


def stream_mass_ops(events: DataFrame, span: str = "24 hours", slide: str = "10 minutes", min_delete: int = 15,
                    min_send: int = 15, min_mb: int = 50, late: str = LATE, v: Vocabulary = DEFAULT) -> DataFrame:
    """Deletions and sends per person over a sliding day."""
    deleted, sent = mass_kinds(v)
    # One row per person and slide first; only those are spread over the windows that overlap them.
    steps = (events.filter(deleted | sent).withWatermark("occurred_at", late)
             .groupBy("employee_id", F.window("occurred_at", slide).alias("s"))
             .agg(F.count_if(deleted).alias("d"), F.count_if(sent).alias("k"),
                  F.sum(F.when(sent, F.coalesce("size_bytes", F.lit(0))).otherwise(F.lit(0))).alias("b")))
    counted = (steps.groupBy("employee_id", F.window(F.window_time("s"), span, slide).alias("w"))
               .agg(F.sum("d").alias("deletes"), F.sum("k").alias("sends"), F.sum("b").alias("sent_bytes")))
    hit = ((F.col("deletes") >= min_delete) | (F.col("sends") >= min_send)
           | (F.col("sent_bytes") >= min_mb * 1_048_576))
    return counted.filter(hit).select("employee_id", F.col("w.start").alias("period_start"),
                                      F.col("w.end").alias("period_end"), "deletes", "sends", "sent_bytes")


def split_late(batch: DataFrame, high_mark, late_seconds: int = 3600) -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows of a micro-batch against the newest time seen before it.

    Late rows go to a side table that the daily re-scoring reads.
    """
    if high_mark is None:
        return batch, batch.limit(0)
    limit = F.lit(high_mark).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(late_seconds))
    return batch.filter(F.col("occurred_at") >= limit), batch.filter(F.col("occurred_at") < limit)


# ------------------------------------------------------------------ late rows

def start_split(rows: DataFrame, root: str, late_seconds: int, interval: str = "30 seconds", once: bool = False):
    """Divide a job's input by batch into `root`/ontime, which the job reads, and `root`/late, which `with_late` reads.

    A batch's on-time rows appear by one rename, so the job sees a batch as a whole and its watermark (of the same
    delay, and without a limit of files per trigger) drops none of them.  A replayed batch gives the same files.
    """
    spark = rows.sparkSession

    def split(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        Path = spark._jvm.org.apache.hadoop.fs.Path
        there = Path(f"{root}/ontime/batch={batch_id}")
        fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
        mark = None
        if fs.exists(Path(f"{root}/marks")):
            mark = own.read.parquet(f"{root}/marks").filter(F.col("batch") < batch_id).agg(F.max("mark")).first()[0]
        batch = batch.persist()
        try:
            on_time, late = split_late(batch, mark, late_seconds)
            late.write.mode("overwrite").parquet(f"{root}/late/batch={batch_id}")
            batch.agg(F.max("occurred_at").alias("mark")).write.mode("overwrite").parquet(f"{root}/marks/batch={batch_id}")
            if not fs.exists(there):
                staged = f"{root}/staged/batch={batch_id}"
                on_time.write.mode("overwrite").parquet(staged)
                fs.mkdirs(there.getParent())
                if not fs.rename(Path(staged), there):
                    raise OSError(f"cannot publish {there}")
        finally:
            batch.unpersist()

    return start_ingest(rows, split, f"{root}/split-checkpoint", interval, once)


def read_on_time(spark: SparkSession, root: str, schema) -> DataFrame:
    """The on-time rows of `start_split` as a stream."""
    return spark.readStream.schema(schema).parquet(f"{root}/ontime/batch=*")


def with_late(emitted: DataFrame, job, root: str, late_seconds: int, ends) -> DataFrame:
    """The daily run: what a job emitted, with all rows of people who have late rows computed again from all their input.

    `job` is the stream's function, `ends` the time at which a result row is closed; open ones are left to the stream.
    """
    spark = emitted.sparkSession
    on_time, late = (spark.read.parquet(f"{root}/{part}").drop("batch") for part in ("ontime", "late"))
    people = late.select(F.col("employee_id").alias("_who")).distinct()
    same = F.col("employee_id").eqNullSafe(F.col("_who"))
    mark = on_time.agg(F.max("occurred_at")).first()[0]
    limit = F.lit(mark).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(late_seconds))
    again = unzoned(job(on_time.unionByName(late).join(people, same, "left_semi")).filter(ends <= limit))
    return emitted.join(people, same, "left_anti").unionByName(again.select(*emitted.columns))


# ------------------------------------------------------------------ de-duplication without a horizon

def dedupe_batch(ledger, batch: DataFrame) -> DataFrame:
    """Rows of a batch whose hash was never seen, and a write that remembers their hashes by day.

    A hash holds its time, so only hashes of the batch's own days and time span are compared, however old they are.
    """
    import uuid

    from ..session import cut_lineage
    state = ledger.snapshot()
    rows = cut_lineage(batch.dropDuplicates(["event_hash"]))
    span = rows.agg(F.min("occurred_at").alias("low"), F.max("occurred_at").alias("high")).first()
    if span["low"] is None:
        return rows
    days = {r[0] for r in rows.select(F.col("occurred_at").cast("date")).distinct().collect()}  # calendar days of a batch
    seen = ledger.read("hashes", "event_hash string, occurred_at timestamp_ntz", state, days)
    seen = seen.filter(F.col("occurred_at").between(F.lit(span["low"]), F.lit(span["high"]))).select("event_hash")
    fresh = cut_lineage(rows.join(seen, "event_hash", "left_anti"))
    days = {r[0] for r in fresh.select(F.col("occurred_at").cast("date")).distinct().collect()}
    if days:
        tx = uuid.uuid4().hex
        ledger.write(fresh.select("event_hash", "occurred_at"), "hashes", tx, state.version + 1)
        ledger.publish(state, tx, days)
    return fresh


def compact_hashes(ledger) -> None:
    """One write for days that several batches hold."""
    import uuid
    state = ledger.snapshot()
    held = [d for _, own in state.writes.values() for d in own]
    several = {d for d in held if held.count(d) > 1}
    if several:
        tx = uuid.uuid4().hex
        ledger.write(ledger.read("hashes", "event_hash string, occurred_at timestamp_ntz", state, several).drop("seq", "event_date"), "hashes", tx, state.version + 1)
        ledger.publish(state, tx, several, rewritten=True)


# ------------------------------------------------------------------ pairs of events

GRAM = 3


def _grams(name: Column) -> Column:
    """Distinct substrings of one to GRAM characters."""
    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1))), lambda i: F.substring(name, i, n))

    return F.array_distinct(F.concat(*[of(n) for n in range(1, GRAM + 1)]))


def _tagged(tag: str, names: Column) -> Column:
    return F.transform(names, lambda x: F.concat(F.lit(tag), x))


def stream_pairs(events: DataFrame, hours: int = 24, late: str = LATE, v: Vocabulary = DEFAULT) -> DataFrame:
    """Archives and renames with the sends of the same person that they may have prepared, within `hours` of each other.

    Both sides are streams.  A name that lies inside another one shares its first GRAM characters with it, so the sides
    meet in an equi join on person and gram, and the names are compared there.  A pair may come several times, once per
    gram it shares; `archive_pairs` and `rename_pairs` reduce that.
    """
    from ..operators import patterns as X
    head = lambda c: F.substring(c, 1, GRAM)
    docs = X.recent_docs(events, None).withWatermark("occurred_at", late)
    name = F.lower(text("target_value"))
    leaf = lambda c: F.lower(F.substring_index(c, "\\", -1))
    old = leaf(F.coalesce(F.nullif(F.col("src_path"), F.lit("")), text("target_value")))
    short = leaf(text("dest_path"))
    disguise = (F.col("action") == "RENAME") & (old != "") & (short != "") & (F.length(short) * 2 < F.length(old)) & ~short.rlike("[一-鿿]")
    archive = (F.col("action") == "ARCHIVE") & (name != "")
    made = docs.filter(archive | disguise).select(
        F.col("employee_id").alias("who"), F.col("event_hash").alias("made_id"), F.col("occurred_at").alias("made_at"), F.when(archive, "archive").otherwise("rename").alias("kind"),
        F.when(archive, name).otherwise(short).alias("made_name"), F.when(archive, F.lit(None).cast("string")).otherwise(old).alias("old"))
    inside = F.array(F.concat(F.lit(">"), head("made_name")))
    made = made.withColumn("gram", F.explode(F.when(F.col("kind") == "archive", F.concat(inside, _tagged("<", _grams(F.col("made_name"))))).otherwise(inside)))

    base = F.regexp_replace("name", r"\.(zip|rar|7z|tar|gz)$", "")
    sent = X.sends(docs, v).withColumn("name", name).filter("name <> ''").select(
        "employee_id", F.col("event_hash").alias("sent_id"), F.col("occurred_at").alias("sent_at"), "name", "dest_path", base.alias("base"))
    sent = sent.withColumn("sent_gram", F.explode(F.array_distinct(F.concat(
        _tagged(">", _grams(F.col("name"))), F.array(F.concat(F.lit("<"), head("name")), F.concat(F.lit("<"), head("base")))))))
    span = F.make_dt_interval(hours=F.lit(hours))
    related = F.contains("name", "made_name") | ((F.col("kind") == "archive") & (F.contains("made_name", "name") | ((F.col("base") != "") & F.contains("made_name", "base"))))
    joined = made.join(sent, (F.col("who") == F.col("employee_id")) & (F.col("gram") == F.col("sent_gram"))
                       & (F.col("sent_at") >= F.col("made_at") - span) & (F.col("sent_at") <= F.col("made_at") + span) & related)
    return joined.select("employee_id", "kind", "made_id", "made_at", "made_name", "old", "sent_id", "sent_at", F.col("name").alias("sent_name"), "dest_path")


def archive_pairs(pairs: DataFrame) -> DataFrame:
    """Person-days with sends of archived names (see `patterns.archive_then_send`)."""
    sends = pairs.filter("kind = 'archive'").groupBy("employee_id", "sent_id").agg(F.min(F.struct("sent_at", "sent_name", "dest_path")).alias("s"))
    return (sends.groupBy("employee_id", F.col("s.sent_at").cast("date").alias("day"))
            .agg(F.min("s.sent_at").alias("window_start"), F.count("*").alias("n_sends"))
            .withColumn("dedup_key", F.concat_ws("|", "employee_id", F.lit("archive_send"), F.col("day").cast("string"))))


def rename_pairs(pairs: DataFrame) -> DataFrame:
    """Person-days with renames that a sent file carries (see `patterns.rename_disguise`)."""
    renames = pairs.filter("kind = 'rename'").groupBy("employee_id", "made_id", "made_at", "made_name", "old").agg(F.min("sent_at").alias("sent_at"))
    first = F.min(F.struct("made_at", F.col("made_name").alias("new"), "old", "sent_at")).alias("r")
    return (renames.groupBy("employee_id", F.col("made_at").cast("date").alias("day")).agg(first)
            .select("employee_id", F.concat_ws("|", "employee_id", F.lit("rename_exfil"), F.col("day").cast("string")).alias("dedup_key"),
                    F.col("r.sent_at").alias("window_start"), F.col("r.old").alias("old"), F.col("r.new").alias("new")))


# ------------------------------------------------------------------ silence of feeds by the clock

def heartbeat_processor(silence_ms: int):
    """Emits an alarm row when a feed has been silent longer than the limit, by the clock of the job."""
    from pyspark.sql.streaming import StatefulProcessor

    class FeedHeartbeat(StatefulProcessor):
        def init(self, handle):
            self._handle = handle
            self._last = handle.getValueState("last", "at_ms bigint")

        def handleInputRows(self, key, rows, timerValues):
            now = timerValues.getCurrentProcessingTimeInMs()
            for _ in rows:
                pass
            for timer in self._handle.listTimers():
                self._handle.deleteTimer(timer)
            self._last.update((now,))
            self._handle.registerTimer(now + silence_ms)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd
            yield pd.DataFrame({"feed": [key[0]], "last_at_ms": [self._last.get()[0]], "alarm_at_ms": [expiredTimerInfo.getExpiryTimeInMs()]})

        def close(self):
            pass

    return FeedHeartbeat()


def stream_heartbeat(messages: DataFrame, silence_seconds: int = 7200) -> DataFrame:
    """Silence alarms per feed by the job's clock, which also runs when all feeds are silent (see `keyed.stream_silence`).

    There are only a few feeds, so each task first reduces its messages to one row per feed and batch; a busy feed does
    not send its rows to one task.
    """
    def latest(batches):
        for pdf in batches:
            yield pdf.groupby("feed", as_index=False)["received_at"].max()

    reduced = messages.select("feed", "received_at").mapInPandas(latest, "feed string, received_at timestamp")
    return (reduced.groupBy("feed")
            .transformWithStateInPandas(heartbeat_processor(silence_seconds * 1000), "feed string, last_at_ms bigint, alarm_at_ms bigint", "update", "processingTime"))


def feed_silence(raw: DataFrame, as_of: str, hours: int = 2, from_hour: int = 9, until_hour: int = 20) -> DataFrame:
    """Batch form: minutes since the last message of each feed and whether that is an alarm."""
    from ..functions.base import micros, ntz
    now = ntz(as_of)
    quiet = (F.unix_micros(now.cast("timestamp")) - micros("last_at"))
    on_duty = (F.hour(now) >= from_hour) & (F.hour(now) < until_hour)
    return (raw.filter(F.col("received_at") <= now).groupBy("feed").agg(F.max("received_at").alias("last_at"))
            .withColumn("alarm", on_duty & (quiet > hours * 3_600_000_000)))


# ------------------------------------------------------------------ micro-batch ingest

def start_ingest(messages: DataFrame, store, checkpoint: str, interval: str = "30 seconds", once: bool = False):
    """Run `store(batch, batch_id)` on every micro-batch of raw messages.

    The checkpoint replaces a stored watermark: after a restart Spark replays the
    unfinished batch under the same id.
    """
    writer = messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()
