"""Streaming jobs run to the end of the given data; their SQL states what must have been emitted."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.events import event_hash
from ..schema import Rules
from ..session import checkpoint_dir
from ..streaming import jobs as J
from ..streaming import keyed as K
from ..streaming.jobs import unzoned
from . import detect_queries  # noqa: F401  (its SQL is read below)
from .base import *


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of canonical rows."""
    schema = read_table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    sql = canonical_sql("spark", "{events}")
    rows = spark.sql(sql, events=raw).withColumn("event_hash", event_hash())
    return rows.withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))


def run_to_end(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream until its input is used up and return what it wrote."""
    spark = df.sparkSession
    root = os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")
    query = (J.unzoned(df).writeStream.outputMode(mode).format("parquet").option("path", f"{root}/out")
             .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out")


def run_whole(source, deliveries: list, name: str, select, job, late_seconds: int, ends) -> DataFrame:
    """Run a job after each delivery to its source, then the daily run over late rows: nothing of the input is lost.

    `source` gives the stream, `select` the rows of it that the job counts.
    """
    root = ""
    for deliver in deliveries:
        deliver()
        rows = select(source())
        spark = rows.sparkSession
        root = root or os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")
        J.start_split(rows, root, late_seconds, once=True).awaitTermination()
        query = (J.unzoned(job(J.read_on_time(spark, root, rows.schema))).writeStream.outputMode("append").format("parquet")
                 .option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
    return J.with_late(spark.read.parquet(f"{root}/out"), job, root, late_seconds, ends)


def at_once(spark: SparkSession, sf: str) -> tuple:
    """(source, deliveries) of the events table as it stands."""
    return lambda: event_stream(spark, sf), [lambda: None]


def in_parts(parts: list[DataFrame]) -> tuple:
    """(source, deliveries) of canonical rows that arrive part by part."""
    spark = parts[0].sparkSession
    inbox = os.path.join(checkpoint_dir(spark), "streams", f"inbox-{uuid.uuid4().hex}")
    return (lambda: J.read_event_stream(spark, inbox, parts[0].schema),
            [lambda p=p: p.write.mode("append").parquet(inbox) for p in parts])


def newest_first(spark: SparkSession, sf: str) -> tuple:
    """The later events, then, behind every watermark, the earlier ones."""
    e = ev(spark, sf)
    return in_parts([e.filter("occurred_at >= timestamp_ntz '2024-01-15'"), e.filter("occurred_at < timestamp_ntz '2024-01-15'")])


@register("t02_stream_fold", with_("canon", "").rstrip() + f""", web as (select * from canon where category = 'WEB' and not {sql_contains('lower(domain)', vocab.NOISE_HINTS)})
 select employee_id, domain, time_bucket(interval 10 minute, occurred_at) as occurred_at, count(*)::int as n from web group by 1, 2, 3
 having time_bucket(interval 10 minute, occurred_at) + interval 10 minute <= (select max(occurred_at) from web) - interval 10 minute""")
def t02(spark, sf):
    return fold_whole(*at_once(spark, sf))


def fold_whole(source, deliveries: list) -> DataFrame:
    ends = F.col("occurred_at") + F.expr("interval 10 minutes")
    return run_whole(source, deliveries, "fold", J.fold_input, J.stream_fold, 600, ends).select(
        "employee_id", "domain", "occurred_at", F.col("count").alias("n"))


@register("t03_stream_dedupe", with_("canon", "select event_id, event_hash from canon"))
def t03(spark, sf):
    e = event_stream(spark, sf)
    return run_to_end(J.stream_dedupe(e.unionByName(event_stream(spark, sf))), "dedupe").select("event_id", "event_hash")


@register("t04_stream_sessions", with_("win", """select employee_id, window_start, max(occurred_at) as window_end, count(*) as n_events from win group by 1, 2
 having max(occurred_at) + interval 60 minute <= (select max(occurred_at) from win) - interval 60 minute"""))
def t04(spark, sf):
    return sessions_whole(*at_once(spark, sf))


def sessions_whole(source, deliveries: list) -> DataFrame:
    ends = F.col("window_end") + F.make_dt_interval(secs=F.lit(Rules().session_gap_seconds))
    return run_whole(source, deliveries, "sessions", lambda e: e, J.stream_sessions, 3600, ends)


@register("t05_stream_mass_ops", with_("cls", "").rstrip() + """, r as (select *, action = 'DELETE' and not noise_doc as del, action in ('SEND','UPLOAD') and not wl as snd from cls where category = 'DOC' and source = 'endpoint'),
 k as (select * from r where del or snd), slots as (select unnest(generate_series(0, 23)) as i),
 x as (select employee_id, time_bucket(interval 1 hour, occurred_at) - to_hours(i::int) as p, del, snd, size_bytes from k, slots)
 select employee_id, p as period_start, p + interval 24 hour as period_end, count(*) filter (del) as deletes, count(*) filter (snd) as sends, coalesce(sum(size_bytes) filter (snd), 0)::bigint as sent_bytes from x group by 1, 2
 having (count(*) filter (del) >= 2 or count(*) filter (snd) >= 2) and p + interval 24 hour <= (select max(occurred_at) from k) - interval 60 minute""")
def t05(spark, sf):
    return mass_ops_whole(*at_once(spark, sf))


def mass_ops_whole(source, deliveries: list) -> DataFrame:
    job = lambda e: J.stream_mass_ops(e, slide="1 hour", min_delete=2, min_send=2, min_mb=1_000_000)
    return run_whole(source, deliveries, "massops", J.mass_input, job, 3600, F.col("period_end"))


@register("t11_late_fold", ORACLES["t02_stream_fold"])
def t11(spark, sf):
    return fold_whole(*newest_first(spark, sf))


@register("t12_late_sessions", ORACLES["t04_stream_sessions"])
def t12(spark, sf):
    return sessions_whole(*newest_first(spark, sf))


@register("t13_late_mass_ops", ORACLES["t05_stream_mass_ops"])
def t13(spark, sf):
    return mass_ops_whole(*newest_first(spark, sf))


FLUSH = "2024-05-01 00:00:00"  # time of a last row that carries the watermark past all others


def shuffled(events: DataFrame, name: str, flush: DataFrame) -> tuple:
    """(source, deliveries): rows in three deliveries without regard to time, then a row that ends the stream."""
    place = F.pmod(F.xxhash64(name), F.lit(3))
    return in_parts([*[events.filter(place == k) for k in (1, 0, 2)], flush.select(*events.columns)])


def run_deliveries(source, deliveries: list, name: str, job) -> DataFrame:
    """Run a stream after each delivery and return all it wrote."""
    out = root = None
    for deliver in deliveries:
        deliver()
        df = job(source())
        spark = df.sparkSession
        root = root or os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")
        (J.unzoned(df).writeStream.outputMode("append").format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination())
        out = spark.read.parquet(f"{root}/out")
    return out


def last_row(events: DataFrame, **fields) -> DataFrame:
    """One row of the same columns at the end of time."""
    spark = events.sparkSession
    own = {"occurred_at": F.lit(FLUSH).cast("timestamp_ntz"), **{k: F.lit(x) for k, x in fields.items()}}
    return spark.range(1).select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields])


LATE_ALL = "70 days"


@register("t07_stream_identity", with_("canon", """select event_id, last_value(acct ignore nulls) over (partition by device_id order by occurred_at, event_id rows unbounded preceding) as account from
 (select *, nullif(regexp_extract(coalesce(src_path, ''), '[Uu]sers[\\\\/]+([^\\\\/]+)[\\\\/]', 1), '') as acct from canon where source = 'endpoint')"""))
def t07(spark, sf):
    """Rows arrive in three shuffled deliveries; each is stamped in the order of time."""
    from ..functions.parsing import account_from_path
    e = ev(spark, sf).filter("source = 'endpoint'").withColumn("account", account_from_path("src_path", "dest_path")).select("event_id", "occurred_at", "device_id", "account")
    found = run_deliveries(*shuffled(e, "event_id", last_row(e, event_id=-1, device_id="end")), "identity", lambda rows: K.stream_asof(rows, "device_id", "account", LATE_ALL))
    return found.filter("id >= 0").select(F.col("id").alias("event_id"), "account")


@register("t07_stream_person", with_("canon", """, k as (select event_id, occurred_at, device_id as a, case when user_no % 3 = 0 then '' else 'n' || user_no end as u,
  case when event_id % 11 = 0 then 'acc' || user_no end as hint from (select *, cast(substr(employee_id, 2) as int) % 40 as user_no from canon where source = 'endpoint')),
 m as (select *, hint as acct from k),
 w as (select *, last_value(acct ignore nulls) over (partition by a order by occurred_at, event_id rows unbounded preceding) as by_agent,
   case when u <> '' then last_value(acct ignore nulls) over (partition by u order by occurred_at, event_id rows unbounded preceding) else acct end as by_user from m)
 select event_id, coalesce(acct, by_agent, by_user, 'AGENT:' || a) as employee_id from w"""))
def t07_person(spark, sf):
    """Person per row from two maps (machine, user id), each kept by its own stream."""
    e = ev(spark, sf).filter("source = 'endpoint'")
    number = F.expr("cast(substr(employee_id, 2) as int) % 40")
    e = e.select("event_id", "occurred_at", F.col("device_id").alias("agent_id"), F.when(number % 3 == 0, "").otherwise(F.concat(F.lit("n"), number.cast("string"))).alias("user_no"),
                 F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("acc"), number.cast("string"))).alias("account_hint"))
    rows = K.hinted(e)
    end = last_row(rows, event_id=-1, agent_key="end", user_key="end")
    maps = [run_deliveries(*shuffled(rows, "event_id", end), name, lambda r, name=name: K.stream_mapped(r, name, "hint", LATE_ALL)) for name in ("agent_key", "user_key")]
    return K.resolved(rows, *maps).select("event_id", "employee_id")


@register("t03_late_duplicates", with_("canon", "select event_id, event_hash from canon qualify row_number() over (partition by event_hash order by event_id) = 1"))
def t03_late(spark, sf):
    """Every row comes again, most of them days later and mixed with new ones."""
    from ..sources.ledger import Ledger
    e = ev(spark, sf).groupBy("event_hash").agg(F.min(F.struct("event_id", "occurred_at")).alias("e")).select("e.*", "event_hash")
    half = F.col("occurred_at") < F.lit("2024-01-15").cast("timestamp_ntz")
    source, deliveries = in_parts([e.filter(half), e.unionByName(e.filter(F.col("event_id") % 2 == 0)), e.filter(half)])
    root = os.path.join(checkpoint_dir(spark), "streams", f"dedupe-{uuid.uuid4().hex}")
    ledger = Ledger(spark, root)

    def keep(batch: DataFrame, batch_id: int) -> None:
        J.dedupe_batch(ledger, J.unzoned(batch)).write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")
        J.compact_hashes(ledger)

    for deliver in deliveries:
        deliver()
        J.start_ingest(source(), keep, f"{root}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_id", "event_hash")


PAIR_SQL = ORACLES["d03_archive_then_send"], ORACLES["d04_rename_disguise"]


@register("t05_stream_archives", f"select employee_id, dedup_key, window_start, n_sends from ({PAIR_SQL[0]})")
def t05_archives(spark, sf):
    return J.archive_pairs(pairs_whole(*newest_first(spark, sf)))\
        .select("employee_id", "dedup_key", "window_start", "n_sends")


@register("t05_stream_renames", f"select employee_id, dedup_key, window_start, old, new from ({PAIR_SQL[1]})")
def t05_renames(spark, sf):
    return J.rename_pairs(pairs_whole(*newest_first(spark, sf)))


def pairs_whole(source, deliveries: list, hours: int = 24 * 40) -> DataFrame:
    """Stream-stream join with late halves; the given period is within `hours`, so all its pairs count."""
    job = lambda e: J.stream_pairs(e, hours)
    select = lambda e: e.filter((F.col("category") == "DOC") & (F.col("source") == "endpoint"))
    return run_whole(source, deliveries, "pairs", select, job, 3600, F.lit("1970-01-01").cast("timestamp"))


MARKED = "timestamp '2024-01-20 00:00:00'"


@register("t08_stream_alerts", with_("verdicts exempt", "").rstrip() + f""", hit as (select v.employee_id || '|' || v.intent as dedup_key, v.* from verdicts v where v.risk_score >= 30
  and not exists (select 1 from exempt x where x.employee_id = v.employee_id and x.signal_type = v.intent and (x.expires_at is null or x.expires_at > v.window_end))),
 g as (select dedup_key, any_value(employee_id) as employee_id, any_value(intent) as scenario, arg_max(risk_score, (window_start, verdict_id)) as risk_score, arg_max(verdict_id, (window_start, verdict_id)) as verdict_id,
   max(window_start) as window_start, min(window_end) as created_at, max(window_end) as hit_at from hit group by 1),
 l as (select *, case when right(employee_id, 1) in ('1', '2') and created_at <= {MARKED} and hit_at <= {MARKED} then case right(employee_id, 1) when '1' then 'CONFIRMED' else 'FP' end else 'NEW' end as st from g)
 select dedup_key, employee_id, scenario, risk_score, verdict_id, window_start, created_at,
  case when st = 'NEW' and scenario = 'baseline_deviation' and (risk_score < 50 or (risk_score <= 65 and created_at + interval 3 day < timestamp '2024-01-31 00:00:00')) then 'CLOSED' else st end as status from l""")
def t08(spark, sf):
    """Verdicts, feedback and exemptions reach the alert stream in three deliveries without order."""
    verdicts = verdict_frames(spark, sf)[2]
    ex = exemptions(spark).withColumn("valid_from", F.lit("2000-01-01").cast("timestamp_ntz"))
    key = F.col("dedup_key")
    label = F.when(F.substring_index(key, "|", 1).endswith("1"), "TP").when(F.substring_index(key, "|", 1).endswith("2"), "FP").otherwise("X")
    changes = K.verdict_changes(verdicts, Rules(alert_score=30))
    feedback = changes.select("dedup_key").distinct().select("dedup_key", label.alias("label"), F.lit("2024-01-20").cast("timestamp_ntz").alias("created_at"))
    changes = unzoned(changes.unionByName(K.feedback_changes(feedback)).unionByName(K.exemption_changes(ex)))
    # The watermark ends at midnight of the 31st.
    end = last_row(changes, dedup_key="end|x", kind="feedback", at=0, score=0, start=-1, expires=-1).withColumn("occurred_at", F.lit("2024-02-10").cast("timestamp_ntz") + F.expr("interval 9000 days"))
    found = run_deliveries(*shuffled(changes, "id", end), "alerts", lambda rows: K.stream_alerts(rows, late="9010 days"))
    return K.alert_snapshot(found).select("dedup_key", "employee_id", "scenario", "risk_score", "verdict_id", "window_start", "created_at", "status")


@register("t09_stream_silence", with_("canon", """, m as (select employee_id as feed, occurred_at as last, coalesce(lead(occurred_at) over (partition by employee_id order by occurred_at), timestamp '2024-02-02 00:00:00') as nxt from canon),
 c as (select feed, last, nxt, unnest(generate_series(date_trunc('day', last + interval 2 hour), nxt, interval 1 day)) as d from m where nxt > last + interval 2 hour),
 a as (select feed, last, d, greatest(last + interval 2 hour, d + interval 9 hour) as alarm, nxt from c)
 select feed, last as last_at, alarm as alarm_at from a where alarm < least(nxt, d + interval 20 hour) qualify row_number() over (partition by feed, d order by alarm) = 1"""))
def t09(spark, sf):
    """Silence of each person's feed in duty hours, once a day; messages come in shuffled deliveries."""
    from ..functions.base import from_micros
    e = ev(spark, sf).select("event_id", "occurred_at", F.col("employee_id").alias("feed"))
    end = last_row(e, event_id=-1, feed="end").withColumn("occurred_at", F.lit("2024-04-12 00:10:00").cast("timestamp_ntz"))
    found = run_deliveries(*shuffled(e, "event_id", end), "silence", lambda rows: K.stream_silence(rows.withColumnRenamed("occurred_at", "received_at"), late="70 days 10 minutes"))
    return found.filter("feed <> 'end'").select("feed", from_micros("last_us").alias("last_at"), from_micros("alarm_us").alias("alarm_at"))


@register("d20_feed_silence", with_("canon", """select source as feed, max(occurred_at) as last_at, epoch_us(timestamp '2024-01-30 12:00:00') - epoch_us(max(occurred_at)) > 600000000 * 0 + 2 * 3600000000 as alarm from canon where occurred_at <= timestamp '2024-01-30 12:00:00' group by 1"""))
def d20(spark, sf):
    raw = ev(spark, sf).select(F.col("source").alias("feed"), F.col("occurred_at").alias("received_at"))
    return J.feed_silence(raw, "2024-01-30 12:00:00")


@register("t10_split_late", with_("canon", "select occurred_at < timestamp '2024-01-20' - interval 1 hour as late, count(*) as n from canon group by 1"))
def t10(spark, sf):
    on_time, late = J.split_late(ev(spark, sf), "2024-01-20 00:00:00")
    both = on_time.select(F.lit(False).alias("late")).unionByName(late.select(F.lit(True).alias("late")))
    return both.groupBy("late").agg(F.count("*").alias("n"))
