"""Line removal across documents with levelled sorted runs of line hashes.

State is a set of immutable runs, each sorted and bucketed by line hash: (h1, h2, n_docs, keeper).  Documents arrive in
batches of descending id.  The lines of a batch are merge-anti-joined with the runs: a line no run holds has its keeper
(largest document) in this batch, any other line already has one in an earlier batch.  The batch then adds its own run.
When a level holds `fanout` runs they are compacted into one run of the next level.

Buckets are the same for all runs, so neither the anti-joins nor the compactions shuffle the runs.

Defined cases: null or empty text is one empty line (and stays as it is); a text that loses all lines becomes empty; rows that share a
document id count as one document; a row with null id keeps all its lines and counts for none; other columns pass
through `drop_lines` untouched; repeated lines of one document count once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import folder, pick, stored

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "h1 long, h2 long, n_docs long, keeper long"


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANK)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashes(key: Column) -> tuple[Column, Column]:
    """128 bits of a line key; the second half is seeded by the literal, so it does not follow from the first."""
    return F.xxhash64(key), F.xxhash64(F.lit("line"), key)


class LineRuns:
    """The runs of all batches so far."""

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path, self.levels, self.tables = folder(spark, "line-runs"), [[]], []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, "h1").write.bucketBy(self.buckets, "h1").sortBy("h1", "h2")
         .option("path", f"{self.path}/{name}").saveAsTable(name))
        self.tables.append(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """`batch`: (h1, h2, doc_id), one row per line and document; all its ids are below those of earlier batches."""
        own = batch.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("largest"))
        own = self.spark.table(self._write(own))
        fresh = own
        for run in self.runs():
            fresh = fresh.join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
        fresh = fresh.select("h1", "h2", "n_docs", F.col("largest").alias("keeper"))
        if self.runs():
            seen = own.join(fresh.select("h1", "h2"), ["h1", "h2"], "left_anti")
            fresh = fresh.unionByName(seen.select("h1", "h2", "n_docs", F.lit(None).cast("long").alias("keeper")))
        self.levels[0].append(self._write(fresh))
        self.compact()

    def compact(self) -> None:
        """Merge full levels upwards."""
        for at, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].append(self._write(self._merged(level)))
                self.levels[at] = []

    def _merged(self, names: list[str]) -> DataFrame:
        """Outer merge joins: runs are sorted and bucketed alike, so each step reads two runs side by side."""
        rows = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).select("h1", "h2", F.col("n_docs").alias("more"), F.col("keeper").alias("other"))
            rows = rows.join(other, ["h1", "h2"], "full_outer").select(
                "h1", "h2", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"),
                F.greatest("keeper", "other").alias("keeper"))
        return rows

    def view(self) -> DataFrame:
        """One row per line: in how many documents it is, and which of them keeps it."""
        names = [name for level in self.levels for name in level]
        return stored(self._merged(names))

    def forget(self) -> None:
        """Drop the catalog entries; the files stay in the shared folder until its owner expires them."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def line_state(docs: DataFrame, n_batches: int = 3, min_chars: int = 20, fanout: int = 2) -> tuple[DataFrame, DataFrame]:
    """(lines: h1, h2, doc_id; state: h1, h2, n_docs, keeper) of documents taken in `n_batches` batches."""
    spark = docs.sparkSession
    key = line_key(F.col("line"))
    h1, h2 = hashes(F.col("key"))
    lines = stored(docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(lines_of(F.col("text"))).alias("line"))
                   .select("doc_id", key.alias("key")).where(F.char_length("key") >= min_chars)
                   .select(h1.alias("h1"), h2.alias("h2"), "doc_id").distinct())
    cuts = [i / n_batches for i in range(1, n_batches)]
    bounds = lines.agg(F.percentile_approx("doc_id", F.array(*[F.lit(c) for c in cuts]), 10000)).first()[0] if cuts else []
    runs = LineRuns(spark, fanout)
    for low, high in reversed(list(zip([None, *(bounds or [])], [*(bounds or []), None]))):
        part = lines
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        runs.add(part)
    state = runs.view()
    runs.forget()
    return lines, state


def drop_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, n_batches: int = 3) -> DataFrame:
    """`docs` with the cleaned `text`, and n_lines, n_dropped.

    Lines whose key has at least `min_chars` code points and is in at least `min_docs` documents stay only in the
    largest document id holding them.
    """
    lines, state = line_state(pick(docs, doc_id="long", text="string"), n_batches, min_chars)
    common = state.where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper")
    # A line of a third of all documents is one row here and many on the other side, which AQE may split.
    gone = (lines.join(common, ["h1", "h2"]).where(F.col("doc_id") < F.col("keeper"))
            .groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("gone")))
    own = docs.withColumn("_id", F.col("doc_id").cast("long"))
    gone = gone.withColumnRenamed("doc_id", "_id")
    all_lines = lines_of(F.col("text").cast("string"))

    def stays(line):
        key = line_key(line)
        h1, h2 = hashes(key)
        return (F.char_length(key) < min_chars) | ~F.array_contains(F.col("gone"), F.struct(h1.alias("h1"), h2.alias("h2")))

    kept = F.when(F.col("gone").isNull(), all_lines).otherwise(F.filter(all_lines, stays))
    out = own.join(gone, "_id", "left").withColumn("_kept", kept)
    out = (out.withColumn("n_lines", F.size(all_lines).cast("long"))
           .withColumn("n_dropped", (F.size(all_lines) - F.size("_kept")).cast("long"))
           .withColumn("text", F.when(F.col("n_dropped") > 0, F.array_join("_kept", "\n")).otherwise(F.col("text").cast("string"))))
    return out.select(*docs.columns, "n_lines", "n_dropped")


def line_digests(docs: DataFrame) -> DataFrame:
    out = drop_lines(pick(docs, doc_id="long", text="string"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))
