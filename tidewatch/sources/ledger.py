"""Tables whose folders are published by a small snapshot: appends and rewritten days become visible at once, or not at all.

A write puts rows under `<table>/tx=<id>/event_date=<day>`.  The snapshot `ledger/version=<n>` lists, for every write, the
days for which it still counts; a rewrite of a day takes that day from all older writes.  Readers open exactly the listed
folders, so a reader that runs during a write sees the state before it, and what a failed job left behind is never read.
There is one writer (the ingest stream).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = "tx string, seq long, days array<date>"


@dataclass
class Snapshot:
    version: int = 0
    writes: dict[str, tuple[int, set[dt.date]]] = field(default_factory=dict)  # tx -> (seq, days it counts for)

    def on(self, days: set[dt.date] | None) -> dict[str, list[dt.date]]:
        """Writes that count for any of `days` (all days if None)."""
        found = {tx: sorted(own if days is None else own & days) for tx, (_, own) in self.writes.items()}
        return {tx: own for tx, own in found.items() if own}


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        where, fs = self._fs(path)
        return fs.exists(where)

    def snapshot(self) -> Snapshot:
        """The newest published state."""
        where, fs = self._fs(f"{self.root}/ledger")
        if not fs.exists(where):
            return Snapshot()
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        versions = sorted(int(n.partition("=")[2]) for n in names if n.startswith("version="))
        if not versions:
            return Snapshot()
        rows = self.spark.read.schema(SNAPSHOT).parquet(f"{self.root}/ledger/version={versions[-1]}").collect()  # one row a write
        return Snapshot(versions[-1], {r["tx"]: (r["seq"], set(r["days"])) for r in rows})

    def publish(self, old: Snapshot, tx: str, days: set[dt.date], rewritten: bool = False) -> None:
        """Make the write `tx` visible; with `rewritten` it replaces all older writes of its days."""
        seq = old.version + 1
        writes = {t: (s, own - days if rewritten else own) for t, (s, own) in old.writes.items() if t != tx}
        writes[tx] = (seq, set(days))
        rows = [(t, s, sorted(own)) for t, (s, own) in writes.items() if own]
        staged = f"{self.root}/ledger/staged-{tx}"
        self.spark.createDataFrame(rows, SNAPSHOT).coalesce(1).write.mode("overwrite").parquet(staged)
        source, fs = self._fs(staged)
        target, _ = self._fs(f"{self.root}/ledger/version={seq}")
        if not fs.rename(source, target):
            raise OSError(f"cannot publish {target}")
        for n in range(max(1, seq - 20), seq - 10):  # readers keep no snapshot for ten writes
            fs.delete(self._fs(f"{self.root}/ledger/version={n}")[0], True)

    def write(self, df: DataFrame, table: str, tx: str, seq: int, ts: str = "occurred_at") -> None:
        """Put rows under a write that `publish` makes visible; a repeated write replaces its own earlier files."""
        (df.withColumn("seq", F.lit(seq).cast("long")).withColumn("event_date", F.col(ts).cast("date")).hint("rebalance", "event_date")
         .write.mode("overwrite").partitionBy("event_date").parquet(f"{self.root}/{table}/tx={tx}"))

    def read(self, table: str, schema: str, state: Snapshot, days: set[dt.date] | None = None) -> DataFrame:
        """Rows of all writes that count, with `seq` and `event_date`."""
        schema = f"{schema}, seq long, tx string, event_date date"
        live = {tx: own for tx, own in state.on(days).items() if self.exists(f"{self.root}/{table}/tx={tx}")}
        if not live:
            return self.spark.createDataFrame([], schema).drop("tx")
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{table}/tx={tx}" for tx in live])
        by_days: dict[tuple, list[str]] = {}
        for tx, own in live.items():
            by_days.setdefault(tuple(own), []).append(tx)
        counts = F.lit(False)
        for own, txs in by_days.items():
            counts = counts | (F.col("tx").isin(txs) & F.col("event_date").isin(list(own)))
        return rows.filter(counts).drop("tx")

    def expire(self, tables: list[str]) -> int:
        """Delete folders of writes that no longer count; run it when no reader is older than the newest snapshot."""
        live, gone = self.snapshot().writes, 0
        for table in tables:
            where, fs = self._fs(f"{self.root}/{table}")
            for status in fs.listStatus(where) if fs.exists(where) else []:
                if status.getPath().getName().removeprefix("tx=") not in live:
                    fs.delete(status.getPath(), True)
                    gone += 1
        return gone
