"""SparkSession settings the jobs rely on."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Correctness settings; a job must not run without them.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

# Plan settings.  Broadcasts are never hinted: Spark takes a side only when its
# statistics (or AQE's runtime size) stay under autoBroadcastJoinThreshold.
PLAN_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    # HotSpot does not compile methods above 8000 bytes of bytecode.  Stages with
    # the long classification expressions run about twice as fast when Spark
    # splits them into small methods instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app_name: str = "tidewatch", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings above; `conf` overrides any of them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED_CONF, **PLAN_CONF, **STREAM_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime-settable settings to a session somebody else built."""
    tuning = {"spark.sql.codegen.hugeMethodLimit": PLAN_CONF["spark.sql.codegen.hugeMethodLimit"]}
    for key, value in {**REQUIRED_CONF, **STREAM_CONF, **tuning}.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and stream checkpoints.

    The cluster names it in `spark.checkpoint.dir`; only where that is unset
    (tests, a laptop) is a fresh local folder used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir: executors do not share a temporary folder")
        configured = tempfile.mkdtemp(prefix="tidewatch-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python may start in another folder.

    The archive's name is a digest of its content, so a second call adds nothing.
    """
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                entry = zipfile.ZipInfo(os.path.relpath(path, os.path.dirname(root)))
                with open(path, "rb") as f:
                    archive.writestr(entry, f.read())
    name = f"tidewatch-{hashlib.sha256(packed.getvalue()).hexdigest()[:16]}.zip"
    context = spark.sparkContext
    if any(os.path.basename(str(p)) == name for p in context._python_includes):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tidewatch-package-"), name)
    with open(path, "wb") as f:
        f.write(packed.getvalue())
    context.addPyFile(path)


def cut_lineage(df):
    """Write `df` once to the shared folder and return the written table.

    A Parquet table rather than an RDD checkpoint: consumers read only their
    columns, and the optimizer knows the real size when it chooses joins.  The
    files survive the loss of executors; the folder's owner expires them.
    """
    path = os.path.join(checkpoint_dir(df.sparkSession), "tables", uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
