"""Helpers the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import checkpoint_dir, cut_lineage, prepare, ship_package

# Rows of an Arrow batch: texts can be long, and a batch is held as a whole.
BATCH_ROWS = 256
BATCH_BYTES = 4_000_000  # of a batch on its way to Python: it lies outside the executor's heap


def ready(spark: SparkSession) -> SparkSession:
    """Settings and code the operators need on the executors."""
    prepare(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast to the given types; others (whatever their names) are dropped."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds.items()])


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of a key as text, modulo; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


def held_out(key: Column, modulus: int, rest: int) -> Column:
    """Rows no model learns from; a row without key is not held out."""
    return F.coalesce(remainder(key, modulus) == rest, F.lit(False))


def folder(spark: SparkSession, label: str) -> str:
    """A new folder in the place driver and executors share."""
    return f"{checkpoint_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back, so a lost executor repeats no earlier work."""
    return cut_lineage(df)


def zstd(df: DataFrame, path: str) -> DataFrame:
    """Write a table with zstandard pages and read it back."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty_like(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on through later tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library keeps and trims
        ctypes.CDLL(None).malloc_trim(0)


def batches(items: Iterable, size: int) -> Iterator[list]:
    """Lists of at most `size` items."""
    part: list = []
    for item in items:
        part.append(item)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part
