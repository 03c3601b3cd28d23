"""Approximate nearest neighbours by an adaptive dimension scan over inverted lists.

Unit vectors are rotated by a random orthogonal matrix and dealt to the lists of a k-means model.  A list is scanned in
blocks of columns: after each block a hypothesis test compares the distance so far, scaled to all columns, with the
distance to beat, and drops candidates that are almost surely worse.  The first distance to beat comes from the model's
sample.  What survives is scored by the cosine of the original vectors in double precision.

The model is fitted on at most `sample_rows` vectors (and `sample_bytes`); every vector is indexed.  Copies of a vector
share one query, and of each distinct vector only the `k` + 1 smallest ids can be among anyone's `k` nearest, so groups
of copies stay small without loss.  Lists are cut into blocks of candidates and chunks of queries of bounded size.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors whose
length is not the table's most frequent one; rows that share an id are one vector (the smallest); a null id takes no
part; with fewer candidates than `k` all found are returned; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stored


class Model:
    def __init__(self, sample: np.ndarray, lists: int, seed: int = 5, rounds: int = 12):
        """`sample`: unit vectors, one per row."""
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        x = sample @ self.rotation
        centres = x[rng.permutation(len(x))[:lists]]
        for _ in range(rounds):
            own = (x @ centres.T).argmax(axis=1)
            total = np.zeros_like(centres)
            np.add.at(total, own, x)
            size = np.linalg.norm(total, axis=1, keepdims=True)
            centres = np.where(size > 0, total / np.maximum(size, 1e-12), centres)
        self.centres, self.sample = centres, x
        self.sample_list = (x @ centres.T).argmax(axis=1) if len(x) else np.zeros(0, np.int64)

    def rotate(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ self.rotation


def valid(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(good).where((length > 0) & (length < float("inf")))
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    common = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return rows.where(F.size("embedding") == (common["dim"] if common else -1))


def digest(vector: Column) -> Column:
    return F.struct(F.xxhash64(vector), F.xxhash64(F.lit("vector"), vector))


def matrix(column, dim: int) -> np.ndarray:
    return np.concatenate([np.asarray(v, np.float64) for v in column]).reshape(-1, dim) if len(column) else np.zeros((0, dim))


def scan(found: np.ndarray, query: np.ndarray, beat: float, keep: int, width: int, doubt: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `found` that survive the tests, and their squared distances; `beat` is the distance to beat."""
    dim = found.shape[1]
    alive, so_far = np.arange(len(found)), np.zeros(len(found))
    for at in range(0, dim, width):
        block = found[alive, at:at + width] - query[at:at + width]
        so_far = so_far + np.einsum("ij,ij->i", block, block)
        seen = min(at + width, dim)
        if seen < dim:
            stay = so_far * (dim / seen) <= beat * (1 + doubt / np.sqrt(seen)) ** 2 + 1e-9
            if stay.sum() >= keep:
                alive, so_far = alive[stay], so_far[stay]
    return alive, so_far


def neighbours(rows: DataFrame, queries: Column, k: int = 5, sample_rows: int = 20_000, sample_bytes: int = 32_000_000,
               max_lists: int = 512, probe_share: float = 0.75, block: int = 4096, chunk: int = 512, width: int = 16,
               doubt: float = 3.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest found of every row of `rows` (vec_id, embedding) where `queries` holds."""
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base = stored(valid(pick(rows, vec_id="long", embedding="array<double>")))
    head = base.select(F.size("embedding").alias("dim")).first()
    if head is None:
        return empty
    dim = head["dim"]
    keyed = base.withColumn("vector", digest(F.col("embedding")))
    order = Window.partitionBy("vector").orderBy("vec_id")
    copies = keyed.withColumn("copy", F.row_number().over(order)).where(F.col("copy") <= k + 1)
    distinct = stored(copies.select("vec_id", "vector", "copy", "embedding"))

    n_sample = max(1, min(sample_rows, sample_bytes // (8 * dim)))
    firsts = distinct.where(F.col("copy") == 1)
    n_vectors = firsts.count()
    picked = matrix(firsts.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_sample).select("embedding").toArrow().column(0).to_pylist(), dim)
    lists = int(min(max_lists, max(1, np.sqrt(n_vectors) / 2), len(picked)))
    model = Model(picked / np.linalg.norm(picked, axis=1, keepdims=True), lists)
    shared = spark.sparkContext.broadcast(model)  # bounded by sample_bytes
    probes = max(1, int(np.ceil(lists * probe_share)))

    def index(parts):
        for part in parts:
            vectors = matrix(part.column(1).to_pylist(), dim)
            turned = shared.value.rotate(vectors)
            own = (turned @ shared.value.centres.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.astype(np.int32)), pa.array([v.astype(np.float32).tobytes() for v in turned], pa.binary()),
                                              pa.array([v.tobytes() for v in vectors], pa.binary())], ["vec_id", "list", "turned", "vector"])

    def ask(parts):
        for part in parts:
            vectors = matrix(part.column(1).to_pylist(), dim)
            model = shared.value
            turned = model.rotate(vectors)
            near = np.argsort(-(turned @ model.centres.T), axis=1, kind="stable")[:, :probes]
            beats = []
            for q, probed in zip(turned, near):
                known = model.sample[np.isin(model.sample_list, probed)]
                far = ((known - q) ** 2).sum(axis=1)
                beats.append(float(np.partition(far, k)[k]) if len(far) > k else float("inf"))
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([p.tolist() for p in near.astype(np.int32)], pa.list_(pa.int32())), pa.array(beats),
                pa.array([v.astype(np.float32).tobytes() for v in turned], pa.binary()), pa.array([v.tobytes() for v in vectors], pa.binary())],
                ["asked", "lists", "beat", "turned", "vector"])

    indexed = stored(distinct.select("vec_id", "embedding").mapInArrow(index, "vec_id long, list int, turned binary, vector binary"))
    ids = keyed.where(queries).select(F.col("vec_id").alias("query_id"), "vector")
    asked = ids.select("vector").distinct().join(firsts.select("vector", F.col("vec_id").alias("asked"), "embedding"), "vector")
    asked = stored(asked.select("asked", "embedding").mapInArrow(ask, "asked long, lists array<int>, beat double, turned binary, vector binary"))
    asked_lists = asked.select("asked", "beat", "turned", "vector", F.explode("lists").alias("list"))
    # At most `max_lists` rows each: how many blocks of candidates and chunks of queries a list has.
    blocks = indexed.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    chunks = asked_lists.groupBy("list").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    sizes = F.broadcast(blocks.join(chunks, "list"))

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = indexed.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("chunk", each("chunks"))
    right = asked_lists.join(sizes, "list").withColumn("chunk", F.pmod(F.xxhash64("asked"), F.col("chunks")).cast("int")).withColumn("block", each("blocks"))

    def search(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(found) and len(asked):
            turned = np.frombuffer(b"".join(found["turned"]), np.float32).reshape(-1, dim).astype(np.float64)
            vectors = np.frombuffer(b"".join(found["vector"]), np.float64).reshape(-1, dim)
            lengths, names = np.linalg.norm(vectors, axis=1), found["vec_id"].to_numpy()
            for key, beat, q_turned, q_vector in zip(asked["asked"], asked["beat"], asked["turned"], asked["vector"]):
                alive, far = scan(turned, np.frombuffer(q_turned, np.float32).astype(np.float64), beat, k + 1, width, doubt)
                if len(alive) > k + 1:
                    alive = alive[far <= np.partition(far, k)[k] + 1e-5]
                q = np.frombuffer(q_vector, np.float64)
                score = vectors[alive] @ q / (lengths[alive] * np.linalg.norm(q))
                best = np.lexsort((names[alive], -score))[:k + 1]
                out += [(key, names[alive[j]], score[j]) for j in best]
        return pd.DataFrame(out, columns=["asked", "vec_id", "score"])

    names = ["list", "block", "chunk"]
    hits = (left.select(*names, "vec_id", "turned", "vector").groupBy(*names)
            .cogroup(right.select(*names, "asked", "beat", "turned", "vector").groupBy(*names))
            .applyInPandas(search, "asked long, vec_id long, score double"))
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    # One more than asked for: the query itself may be among them.
    hits = hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).select("asked", "vec_id", "score")
    hits = hits.join(firsts.select("vector", F.col("vec_id").alias("asked")), "asked").select("vector", "vec_id", "score")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (ids.join(hits, "vector").where(F.col("vec_id") != F.col("query_id")).withColumn("rank", F.row_number().over(own))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
