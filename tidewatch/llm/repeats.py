"""Removal of repeated passages: fixed-block anchors, rolling probes, extension to maximal exact repeats.

* Index: the non-overlapping blocks of `block` words of every text.
* Probe: every rolling run of `block` words of every text meets the blocks by hash.  A passage of `window` words holds a
  whole block wherever it starts in the other text, as long as window >= 2 * block - 1, so no repeat is missed.
* Extension: of a text with hits, each window that holds a hit is verified over its whole length and given the smallest
  document in which it starts.  Verified windows that touch are one maximal repeat.

Texts with the same words are one class, kept by the smallest id (the others go as a whole), so copies are neither
indexed nor probed.  Both meetings, of probes with blocks and of windows with each other, happen in buckets of hashes.
Rows travel packed (some six bytes a probe).  A task first settles what it can see itself and sends one representative
of each hash it holds several times, so a passage that a third of all documents share arrives once per task, not once
per document.  Pairs of documents are never formed.

Words, blocks and texts are compared by hashes: words by 64 bits, blocks by 32 bits besides the bucket (a false hit only
costs a verification), windows by 96 and classes by 128 bits.

Defined cases: null text has no words; texts of fewer words than `window` stay; a row with null id loses nothing and
counts for none; rows that share an id do not remove from each other; ties cannot occur, as only a smaller id removes;
other columns pass through `drop_repeats`; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import folder, pick, stored
from .bpe import joined
from .ngram_join import mix

BLANKS = "[ \\t\\n\\x0B\\f\\r]+"
BASES = (0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95)
CHUNK = 4_000_000


def flat(text: Column) -> Column:
    """The words of a text, joined by one space."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " "))


def word_count(text: Column) -> Column:
    """Words of a flat text."""
    return F.when(text == "", 0).otherwise(F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


def digests(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("d1"), F.xxhash64(F.lit("words"), text).alias("d2")


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of flat, not empty texts end to end; borders between texts)."""
    from xxhash import xxh64_intdigest
    cut = pc.split_pattern(texts, " ")
    sizes = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = cut.flatten().dictionary_encode()
    names = np.array([xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return (names[codes] if len(names) else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def rolling(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hashes of all runs of `size` words: differences of a running polynomial, shifted back to power 0."""
    n = len(h)
    if n < size:
        return np.zeros(0, np.uint64)
    back = np.full(n, pow(base, -1, 2**64), np.uint64)
    up = np.full(n, base, np.uint64)
    up[0] = back[0] = 1
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.cumprod(up))])
        return mix((total[size:] - total[:n - size + 1]) * np.cumprod(back)[:n - size + 1])


def planes(x: np.ndarray) -> bytes:
    """Bytes of unsigned 32-bit numbers, most frequent first: the high bytes are mostly zero and vanish in compression."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


class Chunk:
    """Runs of `size` words inside the texts of one batch: text number `doc` and position `pos` of each."""

    def __init__(self, borders: np.ndarray, size: int):
        lengths = np.maximum(np.diff(borders) - size + 1, 0)
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.pos = np.arange(len(self.doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.at = borders[:-1][self.doc] + self.pos


PACKED = "bucket int, kind int, docs binary, ids binary, counts binary, pos binary, keys binary"
FIELDS = [f.split()[0] for f in PACKED.split(", ")]
KINDS = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def pack(buckets: np.ndarray, kind: int, doc: np.ndarray, pos: np.ndarray, docs: np.ndarray, ids: np.ndarray, keys: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """One row per bucket; `doc` numbers into `docs` (class digests) and `ids`, ascending, and positions ascend in each."""
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order])) + 1
    rows = []
    for own in np.split(order, cuts) if len(order) else []:
        d, p = doc[own], pos[own]
        first = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1])
        step = np.diff(p, prepend=0)
        step[first] = p[first]
        rows.append((int(buckets[own[0]]), kind, docs[d[first]].tobytes(), ids[d[first]].tobytes() if len(ids) else b"",
                     planes(np.diff(np.append(first, len(d)))), planes(step), b"" if keys is None else keys[own].tobytes()))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], KINDS[i]) for i in range(len(FIELDS))], FIELDS)


def home(docs: np.ndarray, doc: np.ndarray, n_buckets: int) -> np.ndarray:
    """Settled places need no bucket of their hash; those of one text travel in one row."""
    return (docs[doc] % n_buckets).astype(np.int32)


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class digest, id, number of the text in this row, position) of each run of a packed row."""
    counts, step = unplanes(row["counts"]), unplanes(row["pos"])
    doc = np.repeat(np.arange(len(counts)), counts)
    total = np.cumsum(step)
    ends = np.cumsum(counts)
    before = np.concatenate([[0], total[ends[:-1] - 1]]) if len(counts) else np.zeros(0, np.int64)
    ids = np.frombuffer(row["ids"], "<i8")
    return np.frombuffer(row["docs"], "<i8")[doc], (ids[doc] if len(ids) else np.zeros(0, np.int64)), doc, total - before[doc]


HITS = "d1 long, pos binary"


def by_doc(d1: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(d1, positions) rows."""
    order = np.argsort(d1, kind="stable")
    d1, pos = d1[order], pos[order].astype("<u4")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(d1)) + 1, [len(d1)]]) if len(d1) else np.zeros(1, np.int64)
    for at in range(0, len(cuts) - 1, 4096):
        some = cuts[at:at + 4097]
        yield pa.RecordBatch.from_arrays([pa.array(d1[some[:-1]]), pa.array([pos[a:b].tobytes() for a, b in zip(some, some[1:])], pa.binary())], ["d1", "pos"])


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, start of each group in it, group number of each place) of equal keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    start = np.flatnonzero(new)
    return order, start, np.cumsum(new) - 1


def probes(block: int, n_buckets: int):
    """Packed runs of `block` words; the lowest bit of a position says that the run is a block of the index."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in joined(parts, CHUNK):
            h, borders = words_of(part.column(1))
            docs = part.column(0).to_numpy()
            own = Chunk(borders, block)
            key = rolling(h, block, BASES[0])[own.at]
            is_block = own.pos % block == 0
            order, start, number = groups(key)
            if not len(order):
                continue
            d = own.doc[order]
            known = np.logical_or.reduceat(is_block[order], start) & (np.minimum.reduceat(d, start) < np.maximum.reduceat(d, start))
            first = np.zeros(len(order), bool)
            first[start] = True
            here = known[number]  # a repeat seen in this batch: all its places are hits, one place is sent
            is_block[order[here & first]] = True
            hit = np.sort(order[here])
            sent = np.sort(order[~here | first])
            bucket = ((key >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int32)
            none = np.zeros(0, np.int64)
            yield from pack(home(docs, own.doc[hit], n_buckets), 1, own.doc[hit], own.pos[hit], docs, none, None)
            yield from pack(bucket[sent], 0, own.doc[sent], 2 * own.pos[sent] + is_block[sent], docs, none, key[sent].astype("<u4"))

    return run


def bucket_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for part in parts:
        yield from part.to_pylist()


def meet_blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the runs that are a block of the index and stand in two texts at least."""
    held = []
    for row in bucket_rows(parts):
        d1, _, _, pos = unpack(row)
        if row["kind"]:
            yield from by_doc(d1, pos)
        else:
            held.append((np.full(len(d1), row["bucket"], np.int32), np.frombuffer(row["keys"], "<u4"), d1, pos))
    if held:
        bucket, key, d1, pos = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order, start, number = groups(bucket, key)
        d = d1[order]
        live = np.logical_or.reduceat(pos[order] % 2 == 1, start) & (np.minimum.reduceat(d, start) < np.maximum.reduceat(d, start))
        own = order[live[number]]
        yield from by_doc(d1[own], pos[own] // 2)


def near_hits(hits: list[bytes], n: int, window: int, block: int) -> np.ndarray:
    """Of the `n` windows of a text, those that hold a hit."""
    edge = np.zeros(n + window + 1, np.int64)
    at = np.unique(np.frombuffer(b"".join(hits), "<u4").astype(np.int64))
    np.add.at(edge, np.maximum(at + block - window, 0), 1)
    np.add.at(edge, at + 1, -1)
    return np.cumsum(edge)[:n] > 0


def windows(window: int, block: int, n_buckets: int):
    """Packed windows that hold a hit, of (d1, rep, text, hits) rows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in joined(parts, CHUNK):
            h, borders = words_of(part.column(2))
            docs, ids = part.column(0).to_numpy(), part.column(1).to_numpy()
            own = Chunk(borders, window)
            counts = np.maximum(np.diff(borders) - window + 1, 0)
            marks = [near_hits(x, n, window, block) for x, n in zip(part.column(3).to_pylist(), counts)]
            keep = np.flatnonzero(np.concatenate(marks)) if marks else np.zeros(0, np.int64)
            doc, pos, at = own.doc[keep], own.pos[keep], own.at[keep]
            h1 = rolling(h, window, BASES[0])[at]
            h2 = rolling(mix(h ^ np.uint64(BASES[1])), window, BASES[1])[at].astype("<u4")
            order, start, number = groups(h1, h2)
            if not len(order):
                continue
            own_id = ids[doc[order]]
            later = own_id > np.minimum.reduceat(own_id, start)[number]  # a smaller document of this batch has it
            found, sent = np.sort(order[later]), np.sort(order[~later])
            bucket = ((h1 >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int32)
            keys = np.empty(len(h1), np.dtype([("h1", "<u8"), ("h2", "<u4")]))
            keys["h1"], keys["h2"] = h1, h2
            yield from pack(home(docs, doc[found], n_buckets), 1, doc[found], pos[found], docs, ids, None)
            yield from pack(bucket[sent], 0, doc[sent], pos[sent], docs, ids, keys[sent])

    return run


def meet_windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the windows that also start in a smaller document."""
    held = []
    for row in bucket_rows(parts):
        d1, ids, _, pos = unpack(row)
        if row["kind"]:
            yield from by_doc(d1, pos)
        else:
            keys = np.frombuffer(row["keys"], np.dtype([("h1", "<u8"), ("h2", "<u4")]))
            held.append((keys["h1"], keys["h2"], d1, ids, pos))
    if held:
        h1, h2, d1, ids, pos = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order, start, number = groups(h1, h2)
        own = ids[order]
        late = order[own > np.minimum.reduceat(own, start)[number]]
        yield from by_doc(d1[late], pos[late])


RESULT = "d1 long, d2 long, rep long, n_removed long, starts array<int>, ends array<int>, kept_sha256 string, kept string"


def cut(window: int, with_text: bool):
    """What is left of (d1, d2, rep, text, places of repeated windows)."""
    import hashlib

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for d1, d2, rep, text, places in zip(*[c.to_pylist() for c in part.columns]):
                if not places:
                    out.append((d1, d2, rep, 0, [], [], hashlib.sha256(text.encode()).hexdigest(), text if with_text else None))
                    continue
                words = text.split(" ")
                at = np.unique(np.frombuffer(b"".join(places), "<u4").astype(np.int64))
                apart = np.flatnonzero(np.diff(at) > window) + 1
                starts, ends = at[np.concatenate([[0], apart])], at[np.concatenate([apart - 1, [-1]])] + window
                left, last = [], 0
                for a, b in zip(starts.tolist(), ends.tolist()):
                    left += words[last:a]
                    last = b
                kept = " ".join(left + words[last:])
                out.append((d1, d2, rep, int((ends - starts).sum()), starts.tolist(), ends.tolist(), hashlib.sha256(kept.encode()).hexdigest(), kept if with_text else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.string()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], [f.split()[0] for f in RESULT.split(", ")])

    return run


def bucketed(df: DataFrame, key: str, n: int) -> DataFrame:
    """`df` written in buckets of `key`, so that joins on it move only the other side.  The catalog entry goes at once."""
    spark, name = df.sparkSession, f"texts_{uuid.uuid4().hex}"
    try:
        (df.write.bucketBy(n, key).sortBy(key).option("compression", "zstd").option("path", folder(spark, "texts")).saveAsTable(name))
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def find(docs: DataFrame, window: int = 50, block: int = 25, words_per_bucket: int = 2_000_000, with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, d1, d2, n_words; classes: what is left of each distinct text of `window` words or more).

    A row whose id is not its class's `rep` is a copy of a smaller document.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it starts")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = pick(docs, doc_id="long", text="string").select("doc_id", flat(F.col("text")).alias("text"))
    texts = texts.select("doc_id", "text", word_count(F.col("text")).alias("n_words"), *digests(F.col("text")))
    long = texts.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    classes = bucketed(long.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("text").alias("text"), F.first("n_words").alias("n"))
                       .repartition(parts, "d1"), "d1", parts)
    total = classes.agg(F.sum("n")).first()[0] or 0
    n_buckets = max(1, -(-total // words_per_bucket))

    runs = classes.select("d1", "text").mapInArrow(probes(block, n_buckets), PACKED)
    hits = runs.repartitionById(n_buckets, F.col("bucket")).mapInArrow(meet_blocks, HITS).groupBy("d1").agg(F.collect_list("pos").alias("hits"))
    held = classes.join(hits, "d1").select("d1", "rep", "text", "hits").mapInArrow(windows(window, block, n_buckets), PACKED)
    places = held.repartitionById(n_buckets, F.col("bucket")).mapInArrow(meet_windows, HITS).groupBy("d1").agg(F.collect_list("pos").alias("places"))
    left = classes.join(places, "d1", "left").select("d1", "d2", "rep", "text", "places").mapInArrow(cut(window, with_text), RESULT)
    return texts, stored(left)


def joined_rows(docs: DataFrame, window: int, block: int, with_text: bool) -> DataFrame:
    texts, classes = find(docs, window, block, with_text=with_text)
    rows = texts.withColumn("short", F.when((F.col("n_words") < window) | F.col("doc_id").isNull(), F.sha2(F.encode("text", "UTF-8"), 256)))
    rows = rows.select("doc_id", "d1", "d2", "n_words", "short")
    own = F.col("doc_id") == F.col("rep")
    copy = F.col("rep").isNotNull() & F.col("short").isNull() & ~own
    out = rows.join(classes, ["d1", "d2"], "left")
    return out.select(
        "doc_id", "d1", "d2", "n_words", F.when(copy, F.col("n_words")).when(F.col("short").isNotNull(), 0).otherwise(F.col("n_removed")).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("short", "kept_sha256")).alias("kept_sha256"),
        F.when(copy, F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))))
        .when(F.col("short").isNotNull(), F.array().cast("array<struct<start:int,end:int>>"))
        .otherwise(F.transform(F.arrays_zip(F.col("starts"), F.col("ends")), lambda x: F.struct(x["starts"].alias("start"), x["ends"].alias("end")))).alias("spans"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"))


def repeat_digests(docs: DataFrame, window: int = 50, block: int = 25) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) of every row; spans are the maximal runs of words that go."""
    return joined_rows(docs, window, block, False).select("doc_id", "n_words", "n_removed", "kept_sha256", "spans")


def drop_repeats(docs: DataFrame, window: int = 50, block: int = 25) -> DataFrame:
    """`docs` with n_removed, and what is left of `text`: kept words joined by one space where words were removed."""
    texts, classes = find(docs, window, block, with_text=True)
    gone = classes.where(F.col("n_removed") > 0).select("d1", "d2", "rep", "n_removed", "kept")
    reps = classes.select("d1", "d2", F.col("rep").alias("first"))
    own = docs.withColumn("_flat", flat(F.col("text").cast("string"))).withColumn("_id", F.col("doc_id").cast("long"))
    own = own.withColumn("_n", word_count(F.col("_flat")))
    d1, d2 = digests(F.col("_flat"))
    own = own.withColumn("_d1", d1).withColumn("_d2", d2)
    gone, reps = (x.withColumnsRenamed({c: f"_{c}" for c in x.columns}) for x in (gone, reps))
    out = own.join(reps, ["_d1", "_d2"], "left").join(gone, ["_d1", "_d2"], "left")
    copy = F.col("_first").isNotNull() & F.col("_id").isNotNull() & (F.col("_id") > F.col("_first")) & (F.col("_n") >= window)
    lost = F.col("_id").isNotNull() & F.col("_n_removed").isNotNull()
    n_removed = F.when(copy, F.col("_n")).when(lost, F.col("_n_removed")).otherwise(0).cast("long")
    text = F.when(copy, "").when(lost, F.col("_kept")).otherwise(F.col("text").cast("string"))
    out = out.withColumn("_out", text).withColumn("_lost", n_removed)
    return out.select(*[F.col("_out").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.col("_lost").alias("n_removed"))
