"""Similarity join of documents on word n-grams (Jaccard), by vertical partitioning.

A global order of all n-grams (by hash) is cut at pivots into fragments.

* Overlaps: each document's n-grams are cut into `FRAGMENTS` segments; the overlap of a pair is counted fragment by
  fragment and summed, so the similarity is exact.
* Candidates: documents meet where, from some pivot on, their next `g` n-grams are the same.  `ORDERS` independent orders
  with `PIVOTS` pivots each give 80 such keys.  At a similarity of 0.85 a key of eight n-grams agrees with
  probability 0.27, so all 80 fail with probability 1e-11; short documents use shorter keys (see `key_sizes`).

Groups of copies are never expanded into all pairs.  Equal sets meet by their digest.  In each key group the member that
shares most keys with others is compared with all others.  Then only documents that are still in
different components, and share a key, are compared with each other: within a component a link changes nothing.  Of an
overlap between components an n-gram that only one component has cannot be part; pairs whose other n-grams are too few
for the threshold are left out.

Defined cases: null or blank texts have no n-grams and link with nothing; shorter texts than `k` words are one n-gram;
rows that share an id are one document whose set is that of the row with the smallest digest; a null id is in no
component (null); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import joined
from .common import pick, stored
from .suffix_tree import words_of

FRAGMENTS, ORDERS, PIVOTS, PRUNES = 8, 8, 10, 3
FILTER_BITS = 24
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words end to end, borders between texts)."""
    from xxhash import xxh64_intdigest
    cut = words_of(texts)
    sizes = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    words = cut.flatten()
    held = pc.not_equal(words, "").to_numpy(zero_copy_only=False).astype(bool)
    ends = np.concatenate([[0], np.cumsum(held)])[np.concatenate([[0], np.cumsum(sizes)])]
    coded = words.filter(pa.array(held)).dictionary_encode()
    names = np.array([xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    return (names[coded.indices.to_numpy(zero_copy_only=False)] if len(names) else names), ends


def runs_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of `k` words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix(sum((h[j:j + n] * ODD[j] for j in range(k)), np.zeros(n, np.uint64)))


def sets_of(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    h, ends = word_hashes(texts)
    with np.errstate(over="ignore"):
        run = runs_of(h, k)
        out = []
        for a, b in zip(ends, ends[1:]):
            if b - a >= k:
                own = np.sort(run[a:b - k + 1])
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif b > a:
                out.append(mix((h[a:b] * ODD[:b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def key_sizes(n: int, percent: int) -> list[int]:
    """How many n-grams a key holds; sets near a border use both sizes, so similar sets always share one.

    Long keys agree with a probability of about 0.27 at the threshold: eight n-grams at 85 %, six at 80 %.
    """
    long = round(np.log(0.27) / np.log(percent / 100))
    return [g for g, low, high in ((1, 1, 18), (3, 13, 75), (long, 54, 2**62)) if low <= n <= high]


def keys_of(own: np.ndarray, pivots: np.ndarray, seeds: np.ndarray, percent: int) -> np.ndarray:
    """Fragment keys of a set."""
    n = len(own)
    orders = np.sort(mix(own[None, :] ^ seeds[:, None]), axis=1)
    found = []
    for g in key_sizes(n, percent):
        at = np.arange(g)
        for r in range(len(seeds)):
            start = np.searchsorted(orders[r], pivots)
            grams = orders[r][(start[:, None] + at) % n]
            found.append(mix((grams * ODD[at]).sum(axis=1) + np.uint64(r * 16 + g)))
    return np.unique(np.concatenate(found))


def profile(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, d1, d2, keys): set size, 128-bit digest of the set and fragment keys of each row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = (np.arange(PIVOTS, dtype=np.uint64) * np.uint64(2**64 // PIVOTS))
        seeds = mix(np.arange(1, ORDERS + 1, dtype=np.uint64) * ODD[0])
        for part in joined(parts):
            with np.errstate(over="ignore"):
                sets = sets_of(part.column(1), k)
                keys = [keys_of(s, pivots, seeds, percent).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
                d1 = np.array([mix(s ^ ODD[1]).sum(dtype=np.uint64) for s in sets], np.uint64)
                d2 = np.array([mix(s ^ ODD[2]).sum(dtype=np.uint64) for s in sets], np.uint64)
            borders = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                pa.ListArray.from_arrays(pa.array(borders), pa.array(flat))], ["doc_id", "n", "d1", "d2", "keys"])

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, keys array<long>")


def wanted(ids: DataFrame) -> np.ndarray:
    """A filter of 2**24 bits that holds all `ids` (and, by chance, others)."""
    bit = ids.select(F.xxhash64("doc_id").bitwiseAND(2**FILTER_BITS - 1).alias("bit"))
    words = bit.select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask"))
    got = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most 2**18 rows
    out = np.zeros(2**(FILTER_BITS - 6), np.int64)
    out[got.column("word").to_numpy()] = got.column("mask").to_numpy()
    return out


def segments(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, grams): the n-grams of the documents in `ids`, cut at the fragments' borders: one binary per fragment."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted(ids))  # 2 MB

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64(2**64 // FRAGMENTS)
        for part in joined(parts, 4_000_000):
            bit = part.column(2).to_numpy()
            held = (shared.value[bit >> 6] >> (bit & 63)) & 1
            part = part.filter(pa.array(held == 1))
            if not part.num_rows:
                continue
            out = []
            for key, own in zip(part.column(0).to_pylist(), sets_of(part.column(1), k)):
                if len(own):
                    out.append((key, [g.tobytes() for g in np.split(own, np.searchsorted(own, borders))]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()),
                                                  pa.array([o[1] for o in out], pa.list_(pa.binary()))], ["doc_id", "grams"])

    bit = F.xxhash64("doc_id").bitwiseAND(2**FILTER_BITS - 1)
    return docs.select("doc_id", "text", bit.alias("bit")).mapInArrow(run, "doc_id long, grams array<binary>")


def links(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (a, b, na, nb) whose similarity is at least `percent`/100, with the overlap; `parts` are segments."""

    def overlap(left: pa.Scalar, right: pa.Scalar) -> int:
        """Partial overlaps, fragment by fragment, summed; only this pair's n-grams leave the batch."""
        left, right = left.as_py(), right.as_py()
        return sum(len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(left, right))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            both = [overlap(x, y) for x, y in zip(part.column(4), part.column(5))]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(both, pa.int64())], ["a", "b", "na", "nb", "both"])

    one = parts.select(F.col("doc_id").alias("a"), F.col("grams").alias("left"))
    two = parts.select(F.col("doc_id").alias("b"), F.col("grams").alias("right"))
    return (pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "left", "right")
            .mapInArrow(run, "a long, b long, na long, nb long, both long")
            .where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))))


def shared_grams(parts: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, shared): how many n-grams of each document in `labels` (doc_id, component) other components have too."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            grams = [np.frombuffer(b"".join(g), np.int64) for g in part.column(2).to_pylist()]
            sizes = [len(g) for g in grams]
            if grams:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(part.column(0).to_numpy(), sizes)), pa.array(np.repeat(part.column(1).to_numpy(), sizes)),
                    pa.array(np.concatenate(grams))], ["doc_id", "component", "gram"])

    rows = parts.join(labels, "doc_id").select("doc_id", "component", "grams").mapInArrow(run, "doc_id long, component long, gram long")
    common = rows.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(F.col("low") < F.col("high"))
    return rows.join(common.select("gram"), "gram").groupBy("doc_id").agg(F.count("*").alias("shared"))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(doc_id, component): the smallest id reachable over `edges` (a, b).

    Every round takes the least label among the neighbours and then the label of that label; written each round.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select("a", "label"))
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, "a").select("a", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("a").alias("next"), F.col("label").alias("far"))
        new = stored(step.join(jump, "next").select("a", F.col("label").alias("old"), F.least("next", "far").alias("label")))
        changed = not new.where(F.col("old") != F.col("label")).isEmpty()
        labels = new.select("a", "label")
        if not changed:
            return labels.select(F.col("a").alias("doc_id"), F.col("label").alias("component"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with only the smallest document of each component; rows without id stay."""
    lost = join(docs, k, percent).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(lost, docs["doc_id"] == lost["doc_id"], "left_anti")


def join(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs` (doc_id, text)."""
    if not 75 <= percent < 100:
        raise ValueError("keys are laid out for thresholds of 75 % to 99 %")
    docs = pick(docs, doc_id="long", text="string")
    rows = stored(profile(docs, k, percent))
    # Equal sets: one of them, with the smallest id, stands for all.
    some = rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    own = some.groupBy("doc_id").agg(F.min(F.struct("d1", "d2", "n")).alias("set")).select("doc_id", "set.*")
    classes = stored(own.withColumn("_n", F.col("n")).groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep")))
    single = classes.select(F.col("rep").alias("doc_id"), "d1", "d2", "n")
    keyed = some.join(single, ["doc_id", "d1", "d2", "n"], "left_semi").select("doc_id", "n", F.explode("keys").alias("key")).distinct()
    groups = keyed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    members = stored(keyed.join(groups, "key"))
    # The member with most company is likely the original of a group of edited copies.
    company = members.groupBy("doc_id").agg(F.sum("size").alias("company"))
    crowd = members.join(company, "doc_id")
    hub = F.max(F.struct("company", (-F.col("doc_id")).alias("turn"), "doc_id", "n"))
    hubs = crowd.groupBy("key").agg(hub.alias("hub")).select("key", F.col("hub.doc_id").alias("hub"), F.col("hub.n").alias("hub_n"))

    def fits(n, m):
        return (100 * n >= percent * m) & (100 * m >= percent * n)

    star = stored(members.join(hubs, "key").where((F.col("hub") != F.col("doc_id")) & fits(F.col("n"), F.col("hub_n")))
                  .select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b"),
                          F.when(F.col("hub") < F.col("doc_id"), F.col("hub_n")).otherwise(F.col("n")).alias("na"),
                          F.when(F.col("hub") < F.col("doc_id"), F.col("n")).otherwise(F.col("hub_n")).alias("nb")).distinct())
    parts = stored(segments(docs, members.select("doc_id").distinct(), k))
    linked = stored(links(star, parts, percent).select("a", "b"))
    first = components(linked)

    # What the hubs left apart: members of one key in different components.
    label = members.select("key", "doc_id", "n").join(first, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    split = label.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(F.col("low") < F.col("high"))
    label = stored(label.join(split.select("key"), "key", "left_semi"))
    for _ in range(PRUNES):  # documents that drop out leave fewer n-grams in common to the others
        able = shared_grams(parts, label.select("doc_id", "component").distinct())
        label = stored(label.drop("shared").join(able, "doc_id").where(100 * F.col("shared") >= percent * F.col("n")))
    label = label.join(label.groupBy("doc_id").agg(F.collect_list("key").alias("keys")), "doc_id")  # a document has 80 keys, or 160
    left, right = (label.select("key", F.col("keys").alias("k" + x), F.col("doc_id").alias(x), F.col("n").alias("n" + x), F.col("component").alias("c" + x), F.col("shared").alias("s" + x))
                   for x in "ab")
    # A pair meets once: at the smallest key both have.
    once = F.array_min(F.array_intersect("ka", "kb")) == left["key"]
    # An overlap of at least percent / (100 + percent) of both sizes is needed.
    enough = (100 + percent) * F.least("sa", "sb") >= percent * (F.col("na") + F.col("nb"))
    apart = (left.join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
                       & fits(F.col("na"), F.col("nb")) & enough & once).select("a", "b", "na", "nb"))
    apart = stored(apart.join(star.select("a", "b"), ["a", "b"], "left_anti"))
    more = stored(links(apart, parts, percent).select("a", "b"))
    final = components(linked.unionByName(more)) if not more.isEmpty() else first

    named = classes.join(final.withColumnRenamed("doc_id", "rep"), "rep", "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component_id"))
    sets = own.join(named, ["d1", "d2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return (rows.select("doc_id").join(sets, "doc_id", "left")
            .select("doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))
