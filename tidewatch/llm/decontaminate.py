"""Benchmark passages in documents, by SimHash over item-sized windows.

Each benchmark item has a 64-bit SimHash of its word shingles, weighted by how often they occur.  A document's windows of
an item's length are fingerprinted the same way (by running sums over the bits).  Eight blocks of eight bits index the
items: if two fingerprints differ in at most `radius` bits, one block differs in at most `radius` // 8, so looking up each
block with that many bits flipped finds every item within the radius.  Candidates are verified by the exact weighted
similarity of their shingles, sum of minima over sum of maxima.

A window without any shingle of an item has similarity 0 with it, so only windows around such shingles are fingerprinted;
`everywhere` fingerprints all windows and gives the same rows.

The items travel to the tasks in blocks of at most `block_bytes`; each block is one pass over the documents.

Defined cases: null texts have no words; items shorter than `k` words cannot be told from chance and take no part; a
document shorter than the item is one window; of windows that match an item equally the first counts; rows that share an
id are reported once; a null id is reported as null; an empty benchmark finds nothing; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import joined
from .common import pick
from .ngram_join import runs_of, word_hashes

FOUND = "doc_id long, item_id long, start_word long, n_words long, hamming int, similarity double"
BLOCKS = 8


def bits(runs: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle hash."""
    return np.unpackbits(runs.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of rows of 64 sums."""
    return np.packbits(sums > 0, axis=1).view(np.uint64).ravel() if len(sums) else np.zeros(0, np.uint64)


def window_prints(runs: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of the windows that hold the shingles start .. start + width - 1."""
    total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits(runs), axis=0, dtype=np.int32)])
    return packed(total[starts + width] - total[starts])


def similarity(one: np.ndarray, two: np.ndarray) -> float:
    """Weighted Jaccard of two runs of shingles; a shingle weighs as often as it occurs."""
    names, back = np.unique(np.concatenate([one, two]), return_inverse=True)
    a = np.bincount(back[:len(one)], minlength=len(names))
    b = np.bincount(back[len(one):], minlength=len(names))
    return float(np.minimum(a, b).sum() / np.maximum(a, b).sum())


class Items:
    """The benchmark items of one block, indexed by size, shingle and fingerprint block."""

    def __init__(self, ids: list[int], texts: list[str | None], k: int, radius: int):
        h, ends = word_hashes(pa.array(texts, pa.string()))
        self.k, self.radius = k, radius
        with np.errstate(over="ignore"):
            cut = [(i, runs_of(h[a:b], k)) for i, a, b in zip(ids, ends, ends[1:]) if b - a >= k]
        self.ids, self.runs = [i for i, _ in cut], [r for _, r in cut]
        sizes = np.array([len(r) for r in self.runs], np.int64)
        prints = np.array([packed(bits(r).sum(axis=0, keepdims=True))[0] for r in self.runs], np.uint64)
        self.by_size = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}
        # Per size and block: which items are near enough to each value of the block's eight bits.
        flips = [sum(1 << b for b in c) for d in range(radius // BLOCKS + 1) for c in combinations(range(8), d)]
        self.tables, self.prints = {}, prints
        for n, at in self.by_size.items():
            own = prints[at].view(np.uint8).reshape(-1, BLOCKS)
            table = np.zeros((BLOCKS, 256, len(at)), bool)
            for b in range(BLOCKS):
                for flip in flips:
                    table[b, own[:, b] ^ flip, np.arange(len(at))] = True
            self.tables[n] = table
        flat = np.concatenate(self.runs) if self.runs else np.zeros(0, np.uint64)
        owner = np.repeat(sizes, sizes)
        pairs = np.unique(np.stack([flat, owner.astype(np.uint64)], axis=1), axis=0) if len(flat) else np.zeros((0, 2), np.uint64)
        self.shingles, first = np.unique(pairs[:, 0], return_index=True)
        self.shingle_sizes = np.split(pairs[:, 1].astype(np.int64), first[1:]) if len(first) else []
        self.known = np.zeros(1 << 20, bool)
        self.known[(self.shingles & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of shingles that some item has, their numbers)."""
        some = np.flatnonzero(self.known[(runs & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.searchsorted(self.shingles, runs[some])
        at = np.minimum(at, max(0, len(self.shingles) - 1))
        same = self.shingles[at] == runs[some] if len(self.shingles) else np.zeros(0, bool)
        return some[same], at[same]

    def search(self, runs: np.ndarray, places: np.ndarray, which: np.ndarray, least: float, everywhere: bool) -> list[tuple]:
        """(item, start, words, hamming, similarity) of the best window of every item found in one text's shingles."""
        starts: dict[int, list] = {}
        if everywhere:
            starts = {n: [np.arange(max(1, len(runs) - n + 1))] for n in self.by_size}
        else:
            for p, w in zip(places, which):
                for n in self.shingle_sizes[w]:
                    starts.setdefault(int(n), []).append(np.arange(max(0, p - n + 1), p + 1))
        best: dict[int, tuple] = {}
        for n, parts in starts.items():
            width = min(n, len(runs))
            at = np.unique(np.concatenate(parts))
            at = np.unique(np.minimum(at, len(runs) - width))
            low = int(at[0])
            own = window_prints(runs[low:int(at[-1]) + width], at - low, width)
            block = own.view(np.uint8).reshape(-1, BLOCKS)
            table = self.tables[n]
            near = np.zeros((len(at), table.shape[2]), bool)
            for b in range(BLOCKS):
                near |= table[b, block[:, b]]
            for w, j in zip(*np.nonzero(near)):
                item = int(self.by_size[n][j])
                far = int(np.bitwise_count(own[w] ^ self.prints[item]))
                if far <= self.radius:
                    close = similarity(runs[at[w]:at[w] + width], self.runs[item])
                    found = (close, -far, -int(at[w]), width)
                    if close >= least and found > best.get(item, (0,)):
                        best[item] = found
        return [(self.ids[i], -start, width + self.k - 1, -far, close) for i, (close, far, start, width) in best.items()]


def item_blocks(benchmark: DataFrame, block_bytes: int):
    """(ids, texts) of the items, in blocks of bounded size."""
    items = pick(benchmark, item_id="long", text="string").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0]
    if not total:
        return
    n = -(-int(total) // block_bytes)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow()
        yield part.column(0).to_pylist(), part.column(1).to_pylist()


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, k: int = 5, radius: int = 23, block_bytes: int = 4_000_000,
          everywhere: bool = False) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity): the best window of every item in every document."""
    spark = docs.sparkSession
    rows = pick(docs, doc_id="long", text="string")
    out = None
    for ids, texts in item_blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast((ids, texts))  # at most about block_bytes

        def run(parts, shared=shared):
            items = Items(*shared.value, k, radius)
            for part in joined(parts):
                with np.errstate(over="ignore"):
                    h, ends = word_hashes(part.column(1))
                    runs = runs_of(h, k)
                    places, which = items.hits(runs)
                    found = []
                    keys = part.column(0)
                    asked = range(len(keys)) if everywhere else np.unique(np.searchsorted(ends, places, side="right") - 1)
                    for d in asked:
                        a, b = ends[d], ends[d + 1] - k + 1
                        if b > a:
                            low, high = np.searchsorted(places, [a, b])
                            if high > low or everywhere:
                                own = items.search(runs[a:b], places[low:high] - a, which[low:high], least, everywhere)
                                found += [(keys[int(d)].as_py(), *f) for f in own]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (
                        pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()))], FOUND_NAMES)

        hits = rows.mapInArrow(run, FOUND)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return spark.createDataFrame([], FOUND)
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("first"), "n_words", "hamming")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("best.first")).alias("start_word"), "best.n_words", "best.hamming", "best.similarity")


FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the documents that hold a benchmark item."""
    found = leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left_anti")
