"""Hard negatives from a multiway hyperplane tree with distance ranges between siblings.

Vectors are compared by the integer inner product of floor(256 * x).  The tree: a node has up to `arity` split points, a
vector belongs to the nearest one, and each split point stores the least and largest distance to the members of every
sibling.  With the norms of a cell these ranges bound the score of any member (2 * score = |a|^2 + |x|^2 - d^2).  A search
asks for scores inside a window; it goes down the tree and leaves out every sibling whose range of distances, seen from
any split point of the node, does not meet the ring that the window cuts around the anchor.  Cells that are left are
searched exactly.

Two searches use the tree: the best rows of the anchor's own label (a window without upper end), then for each positive
the best rows of other labels inside its window.  A window's lower end starts at the k-th best score among a bounded
sample of stored rows, which only shuts out rows that cannot be among the k best.

The tree is fitted on at most `sample_rows` vectors (and `sample_bytes`); all rows are stored in it, and the ranges are
taken over all rows.  Equal vectors of one label are one class: only the 6 smallest ids of it can be in any result, and
anchors of a class share their search.  Cells of more than `block` rows are cut by hash.  Each task holds one block of
rows at a time while the anchors that reach it stream past.

Defined cases: rows with null id, label or vector, or a null or non-finite component take no part; nor do vectors whose
squared integer length is 2**62 or more (scores would not fit a long); a shorter vector counts as followed by zeros, an
empty one has score 0 with all; rows that share an id are one row (the smallest vector, then label); ties go to the
smaller id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stored

LOWEST, HIGHEST = -2**62, 2**62
EXACT = 2.0**53


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows: by floating point while no partial sum can pass 2**53."""
    a, b = left.astype(np.float64), right.astype(np.float64)
    top = np.sqrt((a * a).sum(axis=1).max(initial=0.0)) * np.sqrt((b * b).sum(axis=1).max(initial=0.0))
    return (a @ b.T).astype(np.int64) if top < EXACT / 2 else left @ right.T


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    a, b = left.astype(np.float64), right.astype(np.float64)
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


class Tree:
    """Split points of all nodes; node 0 is the root, child c of node n is `child[n][c]` (a node, or -1 - a cell)."""

    def __init__(self, sample: np.ndarray, n_rows: int, arity: int = 16, leaf: int = 1024, seed: int = 11):
        self.points: list[np.ndarray] = []
        self.child: list[list[int]] = []
        self.cells = 0
        self.path: list[list[tuple[int, int]]] = []  # of each cell: (node, child) from the root on
        rng = np.random.default_rng(seed)
        share = len(sample) / max(1, n_rows)
        # (rows of the sample, path); a node is cut while it stands for more than `leaf` rows
        self.root = self._grow(sample, np.arange(len(sample)), [], rng, arity, max(4.0, leaf * share))

    def _grow(self, sample, own, path, rng, arity, least) -> int:
        distinct = len(own) and len(np.unique(sample[own[:1000]], axis=0)) > 1
        if len(own) <= least or not distinct:
            self.path.append(path)
            self.cells += 1
            return -self.cells
        # Far apart from each other, chosen from a few times as many candidates.
        some = rng.permutation(own)[:8 * arity]
        far = distances(sample[some], sample[some])
        picked, near = [0], far[0]
        while len(picked) < min(arity, len(some)) and near.max() > 0:
            picked.append(int(near.argmax()))
            near = np.minimum(near, far[picked[-1]])
        if len(picked) < 2:
            self.path.append(path)
            self.cells += 1
            return -self.cells
        points = sample[some[picked]]
        at = len(self.points)
        self.points.append(points)
        self.child.append([])
        side = distances(sample[own], points).argmin(axis=1)
        self.child[at] = [self._grow(sample, own[side == c], [*path, (at, c)], rng, arity, least) for c in range(len(points))]
        return at

    def cell_of(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)

        def down(at: int, own: np.ndarray) -> None:
            if at < 0:
                out[own] = -1 - at
            elif len(own):
                side = distances(rows[own], self.points[at]).argmin(axis=1)
                for c, to in enumerate(self.child[at]):
                    down(to, own[side == c])

        down(self.root, np.arange(len(rows)))
        return out

    def set_ranges(self, seen: list[tuple]) -> None:
        """`seen`: (cell, least and largest square length, least and largest distance to each split point on the path)."""
        n = [len(p) for p in self.points]
        self.near = [np.full((k, k), np.inf) for k in n]  # near[node][child, point]
        self.far = [np.full((k, k), -np.inf) for k in n]
        self.short = [np.full(k, np.inf) for k in n]
        self.long = [np.full(k, -np.inf) for k in n]
        for cell, short, long, near, far in seen:
            at = 0
            for node, c in self.path[cell]:
                k = n[node]
                self.near[node][c] = np.minimum(self.near[node][c], near[at:at + k])
                self.far[node][c] = np.maximum(self.far[node][c], far[at:at + k])
                self.short[node][c] = min(self.short[node][c], short)
                self.long[node][c] = max(self.long[node][c], long)
                at += k

    def ranges_of(self, cell: int, rows: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        square = (rows.astype(np.float64)**2).sum(axis=1)
        far = [distances(rows, self.points[node]) for node, _ in self.path[cell]]
        far = np.concatenate(far, axis=1) if far else np.zeros((len(rows), 0))
        return float(square.min()), float(square.max()), far.min(axis=0), far.max(axis=0)

    def reached(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, cell) of all cells that may hold a score in one of the anchor's windows; low, high: anchors x windows."""
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def down(at: int, own: np.ndarray) -> None:
            if not len(own):
                return
            if at < 0:
                found.append((own, np.full(len(own), -1 - at)))
                return
            rows = anchors[own]
            d = distances(rows, self.points[at])
            square = (rows.astype(np.float64)**2).sum(axis=1)
            for c, to in enumerate(self.child[at]):
                if not np.isfinite(self.short[at][c]):
                    continue  # no row below
                near, far = self.near[at][c][None, :], self.far[at][c][None, :]
                least = np.maximum(np.maximum(d - far, near - d), 0).max(axis=1)
                most = (d + far).min(axis=1)
                slack = 1e-6 * (square + self.long[at][c] + most**2) + 1
                best = (square + self.long[at][c] - least**2 + slack) / 2
                worst = (square + self.short[at][c] - most**2 - slack) / 2
                meets = ((low[own] <= best[:, None]) & (high[own] >= worst[:, None]) & (low[own] <= high[own])).any(axis=1)
                down(to, own[meets])

        down(self.root, np.arange(len(anchors)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def best_in(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the `k` largest entries of each row, LOWEST apart; ties go to the smaller id."""
    k = min(k, score.shape[1])
    if not k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    row, col = np.nonzero((score >= least[:, None]) & (score > LOWEST))
    order = np.lexsort((ids[col], -score[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Integers of binary vectors, shorter ones followed by zeros."""
    held = column.to_pylist()
    if all(len(v) == 8 * dim for v in held):
        return np.frombuffer(b"".join(held), "<i8").reshape(len(held), dim)
    out = np.zeros((len(column), dim), np.int64)
    for k, v in enumerate(held):
        own = np.frombuffer(v, "<i8")
        out[k, :len(own)] = own
    return out


def integers(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, q) of the rows that take part."""
    for part in parts:
        keep, vectors = [], []
        for k, v in enumerate(part.column(2).to_pylist()):
            x = np.array([np.nan if c is None else c for c in v], np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(256 * x)
                if np.isfinite(x).all() and (x * x).sum() < 2.0**62:
                    keep.append(k)
                    vectors.append(x.astype("<i8").tobytes())
        if keep:
            some = part.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(vectors, pa.binary())], ["vec_id", "label", "q"])


def search(rows: DataFrame, asked: DataFrame, tree, dim: int, k: int, own_label: bool, tasks: int) -> DataFrame:
    """(asked, low, high, vec_id, score): the `k` best of each block; `rows`: (cell, block, vec_id, label, q),
    `asked`: (cell, block, asked, label, q, lows, highs).  The last step, the `k` best of all blocks, is the caller's."""
    none = F.lit(None).cast("array<long>")
    left = rows.select("cell", "block", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "label", "q", none.alias("lows"), none.alias("highs"))
    right = asked.select("cell", "block", F.lit(1).alias("kind"), F.col("asked").alias("id"), "label", "q", "lows", "highs")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block, stored ones first."""
        at, held, block = None, [], None
        for part in parts:
            keys = np.stack([part.column(c).to_numpy() for c in range(3)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if tuple(keys[a][:2]) != at:
                    at, held, block = tuple(keys[a][:2]), [], None
                piece = part.slice(a, b - a)
                if keys[a][2] == 0:
                    held.append((piece.column(3).to_numpy(), piece.column(4).to_numpy(), matrix(piece.column(5), dim)))
                    continue
                if not held:
                    continue
                if block is None:
                    block = tuple(np.concatenate(x) for x in zip(*held))
                ids, labels, vectors = block
                names, own = piece.column(3).to_numpy(), piece.column(4).to_numpy()
                score = products(matrix(piece.column(5), dim), vectors)
                allowed = (own[:, None] == labels[None, :]) == own_label
                lows, highs = ([np.array(x, np.int64) for x in piece.column(c).to_pylist()] for c in (6, 7))
                for w in range(max(map(len, lows), default=0)):
                    low = np.array([x[w] if w < len(x) else HIGHEST for x in lows])
                    high = np.array([x[w] if w < len(x) else LOWEST for x in highs])
                    row, col = best_in(np.where(allowed & (score >= low[:, None]) & (score <= high[:, None]), score, LOWEST), ids, k)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(high[row]), pa.array(ids[col]), pa.array(score[row, col])],
                                                         ["asked", "high", "vec_id", "score"])

    both = left.unionByName(right).repartition(tasks, "cell", "block").sortWithinPartitions("cell", "block", "kind", "id")
    return both.mapInArrow(run, "asked long, high long, vec_id long, score long")


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95),
         sample_rows: int = 20_000, sample_bytes: int = 16_000_000, arity: int = 16, leaf: int = 1024, block: int = 4096) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of `rows`
    (vec_id, label, embedding) where `anchors` (a condition on vec_id) holds.

    A negative's score lies between `window` percent of the positive's.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    picked = pick(rows, vec_id="long", label="int", embedding="array<double>").dropna()
    coded = picked.mapInArrow(integers, "vec_id long, label int, q binary")
    coded = stored(coded.groupBy("vec_id").agg(F.min(F.struct("q", "label")).alias("own")).select("vec_id", "own.label", "own.q"))
    # Of a class only the smallest ids can be among anyone's positives or negatives.
    copies = max(positives + 1, negatives)
    order = Window.partitionBy("label", "q").orderBy("vec_id")
    distinct = coded.withColumn("copy", F.row_number().over(order)).where(F.col("copy") <= copies)
    asked = coded.where(anchors).groupBy("label", "q").agg(F.min("vec_id").alias("asked"))
    size = coded.agg(F.count("*").alias("n"), F.max(F.octet_length("q")).alias("dim")).first()
    if not size["n"]:
        return spark.createDataFrame([], result)
    dim = size["dim"] // 8

    n_sample = max(1, min(sample_rows, sample_bytes // (8 * max(1, dim))))
    # About so many rows by a threshold on the hash of the id: no task sends more than its share.
    share = F.lit(min(2**63 - 1, int(n_sample / size["n"] * 2**63)))
    some = coded.where(F.shiftrightunsigned(F.xxhash64("vec_id"), 1) <= share).limit(n_sample).select("vec_id", "label", "q").toArrow()
    sample = matrix(some.column("q").combine_chunks(), dim)
    tree = Tree(sample, size["n"], arity, leaf) if len(sample) else Tree(np.zeros((0, dim), np.int64), 0)
    known = 4096
    plan = spark.sparkContext.broadcast((tree, sample[:known], some.column("label").to_numpy()[:known], some.column("vec_id").to_numpy()[:known]))

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            cells = plan.value[0].cell_of(matrix(part.column(2), dim))
            yield pa.RecordBatch.from_arrays([pa.array(cells), *part.columns], ["cell", "vec_id", "label", "q"])

    cells = distinct.select("vec_id", "label", "q").mapInArrow(place, "cell long, vec_id long, label int, q binary")
    # Rows of a cell lie together; a cell of very many rows spreads over several tasks.
    cells = stored(cells.repartitionByRange(tasks, "cell", F.xxhash64("vec_id")).sortWithinPartitions("cell"))
    sizes = {r["cell"]: r["n"] for r in cells.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a cell
    blocks = np.array([-(-sizes.get(c, 0) // block) for c in range(tree.cells)], np.int64)

    def ranges(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per cell and task."""
        held: dict[int, tuple] = {}
        for part in parts:
            own, vectors = part.column(0).to_numpy(), matrix(part.column(1), dim)
            for c in np.unique(own).tolist():
                short, long, near, far = plan.value[0].ranges_of(c, vectors[own == c])
                if c in held:
                    before = held[c]
                    short, long = min(short, before[0]), max(long, before[1])
                    near, far = np.minimum(near, before[2]), np.maximum(far, before[3])
                held[c] = short, long, near, far
        out = [(c, *x) for c, x in held.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(
                (pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())))], ["cell", "short", "long", "near", "far"])

    each = cells.select("cell", "q").mapInArrow(ranges, "cell long, short double, long double, near array<double>, far array<double>")
    each = (each.select("cell", "short", "long", F.posexplode_outer(F.arrays_zip("near", "far")).alias("at", "d"))
            .groupBy("cell", "at").agg(F.min("short").alias("short"), F.max("long").alias("long"), F.min("d.near").alias("near"), F.max("d.far").alias("far"))
            .groupBy("cell").agg(F.min("short").alias("short"), F.max("long").alias("long"), F.sort_array(F.collect_list(F.struct("at", "near", "far"))).alias("d")))
    # The tree's own size: cells x depth x arity numbers.
    tree.set_ranges([(r["cell"], r["short"], r["long"], [x["near"] for x in r["d"] if x["at"] is not None], [x["far"] for x in r["d"] if x["at"] is not None])
                     for r in each.collect()])
    ready_plan = spark.sparkContext.broadcast((*((tree,) + plan.value[1:]), blocks))

    def route(k: int, own_label: bool):
        """Cells and blocks an anchor must visit, with each window's lower end raised to the sample's `k`-th best."""

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, sample, labels, ids, blocks = ready_plan.value
            for part in parts:
                vectors, own = matrix(part.column(2), dim), part.column(1).to_numpy()
                score = products(vectors, sample)
                allowed = (own[:, None] == labels[None, :]) == own_label
                lows, highs = ([list(x) for x in part.column(c).to_pylist()] for c in (3, 4))
                n = max(map(len, lows), default=0)
                low = np.array([x + [HIGHEST] * (n - len(x)) for x in lows], np.int64).reshape(len(own), n)
                high = np.array([x + [LOWEST] * (n - len(x)) for x in highs], np.int64).reshape(len(own), n)
                for w in range(n):
                    fits = np.where(allowed & (score >= low[:, [w]]) & (score <= high[:, [w]]), score, LOWEST)
                    if fits.shape[1] >= k:
                        low[:, w] = np.maximum(low[:, w], np.partition(fits, fits.shape[1] - k, axis=1)[:, fits.shape[1] - k])
                who, cell = tree.reached(vectors, low, high)
                times = blocks[cell]
                who, cell = np.repeat(who, times), np.repeat(cell, times)
                number = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                size = max(1, 4_000_000 // (8 * dim + 16 * n + 32))
                for a in range(0, len(who), size):
                    w = who[a:a + size]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(cell[a:a + size]), pa.array(number[a:a + size].astype(np.int32)), part.column(0).take(pa.array(w)), part.column(1).take(pa.array(w)),
                        part.column(2).take(pa.array(w)), pa.array(low[w].tolist(), pa.list_(pa.int64())), pa.array(high[w].tolist(), pa.list_(pa.int64()))],
                        ["cell", "block", "asked", "label", "q", "lows", "highs"])

        return run

    routed = "cell long, block int, asked long, label int, q binary, lows array<long>, highs array<long>"
    split = spark.createDataFrame([(c, int(b)) for c, b in enumerate(blocks) if b > 1], "cell long, parts int")
    blocked = cells.join(split, "cell", "left").select("cell", F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1))).cast("int").alias("block"), "vec_id", "label", "q")

    asked = stored(asked.select("asked", "label", "q"))
    any_score = asked.select("asked", "label", "q", F.array(F.lit(LOWEST + 1)).alias("lows"), F.array(F.lit(HIGHEST)).alias("highs"))
    found = search(blocked, any_score.mapInArrow(route(positives + 1, True), routed), tree, dim, positives + 1, True, tasks)
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    # The anchor itself is among them, or ids before it that serve just as well.
    near = stored(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives + 1).select("asked", "vec_id", "score"))

    low, high = (F.expr(f"CAST({cut}({int(p)} * CAST(score AS DECIMAL(20, 0)) / 100) AS LONG)") for cut, p in zip(("ceil", "floor"), window))
    ends = near.select("asked", low.alias("low"), high.alias("high")).where(F.col("low") <= F.col("high"))
    # Positives of one upper end share a search; the k best above the lower end are the first of them.
    windows = ends.groupBy("asked", "high").agg(F.min("low").alias("low")).groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("w"))
    windows = asked.join(windows, "asked").select("asked", "label", "q", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    wrong = search(blocked, windows.mapInArrow(route(negatives, False), routed), tree, dim, negatives, False, tasks)
    best = Window.partitionBy("asked", "high").orderBy(F.desc("score"), "vec_id")
    wrong = wrong.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)

    members = coded.where(anchors).select(F.col("vec_id").alias("anchor_id"), "label", "q").join(asked, ["label", "q"]).select("anchor_id", "asked")
    own = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    chosen = (members.join(near.withColumnRenamed("vec_id", "positive_id"), "asked").where(F.col("positive_id") != F.col("anchor_id"))
              .withColumn("place", F.row_number().over(own)).where(F.col("place") <= positives))
    chosen = chosen.select("anchor_id", "asked", "positive_id", F.col("score").alias("positive_score"), low.alias("low"), high.alias("high"))
    return (chosen.join(wrong.select("asked", "high", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["asked", "high"])
            .where(F.col("negative_score") >= F.col("low"))
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
