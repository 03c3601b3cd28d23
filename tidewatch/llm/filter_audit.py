"""Interaction audit of a chain of filters, for every order of the filters at once.

Each document is reduced to the set (mask) of filters it fails.  In an order of the filters a document goes at the first
letter of its mask.  Orders are numbered by their Lehmer code (their lexicographic rank).  All orders that share a prefix
are neighbours, so "removed at step k by filter f" holds for a few intervals of ranks: one for every way to fill the
first k - 1 places with filters the document passes.  A mask's count is added where an interval starts and taken off
where it ends; a running sum over the ranks then gives the removals of every order and step.  The work on documents is
one scan and two aggregations; what follows grows with the number of masks and parts only.

A text is identical to another one by two independent 64-bit hashes and its length (a false match has a chance of about
n**2 / 2**129 in a table of n texts).

Defined cases: null text is empty; a null part is the empty string; a null id has no smaller and is smaller than none
(its copies stay unmarked); rows that share id and text are counted each, and none is a copy of the other; several
labels of one id count as good or toxic if any is; labels without document count for none; other columns are ignored; an
empty table has no parts and gives no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stored

LETTERS = "ABCDE"
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"


def rank(order: list[int]) -> int:
    """Lexicographic rank of a permutation of 0..n-1, from its Lehmer code."""
    n = len(order)
    return sum(sum(later < x for later in order[i + 1:]) * factorial(n - 1 - i) for i, x in enumerate(order))


def intervals(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) of every removal; bit f of a mask is filter f."""
    found = []
    for mask in range(1, 2**n):
        passes = [f for f in range(n) if not mask >> f & 1]
        for before in range(len(passes) + 1):
            for prefix in permutations(passes, before):
                for f in (f for f in range(n) if mask >> f & 1):
                    head = [*prefix, f]
                    low = rank(head + [x for x in range(n) if x not in head])
                    found.append((mask, before + 1, low, low + factorial(n - before - 1)))
    return found


def orders(letters: str) -> list[tuple[int, str]]:
    return [(rank([letters.index(x) for x in p]), "".join(p)) for p in permutations(sorted(letters))]


def conditions(text: Column) -> dict[str, Column]:
    """Failure conditions on one text alone; E needs the whole table."""
    flat = F.trim(F.regexp_replace(text, BLANKS, " "))
    words = F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " ", -1))
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": F.size(words) < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
            "C": 100 * capitals.cast("long") > 3 * F.char_length(text).cast("long"), "D": text.rlike("[#$%&*|]")}


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = sum((F.when(c, F.lit(1 << LETTERS.index(f))).otherwise(F.lit(0)) for f, c in conditions(text).items()), F.lit(0))
    digest = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("text"), text).alias("h2"), F.char_length(text).alias("size")]
    flags = stored(pick(docs, doc_id="long", lang="string", text="string")
                   .select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), own.alias("own"), *digest))
    # The join is on ids, which are spread evenly; a text that a third of the rows share is one row here.
    first = (flags.where(F.col("doc_id").isNotNull()).groupBy("h1", "h2", "size").agg(F.min("doc_id").alias("doc_id"))
             .withColumn("first", F.lit(True)))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return (flags.join(first, ["doc_id", "h1", "h2", "size"], "left")
            .select("doc_id", "part", (F.col("own") + F.when(copy, 1 << LETTERS.index("E")).otherwise(0)).alias("mask")))


def audit(masked: DataFrame, marks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order and step, from (doc_id, part, mask) and (doc_id, good, toxic)."""
    spark, n = masked.sparkSession, len(letters)
    counts = ["docs", "good", "toxic"]
    cells = (masked.join(marks, "doc_id", "left").groupBy("part", "mask")
             .agg(F.count("*").alias("docs"), *[F.count(F.when(F.col(c), 1)).alias(c) for c in counts[1:]]))
    cells = stored(cells)  # at most 32 rows a part

    grid = spark.createDataFrame([(r, o, k + 1, 1 << letters.index(o[k]), o[k]) for r, o in orders(letters) for k in range(n)],
                                 "rank int, filter_order string, step int, bit int, letter string")
    spans = spark.createDataFrame(intervals(n), "mask int, step int, low int, high int")
    hits = cells.join(spans, "mask")
    ends = [hits.select("part", "step", F.col(at).alias("rank"), *[(sign * F.col(c)).alias(c) for c in counts]) for at, sign in (("low", 1), ("high", -1))]
    edges = ends[0].unionByName(ends[1]).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in counts])

    parts = cells.groupBy("part").agg(F.sum("docs").alias("total"))
    failing = F.filter(F.array(*[F.lit(1 << f) for f in range(n)]), lambda bit: F.col("mask").bitwiseAND(bit) != 0)
    fails = (cells.withColumn("bit", F.explode(failing)).groupBy("part", "bit")
             .agg(F.sum("docs").alias("fails"), F.sum(F.when(F.col("mask") == F.col("bit"), F.col("docs")).otherwise(0)).alias("unique_fails")))
    places = parts.select("*", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1))).alias("rank")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    rows = places.join(grid, ["rank", "step"]).join(edges, ["part", "step", "rank"], "left").join(fails, ["part", "bit"], "left")
    running = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    for c in counts:
        rows = rows.withColumn(c, F.coalesce(F.sum(c).over(running), F.lit(0)))
    zero = F.lit(0).cast("long")
    return rows.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("docs").over(so_far)).alias("kept"), F.col("docs").alias("removed"),
        (F.coalesce("fails", zero) - F.col("docs")).alias("redundant"), F.coalesce("unique_fails", zero).alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("docs").over(Window.partitionBy("part", "bit")).alias("shapley"))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of `docs` (doc_id, lang, text) under `labels` (doc_id, quality, toxic)."""
    marks = (pick(labels, doc_id="long", quality="int", toxic="int").where(F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")))
    return audit(masks(docs), marks)
