"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct lower-cased words and their beginnings of four to six letters (so that inflected insults share
terms), hashed into 2**bits columns.  Besides a weight, every column has a vector of `factors` numbers, and each pair of
columns in a text adds the product of their vectors: an insult may weigh more beside the mention of a group.

Only columns whose presence differs between the classes (likelihood-ratio test at `least`) take part; the thousands of
chance words of a text would otherwise be learned by heart.

The model is fitted on a bounded sample of labelled documents, `max_rows` per class in order of the hash of their id
(logistic loss, mini-batches, AdaGrad); every document is scored.

Defined cases: null and empty texts have no terms and get the score of the intercept; several labels of a document count
as toxic if one is; labels without value or without document are left out; without both classes the score is the share of
toxic labels (0 without labels); a null id is never held out; texts of any length are scored whole; other columns pass
through `score` untouched unless they are called score or predicted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import gather
from .common import held_out, pick

NOT_WORD = "[^\\pL\\pM]+"


@dataclass
class Model:
    bias: float
    weights: np.ndarray      # columns
    factors: np.ndarray      # columns x factors
    bits: int

    def scores(self, columns: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Probability of each text, given the columns of all texts end to end."""
        out = np.full(len(ends) - 1, self.bias)
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            if b > a:
                own = np.unique(columns[a:b])
                v = self.factors[own]
                s = v.sum(axis=0)
                out[k] += self.weights[own].sum() + 0.5 * (s @ s - (v * v).sum())
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


class Terms:
    """Columns of texts, with a bounded memory of words seen."""

    def __init__(self, bits: int, remember: int = 60_000):
        self.mask, self.remember, self.seen = (1 << bits) - 1, remember, {}

    def of_word(self, word: str) -> bytes:
        cut = {word, *[word[:n] + "*" for n in (4, 5, 6) if len(word) >= n]}
        return np.array([zlib.crc32(c.encode("utf-8", "surrogatepass")) & self.mask for c in sorted(cut)], "<u4").tobytes()

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(columns of all texts, possibly repeated; borders)."""
        cut = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), NOT_WORD, " "))
        sizes = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        if len(self.seen) > self.remember:
            self.seen = {}
        values = []
        for word in coded.dictionary.to_pylist():
            found = self.seen.get(word)
            if found is None:
                found = self.seen[word] = self.of_word(word) if word else b""
            values.append(found)
        columns, lengths = gather(values, coded.indices.to_numpy(zero_copy_only=False))
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])]
        return columns.astype(np.int64), ends


_TERMS: dict[int, Terms] = {}


def terms(bits: int) -> Terms:
    return _TERMS.setdefault(bits, Terms(bits))


def marked(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of all labels that may be learned from."""
    return (pick(labels, doc_id="long", toxic="int").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)
                                                           & ~held_out(F.col("doc_id"), 5, 0))
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, toxic) of at most `max_rows` labelled documents per class, in order of the hash of their id."""
    marks = marked(labels)
    some = [marks.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for value in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # at most 2 * max_rows rows of two numbers
    return pick(docs, doc_id="long", text="string").join(chosen, "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, bits: int = 18, factors: int = 8, epochs: int = 6,
        rate: float = 0.1, batch: int = 64, ridge: float = 1e-4, least: float = 12.0, seed: int = 17) -> Model:
    """Fit on `docs` (doc_id, text) and `labels` (doc_id, toxic); labels of held-out documents are not read."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = terms(bits)
        for part in parts:
            columns, ends = own.texts(part.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([np.unique(columns[a:b]).astype("<u4").tobytes() for a, b in zip(ends, ends[1:])], pa.binary()),
                                              part.column(1)], ["columns", "toxic"])

    got = sample(docs, labels, max_rows).mapInArrow(run, "columns binary, toxic int").toArrow()  # bounded by max_rows
    y = got.column("toxic").to_numpy().astype(float)
    rows = [np.frombuffer(b, "<u4").astype(np.int64) for b in got.column("columns").to_pylist()]
    order = sorted(range(len(rows)), key=lambda k: (rows[k].tobytes(), y[k]))  # Spark's order is not fixed
    rows, y = [rows[k] for k in order], y[order]
    size = 1 << bits
    rng = np.random.default_rng(seed)
    share = y.mean() if len(y) else 0.0
    if not 0 < share < 1:
        return Model(40.0 if share == 1 else -40.0, np.zeros(size), np.zeros((size, factors)), bits)
    telling = np.flatnonzero(likelihood_ratio(rows, y, size) >= least)
    chosen = np.zeros(size, bool)
    chosen[telling] = True
    rows = [r[chosen[r]] for r in rows]
    w, v, bias = np.zeros(size), rng.normal(0, 0.01, (size, factors)), float(np.log(share / (1 - share)))
    v[~chosen] = 0
    gw, gv, gb = np.full(size, 1e-8), np.full((size, factors), 1e-8), 1e-8
    for _ in range(epochs):
        turn = rng.permutation(len(rows))
        for at in range(0, len(turn), batch):
            part = turn[at:at + batch]
            sizes = np.array([len(rows[k]) for k in part])
            columns = np.concatenate([rows[k] for k in part])
            if not len(columns):
                continue
            owner = np.repeat(np.arange(len(part)), sizes)
            vx = v[columns]
            total = np.stack([np.bincount(owner, vx[:, f], len(part)) for f in range(factors)], axis=1)
            squares = np.bincount(owner, (vx * vx).sum(axis=1), len(part))
            z = bias + np.bincount(owner, w[columns], len(part)) + 0.5 * ((total * total).sum(axis=1) - squares)
            slope = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[part]
            own, back = np.unique(columns, return_inverse=True)
            step = np.bincount(back, slope[owner], len(own)) / len(part) + ridge * w[own]
            gw[own] += step * step
            w[own] -= rate * step / np.sqrt(gw[own])
            pull = slope[owner, None] * (total[owner] - vx)
            step = np.stack([np.bincount(back, pull[:, f], len(own)) for f in range(factors)], axis=1) / len(part) + ridge * v[own]
            gv[own] += step * step
            v[own] -= 0.1 * rate * step / np.sqrt(gv[own])
            gb += slope.mean() ** 2
            bias -= rate * slope.mean() / np.sqrt(gb)
    # The classes are sampled at rates of their own; the bias goes back to the shares of all labels.
    found = {r["toxic"]: r["count"] for r in marked(labels).groupBy("toxic").count().collect()}
    rates = [min(1.0, max_rows / found[c]) for c in (0, 1)]
    bias -= float(np.log(rates[1] / rates[0]))
    return Model(bias, w.astype(np.float32), v.astype(np.float32), bits)


def likelihood_ratio(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Per column 2 ln of how much better two class-wise shares of texts explain its presence than one."""
    both = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    in_one = np.bincount(np.concatenate([r for r, t in zip(rows, y) if t > 0]), minlength=size).astype(float)
    in_all = np.bincount(both, minlength=size).astype(float)
    n_one, n_all = float(y.sum()), float(len(y))

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0)

    share = in_all / n_all
    in_zero, n_zero = in_all - in_one, n_all - n_one
    return 2 * (part(in_one, n_one * share) + part(in_zero, n_zero * share)
                + part(n_one - in_one, n_one * (1 - share)) + part(n_zero - in_zero, n_zero * (1 - share)))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of `docs`, with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits columns
    names = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    at = names.index(text)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        own = terms(model.bits)
        for part in parts:
            p = model.scores(*own.texts(part.column(at)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                             [*names, "score", "predicted"])
        # Python workers outlive the task: hand back what the next stage's JVM needs.
        del model
        own.seen.clear()
        pa.default_memory_pool().release_unused()

    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    return rows.mapInArrow(run, rows.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit(docs, labels)
    rows = pick(docs, doc_id="long", text="string").select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "text")
    return score(rows, model).select("doc_id", "held_out", "score", "predicted")
