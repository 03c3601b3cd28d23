"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams (one to three letters, words padded by one blank on either side) of a
language in order of frequency.  A document is compared by its own list: each of its n-grams costs the distance between
its two ranks, and a fixed penalty where the language does not list it; the language with the smallest sum wins.

Counting is one pass that leaves one row per n-gram, language and task, summed by Spark; the profiles (a fixed number of
n-grams per language, and at most `max_languages` languages) then travel to every task.

Defined cases: null text, or text without a letter, is `und` with score 0, as is everything when nothing can be
learned; a null id is never held out; equal frequencies are ordered by n-gram, equal distances by language name; texts of
any length are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import joined
from .common import held_out, pick

BITS = 21                     # of a code point; three of them make one key
UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool))
    return _LETTERS[0]


def codes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all lower-cased texts, 0 for what is no letter, a 0 after each text; the texts' ends)."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("\0".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in low]) if low else np.zeros(0, np.int64)
    return np.where(letters()[codes], codes, 0).astype(np.int64), ends


def grams(codes: np.ndarray) -> np.ndarray:
    """Keys of all n-grams of a run of code points that begins and ends with 0."""
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    one = codes[codes > 0]
    two = (codes[:-1] << BITS) | codes[1:]
    two = two[(codes[:-1] > 0) | (codes[1:] > 0)] | (1 << 3 * BITS - 1)   # a mark keeps (blank, x) apart from the letter x
    three = ((a << 2 * BITS - 1) | (b << BITS) | c)[b > 0]
    return np.concatenate([one, two, three | np.int64(-2**63)])


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(grams(codes))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def learn(docs: DataFrame, size: int = 300, max_languages: int = 1000) -> list[tuple[str, np.ndarray]]:
    """(language, its `size` most frequent n-grams in order) from `docs` (text, lang)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for part in joined(parts):
            by: dict[str, list[str]] = {}
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                codes, _ = codes_of(texts)
                keys, counts = counted(np.concatenate([[0], codes]))
                if lang in held:
                    keys, counts = summed(*map(np.concatenate, zip(held[lang], (keys, counts))))
                held[lang] = keys, counts
            if sum(len(k) for k, _ in held.values()) > 1_000_000:
                yield from rows(held)
                held = {}
        yield from rows(held)

    def rows(held):
        for lang, (keys, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])

    counts = (pick(docs, text="string", lang="string").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
              .mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    profile = top.select("lang", "gram", "rank").limit(size * max_languages + 1).toArrow().to_pylist()
    if len(profile) > size * max_languages:
        raise ValueError(f"more than {max_languages} languages")
    found: dict[str, list] = {}
    for row in sorted(profile, key=lambda r: (r["lang"], r["rank"])):
        found.setdefault(row["lang"], []).append(row["gram"])
    return [(lang, np.array(g, np.int64)) for lang, g in found.items()]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Profiles:
    """The profiles side by side: for every listed n-gram its rank in each language."""

    def __init__(self, profiles: list[tuple[str, np.ndarray]], size: int):
        self.size, self.langs = size, [lang for lang, _ in profiles]
        self.keys = np.unique(np.concatenate([g for _, g in profiles])) if profiles else np.zeros(0, np.int64)
        # The last row stands for n-grams that no language lists.
        self.ranks = np.full((len(self.keys) + 1, len(profiles)), -1, np.int64)
        for k, (_, g) in enumerate(profiles):
            self.ranks[np.searchsorted(self.keys, g), k] = np.arange(len(g))

    def best(self, codes: np.ndarray) -> tuple[str, float]:
        """Language and score of one text: 1 at equal lists, 0 where no n-gram is listed."""
        if not codes.any() or not self.langs:
            return UNKNOWN, 0.0
        keys, counts = counted(codes)
        if len(keys) > self.size:
            least = np.partition(counts, -self.size)[-self.size]
            some = counts >= least
            keys, counts = keys[some], counts[some]
        order = np.lexsort((keys, -counts))[:self.size]
        keys = keys[order]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.ranks[np.where(self.keys[at] == keys, at, len(self.keys))]
        cost = np.where(known < 0, self.size, np.abs(known - np.arange(len(keys))[:, None])).sum(axis=0)
        win = int(cost.argmin())
        return self.langs[win], float(1 - cost[win] / (self.size * len(keys)))


def predict(docs: DataFrame, profiles: list[tuple[str, np.ndarray]], size: int = 300) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of `docs` (doc_id, held_out, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((profiles, size))  # at most `size` n-grams per language

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Profiles(*shared.value)
        for part in parts:
            codes, ends = codes_of(part.column(2).to_pylist())
            codes = np.concatenate([[0], codes])
            found = [own.best(codes[a:b + 1]) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)] if len(ends) else []
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, size: int = 300) -> DataFrame:
    """Learn from the rows not held out, predict all."""
    rows = pick(docs, doc_id="long", text="string", lang="string").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    profiles = learn(rows.where(~F.col("held_out")).select("text", "lang"), size)
    return predict(rows.select("doc_id", "held_out", "text"), profiles, size)
