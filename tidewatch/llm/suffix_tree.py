"""Language-model scores from a probabilistic suffix tree over words, with a word base line.

Symbols are words (A-Z lower-cased) and one end mark.  The root is the add-one word model of the base line.  A context of
d words is a state of the tree if it was seen `min_count` times, the context without its farthest word is a state (or the
root), and its next words diverge from what that shorter context predicts: leaving out one occurrence at a time, its own
distribution must make the training text likelier by `gain` (natural log).  So contexts grow word by word until the test
stops them; no length is fixed.

A state s predicts  P(w | s) = (n(s, w) + m(s) P(w | shorter s)) / (n(s) + a),  m(s) = a + the count of its rare next words.
Pairs seen fewer than `min_pair` times count as unseen, a is the value of `GRID` that does best in the test.  A word is
scored in its longest state: its score is that of the base line plus one ratio log P(w|s)/P(w|shorter s) for every state
on the way.  A word that training never saw has the base line's probability; all such words are one symbol.

Counts stay distributed and grow with the corpus.  Runs of words travel packed to buckets of pair hashes, so no context
owns a bucket.  For scoring, the base counts of the `head` most frequent words and the states seen most often (up to
`max_pairs` pairs) go to every task as sorted arrays; all other words and states are met in joins.  Two bit sets of fixed
size say where a join may find something.  Words and contexts are identified by 64-bit hashes.

Defined cases: null text is empty and consists of its end alone; a null id is not held out; without training rows every
base probability is one; repeated rows are scored each; very long texts are cut for counting at no place; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import joined
from .common import held_out, pick, stored

BATCH_BYTES = 3_000_000          # texts worked on at once
BASE = 0x9E3779B97F4A7C15        # of the polynomial that names contexts; the nearest word has power 0
END = np.uint64(0x5851F42D4C957F2D)
MARK_BITS = 25
GRID = (1.0, 8.0, 64.0, 512.0, 4096.0)
BLOCK = 8                        # depths counted in one pass over the texts
ROWS = 65_536
LONG = 64                        # bytes of words hashed together


def words_of(texts: pa.Array) -> pa.ListArray:
    """Words with A-Z lower-cased; empty strings may stand at the ends."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def word_names(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, eight bytes at a time for all of them at once; very long words one by one."""
    from xxhash import xxh64_intdigest
    if not len(words):
        return np.zeros(0, np.uint64)
    _, borders, data = words.buffers()
    borders = np.frombuffer(borders, np.int32 if pa.types.is_string(words.type) else np.int64)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    at, size = borders[:-1], np.diff(borders)
    bytes_ = np.zeros(borders[-1] - borders[0] + 8, np.uint8)
    bytes_[:-8] = np.frombuffer(data or b"", np.uint8)[borders[0]:borders[-1]]
    eights = np.ndarray(len(bytes_) - 7, "<u8", bytes_, strides=(1,))
    at = at - borders[0]
    with np.errstate(over="ignore"):
        out = size.astype(np.uint64) * np.uint64(BASE)
        left, own, place, name = size, np.arange(len(size)), at, out
        for _ in range(LONG // 8):
            if not len(own):
                break
            part = eights[place] & (np.uint64(2**64 - 1) >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)))
            name = mixed(name ^ part)
            out[own] = name
            more = left > 8
            left, own, place, name = left[more] - 8, own[more], place[more] + 8, name[more]
    for k in np.flatnonzero(size > LONG):
        out[k] = xxh64_intdigest(bytes_[at[k]:at[k] + size[k]])
    return out


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of each text and its end mark, end to end; borders between texts)."""
    cut = words_of(texts)
    sizes = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    words = cut.flatten()
    held = pc.not_equal(words, "").to_numpy(zero_copy_only=False).astype(bool)
    before = np.concatenate([[0], np.cumsum(held)])
    n = np.diff(before[np.concatenate([[0], np.cumsum(sizes)])])
    names = word_names(words.filter(pa.array(held)))
    borders = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(borders[-1], END)
    real = np.ones(len(out), bool)
    real[borders[1:] - 1] = False
    if len(names):
        out[real] = names
    return out, borders


def places(borders: np.ndarray) -> np.ndarray:
    """Position of each symbol in its text."""
    return np.arange(borders[-1]) - np.repeat(borders[:-1], np.diff(borders))


def longer(context: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """Names of contexts with a farther word in front, now `depth` words long."""
    return context + word * np.uint64(pow(BASE, depth - 1, 2**64))


def pair_name(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (context ^ (context >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def marked(names: DataFrame) -> np.ndarray:
    """A set of 2**25 bits that holds all names of a one-column table (and, by chance, others)."""
    bit = F.shiftrightunsigned(F.col(names.columns[0]), 64 - MARK_BITS)
    words = names.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({names.columns[0]}, {64 - MARK_BITS}) & 63 as int))").alias("mask"))
    got = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most 2**19 rows
    out = np.zeros(2**(MARK_BITS - 6), np.int64)
    out[got.column("word").to_numpy()] = got.column("mask").to_numpy()
    return out


def has(marks: np.ndarray, names: np.ndarray) -> np.ndarray:
    bit = (names >> np.uint64(64 - MARK_BITS)).astype(np.int64)
    return (marks[bit >> 6] >> (bit & 63)) & 1 == 1


def add_up(names: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct name, the sum of its counts), in order of the names."""
    order = np.argsort(names)
    names = names[order]
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
    return order[first], np.add.reduceat(n[order], first) if len(first) else n


def rows(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Numbers as record batches of bounded size; hashes as signed ones."""
    size = len(next(iter(columns.values())))
    for at in range(0, size, ROWS):
        part = {k: v[at:at + ROWS] for k, v in columns.items()}
        yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for v in part.values()], list(part))


def word_counts(texts: DataFrame, flush: int = 2_000_000) -> DataFrame:
    """(word, n): hashes of all words and the end mark of `texts` (text)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            word, n = (np.concatenate(x) for x in zip(*held))
            at, n = add_up(word, n)
            return word[at], n

        for part in joined(parts, BATCH_BYTES):
            held.append(np.unique(symbols(part.column(0))[0], return_counts=True))
            size += len(held[-1][0])
            if size > flush:
                held = [merged()]
                size = len(held[0][0])
                if size > flush // 2:
                    yield from rows({"word": held[0][0], "n": held[0][1]})
                    held, size = [], 0
        if held:
            word, n = merged()
            yield from rows({"word": word, "n": n})

    return texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


PACKED = "bucket int, depth int, contexts binary, sizes binary, nexts binary, times binary"
PAIRS = "depth int, context long, next long, n long"


def small(x: np.ndarray) -> bytes:
    """Bytes of small numbers, the mostly empty high bytes together."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unsmall(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def pair_counts(texts: DataFrame, first: int, last: int, frequent: np.ndarray, followers: np.ndarray, bigrams: np.ndarray | None, states: np.ndarray | None,
                n_buckets: int, min_pair: int, hot: np.ndarray = np.zeros(0, np.uint64)) -> DataFrame:
    """Contexts of `first`..`last` words and the words after them, seen `min_pair` times or more.

    Contexts with a rare word (not in `frequent`) or pair of neighbours (`bigrams`), and those that do not grow out of
    `states` of `first` - 1 words, cannot become states and are left out, as are next words too rare for a pair.
    A context goes to one bucket, so that a batch names it once; contexts of `hot` (sorted) words alone are spread over
    all buckets by their next words, since their rows may be more than a bucket should hold.
    """
    shared = texts.sparkSession.sparkContext.broadcast((frequent, followers, bigrams, states, hot))

    def packed(batch: pa.Array) -> Iterator[list[tuple]]:
        """The rows of each depth."""
        often, after_any, pairs, grown_from, everywhere = shared.value
        s, borders = symbols(batch)
        place = places(borders)
        at = np.flatnonzero(place >= 1)
        at = at[has(often, s[at - 1]) & has(after_any, s[at])]
        place, context = place[at], s[at - 1]
        is_hot = find(everywhere, s)[1]
        spread = is_hot[at - 1]
        for d in range(1, last + 1):
            with np.errstate(over="ignore"):
                if d > 1:
                    keep = place >= d
                    at, place, context, spread = at[keep], place[keep], context[keep], spread[keep]
                    keep = has(pairs, s[at - d + 1] + s[at - d] * np.uint64(BASE))
                    if d == first:
                        keep &= has(grown_from, context)
                    at, place = at[keep], place[keep]
                    context, spread = longer(context[keep], s[at - d], d), spread[keep] & is_hot[at - d]
                if d < first or not len(at):
                    continue
                out = []
                name = pair_name(context, s[at])
                one, n = add_up(name, np.ones(len(at), np.int64))
                own, after = context[one], s[at[one]]
                bucket = bucket_of(np.where(spread[one], name[one], mixed(own)), n_buckets)
                by = np.lexsort((own, bucket))
                cuts = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
                for b in np.flatnonzero(np.diff(cuts)):
                    order = by[cuts[b]:cuts[b + 1]]
                    c = own[order]
                    head = np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1])
                    out.append((int(b), d, c[head].tobytes(), small(np.diff(np.append(head, len(c)))), after[order].tobytes(), small(n[order])))
            yield out

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        for part in joined(parts, BATCH_BYTES):
            for out in packed(part.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], [f.split()[0] for f in PACKED.split(", ")])

    def total(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition is a bucket; counts of its rows are added up now and then."""
        held: list[tuple] = []
        size = 0

        def merged() -> tuple:
            own, after, depth, n = (np.concatenate(x) for x in zip(*held))
            with np.errstate(over="ignore"):
                one, n = add_up(pair_name(own + depth.astype(np.uint64), after), n)
            return own[one], after[one], depth[one], n

        limit = 2_000_000
        for part in parts:
            for row in part.to_pylist():
                own = np.repeat(np.frombuffer(row["contexts"], np.uint64), unsmall(row["sizes"]))
                held.append((own, np.frombuffer(row["nexts"], np.uint64), np.full(len(own), row["depth"], np.int32), unsmall(row["times"])))
                size += len(own)
            if size > limit:
                held = [merged()]
                size = len(held[0][0])
                limit = max(limit, 2 * size)
        if held:
            own, after, depth, n = merged()
            keep = n >= min_pair
            yield from rows({"depth": depth[keep], "context": own[keep], "next": after[keep], "n": n[keep]})

    return texts.mapInArrow(run, PACKED).repartitionById(n_buckets, F.col("bucket")).mapInArrow(total, PAIRS)


GROWN = "context long, parent long, total long"


def grown(pairs: DataFrame) -> DataFrame:
    """(context, parent, total) of the contexts that `pairs` (context, parent, next, n) are when read as one."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            own, up, word = (part.column(k).to_numpy().view(np.uint64) for k in range(3))
            with np.errstate(over="ignore"):
                yield pa.RecordBatch.from_arrays([pa.array((word + x * np.uint64(BASE)).view(np.int64)) for x in (own, up)] + [part.column(3)], ["context", "parent", "total"])

    return pairs.select("context", "parent", "next", "n").mapInArrow(run, GROWN)


def tested(pairs: DataFrame, gain: float, min_pair: int) -> tuple[DataFrame, DataFrame]:
    """(states: context, total, back; pairs: context, next, p, ratio) of `pairs` (context, next, n, total, above).

    `above` is the probability after the shorter context.  `back` is the log10 ratio of words a state has not seen.
    """
    pairs = stored(pairs)
    sums = pairs.groupBy("context").agg(F.sum("n").alias("known"), F.first("total").alias("total"))
    low = F.col("total") - F.col("known")  # occurrences of next words seen too seldom to be kept
    both = pairs.drop("total").join(sums, "context")

    def left_out(a: float):
        rest = F.col("total") - 1 + a
        kept = F.log(((F.col("n") - 1) / F.col("above") + a + low) / rest)
        dropped = F.log((a + low + min_pair - 1) / rest)
        return F.col("n") * F.when(F.col("n") > min_pair, kept).otherwise(dropped)

    gains = both.groupBy("context").agg(F.first("total").alias("total"), F.first("known").alias("known"), *[F.sum(left_out(a)).alias(f"g{i}") for i, a in enumerate(GRID)])
    best = F.greatest(*[F.struct((F.col(f"g{i}") + F.when(low > 0, low * F.log((a + low - 1) / (F.col("total") - 1 + a))).otherwise(0)).alias("gain"), F.lit(a).alias("a")) for i, a in enumerate(GRID)])
    states = gains.select("context", "total", "known", best.alias("best")).where(F.col("best.gain") >= gain)
    mass = F.col("best.a") + low
    states = stored(states.select("context", "total", F.col("best.a").alias("a"), mass.alias("mass"), F.log10(mass / (F.col("total") + F.col("best.a"))).alias("back")))
    p = (F.col("n") + F.col("mass") * F.col("above")) / (F.col("total") + F.col("a"))
    probs = pairs.drop("total").join(states, "context").select("context", "next", "total", p.alias("p"), F.log10(p / F.col("above")).alias("ratio"))
    return states.select("context", "total", "back"), stored(probs)


def learn(texts: DataFrame, words: DataFrame, n_all: int, v_all: int, gain: float, min_count: int, min_pair: int, n_buckets: int,
          hot: np.ndarray) -> tuple[DataFrame, DataFrame, int]:
    """(states, pairs, depth of the tree) from the training texts and their word counts."""
    common = stored(words.where(F.col("n") >= min(min_pair, min_count)))
    frequent, followers = marked(common.where(F.col("n") >= min_count).select("word")), marked(common.where(F.col("n") >= min_pair).select("word"))
    counts = stored(pair_counts(texts, 1, 1, frequent, followers, None, None, n_buckets, min_pair, hot))
    seen = common.where(F.col("n") >= min_count).select(F.col("word").alias("context"), F.lit(0).cast("long").alias("parent"), F.col("n").alias("total"))
    above = common.select(F.col("word").alias("next"), ((F.col("n") + 1) / F.lit(float(n_all + v_all + 1))).alias("above"))
    before = counts.join(seen.select("context", "parent", "total"), "context")
    candidates = before.join(above, "next").select("context", "next", "n", "total", "above")
    bigrams = None
    all_states, all_pairs, depth, counted = [], [], 0, 1
    while True:
        states, pairs = tested(candidates, gain, min_pair)
        if states.isEmpty():
            break
        depth += 1
        all_states.append(states)
        all_pairs.append(pairs)
        seen = stored(grown(before.where(F.col("n") >= min_count)))
        if depth == 1:
            bigrams = marked(seen.select("context"))
        if depth == counted:
            counts = stored(pair_counts(texts, depth + 1, depth + BLOCK, frequent, followers, bigrams, marked(states.select("context")), n_buckets, min_pair, hot))
            counted = depth + BLOCK
        above = pairs.select(F.col("context").alias("parent"), "next", F.col("p").alias("above"))
        before = stored(counts.where(F.col("depth") == depth + 1).select("context", "next", "n").join(seen, "context"))
        candidates = before.join(above, ["parent", "next"]).select("context", "next", "n", "total", "above")
    if not depth:
        return states, pairs, 0
    for more in all_states[1:]:
        all_states[0] = all_states[0].unionByName(more)
    for more in all_pairs[1:]:
        all_pairs[0] = all_pairs[0].unionByName(more)
    return all_states[0], all_pairs[0].select("context", "next", "total", "ratio"), depth


def cut_at(table: DataFrame, value: str, limit: int) -> tuple[float, int]:
    """The least `value` such that at most `limit` rows have it or more, on a scale of 64 steps an octave; how many have less."""
    step = F.floor(F.log2(F.col(value)) * 64)
    bars = table.where(F.col(value) > 0).groupBy(step.alias("step")).count().collect()  # one row per 1/64 octave
    cut, total = float("inf"), 0
    for bar in sorted(bars, key=lambda r: -r["step"]):
        total += bar["count"]
        if total > limit:
            break
        cut = bar["step"]
    return cut, sum(b["count"] for b in bars if b["step"] < cut)


def above_cut(value: str, cut: float):
    return F.floor(F.log2(F.col(value)) * 64) >= F.lit(cut)


@dataclass
class Tables:
    """What every task gets: sorted hashes with their numbers, and the marks of all other states."""
    words: np.ndarray
    word_logs: np.ndarray
    states: np.ndarray
    backs: np.ndarray
    pairs: np.ndarray
    ratios: np.ndarray
    others: np.ndarray | None
    depth: int


def sorted_by(names: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(names)
    return names[order], *[v[order] for v in values]


def collected(table: DataFrame, of_pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(sorted names, their numbers) of (name, next, x) rows, named and packed in the tasks: 16 bytes a row come to the driver."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in joined(parts, 1_000_000):
            first, second = (part.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            with np.errstate(over="ignore"):
                names = pair_name(first, second) if of_pairs else first
            yield pa.RecordBatch.from_arrays([pa.array([names.tobytes()]), pa.array([part.column(2).to_numpy().tobytes()])], ["names", "x"])

    got = table.mapInArrow(run, "names binary, x binary").toArrow()
    names, x = (np.concatenate([np.zeros(0, kind), *[np.frombuffer(v.as_buffer(), kind) for v in got.column(c)]]) for c, kind in (("names", np.uint64), ("x", np.float64)))
    del got
    order = np.argsort(names).astype(np.uint32)
    return names[order], x[order]


def find(names: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in the sorted `names`, whether it is there)."""
    if not len(names):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
    return at, names[at] == asked


def walk(s: np.ndarray, borders: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum of log ratios of each symbol's states that are here; symbol and context of states that may be elsewhere)."""
    gained = np.zeros(len(s))
    at = np.flatnonzero(places(borders) >= 1)
    place, context = places(borders)[at], np.zeros(len(at), np.uint64)
    far_at, far = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    here = np.ones(len(at), bool)
    for d in range(1, t.depth + 1):
        keep = place >= d
        at, place, here = at[keep], place[keep], here[keep]
        context = longer(context[keep], s[at - d], d)
        k, is_state = find(t.states, context)
        here = here & is_state
        j, seen = find(t.pairs, pair_name(context[here], s[at[here]]))
        gained[at[here]] += np.where(seen, t.ratios[j] if len(t.ratios) else 0.0, t.backs[k[here]] if len(t.backs) else 0.0)
        maybe = ~here & has(t.others, context) if t.others is not None else np.zeros(len(at), bool)
        far_at.append(at[maybe])
        far.append(context[maybe])
        keep = here | maybe
        at, place, context, here = at[keep], place[keep], context[keep], here[keep]
    return gained, np.concatenate(far_at), np.concatenate(far)


ASKED = ("kind int, what int, bucket int, batch long, place int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, gained double, "
         "places binary, first binary, second binary")
STATE, PAIR, WORD = 0, 1, 2
ROWS_ASKED = 64  # packed rows of an Arrow batch
QUESTIONS = 32_768  # of a packed row
BYTES_ASKED = 2_000_000  # of an Arrow batch


def bucket_of(names: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((names >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def packed_by_bucket(what: int, owner: np.ndarray, first: np.ndarray, second: np.ndarray, n_buckets: int) -> list[tuple]:
    """(what, bucket, places, first, second): questions about hashes, entries of bounded size per bucket of `first`."""
    bucket = bucket_of(first, n_buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    out = []
    for b in np.flatnonzero(np.diff(cuts)):
        for at in range(cuts[b], cuts[b + 1], QUESTIONS):
            own = order[at:min(at + QUESTIONS, cuts[b + 1])]
            out.append((what, int(b), small(owner[own]), first[own].tobytes(), second[own].tobytes() if len(second) else b""))
    return out


def by_bytes(packed: list[tuple]) -> Iterator[list[tuple]]:
    """Packed questions in lists of bounded bytes and length."""
    held, size = [], 0
    for entry in packed:
        held.append(entry)
        size += sum(map(len, entry[2:]))
        if size >= BYTES_ASKED or len(held) == ROWS_ASKED:
            yield held
            held, size = [], 0
    if held:
        yield held


def answered(asked: DataFrame, states: DataFrame, pairs: DataFrame, words: DataFrame, n_buckets: int) -> DataFrame:
    """(batch, places, base, known, gained) of the packed questions, summed per place.

    A bucket's part of the tables comes first and is held as sorted arrays; questions stream past.
    """
    number = F.floor(F.shiftrightunsigned("a", 32) * n_buckets / F.lit(2.0**32)).cast("int")
    none = [F.lit(None).cast(k).alias(n) for n, k in (("batch", "long"), ("places", "binary"), ("first", "binary"), ("second", "binary"))]

    def table(df: DataFrame, what: int, a: str, b, x) -> DataFrame:
        return df.select(F.col(a).alias("a"), b.alias("b"), x.cast("double").alias("x")).select(number.alias("bucket"), F.lit(0).alias("kind"), F.lit(what).alias("what"), "a", "b", "x", *none)

    zero = F.lit(0).cast("long")
    rows_ = (table(states, STATE, "context", zero, F.col("back")).unionByName(table(pairs, PAIR, "context", F.col("next"), F.col("ratio")))
             .unionByName(table(words, WORD, "word", zero, F.log10(F.col("n") + 1.0))))
    own = [F.lit(None).cast(k).alias(n) for n, k in (("a", "long"), ("b", "long"), ("x", "double"))]
    rows_ = rows_.unionByName(asked.select("bucket", F.lit(1).alias("kind"), "what", *own, "batch", "places", "first", "second"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        found = None

        def tables() -> dict:
            what, a, b, x = (np.concatenate(c) for c in zip(*held)) if held else (np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0))
            with np.errstate(over="ignore"):
                name = np.where(what == PAIR, pair_name(a, b), a)
            return {k: sorted_by(name[what == k], x[what == k]) for k in (STATE, PAIR, WORD)}

        for part in parts:
            kind = part.column(1).to_numpy()
            n = int((kind == 0).sum())
            if n:
                t = part.slice(0, n)
                held.append((t.column(2).to_numpy(), t.column(3).to_numpy().view(np.uint64), t.column(4).to_numpy().view(np.uint64), t.column(5).to_numpy()))
            if n == part.num_rows:
                continue
            if found is None:
                found = tables()
                held = []
            out = []
            for what, batch, places_, first, second in zip(*[part.column(c).slice(n).to_pylist() for c in (2, 6, 7, 8, 9)]):
                owner, key = unsmall(places_), np.frombuffer(first, np.uint64)
                # Nothing is sent about what a question does not ask.
                if what == WORD:
                    at, there = find(found[WORD][0], key)
                    owner, base = owner[there], found[WORD][1][at[there]]
                else:
                    at, there = find(found[STATE][0], key)
                    owner, key, after, back = owner[there], key[there], np.frombuffer(second, np.uint64)[there], found[STATE][1][at[there]]
                    with np.errstate(over="ignore"):
                        at, seen = find(found[PAIR][0], pair_name(key, after))
                    gained = np.where(seen, found[PAIR][1][at] if len(found[PAIR][1]) else 0.0, back)
                if len(owner):
                    own, codes = np.unique(owner, return_inverse=True)
                    out.append((batch, small(own), *((np.bincount(codes, base).tobytes(), small(np.bincount(codes)), b"") if what == WORD else (b"", b"", np.bincount(codes, gained).tobytes()))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64() if i == 0 else pa.binary()) for i in range(5)], ["batch", "places", "base", "known", "gained"])

    return (rows_.select("bucket", "kind", "what", "a", "b", "x", "batch", "places", "first", "second").repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions("kind")
            .mapInArrow(run, "batch long, places binary, base binary, known binary, gained binary"))


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, gained double"


def put_together(scored: DataFrame, more: DataFrame) -> DataFrame:
    """Documents of each batch with the answers to their batch's questions added."""
    docs = scored.where(F.col("kind") == 0).select("batch", "kind", "place", "doc_id", "held_out", "n_tokens", "n_known", "base", "gained",
                                                   *[F.lit(None).cast("binary").alias(n) for n in ("places", "m_base", "m_known", "m_gained")])
    extra = more.select("batch", F.lit(1).alias("kind"), *[F.lit(None).cast(k).alias(n) for n, k in (("place", "int"), ("doc_id", "long"), ("held_out", "boolean"), ("n_tokens", "long"),
                                                                                                  ("n_known", "long"), ("base", "double"), ("gained", "double"))],
                        "places", F.col("base").alias("m_base"), F.col("known").alias("m_known"), F.col("gained").alias("m_gained"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, add = None, [], None
        names = [f.split()[0] for f in RESULT.split(", ")]

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held)
                place = t.column("place").to_numpy()
                base, known, gained = (x[place] for x in add)
                yield from pa.table([t.column("doc_id"), t.column("held_out"), t.column("n_tokens"), pa.array(t.column("n_known").to_numpy() + known.astype(np.int64)),
                                     pa.array(t.column("base").to_numpy() + base), pa.array(t.column("gained").to_numpy() + gained)], names).combine_chunks().to_batches()

        for part in parts:
            keys = part.column(0).to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if keys[a] != at:
                    yield from flush()
                    at, held, add = keys[a], [], None
                piece = part.slice(a, b - a)
                kind = piece.column(1).to_numpy()
                n = int((kind == 0).sum())
                if n:
                    held.append(piece.slice(0, n).select(["place", "doc_id", "held_out", "n_tokens", "n_known", "base", "gained"]))
                    top = int(piece.column("place").slice(0, n).to_numpy().max()) + 1
                    size = max(top, len(add[0]) if add else 0)
                    add = tuple(np.concatenate([x, np.zeros(size - len(x))]) for x in (add or (np.zeros(0),) * 3))
                for places_, base, known, gained in zip(*[piece.column(c).slice(n).to_pylist() for c in ("places", "m_base", "m_known", "m_gained")]):
                    own = unsmall(places_)
                    for x, value in zip(add, (np.frombuffer(base), unsmall(known), np.frombuffer(gained))):
                        if len(value):
                            x[own] += value
        yield from flush()

    return docs.unionByName(extra).repartition("batch").sortWithinPartitions("batch", "kind", "place").mapInArrow(run, RESULT)


def score(docs: DataFrame, gain: float = 5.0, min_count: int = 100, min_pair: int = 4, max_pairs: int = 2_500_000, head: int = 1_000_000,
          words_per_bucket: int = 1_000_000, rows_per_bucket: int = 500_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of `docs`."""
    spark = docs.sparkSession
    docs = pick(docs, doc_id="long", text="string").withColumn("held_out", held_out(F.col("doc_id"), 7, 2))
    texts = docs.where(~F.col("held_out")).select(F.coalesce("text", F.lit("")).alias("text"))
    words = stored(word_counts(texts))
    told = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = int(told["n"]), int(told["v"])
    floor = float(np.log10(1 / (n_all + v_all + 1)))
    n_buckets = max(1, -(-n_all // words_per_bucket))
    # At most 10 words a bucket.
    hot = np.sort(words.where(F.col("n") > words_per_bucket // 10).select("word").toArrow().column("word").to_numpy().view(np.uint64))
    states, pairs, depth = learn(texts, words, n_all, v_all, gain, min_count, min_pair, n_buckets, hot)

    (often, rare_words), (cut, rare_pairs) = cut_at(words, "n", head), cut_at(pairs, "total", max_pairs)
    other_states, other_pairs = states.where(~above_cut("total", cut)), pairs.where(~above_cut("total", cut))
    n_other = other_states.count()
    # Questions are dealt by the tables they are put to, not by how many they are: a batch's answers are summed per document and bucket.
    n_buckets = max(1, -(-(rare_words + rare_pairs + n_other) // rows_per_bucket))
    shared = spark.sparkContext.broadcast(Tables(
        *collected(words.where(above_cut("n", often)).select("word", F.lit(0).cast("long").alias("next"), F.log10(F.col("n") + 1.0).alias("x"))),   # bounded by head
        *collected(states.where(above_cut("total", cut)).select("context", F.lit(0).cast("long").alias("next"), F.col("back").alias("x"))),         # each has a pair
        *collected(pairs.where(above_cut("total", cut)).select("context", "next", F.col("ratio").alias("x")), True),                                # bounded by max_pairs
        marked(other_states.select("context")) if n_other else None, depth))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid
        t = shared.value
        empty = np.zeros(0, np.uint64)
        fields = [f.split() for f in ASKED.split(", ")]
        kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
        for part in joined(parts, BATCH_BYTES):
            with np.errstate(over="ignore"):
                s, borders = symbols(part.column(2))
                gained, far_at, far = walk(s, borders, t)
            n = len(borders) - 1
            if not n:
                continue
            owner = np.repeat(np.arange(n), np.diff(borders))
            own, codes = np.unique(s, return_inverse=True)
            k, known = find(t.words, own)
            logs = np.where(known, t.word_logs[k] if len(t.word_logs) else 0.0, 0.0)[codes]
            known = known[codes]
            batch, rare = uuid.uuid4().int >> 65, np.flatnonzero(~known)
            columns = {"kind": np.zeros(n, np.int32), "batch": np.full(n, batch), "place": np.arange(n, dtype=np.int32), "doc_id": part.column(0), "held_out": part.column(1), "n_tokens": np.diff(borders),
                       "n_known": np.bincount(owner, known, n).astype(np.int64), "base": np.bincount(owner, logs, n) + np.diff(borders) * floor, "gained": np.bincount(owner, gained, n)}
            yield pa.RecordBatch.from_arrays([pa.array(columns[f]) if f in columns else pa.nulls(n, kinds[kind]) for f, kind in fields], [f for f, _ in fields])
            asked = packed_by_bucket(WORD, owner[rare], s[rare], empty, n_buckets) + packed_by_bucket(STATE, owner[far_at], far, s[far_at], n_buckets)
            for asked in by_bytes(asked):
                m = len(asked)
                columns = {"kind": pa.array(np.ones(m, np.int32)), "batch": pa.array(np.full(m, batch))}
                columns |= {f: pa.array([q[i] for q in asked], kinds[kind]) for i, (f, kind) in enumerate((("what", "int"), ("bucket", "int"), ("places", "binary"), ("first", "binary"), ("second", "binary")))}
                yield pa.RecordBatch.from_arrays([columns[f] if f in columns else pa.nulls(m, kinds[kind]) for f, kind in fields], [f for f, _ in fields])

    # Written once: the batches' names are the same for both readers below.
    scored = stored(docs.select("doc_id", "held_out", "text").mapInArrow(run, ASKED))
    more = answered(scored.where(F.col("kind") == 1), other_states, other_pairs, words.where(~above_cut("n", often)), n_buckets)
    return put_together(scored, more).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score",
                                             (F.col("base_score") + F.col("gained")).alias("score"))
