"""Filter audit, repeated passages and hard negatives against brute force."""

import hashlib
import itertools
import math
import random
import re

import pytest

from tidewatch.llm import filter_audit, hard_negatives, queries, repeats
from tidewatch.llm.common import ready


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_repeats(rows, size):
    """(doc_id, n_words, n_removed, digest) with the smallest document of every window in a dict."""
    first = {}
    for i, t in rows:
        if i is not None:
            w = words(t)
            for p in range(len(w) - size + 1):
                key = tuple(w[p:p + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - size + 1 if i is not None else 0):
            if first[tuple(w[p:p + size])] < i:
                gone.update(range(p, p + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passages(rnd, n, size, copies):
    """Texts that share passages of about `size` words at all offsets, copies, chains and self-repeats."""
    shared = [[f"p{rnd.randrange(10**6)}" for _ in range(size + d)] for d in range(-3, 9)]
    rows, at = [], 0
    for _ in range(n):
        text = []
        for _ in range(rnd.randint(0, 5)):
            text += [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, size))] + rnd.choice(shared)
            if rnd.random() < 0.2:
                a, b = sorted((rnd.randrange(len(text)), rnd.randrange(len(text))))
                text += text[a:b]
        rows.append((at, rnd.choice([" ", "\n", " \t"]).join(text)))
        at += rnd.randint(1, 3)
    rows += [(at + 10 + k, rows[k % 5][1]) for k in range(copies)]
    rows += [(at + 500, None), (at + 501, ""), (at + 502, " \n"), (at + 503, "v " * 3000), (at + 504, "v " * 60), (None, rows[1][1]), (None, None), (rows[4][0], rows[4][1]),
             (rows[3][0], "own " + rows[4][1])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("size, block, per_bucket", [(50, 25, 2_000_000), (10, 5, 500), (7, 4, 300)])
def test_repeats_against_brute_force(spark, size, block, per_bucket, monkeypatch):
    ready(spark)
    monkeypatch.setattr(repeats, "CHUNK", 3000)
    rows = passages(random.Random(size), 120, size, 40)
    docs = spark.createDataFrame([(t, i, "x", 1) for i, t in rows], "text string, doc_id long, rep string, d1 int")
    plain = repeats.find
    monkeypatch.setattr(repeats, "find", lambda *a, **k: plain(*a, **{**k, "words_per_bucket": per_bucket}))
    got = repeats.repeat_digests(docs, size, block)
    spans = {(r["doc_id"], r["kept_sha256"]): (r["n_removed"], r["spans"]) for r in got.collect()}
    assert all(n == sum(s["end"] - s["start"] for s in found) for n, found in spans.values())
    want = brute_repeats(rows, size)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == want
    assert sum(w[2] > 0 for w in want) > 60 and any(0 < w[2] < w[1] for w in want)
    left = repeats.drop_repeats(docs, size, block)
    assert left.columns == [*docs.columns, "n_removed"]
    assert sorted(((r["doc_id"], r["n_removed"], hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest()) for r in left.collect()), key=str) == \
        sorted(((i, n, d) for i, _, n, d in want), key=str)


def test_repeats_of_nothing(spark):
    ready(spark)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.repeat_digests(docs).collect() == []
    with pytest.raises(ValueError):
        repeats.repeat_digests(docs, 50, 26)


def test_hot_passage_is_one_row_a_task(spark):
    """A passage in every document: hits are settled where they are seen."""
    ready(spark)
    hot = " ".join(f"h{k}" for k in range(60))
    rows = [(i, " ".join(f"u{i}x{k}" for k in range(i % 30)) + " " + hot) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    runs = docs.select("doc_id", F_flat()).mapInArrow(repeats.probes(25, 1), repeats.PACKED).where("kind = 0").collect()
    sent = sum(len(r["keys"]) // 4 for r in runs)
    own = sum(max(0, i % 30 + 60 - 24) - 36 for i in range(400))
    assert sent <= own + 36 + 400
    got = {r["doc_id"]: r["n_removed"] for r in repeats.repeat_digests(docs).collect()}
    assert got[0] == 0 and all(got[i] == 60 for i in range(1, 400))


def F_flat():
    from pyspark.sql import functions as F
    return repeats.flat(F.col("text")).alias("text")


def brute_audit(rows, marks):
    seen, docs = {}, []
    for i, _, t in rows:
        if i is not None:
            seen[t or ""] = min(seen.get(t or "", i), i)
    for i, lang, t in rows:
        t = t or ""
        w = words(t)
        fails = {f for f, c in {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                                "D": re.search(r"[#$%&*|]", t), "E": i is not None and i > seen[t]}.items() if c}
        docs.append((lang or "", fails, *marks.get(i, (False, False))))
    out = []
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        found = []
        for order in itertools.permutations("ABCDE"):
            alive = own
            for k, f in enumerate(order):
                here = [d for d in alive if f in d[1]]
                alive = [d for d in alive if f not in d[1]]
                total[f] += len(here)
                found.append(("".join(order), k + 1, len(alive), len(here), sum(f in d[1] for d in own) - len(here), sum(d[1] == {f} for d in own),
                              sum(d[2] for d in here), sum(d[3] for d in here)))
        out += [(part, *r, total[r[0][r[1] - 1]]) for r in found]
    return sorted(out)


def test_filter_audit_against_brute_force(spark):
    ready(spark)
    rnd, rows = random.Random(4), []
    kinds = ["w%d " * 1, "A b ", "x# ", "same "]
    for i in range(150):
        n = rnd.choice([0, 3, 199, 200, 201, 400])
        kind = rnd.choice(kinds)
        t = "".join(kind.replace("%d", str(k if rnd.random() < 0.6 else 0)) for k in range(n))
        rows.append((i, rnd.choice(["en", "de", None, ""]), t))
    rows += [(200 + k, "fr", rows[k][2]) for k in range(30)] + [(300, "en", None), (301, None, ""), (None, "en", rows[3][2]), (None, "de", None)]
    rows += [rows[7], (303, "en", "x" * 200_000), (304, "en", "Ü" * 10 + " ÀB"), (305, "en", " \n\t")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(100)] + [(7, 1, 0), (7, 0, 1), (9999, 1, 1), (None, 1, 1)]
    marks = {}
    for i, q, x in labels:
        if i is not None:
            good, bad = marks.get(i, (False, False))
            marks[i] = (good or q == 1, bad or x == 1)
    docs = spark.createDataFrame([(t, i, lang, "z", 5) for i, lang, t in rows], "text string, doc_id long, lang string, part string, mask int")
    got = filter_audit.interactions(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, marks)
    assert filter_audit.interactions(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_intervals_are_the_removals():
    """Every order and mask: one removal, at its first failing letter."""
    for n in (1, 3, 5):
        found = filter_audit.intervals(n)
        by_rank = dict(filter_audit.orders("ABCDE"[:n]))
        assert sorted(by_rank) == list(range(math.factorial(n))) and list(by_rank.values()) == sorted(by_rank.values())
        for mask in range(1, 2**n):
            steps = {r: s for m, s, a, b in found if m == mask for r in range(a, b)}
            assert steps == {r: min(k for k, x in enumerate(o) if mask >> (ord(x) - 65) & 1) + 1 for r, o in by_rank.items()}


def brute_negatives(rows, is_anchor):
    ok = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, lab, v in rows
          if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, lab, v in ok:
        if not is_anchor(a):
            continue
        score = [(sum(x * y for x, y in zip(v, w)), i, m) for i, m, w in ok if i != a]
        for ps, p, _ in sorted((s for s in score if s[2] == lab), key=lambda s: (-s[0], s[1]))[:5]:
            fits = sorted((s for s in score if s[2] != lab and 50 * ps <= 100 * s[0] <= 95 * ps), key=lambda s: (-s[0], s[1]))[:3]
            out += [(a, p, k + 1, i, ps, s) for k, (s, i, _) in enumerate(fits)]
    return sorted(out)


def vectors(rnd, n, dim):
    rows = []
    centres = [[rnd.gauss(0, 0.4) for _ in range(dim)] for _ in range(8)]
    for i in range(n):
        c = rnd.choice(centres)
        rows.append((i, rnd.randrange(4), [x + rnd.gauss(0, 0.1) for x in c]))
    rows += [(n + k, k % 3, list(rows[1][2])) for k in range(60)]  # one vector, copied under three labels
    rows += [(n + 100 + k, k % 2, [0.0] * dim) for k in range(8)] + [(n + 110, 1, [-0.001] * dim)]
    rows += [(n + 120, None, [1.0] * dim), (n + 121, 1, None), (n + 122, 1, [None] + [1.0] * (dim - 1)), (n + 123, 2, [float("nan")] * dim),
             (n + 124, 2, [float("inf")] * dim), (None, 1, [0.3] * dim), (n + 125, 3, [])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("dim, leaf, arity, block", [(6, 30, 4, 4096), (6, 1024, 16, 50), (24, 20, 3, 7)])
def test_hard_negatives_against_brute_force(spark, dim, leaf, arity, block):
    ready(spark)
    rows = vectors(random.Random(dim + leaf), 500, dim)
    docs = spark.createDataFrame([(v, i, lab, 1, "x") for i, lab, v in rows], "embedding array<float>, vec_id long, label int, cell int, q string")
    import numpy as np
    exact = [(i, lab, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, lab, v in rows]
    from pyspark.sql import functions as F
    got = hard_negatives.mine(docs, F.col("vec_id") % 5 == 0, leaf=leaf, arity=arity, block=block, sample_rows=300)
    want = brute_negatives(exact, lambda i: i % 5 == 0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500


def test_tree_leaves_out_siblings():
    """Clustered rows: most cells cannot hold a score near the top; none that does is left out."""
    import numpy as np
    rng = np.random.default_rng(3)
    centres = rng.integers(-300, 300, (40, 8))
    rows = (centres[rng.integers(0, 40, 4000)] + rng.integers(-6, 7, (4000, 8))).astype(np.int64)
    tree = hard_negatives.Tree(rows, len(rows), 8, 100)
    cells = tree.cell_of(rows)
    tree.set_ranges([(int(c), *tree.ranges_of(int(c), rows[cells == c])) for c in np.unique(cells)])
    anchors = rows[:50]
    score = hard_negatives.products(anchors, rows)
    low = np.sort(score, axis=1)[:, [-10]]
    who, cell = tree.reached(anchors, low, np.full_like(low, hard_negatives.HIGHEST))
    reached = set(zip(who.tolist(), cell.tolist()))
    assert all((a, int(cells[x])) in reached for a, x in zip(*np.nonzero(score >= low)))
    assert len(reached) < 0.5 * 50 * tree.cells


def test_hard_negatives_of_large_and_no_numbers(spark):
    ready(spark)
    from pyspark.sql import functions as F
    big = 2.0**21
    rows = [(0, 1, [big, 1.0]), (1, 1, [big, 1.5]), (2, 2, [big * 0.9, 0.0]), (3, 2, [big * 0.6, 3.0]), (4, 2, [1e300, 1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted(map(tuple, hard_negatives.mine(docs, F.col("vec_id") == 0).collect()))
    assert got == brute_negatives(rows[:4], lambda i: i == 0) and len(got) == 2
    assert hard_negatives.mine(docs.limit(0), F.col("vec_id") == 0).collect() == []


def test_queries(spark, data):
    """The registered queries over whole tables."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op12_substring_dedup(spark, data).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats([tuple(r) for r in docs], 50)
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    got = queries.op13_hard_negatives(spark, data).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows, lambda i: i % 50 == 0)
