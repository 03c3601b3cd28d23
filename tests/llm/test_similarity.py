"""Jaccard join, nearest neighbours, decontamination and the pipeline against brute force and planted cases."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tidewatch.llm import decontaminate, nearest, ngram_join, queries
from tidewatch.llm.common import ready

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def edited(rnd, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"edit{rnd.random():.6f}"
    return " ".join(w)


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_join_against_brute_force(spark, k, percent):
    """Chains of edits around the threshold, groups of copies, and passages that unlike documents share."""
    rnd = random.Random(k)
    ready(spark)
    passage = " ".join(f"shared{j}" for j in range(60))
    rows, at = [], 0
    for size in (3, 8, 16, 30, 70, 150, 400):
        for _ in range(4):
            base = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(size))
            chain = base
            for _ in range(9):
                rows.append((at, chain.upper() if rnd.random() < 0.2 else chain))
                at += rnd.randint(1, 5)
                chain = edited(rnd, chain, max(1, size // 150)) if rnd.random() < 0.7 else chain + " tail" * rnd.randint(0, size // 9)
    rows += [(at + j, passage + " " + " ".join(f"u{rnd.randrange(10**6)}" for _ in range(rnd.randint(5, 300)))) for j in range(60)]
    rows += [(at + 100, None), (at + 101, ""), (at + 102, " \t\n"), (at + 103, "one"), (at + 104, "ONE"), (at + 105, "v " * 20_000)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(t, i, "k", 3) for i, t in rows], "text string, doc_id long, key string, n int")
    want = brute_components(rows, k, percent)
    assert sorted(map(tuple, ngram_join.join(docs, k, percent).collect())) == want
    kept = {r["doc_id"] for r in ngram_join.one_of_each(docs, k, percent).collect()}
    assert kept == {c for _, _, c in want}
    assert len({c for _, _, c in want}) < len(want) - 50


def test_join_cases(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.join(docs).collect()), key=str)
    assert got == [(2, 2, 2), (4, 2, 2), (4, 2, 2), (None, 0, None)]
    assert ngram_join.join(docs.limit(0)).collect() == []
    assert sorted(str(r["doc_id"]) for r in ngram_join.one_of_each(docs).collect()) == ["2", "None"]


def test_components_of_a_path(spark):
    order = list(range(40))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(100, 101)], "a long, b long")
    assert {(r["doc_id"], r["component"]) for r in ngram_join.components(edges).collect()} == {(i, 0) for i in range(40)} | {(100, 100), (101, 100)}


def brute_nearest(rows, k=5, every=50):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for j in np.flatnonzero(ids % every == 0):
        s = v @ v[j] / (np.linalg.norm(v, axis=1) * np.linalg.norm(v[j]))
        s[j] = -9
        out[ids[j]] = [(ids[x], s[x]) for x in np.lexsort((ids, -np.round(u @ u[j], 12) + 99 * (np.arange(len(ids)) == j)))[:k]]
    return out


def test_nearest_recall(spark, data):
    ready(spark)
    df = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want, got = brute_nearest(rows), {}
    from pyspark.sql import functions as F
    for r in nearest.neighbours(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(want) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hits = sum(len({x for x, _ in got[q].values()} & {x for x, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    by = dict(rows)
    for q, found in got.items():
        a = np.array(by[q], float)
        for x, s in found.values():
            b = np.array(by[x], float)
            assert abs(s - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-12


def test_nearest_cases(spark):
    """Copies (ties to the smaller id), vectors that take no part, and fewer candidates than asked for."""
    from pyspark.sql import functions as F
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(0, 240, 5)] + [(7, [2.0, 4.0, 1.0]), (8, [-1.0, 0.0, 0.0]), (50, [1.0, 2.0, 0.5]), (None, [1.0, 1.0, 1.0]),
                                                               (300, None), (350, [0.0, 0.0, 0.0]), (400, [1.0, nan, 0.0]), (450, [inf, 0.0, 0.0]),
                                                               (500, [1.0, None, 0.0]), (550, [1.0, 2.0]), (600, [])]
    df = spark.createDataFrame([(v, i, "s") for i, v in rows], "embedding array<double>, vec_id long, score string")
    got = {}
    for r in nearest.neighbours(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 12)))
    assert set(got) == {0, 50, 100, 150, 200}
    for q, found in got.items():
        ids = [i for i in sorted([*range(0, 240, 5), 7]) if i != q]
        exact = sorted(found)
        assert [s for _, _, s in exact] == [1.0] * 5 and len({i for _, i, _ in exact}) == 5
        assert {i for _, i, _ in exact} <= set(ids[:7])
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r["vec_id"]) for r in sorted(nearest.neighbours(few, F.col("vec_id") == 0).collect())] == [(1, 2), (2, 1)]
    assert nearest.neighbours(few.limit(0), F.col("vec_id") == 0).collect() == []


def brute_leaks(docs, items, least=0.8, k=5):
    from collections import Counter
    found = set()
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            if len(v) >= k and len(w) >= k:
                want = Counter(tuple(v[j:j + k]) for j in range(len(v) - k + 1))
                for start in range(max(1, len(w) - len(v) + 1)):
                    part = w[start:start + len(v)]
                    own = Counter(tuple(part[j:j + k]) for j in range(len(part) - k + 1))
                    if sum((own & want).values()) >= least * sum((own | want).values()):
                        found.add((d, i))
                        break
    return found


@pytest.fixture(scope="module")
def leaky(spark):
    rnd = random.Random(9)
    vocabulary = [f"v{j}" for j in range(300)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([5, 9, 20, 20, 60])))) for i in range(25)]
    items += [(30, "v1 v2 v3"), (31, None), (32, "again again again again again again again"), (33, items[0][1])]
    docs = []
    for d in range(80):
        text = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 150))]
        if d % 3 == 0:
            item = rnd.choice(items[:25])[1].split(" ")
            if d % 2:
                item[-1] = "changed"
            if d % 5 == 0 and len(item) > 40:
                item[20] = "changed"
            at = rnd.randint(0, len(text))
            text[at:at] = [w.upper() for w in item]
        docs.append((d, " ".join(text)))
    docs += [(90, None), (91, ""), (92, "again " * 40), (93, "x " * 30_000 + items[3][1]), (94, " ".join(items[4][1].split(" ")[:-1])), (None, items[2][1])]
    return docs, items


def test_leaks_against_brute_force(spark, leaky):
    docs, items = leaky
    ready(spark)
    d = spark.createDataFrame([(t, i, "e") for i, t in docs], "text string, doc_id long, item_id string")
    b = spark.createDataFrame([(t, i, 1.0) for i, t in items], "text string, item_id long, similarity double")
    want = brute_leaks(docs, items)
    got = decontaminate.leaks(d, b)
    rows = sorted(map(tuple, got.collect()), key=str)
    assert {r[:2] for r in rows} == want and len(rows) == len(want) > 20
    assert rows == sorted(map(tuple, decontaminate.leaks(d.where("doc_id is null or doc_id <> 93"), b, everywhere=True).unionByName(
        got.where("doc_id = 93")).collect()), key=str)
    assert rows == sorted(map(tuple, decontaminate.leaks(d, b, block_bytes=300).collect()), key=str)
    kept = [r["doc_id"] for r in decontaminate.clean(d, b).collect()]
    assert sorted(map(str, kept)) == sorted(str(i) for i, _ in docs if i not in {x for x, _ in want})


def test_leaks_of_nothing(spark, leaky):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert decontaminate.leaks(docs, none).collect() == [] and decontaminate.clean(docs, none).count() == 1
    item = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.leaks(docs.limit(0), item).collect() == []


def test_blocks_find_all_within_the_radius():
    rnd = np.random.default_rng(3)
    items = decontaminate.Items([0], ["a b c d e f g"], 5, 23)
    for _ in range(300):
        flips = rnd.choice(64, rnd.integers(0, 24), replace=False)
        other = items.prints[0]
        for f in flips:
            other ^= np.uint64(1) << np.uint64(f)
        block = np.array([other]).view(np.uint8)
        assert any(items.tables[3][b, block[b], 0] for b in range(8))


def test_pipeline(spark, data):
    """Every stage's decision, stage by stage, on documents with planted cases."""
    ready(spark)
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    sf_dir = data.replace("sf0.001", "sf0.01")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, sf_dir)
        assert out.columns == docs.columns, name
    result = corpus_pipeline.run(spark, sf_dir)
    ids = {r["doc_id"] for r in result.select("doc_id").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 500 < len(ids) < len(texts)
    assert not [i for i in ids if any(t in texts[i] for _, t in items)]


def test_every_query_is_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 11)) and len(queries.QUERIES) == 10
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    import __spark_entry__
    assert {*queries.QUERIES, "pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, data, name):
    from oracle_tool import compare, connect
    assert compare(queries.QUERIES[name](spark, data), connect(data), queries.ORACLES[name])[0] == ""
