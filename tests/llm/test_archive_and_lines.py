"""WARC archive and line removal: small cases and brute force."""

import base64
import hashlib
import random

import pytest

from tidewatch.llm import line_dedup, warc
from tidewatch.llm.common import ready

PAGES = "url string, page_id long, html string, key string, payload string, copy int"


@pytest.fixture(scope="module")
def pages(spark):
    ready(spark)
    big = "x" * 300_000
    rows = [("u", 5, "same"), ("u", 3, "same"), ("v", 3, "same"), ("u", 7, None), ("u", 8, ""), ("a\r\nb", 9, big), ("u", 2, big),
            ("u", 11, "solo"), ("u", 11, "solo"), (None, None, "same"), (None, None, "ñ only here")]
    return spark.createDataFrame([(u, i, h, "k", "p", 1) for u, i, h in rows], PAGES)


def test_archive(spark, pages):
    archive = warc.write_archive(pages)
    got = sorted((tuple(r) for r in warc.page_digests(spark, archive).collect()), key=str)

    def digest(t):
        b = (t or "").encode()
        return len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()

    same, empty, big, solo, own = map(digest, ("same", None, "x" * 300_000, "solo", "ñ only here"))
    want = [(5, *same, "revisit", 3), (3, *same, "response", None), (3, *same, "revisit", 3), (None, *same, "revisit", 3),
            (7, *empty, "response", None), (8, *empty, "revisit", 7), (9, *big, "revisit", 2), (2, *big, "response", None),
            (11, *solo, "response", None), (11, *solo, "revisit", 11), (None, *own, "response", None)]
    assert got == sorted(want, key=str)
    assert archive.payloads(spark).count() == 5


def test_archive_reconstructs_records(spark, pages):
    records = warc.record_bytes(warc.read_records(spark, warc.write_archive(pages))).collect()
    by = {(r["page_id"], r["copy"]): bytes(r["record"]) for r in records if r["page_id"] in (2, 9, 11)}
    head, _, body = by[2, 1].partition(b"\r\n\r\n")
    assert body == b"x" * 300_000 + b"\r\n\r\n" and b"Content-Length: 300000" in head
    assert b"WARC-Refers-To: <urn:page:2>" in by[9, 1] and b"a%0D%0Ab" in by[9, 1] and by[9, 1].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    assert b"<urn:page:11:2>" in by[11, 2]


def test_small_payloads_are_no_revisits(spark, pages):
    rows = warc.page_digests(spark, warc.write_archive(pages, min_bytes=5)).collect()
    assert {r["record_type"] for r in rows if r["payload_bytes"] < 5} == {"response"}
    assert [r["record_type"] for r in rows if r["page_id"] == 9] == ["revisit"]


def test_damaged_payload_is_noticed(spark, pages):
    archive = warc.write_archive(pages)
    rows = [(r["key"], bytes(r["payload"]) + b"!") for r in archive.payloads(spark).collect()]
    bad = warc.Archive(archive.path + "-bad")
    spark.createDataFrame(rows, "key string, payload binary").write.parquet(f"{bad.path}/payloads")
    archive.headers(spark).write.parquet(f"{bad.path}/headers")
    with pytest.raises(Exception, match="differs from its digest|disagree at"):
        warc.page_digests(spark, bad).collect()


def test_empty_archive(spark, pages):
    assert warc.page_digests(spark, warc.write_archive(pages.limit(0))).collect() == []


def brute_lines(rows, min_docs=3, min_chars=20):
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def key(line):
        return line.strip(strip).translate(low)

    held = {}
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= min_chars:
                    held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < min_docs or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("n_batches", [1, 4])
def test_lines_against_brute_force(spark, n_batches):
    rnd = random.Random(3)
    pool = [f"a common line with number {k} Ünï" for k in range(12)] + ["short", "", "   ", "exactly twenty chars", "nineteen characters"]
    rows = []
    for i in range(60):
        lines = [rnd.choice(pool) for _ in range(rnd.randint(0, 9))] + [f"only in document {i} and nowhere else"]
        lines = [rnd.choice([x, x.upper().replace("Ü", "Ü"), f"\t {x}\r"]) for x in lines]
        rnd.shuffle(lines)
        rows.append((i * 3 % 50 if i < 55 else None, "\n".join(lines)))
    rows += [(70, None), (71, ""), (72, "\n".join([pool[0]] * 5)), (73, "y" * 200_000 + "\n" + pool[1])]
    docs = spark.createDataFrame([(t, i, "g", 1) for i, t in rows], "text string, doc_id long, gone string, n_lines int")
    ready(spark)
    out = line_dedup.drop_lines(docs.select("doc_id", "text"), n_batches=n_batches)
    got = out.selectExpr("doc_id", "n_lines", "n_dropped", "sha2(encode(coalesce(text, ''), 'UTF-8'), 256)").collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows)
    assert sorted(map(tuple, line_dedup.line_digests(docs).collect()), key=str) == brute_lines(rows)


def test_lines_of_nothing(spark):
    assert line_dedup.line_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, fanout=2, buckets=2)
    for low in (90, 60, 30, 0):
        runs.add(spark.createDataFrame([(1, 1, low + k) for k in range(3)] + [(2, low, low)], "h1 long, h2 long, doc_id long"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    state = {(r["h1"], r["h2"]): (r["n_docs"], r["keeper"]) for r in runs.view().collect()}
    runs.forget()
    assert state == {(1, 1): (12, 92), (2, 90): (1, 90), (2, 60): (1, 60), (2, 30): (1, 30), (2, 0): (1, 0)}


def test_halves_of_a_line_hash_are_independent(spark):
    from pyspark.sql import functions as F
    row = spark.createDataFrame([("some line of text",)], "key string").select(
        line_dedup.hashes(F.col("key"))[1].alias("h2"), F.xxhash64("key", F.lit("line")).alias("follows_from_h1")).first()
    assert row["h2"] != row["follows_from_h1"]
