"""The registered corpus queries and their DuckDB SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, filter_audit, hard_negatives, language, line_dedup, nearest, ngram_join, repeats, suffix_tree, token_files, toxicity, warc
from .common import ready, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file; TIDEWATCH_TOKENIZERS names another folder."""
    if (place := os.environ.get("TIDEWATCH_TOKENIZERS")):
        return os.path.join(place, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive of all pages, read back."""
    ready(spark)
    return warc.page_digests(spark, warc.write_archive(table(spark, sf_dir, "pages")))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents by rank-order profiles."""
    ready(spark)
    return language.identify(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    ready(spark)
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of all documents."""
    ready(spark)
    return bpe.token_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to files and read back."""
    ready(spark)
    files = token_files.write(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return token_files.read(spark, files)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three documents or more, kept in the largest document only."""
    ready(spark)
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their four-word shingles."""
    ready(spark)
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    ready(spark)
    return nearest.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    ready(spark)
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    ready(spark)
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every filter removes at every step of every order."""
    ready(spark)
    return filter_audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of repeated passages of 50 words or more, kept in the smallest document only."""
    ready(spark)
    return repeats.repeat_digests(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector and its five best positives."""
    ready(spark)
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


def _base32(column: str) -> str:
    digits = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    parts = [f"substr({digits}, 1 + (((('0x' || substr({column}, {5 * i // 4 + 1}, 2))::INTEGER) >> {3 - 5 * i % 4}) & 31), 1)" for i in range(31)]
    parts.append(f"substr({digits}, 1 + ((('0x' || substr({column}, 39, 2))::INTEGER) & 31), 1)")
    return " || ".join(parts)


OP1_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first_id,
             row_number() OVER (PARTITION BY body ORDER BY page_id NULLS LAST) AS rn FROM p)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, {_base32('h')} AS payload_digest,
       CASE WHEN rn = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN rn > 1 THEN first_id END AS refers_to
FROM f"""

OP6_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
m AS (SELECT doc_id, part, (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END)
             + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > first_id THEN 16 ELSE 0 END) AS mask FROM w),
g AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m LEFT JOIN g USING (doc_id) GROUP BY ALL),
f AS (SELECT chr(65 + i::INTEGER) AS f, (1 << i::INTEGER) AS bit FROM range(5) r(i)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e
      WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, k::INTEGER AS step, bits[k] AS bit, list_sum(bits[1:k - 1]) AS before FROM o, range(1, 6) r(k)),
r AS (SELECT part, filter_order, step, s.bit, coalesce(sum(n) FILTER (WHERE (mask & (coalesce(before, 0)::INTEGER | s.bit)) = 0), 0) AS kept,
             coalesce(sum(n) FILTER (WHERE (mask & s.bit) > 0 AND (mask & coalesce(before, 0)::INTEGER) = 0), 0) AS removed,
             coalesce(sum(n) FILTER (WHERE (mask & s.bit) > 0 AND (mask & coalesce(before, 0)::INTEGER) > 0), 0) AS redundant,
             coalesce(sum(n) FILTER (WHERE mask = s.bit), 0) AS unique_fails,
             coalesce(sum(good) FILTER (WHERE (mask & s.bit) > 0 AND (mask & coalesce(before, 0)::INTEGER) = 0), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (WHERE (mask & s.bit) > 0 AND (mask & coalesce(before, 0)::INTEGER) = 0), 0) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, s.bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r"""

OP13_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""

QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc, "op2_language": op2_language, "op3_decontamination": op3_decontamination, "op4_bpe": op4_bpe, "op5_token_files": op5_token_files,
    "op6_line_dedup": op6_line_dedup, "op7_ngram_join": op7_ngram_join, "op8_nearest": op8_nearest, "op9_toxicity": op9_toxicity,
    "op10_lm": op10_lm, "op11_filter_audit": op11_filter_audit, "op12_substring_dedup": op12_substring_dedup, "op13_hard_negatives": op13_hard_negatives,
}
ORACLES: dict[str, str] = {"op1_warc": OP1_SQL, "op6_line_dedup": OP6_SQL, "op11_filter_audit": OP11_SQL, "op13_hard_negatives": OP13_SQL}
