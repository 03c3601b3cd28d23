"""Token id files with a shared zstandard dictionary.

Ids of a document are serialised as little-endian integers of 2 bytes (4 where the vocabulary needs it) and compressed
alone, so one short document can be read without its neighbours.  A dictionary trained on a bounded sample of such
arrays makes up for the short frames.  A segment is

    b"TWTOK1", width (1 byte), dictionary hash (32 bytes), number of documents (u32),
    index: one (doc_id i64, has_id u8, offset u64, length u32, n_tokens u32) per document, then the frames.

Segments are rows of a Parquet table (so any Hadoop store holds them) sorted by document id within range buckets; a
manifest says how many ids stand before each segment.  The dictionary is a file of its own in the same folder.

Ids come from the tokenizers library, applied to distinct pieces: the pre-tokenizer never looks across a single space
between two other characters, so pieces cut there are encoded alone; texts with runs of white space are cut by runs.

Defined cases: null text is empty (its only id is the end id); a null document id sorts first; rows that share an id
follow each other in the order of a hash of their texts, and may spread over several buckets; an empty table gives an empty file set; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import SPACE, joined, tokenizer_text
from .common import folder, pick

MAGIC = b"TWTOK1"
HEAD = struct.Struct("<6sB32sI")
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("length", "<u4"), ("n_tokens", "<u4")])
#: Two white-space characters of which at least one is a space: pieces cannot be cut at the space alone.
RUN = "[\\t-\\r\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x20]\\x20|\\x20[\\t-\\r\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
BY_RUN = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


#: Letters, marks behind them, a line end, letters, marks.  The apostrophe is no mark: a byte-level tokenizer keeps it with some letters.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
MARKS = '.,;:!?"()\\-'
CUT = f"^(?P<a> [{LETTERS}]+)(?P<b>[{MARKS}]*)(?:(?P<c>\\n)(?P<d>[{LETTERS}]+)(?P<e>[{MARKS}]*))?$"


def cuts_at_letters(text: str) -> bool:
    """Whether a tokenizer is the plain byte-level one, and none of its added tokens can lie in what `CUT` takes apart."""
    spec = json.loads(text)
    how = spec.get("pre_tokenizer") or {}
    return (how.get("type") == "ByteLevel" and bool(how.get("use_regex", True)) and not how.get("add_prefix_space", True) and spec.get("normalizer") is None
            and spec["model"]["type"] == "BPE" and all(re.search(f"[^{LETTERS}{MARKS}\\s]", t["content"]) for t in spec["added_tokens"]))


def runs_at(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id runs number `at` end to end, and the length of each; run k lies in `flat` from `first[k]` on."""
    own = sizes[at]
    shift = np.repeat(first[at] - (np.cumsum(own) - own), own)
    return flat[shift + np.arange(len(shift))], own


class PieceIds:
    """The library's ids of pieces, with a memory of about `remember` bytes.

    Most pieces are letters with marks behind them, and perhaps a line end and more of the same: a byte-level tokenizer cuts
    at these borders itself, so letters, marks and line ends are remembered as atoms, each with the space before it.
    Atoms are encoded many at a time: a token that starts with a space starts an atom there.
    """

    def __init__(self, text: str, remember: int = 16_000_000, together: int = 500):
        from tokenizers import Tokenizer
        self.library, self.remember, self.together = Tokenizer.from_str(text), remember, together
        self.library.no_padding()
        self.library.no_truncation()
        vocab = self.library.get_vocab()
        self.starts = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.starts[[k for word, k in vocab.items() if word.startswith("\u0120")]] = True
        self.cuts, self.line_end = cuts_at_letters(text), None
        if self.cuts and len(end := self.library.encode("\n", add_special_tokens=False).ids) == 1:
            self.line_end = np.arange(len(self.starts)) == end[0]
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def alone(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces end to end, how many each has)."""
        found = [np.array(f.ids, "<u4") for f in self.library.encode_batch_fast(pieces, add_special_tokens=False)] if pieces else []
        return (np.concatenate(found) if found else np.zeros(0, "<u4")), np.fromiter(map(len, found), np.int64, len(found))

    def many(self, words: list[str], lead: str, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words encoded many at a time with `lead` before each; a token of `head` tells where a word starts."""
        groups = [words[k:k + self.together] for k in range(0, len(words), self.together)]
        ids, sizes = self.alone([lead + lead.join(g) for g in groups])
        heads = np.flatnonzero(head[ids])
        count = np.add.reduceat(head[ids], np.cumsum(sizes) - sizes) if len(sizes) else sizes
        if len(heads) != len(words) or any(c != len(g) for c, g in zip(count, groups)):
            ids, lengths = self.alone([lead + w for w in words])  # no token of this vocabulary tells where a word starts
        else:
            lengths = np.diff(np.append(heads, len(ids)))
        return ids, lengths

    def new_atoms(self, atoms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of atoms; those of letters are encoded many at a time, by spaces or line ends between them."""
        spaced, bare = (pc.match_substring_regex(atoms, f"^{lead}[{LETTERS}]+$").to_numpy(zero_copy_only=False).astype(bool) for lead in (" ", ""))
        if self.line_end is None:
            bare[:] = False
        kind = np.where(spaced, 0, np.where(bare, 1, 2))
        of = [atoms.filter(pa.array(kind == k)).to_pylist() for k in range(3)]
        found = [self.many(of[0], "", self.starts), (np.zeros(0, "<u4"), np.zeros(0, np.int64)), self.alone(of[2])]
        if of[1]:
            ids, lengths = self.many(of[1], "\n", self.line_end)
            found[1] = ids[~self.line_end[ids]], lengths - 1
        if not spaced.all():
            order = np.argsort(np.argsort(kind, kind="stable"), kind="stable")  # of each atom among those of its kind, kind after kind
            ids, lengths = (np.concatenate(x) for x in zip(*found))
            return runs_at(ids, np.cumsum(lengths) - lengths, lengths, order)
        return found[0]

    def atoms(self, atoms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct atoms, from memory where they are known."""
        at = pc.index_in(atoms, value_set=self.known) if len(self.known) else pa.nulls(len(atoms), pa.int32())
        missing = atoms.filter(pc.is_null(at))
        ids, sizes = self.new_atoms(missing)
        known = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        new = pc.is_null(at).to_numpy(zero_copy_only=False).astype(bool)
        known[new] = len(self.known) + np.arange(len(missing))
        self.known = pa.concat_arrays([self.known, missing])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        out = runs_at(self.ids, np.cumsum(self.sizes) - self.sizes, self.sizes, known)
        if self.known.nbytes + self.ids.nbytes + self.sizes.nbytes > self.remember:
            self.forget()
            if atoms.nbytes + out[0].nbytes + out[1].nbytes <= self.remember:
                self.known, (self.ids, self.sizes) = atoms, out
        return out

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words with a space before each, put together from those of their atoms."""
        spaced = pc.binary_join_element_wise("", words, " ")
        if not self.cuts:
            return self.atoms(spaced)
        cut = pc.extract_regex(spaced, CUT)
        whole = pc.is_null(cut)
        parts = [pc.if_else(whole, spaced, cut.field(0)), *[pc.fill_null(cut.field(k), "") for k in range(1, 5)]]
        held = [np.ones(len(words), bool), *[pc.not_equal(x, "").to_numpy(zero_copy_only=False).astype(bool) for x in parts[1:]]]
        coded = pa.concat_arrays([x.filter(pa.array(h)) for x, h in zip(parts, held)]).dictionary_encode()
        ids, sizes = self.atoms(coded.dictionary)
        which = np.full((len(words), 5), -1)
        which.T[np.array(held)] = coded.indices.to_numpy(zero_copy_only=False)
        there = which >= 0
        flat, own = runs_at(ids, np.cumsum(sizes) - sizes, sizes, which[there])
        ends = np.concatenate([[0], np.cumsum(own)])
        return flat, np.diff(ends[np.concatenate([[0], np.cumsum(there.sum(axis=1))])])

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, borders between texts)."""
        n = len(texts)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        hard = pc.match_substring_regex(texts, RUN).to_numpy(zero_copy_only=False).astype(bool)
        easy = texts.filter(pa.array(~hard))
        cut = pc.split_pattern(easy, " ")
        sizes = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        pieces = cut.flatten()
        coded = pieces.dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids, lengths = self.words(coded.dictionary)
        # The first piece of a text has no space before it.
        first, first_lengths = self.alone(pieces.take(pa.array(starts)).to_pylist())
        at[starts] = len(lengths) + np.arange(len(starts))
        runs = [BY_RUN.findall(t) for t in texts.filter(pa.array(hard)).to_pylist()]
        own = {p: k for k, p in enumerate(dict.fromkeys(p for r in runs for p in r))}
        more, more_lengths = self.alone(list(own))
        base = len(lengths) + len(first_lengths)
        parts = [None] * n
        for k, p in zip(np.flatnonzero(~hard), np.split(at, starts[1:]) if len(starts) else []):
            parts[k] = p
        for k, r in zip(np.flatnonzero(hard), runs):
            parts[k] = np.array([base + own[p] for p in r], np.int64)
        flat, all_lengths = np.concatenate([ids, first, more]), np.concatenate([lengths, first_lengths, more_lengths])
        out, counts = runs_at(flat, np.cumsum(all_lengths) - all_lengths, all_lengths, np.concatenate(parts))
        total = np.concatenate([[0], np.cumsum(counts)])
        return out, total[np.concatenate([[0], np.cumsum([len(p) for p in parts])])]


_IDS: dict[str, PieceIds] = {}


def piece_ids(text: str) -> PieceIds:
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already fills the cores
    name = hashlib.sha256(text.encode()).hexdigest()
    if name not in _IDS:
        _IDS[name] = PieceIds(text)
    return _IDS[name]


@dataclass(frozen=True)
class TokenFiles:
    """A folder with segments/, manifest/ and dictionary/."""
    path: str

    def segments(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(SEGMENT).parquet(f"{self.path}/segments")

    def manifest(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("bucket int, segment int, before long").parquet(f"{self.path}/manifest")

    def dictionary(self, spark: SparkSession) -> bytes:
        rows = spark.read.schema("hash binary, data binary").parquet(f"{self.path}/dictionary").take(1)
        return bytes(rows[0]["data"]) if rows else b""


SEGMENT = "bucket int, segment int, n_docs int, n_tokens long, data binary"


def hash_share(column: Column, share: float) -> Column:
    """Whether a hash lies in the lowest `share` of its range."""
    return F.shiftrightunsigned(column, 1) <= F.lit(min(2**63 - 1, int(share * 2**63)))


def train_dictionary(docs: DataFrame, n_docs: int, text: str, end_id: int, width: int, sample_docs: int, dict_bytes: int, sample_bytes: int) -> bytes:
    """A dictionary from about `sample_docs` documents, chosen by the hash of their id, and `sample_bytes` of their ids.

    Tasks encode the sample and cut a document's share out of a place that its hash chooses, so only these bytes travel.
    """
    import zstandard
    each = max(1024, sample_bytes // (2 * sample_docs))
    shared = docs.sparkSession.sparkContext.broadcast(text)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_ids(shared.value)
        for part in joined(parts, 2_000_000):
            ids, ends = own.texts(part.column(1))
            out = []
            for h, a, b in zip(part.column(0).to_pylist(), ends, ends[1:]):
                data = np.append(ids[a:b], end_id).astype(f"<u{width}").tobytes()
                at = h % max(1, len(data) // width - each // width) * width
                out.append(data[at:at + each])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["h", "sample"])

    h = F.xxhash64(F.lit("sample"), F.col("doc_id"), F.xxhash64("text"))
    some = docs.select(h.alias("h"), F.coalesce("text", F.lit("")).alias("text")).where(hash_share(F.col("h"), sample_docs / max(1, n_docs)))
    samples = [r["sample"] for r in sorted(some.mapInArrow(run, "h long, sample binary").toLocalIterator())][:2 * sample_docs]
    try:
        return zstandard.train_dictionary(dict_bytes, [bytes(x) for x in samples]).as_bytes() if samples else b""
    except zstandard.ZstdError:  # too little to learn from
        return b""


def range_borders(docs: DataFrame, n_docs: int, n_buckets: int, sample_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """Borders of `n_buckets` ranges of (doc_id, hash) from a sorted sample; rows of one id may lie in several ranges."""
    if n_buckets < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = F.xxhash64(F.lit("border"), "doc_id", "hash")
    some = docs.where(hash_share(own, sample_ids / max(1, n_docs))).select("doc_id", "hash").toArrow()
    ids, hashes = some.column("doc_id").fill_null(-2**63).to_numpy(), some.column("hash").to_numpy()
    order = np.lexsort((hashes, ids))
    at = order[np.unique(np.arange(1, n_buckets) * len(order) // n_buckets)] if len(order) else order
    return ids[at], hashes[at]


def bucket_of(ids: np.ndarray, hashes: np.ndarray, borders: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many borders lie before (id, hash)."""
    low, high = np.searchsorted(borders[0], ids, "left"), np.searchsorted(borders[0], ids, "right")
    for k in np.flatnonzero(low < high):  # ids that are borders themselves
        low[k] += np.searchsorted(borders[1][low[k]:high[k]], hashes[k], "left")
    return low


def write(docs: DataFrame, path: str, end_id: int = 2, sample_docs: int = 1000, dict_bytes: int = 65536,
          docs_per_segment: int = 512, docs_per_bucket: int = 65_536, level: int = 3, bucket_bytes: int = 16_000_000,
          max_buckets: int = 20_000, sample_bytes: int = 8_000_000) -> TokenFiles:
    """Encode `docs` (doc_id, text) and write the files; `path` names the tokenizer.

    A bucket holds about `bucket_bytes` of text; beyond `max_buckets` of them they grow (a bucket is sorted by Spark,
    which spills, and written segment by segment, so its size bounds no memory).
    """
    spark = docs.sparkSession
    text = tokenizer_text(path)
    spec = json.loads(text)
    top = max([*spec["model"]["vocab"].values(), *[t["id"] for t in spec["added_tokens"]], end_id])
    width = 2 if top < 65536 else 4
    docs = pick(docs, doc_id="long", text="string").withColumn("hash", F.xxhash64("text"))
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    words = train_dictionary(docs, size["n"], text, end_id, width, sample_docs, dict_bytes, sample_bytes)
    words_hash = hashlib.sha256(words).digest()
    out = TokenFiles(folder(spark, "tokens"))
    spark.createDataFrame([(bytearray(words_hash), bytearray(words))], "hash binary, data binary").coalesce(1).write.parquet(f"{out.path}/dictionary")

    n_buckets = min(max_buckets, max(1, -(-size["bytes"] // bucket_bytes), -(-size["n"] // docs_per_bucket)))
    borders = range_borders(docs, size["n"], n_buckets, 20 * n_buckets)
    n_buckets = len(borders[0]) + 1
    shared = spark.sparkContext.broadcast((text, words, borders))

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        tokenizer, dictionary, limits = shared.value
        own = piece_ids(tokenizer)
        pack = compressor(zstandard, dictionary, level)
        for part in joined(parts):
            ids, ends = own.texts(part.column(1).fill_null(""))
            frames = [pack.compress(np.append(ids[a:b], end_id).astype(f"<u{width}").tobytes()) for a, b in zip(ends, ends[1:])]
            keys, hashes = part.column(0), part.column(2)
            bucket = bucket_of(keys.fill_null(-2**63).to_numpy(zero_copy_only=False), hashes.to_numpy(zero_copy_only=False), limits)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), keys, hashes, pa.array(np.diff(ends) + 1, pa.int32()),
                                              pa.array(frames, pa.binary())], ["bucket", "doc_id", "hash", "n_tokens", "frame"])

    def segments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (bucket, doc_id)."""
        held: list[tuple] = []
        at = number = None

        def flush():
            return pa.RecordBatch.from_pylist([pack_segment(held, at, number, width, words_hash)], schema=SEGMENT_ARROW)

        for part in parts:
            for row in zip(*[c.to_pylist() for c in part.columns]):
                if held and (row[0] != at or len(held) == docs_per_segment):
                    yield flush()
                    number = number + 1 if row[0] == at else 0
                    held = []
                if not held and row[0] != at:
                    number = 0
                at = row[0]
                held.append(row[1:])
        if held:
            yield flush()

    rows = docs.mapInArrow(encode, "bucket int, doc_id long, hash long, n_tokens int, frame binary")
    # A bucket is a partition of its own: hashing would put several into one task.
    (rows.repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "hash").drop("hash")
     .mapInArrow(segments, SEGMENT).write.option("compression", "none").parquet(f"{out.path}/segments"))
    sizes = out.segments(spark).select("bucket", "segment", "n_tokens")
    # One row per segment: the running sum first over buckets, then inside each.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy("bucket").agg(F.sum("n_tokens").alias("all")).select(
        "bucket", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("bucket").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    (sizes.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(totals, "bucket")
     .select("bucket", "segment", (F.col("base") + F.col("inner")).alias("before")).write.parquet(f"{out.path}/manifest"))
    return out


SEGMENT_ARROW = pa.schema([("bucket", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("data", pa.binary())])


def compressor(zstandard, dictionary: bytes, level: int):
    words = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=True)


def pack_segment(rows: list[tuple], bucket: int, number: int, width: int, words_hash: bytes) -> dict:
    """A segment of (doc_id, n_tokens, frame) rows."""
    index = np.zeros(len(rows), INDEX)
    index["doc_id"] = [0 if r[0] is None else r[0] for r in rows]
    index["has_id"] = [r[0] is not None for r in rows]
    index["n_tokens"] = [r[1] for r in rows]
    index["length"] = [len(r[2]) for r in rows]
    index["offset"] = np.cumsum(index["length"].astype(np.int64)) - index["length"]
    data = HEAD.pack(MAGIC, width, words_hash, len(rows)) + index.tobytes() + b"".join(r[2] for r in rows)
    return {"bucket": bucket, "segment": number, "n_docs": len(rows), "n_tokens": int(index["n_tokens"].sum()), "data": data}


class SegmentReader:
    """Reads documents of a segment one by one."""

    def __init__(self, data: bytes, dictionary: bytes):
        import zstandard
        magic, self.width, words_hash, n = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        if hashlib.sha256(dictionary).digest() != words_hash:
            raise ValueError("the segment was written with another dictionary")
        self.index = np.frombuffer(data, INDEX, n, HEAD.size)
        self.data, self.base = memoryview(data), HEAD.size + n * INDEX.itemsize
        words = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.unpack = zstandard.ZstdDecompressor(dict_data=words)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        entry = self.index[k]
        at = self.base + int(entry["offset"])
        ids = np.frombuffer(self.unpack.decompress(self.data[at:at + int(entry["length"])]), f"<u{self.width}").astype("<u4")
        if len(ids) != entry["n_tokens"]:
            raise ValueError(f"document {k} holds {len(ids)} ids, not {entry['n_tokens']}")
        return ids


def read(spark: SparkSession, files: TokenFiles, with_ids: bool = False) -> DataFrame:
    """Per document doc_id, start, n_tokens, ids_crc32 (and ids), from the files alone."""
    shared = spark.sparkContext.broadcast(files.dictionary(spark))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for before, data in zip(part.column(0).to_pylist(), part.column(1)):
                own = SegmentReader(data.as_py(), shared.value)
                index = own.index
                counts = index["n_tokens"].astype(np.int64)
                ids = [own.ids(k) for k in range(len(index))]
                columns = [pa.array(index["doc_id"], pa.int64(), mask=index["has_id"] == 0), pa.array(before + np.cumsum(counts) - counts),
                           pa.array(counts), pa.array([zlib.crc32(i) for i in ids], pa.int64())]
                if with_ids:
                    columns.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(columns)])

    return (files.segments(spark).select("bucket", "segment", "data").join(files.manifest(spark), ["bucket", "segment"])
            .select("before", "data").mapInArrow(run, schema))
