"""BPE encoding by speculation, and decoding.

A text is cut at white space; every distinct piece of a worker is encoded once.  Greedy longest match proposes tokens;
a vectorised check tests every pair of neighbours of all new pieces at once; only pieces with an incompatible pair are
merged exactly.  A token sequence whose tokens each encode to themselves and whose neighbours are all compatible is the
BPE encoding, so the result never depends on the speculation.

Two neighbours A, B are compatible when no merge ever crosses their border.  The symbols at the border are the right
spine of A's merge tree and the left spine of B's; walking both back in order of creation visits every pair of symbols
that stand side by side at some time, and the pair merges if its rank comes before both symbols are consumed.

Normalisation, pre-tokenisation and special tokens are those of the tokenizers library, applied to distinct pieces.

Defined cases: a null text is empty and has no tokens; texts of any length are encoded whole; special tokens written in
a text become their ids; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import give_back, pick

#: White space of the tokenizer's patterns (Unicode's, without the information separators that Python adds).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = re.compile(f"[^{SPACE}]+")
ODD = "[\\x1c-\\x1f]"  # white space to Arrow but not to the tokenizer
LAST = np.int64(1) << 40
BATCH_BYTES = 4_000_000  # texts encoded at once


class Merges:
    """The merge table of a tokenizer file: vocabulary, ranks, and each token's last merge."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.special.items()})
        self.rank: dict[tuple[int, int], int] = {}
        self.result: list[int] = []                   # by rank: the token a merge makes
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((self.ids[a], self.ids[b]), r)
            self.result.append(self.ids[a + b])
        self.longest = max(map(len, self.ids))
        starts: dict[str, set[int]] = {}
        for token in self.ids:
            if len(token) > 1:
                starts.setdefault(token[:2], set()).add(len(token))
        self.sizes = {start: sorted(sizes, reverse=True) for start, sizes in starts.items()}
        size = max(self.names) + 1
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.made = np.full(size, -1, np.int64)       # rank of the token's last merge; -1 for a single symbol
        self.sound = np.zeros(size, bool)             # it encodes to itself by merges of rising rank
        for token, i in self.ids.items():
            self._trace(token, i)
        keys = sorted((a * size + b, r) for (a, b), r in self.rank.items())
        self.size = size
        self.pair_keys = np.array([k for k, _ in keys], np.int64)
        self.pair_ranks = np.array([r for _, r in keys], np.int64)

    def symbols(self, piece: str) -> list[int]:
        return [self.ids[c] for c in piece[:-1]] + [self.ids[piece[-1] + self.suffix]] if piece else []

    def _trace(self, token: str, i: int) -> None:
        whole = self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix)
        body = token[: -len(self.suffix)] if whole else token
        try:
            start = self.symbols(body) if whole or not self.suffix else [self.ids[c] for c in body]
        except KeyError:
            return
        steps: list[tuple[int, int, int]] = []
        if self.merge(start, steps) != [i]:
            return
        if not steps:
            self.sound[i] = True
            return
        rank, a, b = steps[-1]
        self.left[i], self.right[i], self.made[i] = a, b, rank
        self.sound[i] = all(x[0] <= y[0] for x, y in zip(steps, steps[1:]))

    def merge(self, ids: list[int], steps: list | None = None) -> list[int]:
        """Exact merging: lowest rank first, leftmost among equals."""
        return self._merge_short(list(ids), steps) if len(ids) <= 64 else self._merge_long(list(ids), steps)

    def _merge_short(self, ids: list[int], steps: list | None) -> list[int]:
        rank, none = self.rank.get, len(self.result)
        ranks = [rank(pair, none) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            if steps is not None:
                steps.append((best, ids[k], ids[k + 1]))
            ids[k] = self.result[best]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = rank((ids[k], ids[k + 1]), none)
        return ids

    def _merge_long(self, ids: list[int], steps: list | None) -> list[int]:
        """With a heap, for texts without white space."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.rank[pair], k, *pair) for k, pair in enumerate(zip(ids, ids[1:])) if pair in self.rank]
        heapq.heapify(heap)

        def offer(k: int) -> None:
            pair = ids[k], ids[after[k]]
            if pair in self.rank:
                heapq.heappush(heap, (self.rank[pair], k, *pair))

        while heap:
            best, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            if steps is not None:
                steps.append((best, a, b))
            ids[k], ids[j], after[k] = self.result[best], -1, after[j]
            if after[k] < n:
                before[after[k]] = k
                offer(k)
            if before[k] >= 0:
                offer(before[k])
        return [i for i in ids if i >= 0]

    def propose(self, piece: str) -> list[int]:
        """Greedy longest match; the word end counts as part of the last token."""
        out, at, n, ids = [], 0, len(piece), self.ids
        while at < n:
            if n - at <= self.longest and (found := ids.get(piece[at:] + self.suffix)) is not None:
                out.append(found)
                break
            room = n - at - 1
            for size in self.sizes.get(piece[at:at + 2], ()):
                if size <= room and (found := ids.get(piece[at:at + size])) is not None:
                    out.append(found)
                    at += size
                    break
            else:
                out.append(ids[piece[at]])
                at += 1
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair: would BPE leave the border between the two tokens alone."""
        ok = self.sound[a] & self.sound[b]
        live = np.flatnonzero(ok)
        x, y = a[live].copy(), b[live].copy()
        end_x, end_y = np.full(len(x), LAST), np.full(len(y), LAST)
        while len(live):
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], LAST)
            crossed = (rank < end_x) & (rank <= end_y) & (rank < LAST)
            ok[live[crossed]] = False
            made_x, made_y = self.made[x], self.made[y]
            more = ~crossed & ((made_x >= 0) | (made_y >= 0))
            live, x, y, end_x, end_y, made_x, made_y = (v[more] for v in (live, x, y, end_x, end_y, made_x, made_y))
            back_x = made_x > made_y                      # of equal ranks the right one is merged later
            end_x, end_y = np.where(back_x, made_x, end_x), np.where(back_x, end_y, made_y)
            x, y = np.where(back_x, self.right[x], x), np.where(back_x, y, self.left[y])
        return ok

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], int]:
        """Token ids of each pre-token, and how many needed exact merging."""
        proposed = [self.propose(p) for p in pieces]
        sizes = np.array([len(p) for p in proposed], np.int64)
        flat = np.fromiter((i for p in proposed for i in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(pieces)), sizes)
        failing = np.zeros(len(pieces), bool)
        failing[owner[~self.sound[flat]]] = True
        inner = owner[1:] == owner[:-1] if len(flat) else np.zeros(0, bool)
        ok = self.compatible(flat[:-1][inner], flat[1:][inner])
        failing[owner[:-1][inner][~ok]] = True
        for k in np.flatnonzero(failing):
            proposed[k] = self.merge(self.symbols(pieces[k]))
        return proposed, int(failing.sum())


class Encoder:
    """Encodes texts piece by piece with a bounded memory of pieces seen.

    The memory has two generations: a full one becomes the old one, from which pieces in use move back.  Pieces are looked
    up and learnt `step` at a time, so neither generation outgrows its size by more, however many a batch holds.
    """

    def __init__(self, text: str, remember: int = 200_000, step: int = 16_384):
        from tokenizers import Tokenizer
        self.merges, self.remember, self.step = Merges(text), remember, step
        # The library only normalises and pre-tokenises here: without its model it takes 40 MB less in every worker.
        spec = json.loads(text)
        self.library = Tokenizer.from_str(json.dumps({**spec, "added_tokens": [], "model": {**spec["model"], "vocab": {}, "merges": []}}))
        self.split = re.compile("(" + "|".join(map(re.escape, self.merges.special)) + ")") if self.merges.special else None
        self.plain = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
        # Byte-level alphabet: printable bytes stand for themselves, the others follow at 256.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.seen: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.names = pa.array([self.merges.names.get(i, "") for i in range(self.merges.size)], pa.string())
        self.exact = self.total = 0

    def pre_tokens(self, chunk: str) -> list[str]:
        """The library's pre-tokens of a piece without white space; printable ASCII needs no normalisation."""
        if chunk.isascii() and chunk.isprintable():
            low = chunk.lower()
            return [low] if low.isalpha() else self.plain.findall(low)
        if chunk.isalpha() and max(chunk) < "\u0250":  # Latin letters: composed already, and lowered one by one
            low = chunk.lower()
            if low.isalpha():
                return [low.encode().decode("latin-1").translate(self.bytes)]
        return [t for t, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]

    def learn(self, chunks: list[str]) -> None:
        words: dict[str, int] = {}
        plans: list[list[tuple[bool, int]]] = []
        for chunk in chunks:
            parts = self.split.split(chunk) if self.split and "<|" in chunk else [chunk]
            plan = []
            for part in parts:
                if part in self.merges.special:
                    plan.append((True, self.merges.special[part]))
                elif part:
                    plan += [(False, words.setdefault(t, len(words))) for t in self.pre_tokens(part)]
            plans.append(plan)
        ids, exact = self.merges.encode(list(words))
        self.exact += exact
        self.total += len(words)
        seen = self.seen
        for chunk, plan in zip(chunks, plans):
            if len(plan) == 1 and not plan[0][0]:
                own = ids[plan[0][1]]
            else:
                own = [i for special, k in plan for i in ([k] if special else ids[k])]
            seen[chunk] = array("I", own).tobytes()

    def entries(self, chunks: pa.Array) -> list[bytes]:
        """Ids of distinct pieces."""
        out: list[bytes] = []
        for at in range(0, len(chunks), self.step):
            part = chunks.slice(at, self.step).to_pylist()
            if len(self.seen) > self.remember:
                self.old, self.seen = self.seen, {}
            seen, old = self.seen, self.old
            new = [c for c in part if c not in seen]
            if new:
                seen.update((c, old[c]) for c in new if c in old)
                if (new := [c for c in new if c not in seen]):
                    self.learn(new)
            out += [seen[c] for c in part]
        return out

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(ids of all texts, where each text's ids start and end, decoded texts)."""
        if pc.any(pc.match_substring_regex(texts, ODD)).as_py():
            cut = pa.array([PIECES.findall(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            cut = pc.utf8_split_whitespace(texts)
        pieces = cut.flatten()
        empty = pc.not_equal(pieces, "")                # splitting leaves empty strings at a text's ends
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))]).astype(np.int64)
        held = empty.to_numpy(zero_copy_only=False).astype(bool)
        starts = np.concatenate([[0], np.cumsum(held)])[starts]
        coded = pieces.filter(empty).dictionary_encode()
        del cut, pieces
        ids, sizes = gather(self.entries(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False))
        ends = np.concatenate([[0], np.cumsum(sizes)])[starts]
        decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.names.take(pa.array(ids))), " ")
        return ids, ends, decoded


def gather(values: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id runs `values[at]` end to end, and the length of each."""
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    flat, first = np.frombuffer(b"".join(values), "<u4"), np.cumsum(sizes) - sizes
    own = sizes[at]
    shift = np.repeat(first[at] - (np.cumsum(own) - own), own)
    return flat[shift + np.arange(len(shift))], own


def joined(parts: Iterator[pa.RecordBatch], chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches put together up to about so many bytes, so that frequent pieces are looked up once."""
    give_back()
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += part.nbytes
        if size >= chars:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size, part = [], 0, None
            while whole:
                yield whole.pop(0)
    if held:
        whole, held, part = pa.Table.from_batches(held).combine_chunks().to_batches(), [], None
        while whole:
            yield whole.pop(0)
    give_back()


_ENCODERS: dict[str, Encoder] = {}


def encoder(text: str) -> Encoder:
    """One encoder for each tokenizer file and Python worker."""
    name = hashlib.sha256(text.encode()).hexdigest()
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(text)
    return _ENCODERS[name]


def tokenizer_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, ids as binary of little-endian 32 bit integers, decoded text) of each row's `text`."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_text(path))  # a tokenizer file: its size is fixed

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for part in joined(parts, BATCH_BYTES):
            ids, ends, decoded = own.texts(part.column(1).fill_null(""))
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([ids[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()), decoded],
                ["key", "ids", "decoded"])

    out = pick(docs, **{key: "long", "text": "string"}).mapInArrow(run, "key long, ids binary, decoded string")
    return out.withColumnRenamed("key", key)


def token_digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Per document the number of tokens and digests of ids and decoded text (and the ids, 32 bits each)."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_text(path))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for part in joined(parts, BATCH_BYTES):
            ids, ends, decoded = own.texts(part.column(1).fill_null(""))
            columns = [
                part.column(0), pa.array(np.diff(ends), pa.int64()),
                pa.array([hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(ends, ends[1:])], pa.string()),
                pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in decoded], pa.string())]
            if with_ids:
                columns.append(pa.array([ids[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][:len(columns)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else "")
    return pick(docs, doc_id="long", text="string").mapInArrow(run, schema)
