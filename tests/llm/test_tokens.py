"""BPE by speculation, and token files, against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")

from tidewatch.llm import bpe, token_files  # noqa: E402
from tidewatch.llm.common import ready  # noqa: E402
from tidewatch.llm.queries import tokenizer_path  # noqa: E402

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
CASES = ["", "   ", "aaaaaaaa aaaa'sll's", "Ünïcödé ΣΑΣ İstanbul ﬁne ẞ é", "<|endoftext|>x<|startoftext|> y <|ENDOFTEXT|>",
         "a\x1cb !\x1c! \x00\x7f", "日本語 한국어 😀👍🏽", "x" * 5000, "ab" * 3000, "1234 12a3", "a  b", "a   b", "a \nb", "a\n b", "a\n\n b  \n c  ",
         " lead", "trail ", "\n\n", "a\xa0 b \xa0c", "it's we'll they'Re don't x　y\x85z"]


def random_texts(n):
    rnd = random.Random(7)
    return ["".join(rnd.choice("abcdefghilnorstu'.,<|>0é ß\n \xa0　") for _ in range(rnd.randint(1, 90))) for _ in range(n)]


def test_words_match_the_library():
    texts = CASES + random_texts(1500)
    library = tokenizers.Tokenizer.from_file(WORD)
    own = bpe.Encoder(bpe.tokenizer_text(WORD), remember=500)  # a small memory is turned over many times
    for at in range(0, len(texts), 200):
        part = texts[at:at + 200]
        ids, ends, decoded = own.texts(pa.array(part))
        for text, a, b, back in zip(part, ends, ends[1:], decoded.to_pylist()):
            want = library.encode(text, add_special_tokens=False).ids
            assert ids[a:b].tolist() == want, text
            assert back == library.decode(want, skip_special_tokens=False), text
    assert 0 < own.exact < own.total


def test_memory_of_pieces_is_bounded_within_a_batch():
    """One batch of far more pieces than are remembered: no generation outgrows its size by more than one step."""
    own = bpe.Encoder(bpe.tokenizer_text(WORD), remember=1000)
    texts = [" ".join(f"w{k}x" for k in range(at, at + 500)) for at in range(0, 40_000, 500)]
    ids, ends, decoded = own.texts(pa.array(texts))
    assert max(len(own.seen), len(own.old)) <= 1000 + own.step
    library = tokenizers.Tokenizer.from_file(WORD)
    for k in (0, 40, 79):
        want = library.encode(texts[k], add_special_tokens=False).ids
        assert ids[ends[k]:ends[k + 1]].tolist() == want
        assert decoded[k].as_py() == library.decode(want, skip_special_tokens=False)


def test_the_library_holds_no_model():
    """It normalises and pre-tokenises as the whole tokenizer does, without vocabulary and merges in every worker."""
    library, own = tokenizers.Tokenizer.from_file(WORD), bpe.Encoder(bpe.tokenizer_text(WORD))
    assert own.library.get_vocab_size(with_added_tokens=True) == 0
    split = lambda t, x: [p for p, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(x))]
    for text in CASES + random_texts(300):
        assert split(own.library, text) == split(library, text)


def test_compatibility_is_exact():
    """Every sound pair's verdict equals merging both tokens' symbols."""
    own = bpe.Merges(bpe.tokenizer_text(WORD))
    rnd = random.Random(2)
    plain = [i for t, i in own.ids.items() if not t.endswith("</w>") and own.sound[i] and t.isalpha()]
    pairs = [(rnd.choice(plain), rnd.choice(plain)) for _ in range(4000)]
    ok = own.compatible(*np.array(pairs, np.int64).T)
    for (a, b), verdict in zip(pairs, ok):
        symbols = [own.ids[c] for c in own.names[a] + own.names[b]]
        assert (own.merge(symbols) == [a, b]) == verdict
    assert 0 < ok.sum() < len(ok)


def test_long_and_short_merging_agree():
    own = bpe.Merges(bpe.tokenizer_text(WORD))
    rnd = random.Random(4)
    for _ in range(200):
        ids = own.symbols("".join(rnd.choice("aeinrst") for _ in range(rnd.randint(1, 60))))
        assert own._merge_short(list(ids), None) == own._merge_long(list(ids), None)


def test_token_digests(spark):
    ready(spark)
    docs = spark.createDataFrame([(t, k, "x", 3) for k, t in enumerate([None, *CASES, "twice", "twice"])], "text string, doc_id long, key string, ids int")
    library = tokenizers.Tokenizer.from_file(WORD)
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.token_digests(docs, WORD).collect()}
    for k, text in enumerate([None, *CASES, "twice", "twice"]):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got[k] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    row = bpe.encode(docs.where("doc_id = 3"), WORD).first()
    assert np.frombuffer(row["ids"], "<u4").tolist() == library.encode(CASES[2], add_special_tokens=False).ids
    assert bpe.token_digests(docs.limit(0), WORD).collect() == []


def test_pieces_match_the_library():
    texts = CASES + random_texts(1500)
    library = tokenizers.Tokenizer.from_file(BYTE)
    own = token_files.PieceIds(bpe.tokenizer_text(BYTE), remember=500)
    for at in range(0, len(texts), 200):
        ids, ends = own.texts(pa.array(texts[at:at + 200]))
        for text, a, b in zip(texts[at:at + 200], ends, ends[1:]):
            assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_marks_and_line_ends_make_no_new_words():
    """Letters, marks and line ends are remembered apart, with the library's ids."""
    heads = ["Anblewh", "\u00e9ai\u0153", "x", "and"]
    texts = [" ".join(f"{a}{m}{c}" for a in heads for m in (".", ",", ".)", "?!", "-") for c in ("", *(f"\n{b}{n}" for b in heads for n in ("", ".", "'s", "\nx"))))]
    texts += ["don't, we'll. a.\n\nb c\n d\u00b7e. f\u00aa. <|endoftext|>. x.\n<|endoftext|>y", "a\u0300. \u0130. \u017f. 7. seven7.\nx a_b."]
    library = tokenizers.Tokenizer.from_file(BYTE)
    own = token_files.PieceIds(bpe.tokenizer_text(BYTE))
    ids, ends = own.texts(pa.array(texts))
    for text, a, b in zip(texts, ends, ends[1:]):
        assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, text
    own.forget()
    own.texts(pa.array(["a " + " ".join(f"{a}.\n{b}," for a in heads for b in heads)]))
    assert len(own.known) <= 2 * len(heads) + 4  # the marks, the line end and "a", not one for each pair


def test_token_files(spark):
    ready(spark)
    texts = [None, *CASES, *random_texts(120)]
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    docs = spark.createDataFrame([(texts[k], k * 7 - 50, "b", b"f") for k in order], "text string, doc_id long, bucket string, frame binary")
    files = token_files.write(docs, BYTE, docs_per_bucket=40, docs_per_segment=16, dict_bytes=2048)
    library = tokenizers.Tokenizer.from_file(BYTE)
    want, start = [], 0
    for k, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((k * 7 - 50, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    got = sorted(tuple(r) for r in token_files.read(spark, files, with_ids=True).collect())
    assert got == want
    row = files.segments(spark).orderBy("bucket", "segment").first()
    one = token_files.SegmentReader(bytes(row["data"]), files.dictionary(spark))
    assert one.ids(5).tolist() == want[5][4]  # a single document, without its neighbours
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.SegmentReader(bytes(row["data"]), b"other")
    assert files.segments(spark).count() > 5


def test_token_files_with_ties_and_nothing(spark):
    docs = spark.createDataFrame([(None, "no id"), (1, "one"), (1, "one"), (1, "other"), (-5, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in token_files.read(spark, token_files.write(docs, BYTE)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, -5, 1, 1, 1]
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:])) and got[1][2] == 1
    assert token_files.read(spark, token_files.write(docs.limit(0), BYTE)).collect() == []
