import hashlib
import random
import struct
import unicodedata

import pytest
from tokenizers import Tokenizer

from quernel.llm import bpe, token_count

TEXTS = [
    "",
    "Hello  World's 123 <|endoftext|> ΣΑΣ İ  x'LL don'T ſ é\n​ ~!!",
    "<|startoftext|><|endoftext|>x<|end",
    "漢字かな交じり文 😀😀 ՘ a\x1cb a\x85b",
    "é Å K ﬁ",
    "a" * 20_000,
    "ab " * 15_000 + "x" * 40_000 + " y<|endoftext|>",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def marked_texts(n):
    """Letters with combining marks beside digits, punctuation and special tokens, composed, decomposed and mixed; lower case that leaves the plain range."""
    rng = random.Random(7)
    bits = ["<|endoftext|>", "2", "19", "!", "'s", "'LL", " ", "\n", "\x1c", "\x85", "–", "²"]
    fixed = ["bạn2", "Cảm ơn bạn, tôi đến.", "Ḥasan's", "Ⱥ2", "ȾȾ!"]
    texts = [unicodedata.normalize(form, t) for t in fixed for form in ("NFC", "NFD")]
    for _ in range(n):
        text = "".join(
            rng.choice("aeiouyAEIOUbdhsnHSDĥạẞȺİſΣσΑЙßơƯ漢é한") + "".join(chr(rng.randint(0x300, 0x36F)) for _ in range(rng.choice([0, 0, 1, 1, 2]))) if rng.random() < 0.6 else rng.choice(bits)
            for _ in range(rng.randint(1, 25))
        )
        form = rng.choice(["NFC", "NFD", None])
        texts.append(unicodedata.normalize(form, text) if form else text)
    return texts


def test_marks_as_the_library(library):
    own = bpe.WordBpe(open(bpe.default_path(), "rb").read())
    counter = token_count.Transducer(own)
    texts = marked_texts(20_000)
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text) == struct.pack(f"<{len(e.ids)}I", *e.ids), ascii(text)
        assert counter.count(text) == len(e.ids) == counter.count(text, 5), ascii(text)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(none).count() == 0 and token_count.count_tokens(none).count() == 0


def some_texts():
    rng = random.Random(1)
    return TEXTS + ["".join(rng.choice("aabcdeth'é😀<|>12 \n\t.,endoftext") for _ in range(rng.randint(1, 200))) for _ in range(800)]


def test_encode_and_decode_as_the_library(spark, library):
    texts = some_texts()
    frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(-1, None, None)], "doc_id long, text string, ids_le string")
    out = {r.doc_id: r for r in bpe.encode(frame).collect()}
    assert out[-1].n_tokens == 0 and out[-1].decoded == ""
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert bytes(out[i].ids_le) == struct.pack(f"<{len(e.ids)}I", *e.ids), texts[i][:100]
        assert out[i].decoded == library.decode(e.ids, skip_special_tokens=False)


def test_ids_array(spark, library):
    frame = bpe.encode(spark.createDataFrame([("some words here",), ("",)], "text string"))
    assert [r[0] for r in frame.select(bpe.ids_array("ids_le")).collect()] == [library.encode("some words here", add_special_tokens=False).ids, []]


def test_long_words_take_levels(library):
    own = bpe.load(open(bpe.default_path(), "rb").read())
    rng = random.Random(4)
    for n in (2, 15, 16, 17, 18, 33, 257, 4000):
        word = "".join(rng.choice("theraion") for _ in range(n))
        assert own.word(word) == library.encode(word, add_special_tokens=False).ids


def test_counts_as_the_library(spark, library):
    texts = some_texts()
    frame = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)] + [(-1, None, None)], "doc_id long, text string, over_limit boolean")
    out = {r.doc_id: r for r in token_count.count_tokens(frame).collect()}
    assert (out[-1].n_bytes, out[-1].n_tokens, out[-1].over_limit) == (0, 0, False)
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert out[i].n_tokens == len(e.ids) and out[i].n_bytes == len(texts[i].encode()) and out[i].over_limit == (len(e.ids) > 2048)


def test_chunks_compose(library):
    counter = token_count.compiled(bpe.load(open(bpe.default_path(), "rb").read()))
    for text in some_texts()[:200]:
        if len(text) < 3000:
            assert {counter.count(text, n) for n in (1, 3, 7, 50)} == {len(library.encode(text, add_special_tokens=False).ids)}


def test_query_digests(spark, library, tmp_path):
    spark.createDataFrame([(1, "The end."), (1, "The end."), (None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = library.encode("The end.", add_special_tokens=False).ids
    rows = bpe.op3_bpe(spark, str(tmp_path)).collect()
    assert sorted(r.n_tokens for r in rows) == sorted([len(ids)] * 2 + [0])
    row = next(r for r in rows if r.n_tokens)
    assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
