"""Chunked encoding against the tokenizer itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from probelake.llm import bpe_chunks
from tests.conftest import data

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, key string, pos int, kind int, digest string"


@pytest.fixture(scope="module")
def own():
    return Tokenizer.from_file(PATH)


def want(own, text):
    ids = own.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(own.decode(ids, skip_special_tokens=False))


ODD = [
    "", " ", "\n", "   \n\n\t  x", "it's we'll I'VE 'd'", "x'" + "re" * 5, "<|endoftext|>", "a<|endoftext|> b<|endof", "é́ naïve 日本語 123² Ⅷ", "\U0001f600\U0001f468‍\U0001f469 ok", "\x00\x1c\x1f\x85  .", "aİıǅʰͰ", "...!!!  ??  \r\n\r\n  end  ",
]


def test_words_are_those_of_the_tokenizer(own):
    enc = bpe_chunks.encoder(PATH)
    rnd = random.Random(5)
    letters = "ab Zéß09.,'\"\n\t  _$<|>łɏ"
    for text in [*ODD, *("".join(rnd.choices(letters, k=rnd.randint(1, 60))) for _ in range(3000))]:
        assert enc.encode(text.encode()).tolist() == own.encode(text, add_special_tokens=False).ids, repr(text)
        assert enc.report(enc.encode(text.encode())) == want(own, text)


@pytest.mark.parametrize("seed", range(6))
def test_joins_agree_wherever_a_text_is_cut(own, seed):
    enc, rnd = bpe_chunks.encoder(PATH), random.Random(seed)
    pieces = ["hello world ", "don't ", "   ", "\n\n", "abc" * 40, " " * 150, "<|endoftext|>", "日本語" * 20, "1234567890" * 15, "we'll", "'", "re", "x", "!?" * 90, "\U0001f600", "été "]
    for _ in range(150):
        text = "".join(rnd.choices(pieces, k=rnd.randint(2, 30)))
        ends = sorted({0, len(text), *(rnd.randrange(len(text)) for _ in range(rnd.randint(1, 8)))})
        joiner = bpe_chunks.Joiner(enc)
        for i, j in zip(ends, ends[1:], strict=False):
            joiner.add(enc.marked(text[i:j].encode()))
        assert joiner.finish().tolist() == own.encode(text, add_special_tokens=False).ids, repr(text)


def test_chunks_are_the_text_and_follow_their_content():
    rnd = random.Random(1)
    text = " ".join(rnd.choice(["alpha", "béta", "日本", "delta", str(rnd.random())]) for _ in range(20_000)).encode()
    parts = bpe_chunks.chunks(text)
    assert b"".join(parts) == text and all(p.decode() for p in parts)
    moved = bpe_chunks.chunks(b"another beginning " * 30 + text)
    assert len(set(parts) & set(moved)) >= 0.9 * len(parts)
    assert bpe_chunks.chunks(b"") == []
    flat = bpe_chunks.chunks("日".encode() * 100_000)
    assert b"".join(flat) == "日".encode() * 100_000 and all(p.decode() for p in flat)


def test_a_long_run_without_words_is_joined(own):
    enc, text = bpe_chunks.encoder(PATH), "ab" * 40_000 + " end"
    joiner = bpe_chunks.Joiner(enc)
    for i in range(0, len(text), 1000):
        joiner.add(enc.marked(text[i : i + 1000].encode()))
    assert joiner.finish().tolist() == own.encode(text, add_special_tokens=False).ids
    assert not np.any(joiner.finish() & bpe_chunks.FIRST)


def test_documents_with_copies(spark, own):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(1, 9)))
    shared = [" ".join(word() for _ in range(1500)) for _ in range(3)]
    docs = [(k, rnd.choice(shared) if k % 3 == 0 else word() + rnd.choice(["", " ", "\n", "'s"]) + rnd.choice(shared) + " ".join(word() for _ in range(800)) + rnd.choice(shared)) for k in range(40)]
    docs += [(100 + k, t) for k, t in enumerate(ODD)] + [(None, shared[0]), (None, None), (7, shared[1]), (7, shared[1]), (8, "w" * 300_000), (9, " ".join(shared * 20))]
    frame = spark.createDataFrame([(i, t, "k", 1, 2, "d") for i, t in docs], DOCS).repartition(5)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_chunks.encode(frame, PATH).collect())
    assert got == sorted((str(i), *want(own, t)) for i, t in docs)


def test_shared_chunks_are_encoded_once(spark):
    text = " ".join(str(k * k) for k in range(4000))
    docs = spark.createDataFrame([(k, f"{k} {text} {k}") for k in range(20)], "doc_id long, text string").repartition(4)
    bits = bpe_chunks.shared_filter(docs)
    assert len(bits) == bpe_chunks.FILTER_BITS // 8
    inner = {bpe_chunks.digest(c) for c in bpe_chunks.chunks(f"0 {text} 0".encode())} & {bpe_chunks.digest(c) for c in bpe_chunks.chunks(f"1 {text} 1".encode())}
    assert inner and all(bits[(b := bpe_chunks._bit(d)) >> 3] >> (b & 7) & 1 for d in inner)
    assert sum(bin(x).count("1") for x in bits) == len(inner)


def test_nothing_and_the_given_table(spark, own):
    assert bpe_chunks.encode(spark.createDataFrame([], DOCS), PATH).count() == 0
    docs = spark.read.parquet(f"{data()}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_chunks.encode(docs, PATH).collect()}
    assert got == {r.doc_id: want(own, r.text) for r in docs.collect()}


def test_new_words_of_plain_text_need_the_model_alone(own, monkeypatch):
    """The whole tokenizer, a batch a text, took most of the time of texts with many new words (its threads wait for each other)."""
    enc, rnd = bpe_chunks.Encoder(PATH), random.Random(8)
    text = " ".join("".join(rnd.choices("etaoinshrdluçñéßØ019.-'", k=rnd.randint(1, 18))) for _ in range(4000))
    monkeypatch.setattr(enc, "own", None)
    assert enc.encode(text.encode()).tolist() == own.encode(text, add_special_tokens=False).ids
