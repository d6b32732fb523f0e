"""BPE encoding and decoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reposift.llm.bpe import LONG_WORD, Vocabulary, encode_documents, token_digests

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return Vocabulary(PATH), Tokenizer.from_file(PATH)


def _same(both, texts):
    own, library = both
    for text, ids in zip(texts, own.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert own.decode(ids).decode() == library.decode(want, skip_special_tokens=False) == text


def test_odd_texts(both):
    _same(both, ["", " ", "\n\n  x\t", "<|endoftext|>", "a <|endoftext|>  b", "a" * 5000, "ab" * 700, "\x1c\x1d a\x85b", "日本語" * 200,
                 "😀" * 90, "it's we're I'LL 'd", "é" * 300 + " 123 ½ ٣", "x" * LONG_WORD, "x" * (LONG_WORD + 1)])


def test_random_mixtures(both):
    draw = random.Random(3)
    _same(both, ["".join(draw.choice("ab 1.\n\t'é日😀<|endoftext|>st　") for _ in range(draw.randint(0, 60))) for _ in range(300)])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x2FF), max_size=80))
def test_property(both, text):
    _same(both, [text])


def test_long_words_merge_like_short_ones(both):
    own = both[0]
    draw = random.Random(1)
    for n in (2, 17, 120):
        word = bytes(draw.choice(b"thernd") for _ in range(n))
        assert own._merge_long(word) == own.merge([word])[0]


def test_documents(spark, both):
    rows = [(1, "a b"), (1, "a b"), (None, "x"), (2, None), (3, ""), (4, "word " * 3000)]
    docs = spark.createDataFrame([(i, t, "s", "clash") for i, t in rows], "doc_id long, text string, source string, ids string")
    got = sorted(map(tuple, token_digests(encode_documents(docs, PATH)).collect()), key=repr)
    want = []
    for i, text in rows:
        ids = both[1].encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert encode_documents(docs.limit(0), PATH).count() == 0
