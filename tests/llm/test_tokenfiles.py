"""Token files: Elias-Fano select, an exact round trip, offsets."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reposift.llm import tokenfiles
from reposift.llm.eliasfano import EliasFano
from reposift.session import work_path

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=300))
def test_elias_fano(values):
    values = np.array(sorted(values), np.int64)
    read, end = EliasFano.read(memoryview(EliasFano.of(values).to_bytes() + b"x"), 0)
    assert read.all().tolist() == values.tolist()
    assert all(read.at(i) == values[i] for i in range(0, len(values), 7))
    with pytest.raises(IndexError):
        read.at(len(values))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 60_000))
    assert len(EliasFano.of(ends).to_bytes()) * 8 / len(ends) < 2.5 + np.log2(ends[-1] / len(ends))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abHTIKzé̸̱́Σß 日😀.,'<|>\n\t\x1c\x85", max_size=40))
def test_words_by_library(text):
    known = tokenfiles.tokens_of(PATH)
    ids = np.frombuffer(known.encode(text.encode(), 1), "<u2").tolist()
    assert ids == [*LIBRARY.encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("rows", [[], [(5, "b a"), (None, "none"), (2, None), (5, "b a"), (-3, "x" * 3000), (5, "a"), (9, "<|endoftext|> Z")]])
def test_round_trip(spark, monkeypatch, rows):
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, part int")
    path = work_path(spark, "tokens")
    tokenfiles.write_token_files(docs, PATH, 1, path)
    got = tokenfiles.token_offsets(spark, path).orderBy("start").collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == sorted((i is not None, i or 0) for i, _ in rows)
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    place, left = 0, [(i, [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]
    for r in got:
        match = next(x for x in left if x[0] == r["doc_id"] and zlib.crc32(np.array(x[1], "<u4").tobytes()) == r["ids_crc32"])
        left.remove(match)
        assert (r["start"], r["n_tokens"]) == (place, len(match[1]))
        place += len(match[1])
    assert not left
    read = {(r["doc_id"], bytes(r["ids"])) for r in tokenfiles.read_documents(spark, path).collect()}
    assert len(read) == len({(i, t) for i, t in rows})


def test_select_in_a_block():
    ids = [np.array(x, "<u2").tobytes() for x in ([4, 5, 1], [1], [9, 1])]
    (found,) = tokenfiles.blocks(tokenfiles.block(3, 100, 2, [None, 7, 7], ids) + b"\n")
    assert (len(found), found.part, found.before) == (3, 3, 100)
    assert [(n, i.tolist()) for n, i in map(found.document, range(3))] == [(None, [4, 5, 1]), (7, [1]), (7, [9, 1])]
    with pytest.raises(ValueError):
        next(tokenfiles.blocks(b"\0" * 100))
