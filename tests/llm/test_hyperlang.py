"""Language ID: exact n-gram counts, bundling, held-out accuracy."""

import random
import zlib
from collections import Counter

import numpy as np

from reposift.llm import hyperlang
from reposift.llm.hyperlang import Profiles


def test_counts_and_bundle(monkeypatch):
    made = Profiles(3, 64, 1)
    text = "Ab, c!! DÉ 12 ab"
    code = lambda s: sum((0 if c == " " else ord(c)) << 21 * (len(s) - 1 - i) for i, c in enumerate(s))
    spaced = " ab c dé ab "
    want = Counter(code(spaced[i : i + 3]) for i in range(len(spaced) - 2))
    grams, counts = made.counts(text)
    assert dict(zip(grams.tolist(), counts.tolist())) == want
    monkeypatch.setattr(hyperlang, "LETTERS_AT_ONCE", 4)
    again = made.counts(text)
    assert (again[0] == grams).all() and (again[1] == counts).all()
    whole = sum(n * made._vector(g).astype(float) for g, n in want.items())
    assert np.allclose(made.bundle(grams, counts), whole)
    monkeypatch.setattr(hyperlang, "CACHED_GRAMS", 3)
    assert np.allclose(made.bundle(grams, counts), whole) and np.allclose(made.bundle(grams, counts), whole)
    a, b, c = (made._letter(ord(x)) for x in "abc")
    assert (made._vector(code("abc")) == np.roll(a, 2) * np.roll(b, 1) * c).all()
    for nothing in ("", " 12 .", "!"):
        assert not len(made.counts(nothing)[0])


def corpus(n):
    draw = random.Random(5)
    parts = {"xx": ["tha", "ing", "ou", "er"], "yy": ["sch", "ein", "ü", "er"], "zz": ["que", "eau", "é", "en"]}
    rows = []
    for i in range(n):
        lang = draw.choice(list(parts))
        words = ["".join(draw.choices(parts[lang], k=draw.randint(1, 3))) for _ in range(draw.randint(3, 40))]
        rows.append((i, " ".join(words), lang if i % 10 else None, lang))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus(300)
    rows += [(1000, None, "xx", ""), (1001, "12 !!", "yy", ""), (1002, "", "zz", ""), (None, "the thing out", "xx", "xx"), (7, rows[7][1], "xx", rows[7][3]),
             (1003, "queeau " * 20_000, None, "zz")]
    docs = spark.createDataFrame([(i, t, lang, "s", "clash", 0.5) for i, t, lang, _ in rows],
                                 "doc_id long, text string, lang string, source string, lang_pred string, score double").repartition(4)
    got = hyperlang.identify_languages(docs, dim=512).collect()
    assert len(got) == len(rows)
    truth = {(i, t): want for i, t, _, want in rows}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if truth[r["doc_id"], r["text"]] == "":
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == truth[r["doc_id"], r["text"]] and 0 < r["score"] <= 1
    few = hyperlang.identify_languages(docs, keep=["doc_id"], dim=64)
    assert few.columns == ["doc_id", "held_out", "lang_pred", "score"]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, "abc", None)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in hyperlang.identify_languages(docs).collect()} == {("und", 0.0)}
    assert hyperlang.identify_languages(docs.limit(0)).count() == 0


def test_predictions_ignore_labels_of_held_out_rows(spark):
    rows = corpus(120)
    schema = "doc_id long, text string, lang string"
    told = []
    for wrong in (False, True):
        given = [(i, t, "yy" if wrong and zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang, _ in rows]
        got = hyperlang.identify_languages(spark.createDataFrame(given, schema), keep=["doc_id"], dim=256).collect()
        told.append(sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in got))
    assert told[0] == told[1]
