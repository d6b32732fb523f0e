"""Collocations against plain counting, and the trie with tiny limits."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from reposift.llm import collocations as C
from reposift.llm import hattrie as H


def plain(rows, least, longest, top):
    f, n = Counter(), Counter()
    low = {c: c + 32 for c in range(65, 91)}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for at in range(len(words) - size + 1):
                    f[lang, tuple(words[at : at + size])] += 1
    out = []
    held = {k: v for k, v in f.items() if len(k[1]) >= 2 and v >= least}
    inside = {(lang, p[a:b], v) for (lang, p), v in held.items() for a in range(len(p)) for b in range(a + 2, len(p) + 1) if b - a < len(p)}
    for (lang, p), a in held.items():
        if (lang, p, a) not in inside:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    found = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        found += [(lang, i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return sorted(found)


def texts():
    rng = np.random.default_rng(3)
    words = ["A", "b", "ä", "c-d", "e", "É", "f g", "🙂", "h", "The", "of"]
    rows = []
    for i in range(300):
        some = rng.choice(words, rng.integers(0, 40), p=[0.3, 0.2, 0.1, 0.1, *[0.3 / 7] * 7])
        rows.append((rng.choice([" ", "\t", "  ", ". ", "\n", "!"]).join(some), ["en", "de", None, "und"][i % 4]))
    rows += [(None, "en"), ("", None), (" ,;. ", "de"), ("a b " * 3000, "en"), ("x" * 50_000 + " b", "en"), ("c\x00 c\x00 c\x00 c\x00 c\x00 c\x00", "fr")]
    return rows + rows[:20]


def test_against_plain_counting(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, *r, 1, "p") for i, r in enumerate(rows)], "doc_id long, text string, lang string, f int, phrase string")
    got = C.collocations(docs.repartition(3), least=6, longest=4, top=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 6, 4, 40)


@pytest.mark.parametrize("limits", [{}, {"BURST": 5, "MOST_WORDS": 9, "MOST_ENTRIES": 30}, {"SLICE_BYTES": 50, "MOST_WORDS": 4}])
def test_runs_of_a_task_with_small_limits(monkeypatch, limits):
    for name, value in limits.items():
        for module in (C, H):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, value)
    rows = [(t, g or "und") for t, g in texts()]
    batches = [pa.RecordBatch.from_pydict({"lang": [g for _, g in some], "text": [(t or "").encode() for t, _ in some]}) for some in (rows[:100], rows[100:101], rows[101:])]
    want = Counter()
    low = {c: c + 32 for c in range(65, 91)}
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, 5):
                for at in range(len(words) - size + 1):
                    want[lang, " ".join(words[at : at + size])] += 1
    gate, got = np.full(1 << C.GATE_BITS - 3, 255, np.uint8), Counter()
    for shortest, longest in ((1, 1), (2, 2), (3, 4)):
        for batch in C._counted(shortest, longest, gate)(iter(batches)):
            for lang, phrase, f in zip(*[c.to_pylist() for c in batch.columns]):
                got[lang, phrase] += f
    assert got == want


def test_numbers_past_64_bits(spark):
    big = spark.createDataFrame([(9_000_000_000_000, 90_000_000_000_000, 900_000_000_007, 900_000_000_011)], "a long, n long, l long, r long")
    score = big.selectExpr("cast(a as decimal(20,0)) * 1000 * cast(n as decimal(20,0)) div (cast(l as decimal(20,0)) * cast(r as decimal(20,0))) as s")
    assert score.first()["s"] == 9_000_000_000_000 * 1000 * 90_000_000_000_000 // (900_000_000_007 * 900_000_000_011)


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_trie_counts_prefixes_and_spills_whole_subtrees(monkeypatch):
    monkeypatch.setattr(H, "BURST", 8)
    rng = np.random.default_rng(1)
    trie, want = H.HatTrie(3), Counter()
    words = H.Words()
    words.ids("en", [str(i).encode() for i in range(1000)])
    for _ in range(20):
        rows = rng.integers(0, 700, (50, 3)).astype(np.int32)
        rows[rows[:, 2] % 3 == 0, 2] = H.NONE
        trie.add(rows)
        for r in rows.tolist():
            want[tuple(r[:2])] += 1
            if r[2] >= 0:
                want[tuple(r)] += 1
    before = trie.settle()
    rows, counts = trie.take(0.5)
    assert before / 2 <= len(rows) and trie.entries == before - len(rows)
    assert not {r & 255 for r in rows[:, 0].tolist()} & set(trie.root.children)
    got = Counter()
    for some in ((rows, counts), trie.take()):
        for batch in H.sorted_run(*some, words, 2):
            phrases = batch.column("phrase").to_pylist()
            assert phrases == sorted(phrases, key=lambda p: [w.encode() for w in p.split(" ")])
            for p, f in zip(phrases, batch.column("f").to_pylist()):
                got[tuple(map(int, p.split(" ")))] += f
    assert got == want and trie.entries == 0
