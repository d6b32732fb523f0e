"""Mixing against a plain queue."""

import hashlib
import re

import pytest

from reposift.llm import mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > most * sizes[s] + 1e-9}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def plain_mix(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = {s for _, _, s in rows}
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in sources}
    target = plain_targets(total)
    copies = []
    for s in sources:
        queue = sorted((hashlib.md5(f"mix:{'' if d is None else d}".encode()).hexdigest(), d if d is not None else -1e18, size[i], i)
                       for i, (d, _, own) in enumerate(rows) if own == s)
        at = 0
        for key, d, n, i in queue:
            at += n
            copies += [((at + turn * total[s]) / target[s], key, d, n, i) for turn in range(2) if n]
    taken, spent = [0] * len(rows), 0
    for _, _, _, n, i in sorted(copies):
        spent += n
        if spent > sum(target.values()):
            break
        taken[i] += n
    return size, total, target, taken


@pytest.mark.parametrize("small", [False, True])
def test_against_a_plain_queue(spark, monkeypatch, small):
    if small:
        for name, value in (("ROWS_PER_BUCKET", 4), ("PARTS", 5), ("LAST_COPIES", 3)):
            monkeypatch.setattr(mixing, name, value)
    sources = ["a", "b", "é", "c", None, "B"]
    rows = [(i, "w " * (i * 7 % 23) if i % 11 else None, sources[i % 6] if i % 3 else "a") for i in range(300)]
    rows += [(None, "x y", "a"), (None, "x y z", "a"), (4, "one two", None), (500, "word\x0b" * 5000, "c"), (501, "", "empty")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, target int").repartition(5)
    got = mixing.mix_sources(docs)
    size, total, target, taken = plain_mix(rows)
    told = sorted(((r["doc_id"], r["source"], r["size"], r["source_size"], r["size"] * r["times"]) for r in got.collect()), key=repr)
    assert told == sorted(((d, s, size[i], total[s], taken[i]) for i, (d, _, s) in enumerate(rows)), key=repr)
    assert all(r["target"] == pytest.approx(target[r["source"]]) for r in got.collect())
    assert max(r["times"] for r in got.collect()) == 2


def test_empty_and_wordless(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix_sources(spark.createDataFrame([], schema)).count() == 0
    got = mixing.mix_sources(spark.createDataFrame([(1, None, "a"), (2, " ", None)], schema)).collect()
    assert [(r["size"], r["target"], r["times"]) for r in got] == [(0, 0.0, 0)] * 2


def test_single_source_takes_one_and_a_half(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('w ', 10) as text", "'s' as source")
    times = [r["times"] for r in mixing.mix_sources(docs).collect()]
    assert sorted(times) == [1] * 200 + [2] * 200
