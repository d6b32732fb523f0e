"""Prefix trie against plain counting."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from reposift.llm import prefixtrie as P

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    turns = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            turns[c].append((n is not None, n or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(mine, key=lambda x: x[:2] + (hashlib.sha256(f"{len(x[2])}:{x[2]}{x[3]}".encode()).hexdigest(),))]
           for c, mine in turns.items()}
    paths = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + mine[h:]
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, leaves, saved = [], {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        saved[node] = sum(saved[c] for c in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        ends = ",".join(str(c) for c in members[node] if len(paths[c]) == len(node))
        out.append((members[node][0], len(node), members[node[:-1]][0] if node else None, len(members[node]), len(children[node]),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations():
    rng, rows = np.random.default_rng(5), []
    for c in [*range(-3, 3), *range(95, 130), *range(300, 420), *range(1000, 1060)]:
        if c % 100 == 0 and c % 200:
            continue  # a base that isn't there
        for n in range(int(rng.integers(1, 8))):
            rows.append((c, n if n != 2 else None, ["user", "assistant", None][n % 3], ["hi", "ok", "", None, f"own {c}", "é🙂"][int(rng.integers(0, 6)) if n else 0]))
    rows += [(1100 + i, n, "user", f"same {n}") for i in range(30) for n in range(9)]  # copies
    rows += [(350, 100 + n, "user", "long" if n % 5 else f"turn {n}") for n in range(400)]  # one very long
    rows += [(351, 100 + n, "user", "long" if n % 5 else f"turn {n}") for n in range(380)]
    rows += [(None, 1, "user", "lost"), (7, 1, "a", "x"), (7, 1, "a", "x"), (7, 1, "a", "y"), (8, 1, "user", "z" * 20_000)]
    return rows


@pytest.mark.parametrize("bits,block,ends", [(None, 1024, 8192), (4, 16, 4)])
def test_against_plain_counting(spark, monkeypatch, bits, block, ends):
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "ENDS_PER_TEXT", ends)
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, p1 int").repartition(5)
    got = P.prefix_trie(df, bits=bits)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


def test_one_and_no_conversation(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert P.prefix_trie(spark.createDataFrame([], kind)).count() == 0
    rows = [(5, 1, "user", "a"), (5, 2, None, None)]
    assert sorted((tuple(r) for r in P.prefix_trie(spark.createDataFrame(rows, kind)).collect()), key=repr) == plain(rows)


def test_a_long_conversation_lies_in_several_ranges(spark):
    rows = [(200, n, "user", f"t{n % 7}") for n in range(3000)] + [(201 + n, 0, "user", "t0") for n in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    placed, sizes = P._positions(P._turns(df))
    assert sorted(r["pos"] for r in placed.where("conv_id = 200").collect()) == list(range(1, 3001))
    assert {r["conv_id"]: r["own"] for r in sizes.collect()}[200] == 3000
    assert P.prefix_trie(df).count() == len(plain(rows))


def test_an_estimate_is_never_too_small(spark):
    rng = np.random.default_rng(2)
    ids = rng.integers(-(2**62), 2**62, (500, 2))
    many = np.r_[ids, ids[:100], ids[:50]]
    df = spark.createDataFrame([tuple(map(int, r)) for r in many], "p1 long, p2 long").repartition(4)
    for bits in (6, 16):
        sketch = P.count_min(df, bits)
        least = np.minimum.reduce([sketch[r][P._counters(ids[:, 0].copy(), ids[:, 1].copy(), r, bits)] for r in range(P.ROWS)])
        assert (least[:100] == 2).all() and (least >= 1).all()
    assert (least[100:] == 1).mean() > 0.99


def test_batches_cut_anywhere_give_the_same_digest(spark):
    ids = [(1, 1, c) for c in range(5000)] + [(1, 2, 3)]
    df = spark.createDataFrame(ids, "p1 long, p2 long, conv_id long").repartition(7)
    got = {r["p2"]: r["ends_sha256"] for r in P._end_digests(df).collect()}
    assert got == {1: hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest(), 2: hashlib.sha256(b"3").hexdigest()}
