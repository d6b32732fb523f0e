"""Order MinHash against a plain computation."""

import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from reposift.llm import orderhash

MASK = ~((1 << 30) - 1)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def long_hash(x, seed=42):
    return signed(xxhash.xxh64_intdigest((x & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little"), seed & 0xFFFFFFFFFFFFFFFF))


def slow_items(text):
    """(hash with occurrence number, place) of every k-mer."""
    kmers = re.findall(r"(?=(\S{1,4}\s*\S{1,4}))\S{1,4}", text) or [text]
    seen, items = Counter(), []
    for place, kmer in enumerate(kmers):
        h = signed(xxhash.xxh64_intdigest(kmer.encode(), 42)) & MASK
        n, seen[h] = seen[h], seen[h] + 1
        items.append((h if not n else None, h, n, place))
    return items


def test_items_and_slots(spark):
    draw = random.Random(3)
    texts = ["", " ", "a", "That it.", "ab " * 40, "x" * 300, "é日😀 " * 9, *(" ".join(draw.choices(["the", "of", "thing", "ab"], k=60)) for _ in range(12))]
    starts = orderhash.starting_places(8)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select("text", orderhash.signature(F.col("text"), starts, 2).alias("slots"), orderhash._numbered(F.sort_array(F.transform(
        F.when(F.size(F.regexp_extract_all("text", F.lit(orderhash.KMER), F.lit(1))) == 0, F.array("text")).otherwise(
            F.regexp_extract_all("text", F.lit(orderhash.KMER), F.lit(1))),
        lambda x, i: F.xxhash64(x).bitwiseAND(F.lit(MASK).cast("long")).bitwiseOR(i.cast("long"))))).alias("items")).collect()
    for r in got:
        items = slow_items(r["text"])
        assert sorted(x & ~MASK for x in r["items"]) == list(range(len(items)))
        by_place = {x & ~MASK: x & MASK for x in r["items"]}
        named = {}
        for first, h, n, place in items:
            if first is not None:
                assert by_place[place] == h
            assert named.setdefault((h, n), by_place[place]) == by_place[place]
        assert len(set(by_place.values())) == len(items)
        order = sorted(r["items"])
        for slot, start in zip(r["slots"], starts):
            at = sum(x < start for x in order)
            chosen = sorted(((order[(at + k) % len(order)]) for k in range(2)), key=lambda x: x & ~MASK)
            digest = 42
            for x in chosen:
                digest = long_hash((x >> 30) & ((1 << 34) - 1), digest)
            assert slot == (digest & 0xFFFF) - (1 << 15)


@pytest.mark.parametrize("ids", [[5, 3, 9, 1, 7, None, 3], [4], [], [None, None], list(range(40))])
def test_next_document(spark, ids):
    rows = [(i, f"text {k} {i}" if k % 4 else None) for k, i in enumerate(ids)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, slots string").repartition(3)
    got = orderhash.edited_fingerprints(docs, permutations=4).collect()
    texts = {(i, t or "") for i, t in rows}
    known = {(i, t): signed(xxhash.xxh64_intdigest(t.encode(), 42)) for i, t in texts}
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), known[x], x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        away = len(t) // 3
        want.append((i, len(t), t[: len(t) - away] + order[(k + 1) % len(order)][1][:away]))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited"]) for r in got), key=repr) == sorted(want, key=repr)


def test_likeness_follows_edits(spark):
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(1, 9))) for _ in range(400)]
    moved = words[200:] + words[:200]
    swapped = words.copy()
    draw.shuffle(swapped)
    few = [w if i % 50 else "edit" for i, w in enumerate(words)]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate([words, few, swapped, moved, words])], "doc_id long, text string")
    slots = {r["doc_id"]: r["slots"] for r in orderhash.order_fingerprints(df, permutations=128).collect()}
    like = [sum(a == b for a, b in zip(slots[0], slots[k])) / 128 for k in range(5)]
    assert like[4] == like[0] == 1 and like[1] > 0.7 > like[3] > like[2]
