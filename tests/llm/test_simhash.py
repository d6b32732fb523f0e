"""SimHash near copies against a direct computation."""

import random
import re

import numpy as np
import xxhash

from reposift.llm import simhash
from reposift.llm.components import connected_components


def slow_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, linked):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints():
    draw = random.Random(2)
    texts = [None, "", " \t", "A", "a b", "a B c", "É é\x0bx\x1cy", *(" ".join(draw.choices(["the", "of", "X.", "ü"], k=draw.randint(1, 90))) for _ in range(60))]
    for text in texts:
        for n in (3, 5):
            assert simhash.text_fingerprint(text and text.encode(), n) == slow_fingerprint(text, n), text


def test_near_fingerprints_share_the_home_anchor():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**63), 2**63 - 1, 300, dtype=np.int64)
    for threshold in (0, 1, 2, 3):
        rows, keys, home = simhash.anchors(x, threshold)
        assert home.sum() == len(x)
        y = x.copy().view(np.uint64)
        for _ in range(threshold):
            y ^= np.uint64(1) << rng.integers(0, 64, len(y), dtype=np.uint64)
        other_rows, other_keys, _ = simhash.anchors(y.view(np.int64), threshold)
        own = dict(zip(rows[home].tolist(), keys[home].tolist()))
        met = set(zip(other_rows.tolist(), other_keys.tolist()))
        assert all((row, key) in met for row, key in own.items())
        assert len(met) == len(other_rows)


def _links(spark, values, threshold=2):
    df = spark.createDataFrame([(int(v),) for v in values], "fp long").repartition(3)
    return connected_components(simhash.fingerprint_links(df, threshold))


def test_links_with_split_anchors(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOMES_PER_PART", 4)
    rng = np.random.default_rng(4)
    seeds = rng.integers(-(2**63), 2**63 - 1, 6, dtype=np.int64)
    values = {int(v) for v in seeds}
    for v in seeds:
        for _ in range(40):
            flips = np.bitwise_xor.reduce(np.left_shift(np.uint64(1), rng.integers(0, 64, rng.integers(1, 4), dtype=np.uint64)))
            values.add(int((np.array([v]).view(np.uint64) ^ flips).view(np.int64)[0]))
    values = sorted(values)
    bits = np.array(values).view(np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 2
    want = slow_components(values, [(values[i], values[j]) for i, j in zip(*np.nonzero(near))])
    got = {r["node"]: r["root"] for r in _links(spark, values).collect()}
    assert all(got.get(v, v) == want[v] for v in values)


def test_documents(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(9, long), (3, long.replace("w77 ", "w78 ")), (5, None), (4, ""), (7, "one two"), (8, "One  TWO"), (None, "one two"), (None, "alone"), (7, "one two")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_copies(docs).collect()}
    assert got == {(9, 3), (3, 3), (5, 4), (4, 4), (7, 7), (8, 7), (None, 7), (None, None)}
    kept = sorted(map(repr, (r["doc_id"] for r in simhash.drop_copies(docs).collect())))
    assert kept == sorted(map(repr, [3, 4, 7, None])) and simhash.drop_copies(docs).columns == docs.columns
    assert simhash.near_copies(docs.limit(0)).count() == 0


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 60)] + [(5, 5), (None, 4), (7, None), (6, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in range(5, 60)}}
