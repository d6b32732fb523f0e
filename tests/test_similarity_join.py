"""Threshold self-join and TF-IDF weights against plain computations."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from reposift.operators import pairs as P
from reposift.operators import similarity_join as J
from reposift.operators.tfidf import embed_tfidf, tfidf


def issues():
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(60)] + ["the"] * 30 + ["Ä-ö", "x1"]
    rows, texts = [], []
    for i in range(150):
        if i % 5 == 0 and texts:
            text = re.sub(r"w1\d", "other", texts[int(rng.integers(len(texts)))])
        else:
            text = " ".join(rng.choice(vocabulary, rng.integers(0, 30)))
        texts.append(text)
        rows.append((["hot", "hot", "b", None][i % 4] if i % 11 else "c", i + 1, f" T{i % 9} ", text if i % 17 else None))
    rows += [("hot", 1000 + i, "copy", "same words in each of them here") for i in range(12)]
    return [*rows, ("d", 1, "alone", "alone"), ("hot", 2000, "", "")]


def plain_weights(rows):
    docs = {}
    for repo, number, title, body in rows:
        text = title + "\n" + (body or "").strip()
        docs[repo, number] = Counter(re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text.lower()))
    df = Counter(w for c in docs.values() for w in c)
    out = {}
    for key, c in docs.items():
        raw = {w: n * math.log((len(docs) + 1) / (df[w] + 1)) for w, n in c.items()}
        length = math.sqrt(sum(x * x for x in raw.values()))
        out[key] = {w: x / length for w, x in raw.items() if x > 0}
    return out


def plain_pairs(rows, least):
    weights = plain_weights(rows)
    found = {}
    for (r1, n1), a in weights.items():
        for (r2, n2), b in weights.items():
            if r1 is not None and r1 == r2 and n1 > n2:
                cosine = round(sum(x * b.get(w, 0.0) for w, x in a.items()), 9)
                if cosine >= least:
                    found[r1, n1, n2] = cosine
    return found


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(issues(), "repo_name string, issue_number long, title string, body string").repartition(3).cache()


@pytest.mark.parametrize("least", [0.2, 0.4, 0.8, 1.0])
@pytest.mark.parametrize("slack", [0.5, 1.0])
def test_all_pairs_at_the_threshold(table, monkeypatch, least, slack):
    monkeypatch.setattr(J, "SLACK", slack)
    got = {(r["repo"], r["issue_1_number"], r["issue_2_number"]): r["cosine_similarity"] for r in P.similar_pairs(table, least, with_text=False).collect()}
    want = plain_pairs(issues(), least)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-9) for k in got)


def test_signed_vectors(spark):
    """The bound on the rest holds whatever the signs."""
    rng = np.random.default_rng(2)
    rows = []
    for n in range(80):
        x = rng.normal(size=12) * (rng.random(12) < 0.5) + (n % 3 == 0)
        x /= np.linalg.norm(x) or 1.0
        rows.append(x)
    df = spark.createDataFrame([("g", n, f"{i:02d}", i, float(v)) for n, x in enumerate(rows) for i, v in enumerate(x) if v], "g string, n long, word string, df int, weight double")
    got = {(r["number_1"], r["number_2"]) for r in J.similar_pairs(df, "g", "n", 0.6).collect()}
    assert got == {(a, b) for a in range(80) for b in range(a) if round(float(rows[a] @ rows[b]), 9) >= 0.6}


def test_weights(spark, table):
    texts = [(i, t) for i, t in enumerate(["a b b", "A c", None, "", "a"])]
    got = {(r["n"], r["word"]): r["weight"] for r in tfidf(spark.createDataFrame(texts, "n int, text string"), ["n"]).collect()}
    a, b, c = math.log(6 / 4), 2 * math.log(6 / 2), math.log(6 / 2)
    want = {(0, "a"): a / math.hypot(a, b), (0, "b"): b / math.hypot(a, b), (1, "a"): a / math.hypot(a, c), (1, "c"): c / math.hypot(a, c), (4, "a"): 1.0}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_texts_and_counts(table):
    pairs = P.similar_pairs(table)
    assert pairs.columns == ["repo", "issue_1_number", "issue_1_text", "issue_2_number", "issue_2_text", "cosine_similarity", "is_duplicate"]
    found = plain_pairs(issues(), 0.4)
    counts = {r["repo_name"]: (r["issues"], r["pairs"]) for r in P.similar_counts(table, pairs).collect() if r["repo_name"]}
    assert counts == {g: (sum(r[0] == g for r in issues()), sum(k[0] == g for k in found)) for g in ("hot", "b", "c", "d")}


def test_counts_cover_all_pairs(table, monkeypatch):
    from catalog import pairs as Q

    monkeypatch.setattr(Q, "view", lambda spark, folder, name: table.unionByName(table.limit(40)))
    counted = {r["repo_name"]: r for r in Q.counts(table.sparkSession, "").collect()}
    numbers = {g: {r[1] for r in issues() if r[0] == g} for g in ("hot", "b", "c", "d")}
    assert {g: counted[g]["pairs"] for g in numbers} == {g: len(n) * (len(n) - 1) // 2 for g, n in numbers.items()}
    assert counted[None]["pairs"] == counted[None]["alike"] == 0 and 0 < counted["hot"]["alike"] < counted["hot"]["pairs"]


def test_no_python_and_no_unfiltered_pairs(table):
    plan = P.similar_pairs(table, with_text=False)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_empty(spark):
    empty = spark.createDataFrame([], "repo_name string, issue_number long, title string, body string")
    assert P.similar_pairs(empty).count() == 0


def test_hashed_vectors(spark):
    import hashlib

    texts = [(i, t) for i, t in enumerate(["a b b", "A c", None, "", "a", "a a a"])]
    df = spark.createDataFrame(texts, "n int, text string")
    got = {r["n"]: r["embedding"] for r in embed_tfidf(df, ["n"], dimension=16).collect()}
    raw = {0: {"a": 1, "b": 2}, 1: {"a": 1, "c": 1}, 2: {}, 3: {}, 4: {"a": 1}, 5: {"a": 3}}
    for n, counts in raw.items():
        want = np.zeros(16)
        for w, tf in counts.items():
            digest = hashlib.md5(w.encode()).hexdigest()
            want[int(digest[:8], 16) % 16] += tf * math.log(7 / ({"a": 4}.get(w, 1) + 1)) * (1 if digest[8] < "8" else -1)
        assert got[n] == pytest.approx(want / (np.linalg.norm(want) or 1.0), abs=1e-6)
    assert "Python" not in embed_tfidf(df, ["n"])._jdf.queryExecution().toString()
