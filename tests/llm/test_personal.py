"""Personal data against plain regular expressions; trees, thresholds and redaction."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reposift.llm import personal as P

# The base patterns as they are stated
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    each = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in each) % 10 == 0


def slow_base(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


def slow_redact(text, spans):
    out, at = "", 0
    for s in spans:
        if s["start"] >= at:
            out += text[at : s["start"]] + "[" + s["kind"].upper() + "]"
        at = max(at, s["end"])
    return out + text[at:]


def texts():
    draw = random.Random(5)
    odd = [None, "", "a@b.c", "a@b_c@d.com x@y.z_d@e.f", "1.2.3.4.5.6.7.8 0001.02.3.255 1.2.3.256 1.2.3.99999999999999999999",
           "4111 1111-1111 1111 4111111111111111", "+1 (234) 555-6789 +123456789012345678", "😀é a.b@c.d.e é +49 30 123456 4012888888881881",
           "9" * 4000, "a" * 30_000 + "@b.co", "1 " * 20_000, "+1(" * 3000, "4111111111111111 " * 700, "x" * 200_000]
    odd += ["".join(draw.choice("ab1234567890 .-+()@éÉ😀\n%_") for _ in range(draw.randint(0, 80))) for _ in range(700)]
    return odd + ["".join(draw.choice("12.-+ @a") for _ in range(draw.randint(0, 60))) for _ in range(500)]


def test_base_spans_and_redaction(spark):
    given = texts()
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(given)], "doc_id long, text string, spans int").repartition(6)
    found = P.find_personal_data(docs, keep=["text"])
    for r in found.withColumn("redacted", P.redact(F.col("text"), F.col("spans"))).collect():
        text = given[r["doc_id"]]
        assert [(s["start"], s["rank"], s["end"], s["kind"]) for s in r["spans"] if s["base"]] == slow_base(text), text
        for s in r["spans"]:
            assert s["base"] or not any(b["base"] and b["start"] < s["end"] and s["start"] < b["end"] for b in r["spans"])
        assert r["redacted"] == (slow_redact(text, r["spans"]) if text is not None else None)


def test_learned_spans(spark):
    draw = random.Random(9)
    hexed = lambda: "".join(draw.choices("0123456789abcdef", k=40))
    rows = []
    for i in range(240):
        secret = hexed()
        lead = draw.choice(['token = "', "password: ", 'secret="'])
        rows.append((i, f"some words {lead}{secret}\" more", "keys"))
        rows.append((1000 + i, f"see issue-{i}-of-the-long-named-branch and file_{i}_version_two_of_three", "names"))
    rows += [(5001, "just clean words, 12 of them, version 2.0", "clean"), (None, None, "null")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["source"], r["spans"]) for r in P.find_personal_data(docs, keep=["source"]).collect()}
    assert all(len(s) == 1 and s[0]["kind"] == "secret" for source, s in got.values() if source == "keys")
    assert not any(s for source, s in got.values() if source in ("names", "clean", "null"))
    assert P.find_personal_data(docs.limit(0)).count() == 0


def test_models_are_fitted_on_all_candidates(spark):
    draw = random.Random(4)
    rows = []
    for i in range(5000):
        lead = draw.choice(["token: ", "secret=", "see ", "", "file ", "key: "])
        rows.append((i, lead + "".join(draw.choices("0123456789abcdefXYZ_-", k=draw.randint(18, 45)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = docs.select("doc_id", P.candidates(F.col("text")).alias("candidates")).cache()
    got = P.learn(found)["secret"]
    each = found.select("doc_id", F.explode("candidates").alias("c")).where("c.kind = 'secret'").select(
        P.features(F.col("c")).alias("x"), F.coalesce(P.weak_label(F.col("c")), F.lit(False)).alias("y"),
        (F.xxhash64(F.lit(3), "doc_id", "c.start", "c.found") % 2 == 0).alias("held")).collect()
    x, y, held = (np.array([r[k] for r in each], float) for k in ("x", "y", "held"))
    want = P.fit(x, y, held > 0)
    assert len(each) > 4000 and got.base == pytest.approx(want.base) and len(got.trees) == len(want.trees)
    assert np.allclose(got.log_odds(x), want.log_odds(x)) and got.threshold == pytest.approx(want.threshold, abs=2e-6)


def test_trees_as_expressions(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, (800, len(P.FEATURES))).astype(float)
    y = ((x[:, 0] > 4) & (x[:, 3] < 6)).astype(float)
    model = P.fit(x, y, np.arange(800) % 2 == 0)
    scores = 1 / (1 + np.exp(-model.log_odds(x)))
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "k int, x array<double>")
    told = np.array([r["s"] for r in df.select("k", model.score(F.col("x")).alias("s")).orderBy("k").collect()])
    assert np.allclose(told, scores)
    assert ((scores >= model.threshold) == y).mean() > 0.97
    assert P.fit(x, np.zeros(800), np.arange(800) % 2 == 0).threshold == 2.0
    assert P.fit(x[:0], y[:0], np.zeros(0, bool)).threshold == 2.0


@pytest.mark.parametrize("digits", ["0", "4111111111111111", "4111111111111112", "79927398713", ""])
def test_luhn(spark, digits):
    assert spark.range(1).select(P.luhn(F.lit(digits))).first()[0] == (bool(digits) and luhn(digits))
