import random
import re

import pytest
from pyspark.sql import functions as F

from reposift.functions import text as X

def slow_normalize(text):
    """Character by character: line ends become LF, both ends and the right side of every line lose their blanks."""
    ends = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
    first, last = 0, len(text)
    while first < last and text[first].isspace():
        first += 1
    while last > first and text[last - 1].isspace():
        last -= 1
    lines, line = [], []
    for place in range(first, last):
        c = text[place]
        if c not in ends:
            line.append(c)
        elif not (c == "\n" and place > first and text[place - 1] == "\r"):
            lines.append("".join(line))
            line = []
    out = []
    for one in [*lines, "".join(line)]:
        keep = len(one)
        while keep and one[keep - 1].isspace():
            keep -= 1
        out.append(one[:keep])
    return "\n".join(out)


# Fixed patterns: the same steps in Python's own dialect
PYTHON = {
    "strip_html_comments": lambda s: re.sub("(?s)<!--.*?-->", "", s),
    "strip_code_blocks": lambda s: re.sub("(?s)```.*?```", "", s),
    "strip_inline_code": lambda s: re.sub("`[^`]*`", "", s),
    "unwrap_links": lambda s: re.sub(r"\[([^\]]+)\]\([^\)]+\)", r"\1", s),
    "strip_headings": lambda s: re.sub(r"(?m)^#+\s+", "", s),
    "strip_blockquotes": lambda s: re.sub(r"(?m)^>\s+", "", s),
    "strip_bold": lambda s: re.sub(r"(\*\*|__)(.*?)\1", r"\2", s),
    "strip_italics": lambda s: re.sub(r"(\*|_)(.*?)\1", r"\2", s),
    "collapse_whitespace": lambda s: re.sub(r"\s+", " ", s).strip(),
    "trim_unicode": lambda s: s.strip(),
    "normalize_text": slow_normalize,
}
PIECES = ["a", "b_c", "é", "漢", " ", "\t", "\n", "\r\n", "\r", "\x0b", "\x1c", "\x1f", "\x85", " ", " ", "\xa0",
          "*", "**", "_", "__", "`", "```", "#", "## ", "> ", ">", "[", "]", "(", ")", "<!--", "-->", "https://x.y/z?q=1"]


def random_texts(n=1500):
    rng = random.Random(7)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(random_texts())], "i int, t string").cache()


@pytest.mark.parametrize("name", PYTHON)
def test_step_equals_python(texts, name):
    got = texts.select("t", getattr(X, name)(F.col("t")).alias("out")).collect()
    wrong = [(r.t, r.out, PYTHON[name](r.t)) for r in got if r.out != PYTHON[name](r.t)]
    assert not wrong, wrong[:3]


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("o")).first().o


@pytest.mark.parametrize("given, wanted", [
    ("a_b_c", "abc"), ("[k](x.md)", "k"), ("[k](https://x)", "[k]("), (None, ""), ("", ""), ("a ** b", "a b"),
    ("see https://a.b/c#frag now", "see #frag now"), ("x\n\n# Title\n> said", "x Title said"), ("`a` <!-- n\n --> b", "b"),
])
def test_clean_text(spark, given, wanted):
    assert one(spark, given, X.clean_text) == wanted


def test_links_first(spark):
    assert one(spark, "[k](https://x)", lambda c: X.clean_text(c, links_first=True)) == "k"


def test_long_url_and_long_text(spark):
    assert one(spark, "a https://x/" + "y" * 200_000 + " b", X.clean_text) == "a b"
    assert one(spark, "w " * 200_000, X.clean_text) == ("w " * 200_000).strip()


@pytest.mark.parametrize("blank", [" ", "\t", "\x1c", "\x1f", " \t"])
def test_long_runs_of_blanks_take_linear_time(spark, blank):
    import time

    one(spark, "warm  \nup", X.normalize_text)
    began = time.time()
    assert one(spark, "a" + blank * 200_000 + "b\nc", X.normalize_text).endswith("b\nc")
    assert time.time() - began < 5


def test_clip_counts_characters(spark):
    clipped = one(spark, "é" * 12_001, X.clip_issue_text)
    assert clipped.startswith("é" * 12_000 + "\n\n[TRUNCATED:")
    assert one(spark, "é" * 12_000, X.clip_issue_text) == "é" * 12_000


@pytest.mark.parametrize("given, wanted", [("=1", "'=1"), ("", ""), (" =1", " =1"), ("-x", "'-x"), ("@a", "'@a"), (None, None)])
def test_escape_csv_formula(spark, given, wanted):
    assert one(spark, given, X.escape_csv_formula) == wanted


def test_shapes(spark):
    row = spark.createDataFrame([(" T ", None, 5)], "t string, b string, n long").select(
        X.embedding_text(F.col("t"), F.col("b")).alias("e"), X.combine_text(F.col("t"), F.col("b")).alias("c"),
        X.issue_payload(F.col("t"), F.col("b")).alias("p"), X.issue_key(F.lit("o/r"), F.col("n")).alias("k"),
        X.fence_text(F.col("n"), F.lit("x")).alias("f"), X.match_message(F.col("n"), F.lit(0.954), "Bot: ").alias("m")).first()
    assert row.e == "T\n" and row.c == " T \n" and row.p == "TITLE: T | BODY: " and row.k == "o/r#5"
    assert row.f == "BEGIN_UNTRUSTED_ISSUE_5\nx\nEND_UNTRUSTED_ISSUE_5" and row.m == "Bot: Duplicate of #5 (95% match)."
