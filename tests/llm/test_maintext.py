"""Main text: held-out accuracy on labelled pages, the given pages against their article, odd pages."""

import itertools
import re
from html import unescape

import numpy as np
import pyarrow.parquet as pq
import pytest

from reposift.llm import crf
from reposift.llm import maintext as M
from reposift.llm.labelledpages import label_at, labelled_page
from reposift.llm.pageblocks import leaf_blocks


@pytest.fixture(scope="module")
def reader():
    return M.Reader(M.trained())


def test_held_out_pages(reader):
    right = wrong = 0
    for seed in range(50_000, 50_200):
        html, begins, labels = labelled_page(seed)
        blocks, states = reader.blocks(html)
        for block, state in zip(blocks, states):
            right, wrong = (right + 1, wrong) if label_at(begins, labels, block.begin) == state else (right, wrong + 1)
    assert right / (right + wrong) >= 0.985


def article(html):
    inner = re.search("<article>(.*)</article>", html, re.S)[1]
    parts = (" ".join(unescape(re.sub("</?b>|<br>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", inner))
    return "\n".join(p for p in parts if p)


def test_given_pages(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    got = {r["page_id"]: r for r in M.extract_main_text(spark.read.parquet(path)).collect()}
    for row in pq.read_table(path).to_pylist():
        assert got[row["page_id"]]["text"] == article(row["html"]) and got[row["page_id"]]["n_chars"] == len(article(row["html"]))


LONG = "This is a long enough sentence about the matter at hand, and it goes on for a while."


@pytest.mark.parametrize("html,want", [
    (f"<body><div id=nav><a href=1>Home</a> <a href=2>News</a></div><div class='post-body'><h1>Title here</h1><p>{LONG}<p>{LONG}</div>"
     f"<div class=comments><h3>2 comments</h3><div class=comment><p>{LONG}</p></div></div><div class='cookie-notice'>We use cookies. <button>OK</button></div></body>",
     f"Title here\n{LONG}\n{LONG}"),
    (f"<main><article><h1>T &amp; U&nbsp;x</h1><p>{LONG}</p><div class='ad'>Buy this now, it is cheap.</div><p>Yes.</p><ul><li>{LONG}</li></ul></article>"
     f"<aside class='sidebar'><h3>Related</h3><a href=1>Other story</a></aside></main><footer>&copy; 2020 Us</footer>",
     f"T & U x\n{LONG}\nYes.\n{LONG}"),
    (f"<article><h1>One thing</h1><p>{LONG}</p></article><section id='comments'><article class='comment'><p>{LONG}</p></article></section><form><p>Your mail</p><button>Go</button></form>", f"One thing\n{LONG}"),
    (f"<table><tr><td class=sidebar><a href=1>One</a><td class=content><h2>Head</h2><p>{LONG}</p></table>", f"Head\n{LONG}"),
])
def test_layouts(reader, html, want):
    assert reader.text(html) == want


def test_blocks():
    html = ("<!DOCTYPE html><title>no</title><body>a<br>b <b>c</b><!-- no --><script>if (a < b) '</p>'</script>d<p>e&lt;f&#233;&bogus; <i>g\n\t h</p>"
            "<ul><li>1<li>2<ul><li>3</ul></ul></i></div>x < y<p class=\"a>b\">z<style>p{}</style><![CDATA[q]]><textarea>no</textarea></p>tail <a href='u'>l</a> <div")
    assert [b.text for b in leaf_blocks(html)] == ["a b cd", "e<fé&bogus; g h", "1", "2", "3", "x < y", "zq", "tail l"]
    assert leaf_blocks(html)[-1].linked == 1 and leaf_blocks(html)[3].path[-1][0] == "li"
    assert [b.text for b in leaf_blocks("<p>cut <b>here <scr")] == ["cut here"]
    assert leaf_blocks(None) == leaf_blocks("") == leaf_blocks("<script>x") == []
    assert [b.text for b in leaf_blocks("<div>" * 3000 + "deep")] == ["deep"]


def test_viterbi_and_gradient_against_all_sequences():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5):
        scores, steps = rng.normal(size=n), rng.normal(size=(2, 2))

        def weight(states):
            return sum(s * x for s, x in zip(states, scores)) + sum(steps[a, b] for a, b in zip(states, states[1:]))

        every = list(itertools.product((0, 1), repeat=n))
        assert tuple(crf.Crf({}, steps).viterbi(list(scores))) == max(every, key=weight)
        chances = np.exp([weight(s) for s in every])
        one, moves, total = crf._expected(np.r_[scores, np.zeros(2)][None, :], steps, np.array([n]))
        assert np.allclose(one[0, :n], (chances[:, None] * np.array(every)).sum(0) / chances.sum()) and np.isclose(total, np.log(chances.sum()))
        want = np.zeros((2, 2))
        for s, c in zip(every, chances):
            for a, b in zip(s, s[1:]):
                want[a, b] += c / chances.sum()
        assert np.allclose(moves, want)


def test_rows_of_any_kind(spark):
    rows = [(1, "u", None, 5), (1, "u", None, 5), (None, None, "", 1), (2, "v", "<p>" + "word. " * 200_000, 2), (3, "w", "no tags at all, just text.", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = M.extract_main_text(pages).collect()
    assert len(got) == 5 and M.extract_main_text(pages.limit(0)).count() == 0
    found = {r["page_id"]: r for r in got}
    assert found[1]["text"] == "" and found[1]["n_chars"] == 0 and found[2]["n_chars"] == 200_000 * 6 - 1
