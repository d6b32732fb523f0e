"""License scan against plain searches."""

import random
import re

from reposift.llm import licences
from reposift.llm.licences import PHRASES, TEMPLATES, Templates, scan_licences, words_of


def slow_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_scan(words, templates, threshold):
    """Every window of the same places, every template, no filter."""
    found = set()
    for label, texts in templates.items():
        for text in texts:
            notice = words_of(text.encode())
            half, wanted = max(8, 1 << (len(notice) - 1).bit_length()), set(notice)
            for at in range(0, max(1, len(words)), half):
                shared = wanted & set(words[at : at + 2 * half])
                if len(shared) >= threshold * len(wanted) - 1e-9:
                    found.add((label, round(len(shared) / len(wanted), 9)))
    return found


def test_join_loses_nothing_to_its_filters():
    draw = random.Random(1)
    templates = {"a": ["one two three four five six", "two four six eight"], "b": ["one three five seven nine"], "c": ["ten"]}
    vocabulary = "one two three four five six seven eight nine ten x y z".split()
    for threshold in (0.5, 0.8, 1.0):
        for trial in range(150):
            frequency = {w.encode(): draw.randint(0, 9) for w in vocabulary}
            known = Templates(templates, threshold, frequency)
            words = [w.encode() for w in draw.choices(vocabulary, k=draw.randint(0, 60))]
            best = {}
            for label, part in ((x, y) for _, x, y in known.scan(words)):
                best[label] = max(part, best.get(label, 0))
            want = {}
            for label, part in slow_scan(words, templates, threshold):
                want[label] = max(part, want.get(label, 0))
            assert {k: round(v, 9) for k, v in best.items()} == want


def test_documents(spark):
    rows = [
        (1, "Text.\nReleased under the MIT\n License. More"), (2, "CC-BY; all rights, reserved All RIGHTS reserved"), (3, None), (4, ""),
        (None, "licensed under the Apache License, Version 2.0"), (5, "the license is under review; version two"), (1, "x"), (6, "cc by" * 2),
        (7, "general Public License general public license " + "w " * 30_000 + "cc by nc")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_words int")
    got = scan_licences(docs).collect()
    assert len(got) == len(rows)
    by_words = {(r["doc_id"], r["n_words"]): r for r in got}
    for i, text in rows:
        words = slow_words(text)
        r = by_words[i, len(words)]
        places = sorted((k, label) for k in range(len(words)) for p, label in PHRASES.items() if words[k : k + len(p.split())] == p.split())
        assert (r["n_base"], r["base_labels"]) == (len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
    labels = {(r["doc_id"], f["label"]) for r in got for f in r["found"]}
    assert labels == {(1, "mit"), (2, "cc-by"), (2, "reserved"), (None, "apache-2.0"), (7, "gpl"), (7, "cc-by")}
    assert scan_licences(docs.limit(0)).count() == 0


def test_every_template_is_found_and_told_apart():
    known = Templates(TEMPLATES, 0.9)
    for label, texts in TEMPLATES.items():
        for text in texts:
            assert label in {x for _, x, _ in known.scan(words_of(("lead " * 37 + text + " tail" * 50).encode()))}
    assert not known.scan(words_of(b"this is licensed under the terms of a license version"))
    assert licences.words_of(None) == []
