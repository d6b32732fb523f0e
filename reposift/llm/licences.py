"""License scans: base phrases, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The word rule and the base phrases with their labels
WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices by label; a label may have several.  Own list, a parameter of the scan.
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license version 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"],
    "gpl-3.0": ["licensed under the gnu general public license version 3"],
    "mit": ["released under the mit license", "licensed under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "mpl-2.0": ["subject to the terms of the mozilla public license v 2 0"],
}
RULE = re.compile(WORD)


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a whole text, A-Z in lower case; a null text has none."""
    return RULE.findall((text or b"").lower())


class Templates:
    """License templates as sets of words, ordered from the rarest to the most frequent in the corpus.

    A block contains a template if it holds at least ``need`` of its words,
    ``need`` being the threshold times their number, rounded up.  Such a block
    holds one of the template's rarest ``size - need + 1`` words (prefix), has
    ``need`` words itself (length), and after the first shared word enough
    words of both remain (position).
    """

    def __init__(self, templates: Mapping[str, list[str]], threshold: float, frequency: Mapping[bytes, int] | None = None):
        notices = [(label, words_of(t.encode())) for label, texts in templates.items() for t in texts]
        frequency = frequency or {}
        every = {w for _, words in notices for w in words}
        self.rank = {w: i for i, w in enumerate(sorted(every, key=lambda w: (frequency.get(w, 0), w)))}
        self.labels, self.sets, self.need = [], [], []
        # by half a block's words: prefix rank to (template, place in its order)
        self.prefix: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for label, words in notices:
            ranks = sorted({self.rank[w] for w in words})
            need = max(1, ceil(threshold * len(ranks) - 1e-9))
            prefix = self.prefix.setdefault(max(8, 1 << (len(words) - 1).bit_length()), {})
            for place, rank in enumerate(ranks[: len(ranks) - need + 1]):
                prefix.setdefault(rank, []).append((len(self.labels), place))
            self.labels.append(label)
            self.sets.append(frozenset(ranks))
            self.need.append(need)

    def contained(self, block: list[int], prefix: Mapping[int, list[tuple[int, int]]]) -> dict[str, float]:
        """Labels of the templates that a block, given as its distinct ranks in order, contains, with the containment."""
        found: dict[str, float] = {}
        tried = set()
        for at, rank in enumerate(block):
            for which, place in prefix.get(rank, ()):
                if which in tried:
                    continue
                # the first word they share: a rarer one would be in the prefix as well
                tried.add(which)
                words, need = self.sets[which], self.need[which]
                if min(len(words) - place, len(block) - at) < need:
                    continue
                shared = len(words.intersection(block))
                if shared >= need:
                    found[self.labels[which]] = max(shared / len(words), found.get(self.labels[which], 0.0))
        return found

    def scan(self, words: list[bytes]) -> list[tuple[int, str, float]]:
        """(first template word, label, containment) of every block that contains a template.

        Blocks are windows that overlap by half and are at least twice as long
        as the notice, so a notice lies whole in one of them wherever lines break.
        """
        known = self.rank
        hits = [(i, known[w]) for i, w in enumerate(words) if w in known]
        found = []
        for half, prefix in self.prefix.items():
            by_half: dict[int, dict[int, int]] = {}
            for i, rank in hits:
                by_half.setdefault(i // half, {}).setdefault(rank, i)
            for at, first in by_half.items():
                block = by_half.get(at + 1, {}) | first
                if not prefix.keys().isdisjoint(block):
                    start = min(block.values())
                    found += [(start, label, part) for label, part in self.contained(sorted(block), prefix).items()]
        return sorted(found)


def template_frequencies(docs: DataFrame, templates: Mapping[str, list[str]]) -> DataFrame:
    """``word, n``: how often each template word occurs in all texts; summed up in tasks first."""
    wanted = sorted(Templates(templates, 1.0).rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, counts = set(wanted), Counter()
        for batch in batches:
            for text in batch.column("text"):
                counts.update(w for w in words_of(text.as_py()) if w in vocabulary)
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

    told = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word binary, n long")
    return told.groupBy("word").agg(F.sum("n").alias("n"))


def scan_licences(docs: DataFrame, templates: Mapping[str, list[str]] = TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """Licenses of whole texts, a row per document.

    ``doc_id, n_words, n_base, first_word, last_word, base_labels, found`` with
    ``found`` an array of (label, start, containment): the base phrases at every
    word where they stand, with containment 1, and the templates that blocks of
    the text contain, with the block's first word.

    The word frequencies that order the prefixes come from all texts.  The
    templates are a stated set, shipped to the tasks.  Null and empty texts have
    no word and find nothing.  Rows keep their doc_id, null or repeated.  An
    empty table gives no row.  Other columns are ignored.
    """
    counts = {bytes(r["word"]): r["n"] for r in template_frequencies(docs, templates).collect()}
    known = Templates(templates, threshold, counts)
    phrases = [(words_of(p.encode()), label) for p, label in PHRASES.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "found")}
            for text in batch.column("text"):
                words = words_of(text.as_py())
                base = []
                for phrase, label in phrases:
                    at = -1
                    for _ in range(words.count(phrase[0])):
                        at = words.index(phrase[0], at + 1)
                        if words[at : at + len(phrase)] == phrase:
                            base.append((at, label))
                base.sort()
                out["n_words"].append(len(words))
                out["n_base"].append(len(base))
                out["first_word"].append(base[0][0] if base else None)
                out["last_word"].append(base[-1][0] if base else None)
                out["base_labels"].append(",".join(sorted({label for _, label in base})))
                out["found"].append([{"label": label, "start": at, "containment": part}
                                     for at, label, part in [(a, b, 1.0) for a, b in base] + known.scan(words)])
            kinds = dict.fromkeys(("n_words", "n_base", "first_word", "last_word"), pa.int64()) | {
                "base_labels": pa.string(),
                "found": pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("containment", pa.float64())]))}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {c: pa.array(out[c], kinds[c]) for c in kinds})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
                               "found array<struct<label: string, start: long, containment: double>>")
