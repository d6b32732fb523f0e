"""Language ID by hyperdimensional profiles: permuted letter vectors bound into n-grams, bundled, compared by cosine."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposift.llm.common import staged

#: Letters of a text that are counted together, and n-grams that are bundled together.
LETTERS_AT_ONCE, GRAMS_AT_ONCE = 1 << 21, 4096
#: N-gram vectors kept per worker.
CACHED_GRAMS = 60_000
#: Languages whose profiles are held in memory.
MOST_LANGUAGES = 10_000
GAP = 0


class Profiles:
    """Makes document vectors.  A letter's vector is drawn from a generator seeded with its code point, so any letter has one."""

    def __init__(self, n: int, dim: int, seed: int):
        self.n, self.dim, self.seed = n, dim, seed
        self.letters: dict[int, np.ndarray] = {}
        self.grams: dict[int, int] = {}
        self.vectors = np.empty((1024, dim), np.int8)
        self.kind = np.full(0x110000, -1, np.int32)  # 0: no letter, else the lower-case letter, -1: not met yet

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > CACHED_GRAMS:
                self.letters.clear()
            self.letters[code] = np.random.default_rng([self.seed, code]).choice(np.array([-1, 1], np.int8), self.dim)
        return self.letters[code]

    def _vector(self, gram: int) -> np.ndarray:
        """The bound vectors of an n-gram's letters, each permuted (rotated) by its distance from the last one."""
        bound = np.ones(self.dim, np.int8)
        for back in range(self.n):
            bound = bound * np.roll(self._letter(gram >> 21 * back & 0x1FFFFF), back)
        return bound

    def codes(self, text: str) -> np.ndarray:
        """Lower-case letters as code points, with one GAP between words."""
        raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        kind = self.kind[raw]
        if (kind < 0).any():
            for code in np.unique(raw[kind < 0]).tolist():
                self.kind[code] = code if unicodedata.category(chr(code))[0] == "L" else GAP
            kind = self.kind[raw]
        keep = kind != GAP
        keep[1:] |= keep[:-1]
        return kind[keep].astype(np.int64)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of a whole text, a gap before and after it, and how often each occurs; none without a letter."""
        codes = self.codes(text)
        if not codes.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        codes = np.r_[GAP, codes, [] if codes[-1] == GAP else GAP].astype(np.int64)
        codes = np.r_[codes, np.zeros(max(0, self.n - len(codes)), np.int64)]
        found = [np.empty((2, 0), np.int64)]
        for at in range(0, len(codes) - self.n + 1, LETTERS_AT_ONCE):
            some = codes[at : at + LETTERS_AT_ONCE + self.n - 1]
            grams = some[: len(some) - self.n + 1]
            for i in range(1, self.n):
                grams = grams << 21 | some[i : len(some) - self.n + 1 + i]
            found.append(np.stack(np.unique(grams, return_counts=True)))
        if len(found) == 2:
            return found[1][0], found[1][1]
        every = np.concatenate(found, axis=1)
        grams, where = np.unique(every[0], return_inverse=True)
        return grams, np.bincount(where, weights=every[1]).astype(np.int64)

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the n-grams' vectors, each as often as it occurs."""
        total = np.zeros(self.dim)
        for at in range(0, len(grams), GRAMS_AT_ONCE):
            some = grams[at : at + GRAMS_AT_ONCE].tolist()
            known = self.grams
            new = [g for g in some if g not in known]
            if len(known) + len(new) > CACHED_GRAMS:
                known.clear()
                new = some
            if len(known) + len(new) > len(self.vectors):
                self.vectors = np.resize(self.vectors, (max(2 * len(self.vectors), len(known) + len(new)), self.dim))
            for gram in new:
                self.vectors[len(known)] = self._vector(gram)
                known[gram] = len(known)
            rows = np.fromiter(map(known.__getitem__, some), np.int64, len(some))
            total += counts[at : at + GRAMS_AT_ONCE].astype(np.float32) @ self.vectors[rows].astype(np.float32)
        return total


@lru_cache(maxsize=2)
def profiles(n: int, dim: int, seed: int) -> Profiles:
    """One per Python worker and setting."""
    return Profiles(n, dim, seed)


def language_prototypes(docs: DataFrame, n: int = 3, dim: int = 1024, seed: int = 11) -> DataFrame:
    """``lang, place, value``: the bundle of all texts of each language, a row per component.

    Rows without text or lang teach nothing.  A task adds up whole vectors and
    tells one per language; only those sums are shuffled.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, sums = profiles(n, dim, seed), {}
        for batch in batches:
            by_language: dict[str, list] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                by_language.setdefault(lang, []).append(made.counts(text))
            for lang, found in by_language.items():
                grams, where = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                counts = np.bincount(where, weights=np.concatenate([c for _, c in found]))
                sums[lang] = sums.get(lang, 0) + made.bundle(grams, counts)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * dim), "place": pa.array(np.arange(dim, dtype=np.int32)), "value": pa.array(total)})

    own = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    told = own.mapInArrow(learn, "lang string, place int, value double")
    return told.groupBy("lang", "place").agg(F.sum("value").alias("value"))


def classify(
    docs: DataFrame, prototypes: DataFrame, keep: Sequence[str] | None = None, n: int = 3, dim: int = 1024, seed: int = 11
) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` with ``lang_pred, score``: the language whose prototype has the largest cosine with the text's vector.

    ``score`` is that cosine, between 0 and 1.  A text that is null or has no
    letter is ``und`` with score 0, as is every text where no language was
    learned.  Equal cosines go to the first language in order.  Only the text is
    read.  The prototypes, ``dim`` numbers a language, are held by the driver
    and by each task; their number is checked.
    """
    langs = sorted(r["lang"] for r in prototypes.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    place = {lang: i for i, lang in enumerate(langs)}
    matrix = np.zeros((len(langs), dim), np.float64)
    for row in prototypes.toLocalIterator():
        matrix[place[row["lang"]], row["place"]] = row["value"]
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = profiles(n, dim, seed)
        for batch in batches:
            names, scores = [], []
            for text in batch.column("text").to_pylist():
                grams, counts = made.counts(text or "")
                vector = made.bundle(grams, counts)
                size = np.linalg.norm(vector)
                if not size or not langs:
                    names.append("und")
                    scores.append(0.0)
                    continue
                cosines = matrix @ vector / size
                best = int(cosines.argmax())
                names.append(langs[best])
                scores.append(float(np.clip(cosines[best], 0, 1)))
            yield pa.RecordBatch.from_pydict(
                {c: batch.column(c) for c in kept} | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    kept = [c for c in keep or docs.columns if c not in ("lang_pred", "score")]
    own = docs.withColumn("text", F.col("text").cast("string"))
    given = own.select(*[F.col(f"`{c}`") for c in kept], *[] if "text" in kept else ["text"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name in kept)
    return given.mapInArrow(predict, f"{fields}, lang_pred string, score double")


def held_out(doc_id: Column | str, folds: int = 5) -> Column:
    """Is crc32 of the id's text divisible by ``folds``?  A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def identify_languages(
    docs: DataFrame, keep: Sequence[str] | None = None, n: int = 3, dim: int = 1024, seed: int = 11
) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` with ``held_out, lang_pred, score``, a row per document.

    Learns from the rows that aren't held out and have a lang, predicts all
    rows from their texts.  Repeated rows get equal predictions.  Columns of
    ``docs`` named held_out, lang_pred or score are replaced.  An empty table
    gives no row.
    """
    prototypes = staged(language_prototypes(docs.where(~held_out("doc_id")), n, dim, seed), "prototypes")
    marked = docs.withColumn("held_out", held_out("doc_id"))
    return classify(marked, prototypes, [*[c for c in keep or docs.columns if c != "held_out"], "held_out"], n, dim, seed)
