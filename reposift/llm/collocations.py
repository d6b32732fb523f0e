"""Collocations of words by HAT-trie counting of phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reposift.llm.common import staged
from reposift.llm.hattrie import MOST_ENTRIES, MOST_WORDS, NONE, HatTrie, Words, sorted_run

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bytes of text that a task cuts into words at once; a longer text is cut alone.
SLICE_BYTES = 8 << 20
#: Bits of the gate that keeps phrases with a rare part out of the next pass, sent in blocks.  A fixed size: fuller, it only lets more through.
GATE_BITS, BLOCK_BITS = 24, 13

_LETTER, _BLANK, _STOP = 0, 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _STOP


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of lower-cased texts that lie one behind the other; the first word of each text; words that go on a piece."""
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    kind = _KIND[data]
    letter = np.zeros(len(data) + 2, bool)
    np.equal(kind, _LETTER, out=letter[1:-1])
    starts = np.flatnonzero(letter[1:-1] & (~letter[:-2] | begins[:-1]))
    ends = np.flatnonzero(letter[1:-1] & (~letter[2:] | begins[1:])) + 1
    packed = data[letter[1:-1]]
    at = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(packed)])
    first, goes_on = np.searchsorted(starts, offsets), np.ones(len(starts) + 1, bool)
    goes_on[first] = False
    goes_on[np.searchsorted(starts, np.flatnonzero(kind == _STOP))] = False
    return words, first, goes_on[:-1]


def _places(hashes: list[np.ndarray]) -> np.ndarray:
    """Places in the gate of sequences of word hashes."""
    found = np.zeros_like(hashes[0])
    for word in hashes:
        found = (found + word) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(29)
    return (found * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - GATE_BITS)).astype(np.int64)


def _open(gate: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (gate[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


def _reach(fit: np.ndarray, same: np.ndarray, shortest: int, longest: int) -> np.ndarray:
    """The longest sequence from each word, up to ``longest``, whose parts of ``shortest`` - 1 words all fit; 0 below ``shortest``."""
    reach, alive = np.zeros(len(fit), np.int8), fit.copy()
    for more in range(1, longest - shortest + 2):
        alive[-more:] = False
        alive[:-more] &= fit[more:] & same[more - 1 : len(fit) - 1]
        reach[alive] = shortest - 1 + more
    return reach


def _counted(shortest: int, longest: int, gate: np.ndarray | None):
    """Arrow function: sorted runs of the phrases of ``shortest`` to ``longest`` words whose words and parts of ``shortest`` - 1 words pass the gate."""

    frequent = None if gate is None else lambda hashes: _open(gate, _places([hashes]))

    def rows(words: Words, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        langs, texts = batch.column("lang").dictionary_encode(), batch.column("text")
        lang_of, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary.to_pylist()
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        held = texts.buffers()[2]
        whole = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
            data = _LOWER[whole[offsets[at] : offsets[upto]]]
            spelt, first, goes_on = _cut(data, offsets[at : upto + 1] - offsets[at])
            lang = np.repeat(lang_of[at:upto].astype(np.int64), np.diff(first))
            at = upto
            if not len(spelt):
                continue
            spelt = spelt.dictionary_encode()
            own, n = spelt.dictionary, len(spelt.dictionary)
            met = pa.array(lang * n + spelt.indices.to_numpy()).dictionary_encode()
            pairs = met.dictionary.to_numpy()
            found = np.empty(len(pairs), np.int32)
            for k in np.unique(pairs // n).tolist():
                some = np.flatnonzero(pairs // n == k)
                found[some] = words.ids(names[k], own.take(pa.array(pairs[some] % n)).to_pylist(), frequent)
            ids = found[met.indices.to_numpy()]
            if longest == 1:
                yield ids[:, None]
                continue
            same = np.r_[goes_on[1:], False]
            fit = ids != NONE
            if shortest > 2:
                hashes = np.r_[np.frombuffer(words.hashes, np.uint64), np.uint64(0)][ids]
                fit &= same & _open(gate, _places([hashes, np.roll(hashes, -1)]))
            reach = _reach(fit, same, shortest, longest)
            begin = np.flatnonzero(reach)
            path = np.full((len(begin), longest), NONE, np.int32)
            for k in range(longest):
                far = reach[begin] > k
                path[far, k] = ids[begin[far] + k]
            yield path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, trie = Words(), HatTrie(longest)
        for batch in batches:
            for some in rows(words, batch):
                trie.add(some)
                if len(words) > MOST_WORDS:
                    yield from sorted_run(*trie.take(), words, shortest)
                    words.clear()
                while trie.entries > MOST_ENTRIES and trie.settle() > MOST_ENTRIES:
                    yield from sorted_run(*trie.take(0.5), words, shortest)
        yield from sorted_run(*trie.take(), words, shortest)

    return run


def _gate(frequent: DataFrame) -> np.ndarray:
    """A bit per place at which a frequent phrase lies.

    Tasks send the blocks they touch, at most 2^(GATE_BITS - 3) bytes each; the
    blocks are joined by number, and as many bytes come to the driver.
    """

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            found: dict[int, list] = {}
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                seed = xxhash.xxh64_intdigest(lang)
                hashes = [xxhash.xxh64_intdigest(w, seed) for w in phrase.split(" ")]
                found.setdefault(len(hashes), []).append(hashes)
            for hashes in found.values():
                places = _places(list(np.array(hashes, np.uint64).T))
                for block in np.unique(places >> BLOCK_BITS).tolist():
                    bits = blocks.setdefault(block, np.zeros(1 << BLOCK_BITS, bool))
                    bits[places[places >> BLOCK_BITS == block] & (1 << BLOCK_BITS) - 1] = True
        for block, bits in blocks.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()])})

    def joined(pdf):
        whole = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]])
        return pdf.head(1).assign(bits=[whole.tobytes()])

    kind = "block int, bits binary"
    found = frequent.select("lang", "phrase").mapInArrow(touched, kind).groupBy("block").applyInPandas(joined, kind).collect()
    gate, size = np.zeros(1 << GATE_BITS - 3, np.uint8), 1 << BLOCK_BITS - 3
    for row in found:
        gate[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return gate


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def count_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """``lang, n`` (all words of a language) and ``lang, phrase, words, f`` of all phrases that occur ``least`` times or more.

    Three passes: words, pairs of frequent words, longer phrases of frequent
    pairs.  A part of a phrase occurs at least as often as the phrase, so a
    phrase with a rare part isn't counted.  The runs of all tasks are dealt by
    the whole path (language and phrase), which splits hot prefixes too, and
    merged there.
    """
    texts, kind = _texts(docs), "lang string, phrase string, f long"

    def merged(shortest: int, upto: int, gate: np.ndarray | None) -> DataFrame:
        runs = texts.mapInArrow(_counted(shortest, upto, gate), kind)
        return runs.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))

    words = staged(merged(1, 1, None), "words")
    sizes = staged(words.groupBy("lang").agg(F.sum("f").alias("n")), "sizes")
    found = words.where(F.col("f") >= least)
    for shortest, upto in ((2, min(2, longest)), (3, longest)):
        if shortest <= upto:
            found = found.unionByName(staged(merged(shortest, upto, _gate(found)).where(F.col("f") >= least), "phrases"))
    return sizes, found.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "f")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases by their weakest cut: ``lang, rank, phrase, a, l, r, n, score``.

    ``docs(text, lang)``; a null text is empty, a null language ``und``; other
    columns are ignored.  Pieces end at ``.,;:!?`` and line ends, A-Z are
    lower-cased, words end at blanks and tabs.  A candidate has 2 to
    ``longest`` words and occurs ``least`` times; its score is the lowest of
    floor(1000 a n / (l r)) over all cuts, the first of equal ones.  Candidates
    inside a longer one of equal count are left out: it is enough to look at
    those one word longer, as counts never rise from part to whole.  Equal
    scores go by count, then by the phrase's bytes.  Repeated rows count again;
    an empty table gives no row.
    """
    sizes, found = count_phrases(docs, least, longest)
    found = staged(found, "frequent")
    candidates = found.where("words >= 2").withColumnRenamed("f", "a")
    parts = F.split("phrase", " ")

    def joined(start, length):
        return F.array_join(F.slice(parts, start, length), " ")

    longer = candidates.where("words >= 3")
    inside = longer.select("lang", "a", F.explode(F.array(joined(1, F.col("words") - 1), joined(2, F.col("words") - 1))).alias("phrase")).distinct()
    open_ = candidates.join(inside, ["lang", "phrase", "a"], "left_anti")
    cuts = (
        open_.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
        .select("*", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    )
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(found.select("lang", F.col("phrase").alias(side), F.col("f").alias(count)), ["lang", side])
    exact = "cast({} as decimal(20,0))".format
    score = F.expr(f"{exact('a')} * 1000 * {exact('n')} div ({exact('l')} * {exact('r')})")
    scored = cuts.join(sizes, "lang").withColumn("score", score)
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = lowest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
