"""SimHash near copies by anchor points: a covering code of anchors, near fingerprints meet at a shared anchor."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposift.llm.common import ROW_KEY, one_per_key, row_key, staged
from reposift.llm.components import connected_components, local_roots

# The binary Golay code: 23 bits, 4,096 codewords, every word within 3 bits of exactly one of them.
BLOCK, RADIUS = 23, 3
GENERATOR = 0b101011100011
#: Homes of one anchor that one task compares with the anchor's members; more are split over tasks.
HOMES_PER_PART = 2048
SLICE = 1 << 16


def _majority(hashes: np.ndarray, ones: np.ndarray) -> None:
    """Add to ``ones`` how many of the hashes have each bit set."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones += bits.sum(axis=0, dtype=np.int64)


def _mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """The hashes themselves, or for each further turn another mixture of their bits."""
    if turn:
        hashes = (hashes + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
        hashes = (hashes ^ hashes >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = hashes ^ hashes >> np.uint64(29)
    return hashes


def _of_words(words: list[bytes], shingle: int, seed: int, turns: int) -> list[int]:
    """``turns`` unsigned 64-bit SimHashes of the shingles of a word sequence; no word: 0."""
    if not words:
        return [0] * turns
    joined, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    starts, digest = [0, *ends], xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros((turns, 64), np.int64)
    for at in range(0, n, SLICE):
        upto = min(n, at + SLICE)
        hashes = np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts[at:upto], ends[min(len(words), shingle) - 1 + at :])], np.uint64)
        for turn in range(turns):
            _majority(_mixed(hashes, turn), ones[turn])
    return [sum(1 << int(i) for i in np.flatnonzero(2 * row > n)) for row in ones]


def text_fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a whole text; no word: 0."""
    return _of_words((text or b"").lower().split(), shingle, seed, 1)[0]


def fingerprints(docs: DataFrame, shingle: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, fp`` and the long columns ``keep``: the fingerprint's bits as a signed long.  A null text counts as empty, with fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([text_fingerprint(t.as_py(), shingle) for t in batch.column("_text")], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64()), *map(batch.column, keep)], ["doc_id", "fp", *keep])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_text"), *keep)
    return own.mapInArrow(run, ", ".join(["doc_id long", "fp long", *[f"{c} long" for c in keep]]))


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator polynomial."""
    rest = words.astype(np.uint64)
    for bit in range(BLOCK - 1, BLOCK - 13, -1):
        rest = np.where(rest >> np.uint64(bit) & np.uint64(1), rest ^ np.uint64(GENERATOR << (bit - 11)), rest)
    return rest.astype(np.int64)


@lru_cache(maxsize=4)
def _moves(threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each surplus 0..threshold: the differences to codewords that lie that far beyond the radius, by syndrome.

    Surplus 0 is the nearest codeword, the home.  Each entry is (first index of every syndrome and the end, patterns).
    """
    found = []
    for surplus in range(threshold + 1):
        weights = range(RADIUS + 1) if surplus == 0 else [RADIUS + surplus]
        words = np.array([sum(1 << b for b in bits) for w in weights for bits in combinations(range(BLOCK), w)], np.int64)
        at = syndrome(words)
        order = np.argsort(at, kind="stable")
        found.append((np.searchsorted(at[order], np.arange(2049)), words[order]))
    return found


def _neighbours(words: np.ndarray, surplus: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and codewords at ``surplus`` beyond the radius."""
    first, patterns = _moves(threshold)[surplus]
    at = syndrome(words)
    many = first[at + 1] - first[at]
    rows = np.repeat(np.arange(len(words)), many)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
    return rows, words[rows] ^ patterns[first[at][rows] + within]


def anchors(fps: np.ndarray, threshold: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every anchor a fingerprint is sent to: (row number, anchor, is it the home).

    Anchors are pairs of Golay codewords over bits 0-22 and 23-45.  Two
    fingerprints within ``threshold`` bits differ by s and t bits in the two
    blocks, s + t <= threshold, so the second lies within radius + s and
    radius + t of the first one's home: the surpluses of both blocks together
    never exceed the threshold.
    """
    mask = (1 << BLOCK) - 1
    bits = fps.astype(np.int64).view(np.uint64)
    low, high = (bits & np.uint64(mask)).astype(np.int64), (bits >> np.uint64(BLOCK) & np.uint64(mask)).astype(np.int64)
    rows, keys, home = [], [], []
    for s in range(threshold + 1):
        row, left = _neighbours(low, s, threshold)
        for t in range(threshold + 1 - s):
            inner, right = _neighbours(high[row], t, threshold)
            rows.append(row[inner])
            keys.append(left[inner] << BLOCK | right)
            home.append(np.full(len(inner), s == t == 0))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(home)


def _stars(homes: np.ndarray, members: np.ndarray, differing: int) -> np.ndarray:
    """Links between homes and members as stars: nodes over the smallest one of their component here.

    A row holds a node and the words of its check; two are linked if their
    checks differ in ``differing`` or fewer bits.
    """
    near_home, near_member = [], []
    for at in range(0, len(homes), 256):
        some, apart = homes[at : at + 256], 0
        for k in range(1, homes.shape[1]):
            # of signed numbers bitwise_count counts the bits of |x|
            apart = apart + np.bitwise_count((some[:, k, None] ^ members[None, :, k]).view(np.uint64)).astype(np.int16)
        i, j = np.nonzero((apart <= differing) & (some[:, 0, None] != members[None, :, 0]))
        near_home.append(some[i, 0])
        near_member.append(members[j, 0])
    nodes, _, _, root = local_roots(np.concatenate(near_home), np.concatenate(near_member))
    other = root != np.arange(len(nodes))
    return np.stack([nodes[other], nodes[root[other]]])


def anchor_links(nodes: DataFrame, node: str, probes: list[str], checks: list[str], threshold: int, differing: int) -> DataFrame:
    """Stars ``u, v`` of the links between distinct nodes that meet at an anchor and whose checks are near.

    ``probes`` are 64-bit fingerprints: nodes within ``threshold`` bits in one
    of them meet.  ``checks`` together may differ in ``differing`` bits.  Rows
    sent to anchors grow in proportion to the input (about 61 a fingerprint at
    threshold 2); the pairs that meet are compared inside a task, and only one
    row per linked node and anchor leaves it.  Anchors with many homes are
    split into parts of about HOMES_PER_PART homes, each with all members; the
    members of a part are streamed.
    """
    carried = list(dict.fromkeys([node, *checks]))
    pick = [carried.index(node), *map(carried.index, checks)]

    def send(reach: int, columns: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    some = batch.slice(at, 4096)
                    for table, probe in enumerate(probes):
                        rows, keys, home = anchors(some.column(probe).to_numpy(zero_copy_only=False), reach)
                        sent = some.select(columns).take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys | table << 2 * BLOCK), pa.array(home), *sent.columns], ["anchor", "home", *columns])

        return run

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes = None, np.empty((0, len(pick)), np.int64)
        for batch in batches:
            anchor, part, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "part", "home"))
            if not len(home):
                continue
            rows = np.stack([batch.column(carried[k]).to_numpy(zero_copy_only=False) for k in pick], axis=1)
            first = np.r_[0, np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1]
            last = np.r_[first[1:], len(home)]
            goes_on = (anchor[0], part[0]) == key
            useful = home[first] & (last - first > 1)
            useful[0] |= goes_on
            useful[-1] |= home[first[-1]]
            found = [np.empty((2, 0), np.int64)]
            for a, b in zip(first[useful], last[useful]):
                own = rows[a:b][home[a:b]]
                homes = np.concatenate([homes, own]) if a == 0 and goes_on else own
                if len(homes):
                    found.append(_stars(homes, rows[a:b], differing))
            if not useful[-1]:
                homes = np.empty((0, len(pick)), np.int64)
            key = (anchor[-1], part[-1])
            u, v = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    nodes = nodes.select(*dict.fromkeys([*carried, *probes]))
    homes = nodes.mapInArrow(send(0, []), "anchor long, home boolean")
    full = (
        homes.groupBy("anchor").count().where(F.col("count") > HOMES_PER_PART)
        .select("anchor", F.ceil(F.col("count") / HOMES_PER_PART).cast("int").alias("parts"))
    )
    parts = F.coalesce("parts", F.lit(1))
    sent = nodes.mapInArrow(send(threshold, carried), "anchor long, home boolean, " + ", ".join(f"{c} long" for c in carried))
    return (
        sent.join(staged(full, "full-anchors"), "anchor", "left")
        .select("anchor", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "home", *carried,
                F.pmod(F.xxhash64(node), parts).cast("int").alias("own"))
        .select("anchor", "part", (F.col("home") & (F.col("part") == F.col("own"))).alias("home"), *carried)
        .repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.desc("home"))
        .mapInArrow(compare, "u long, v long")
    )


def fingerprint_links(distinct: DataFrame, threshold: int = 2) -> DataFrame:
    """Stars ``u, v`` joining all distinct fingerprints ``fp`` that links of ``threshold`` or fewer bits connect."""
    return anchor_links(distinct, "fp", ["fp"], ["fp"], threshold, threshold)


def _components(own: DataFrame, threshold: int) -> DataFrame:
    """``fp, root``: every fingerprint of ``own(doc_id, fp)`` and the smallest one that links reach."""
    distinct = staged(own.select("fp").distinct(), "distinct")
    found = connected_components(fingerprint_links(distinct, threshold)).withColumnRenamed("node", "fp")
    return staged(distinct.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")


def near_copies(docs: DataFrame, threshold: int = 2, shingle: int = 3) -> DataFrame:
    """Near-copy groups of whole texts: ``doc_id, fp, component_id``, a row per document.

    Documents whose fingerprints differ in ``threshold`` or fewer bits are
    linked; ``component_id`` is the smallest doc_id that links reach.  Equal
    fingerprints are one node, so copies are never laid out as pairs.

    Null or empty texts have fingerprint 0 and are linked like others.  A null
    doc_id joins its group but never names one unless the group has no other.
    Repeated rows give repeated rows.  An empty table gives no row.  Columns
    other than doc_id and text are ignored.
    """
    own = staged(fingerprints(docs, shingle), "fingerprints")
    rooted = _components(own, threshold)
    least = own.groupBy("fp").agg(F.min("doc_id").alias("rep")).join(rooted, "fp")
    least = staged(least.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    named = staged(rooted.join(least, "root").select("fp", "component_id"), "named")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_copies(docs: DataFrame, threshold: int = 2, shingle: int = 3) -> DataFrame:
    """One row of ``docs`` for each group of near copies, with all its columns: the one with the smallest doc_id, null last.

    Rows are told apart by doc_id and text, so different documents under one
    doc_id, or without one, each stay or go with their own group; of rows
    equal in both one stays.  An empty table gives no row.
    """
    keyed = docs.withColumns(row_key("doc_id", "text"))
    own = staged(fingerprints(keyed, shingle, keep=ROW_KEY), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW_KEY)
    of_fp = own.groupBy("fp").agg(F.min(first).alias("first")).join(_components(own, threshold), "fp")
    kept = of_fp.groupBy("root").agg(F.min("first").alias("first")).select(*[F.col(f"first.{c}").alias(c) for c in ROW_KEY])
    rows = own.groupBy(*ROW_KEY).agg(F.count("*").alias("_rows"))
    return one_per_key(keyed, staged(rows.join(kept, list(ROW_KEY)), "kept")).select(*docs.columns)
