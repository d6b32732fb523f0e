"""Trie of conversation prefixes, screened by a count-min sketch so that only prefixes that may be shared are shuffled."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reposift.llm.common import staged

#: Conversations c share the beginning of conversation c - c % FAMILY; fewer than MOST_SHARED turns of it.
FAMILY, MOST_SHARED = 100, 6
#: Turns of one conversation that one window adds up; blocks of them are added up again.
BLOCK = 1024
#: The sketch: rows, counters of a row (four for each prefix, at most 2^MOST_BITS), and counters in a block that is sent.
ROWS, LEAST_BITS, MOST_BITS, SENT_BITS = 2, 10, 24, 16
#: Ends that are joined to one text before they are hashed.
ENDS_PER_TEXT = 8192
KEY = ["p1", "p2"]


def _turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, a, b, chars, uid``: 120 bits of a digest in place of role and text, so texts are read once and never shuffled."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    number = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.char_length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("uid"),
    ).select("conv_id", "turn", number(1).alias("a"), number(16).alias("b"), "chars", "uid")


def _before(rows: DataFrame, key: str, block: str, sums: dict[str, Column]) -> DataFrame:
    """``key, block`` and what all earlier blocks of the key add up to; blocks with something before them only."""
    earlier = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    joined = {name: (F.bit_xor if name.startswith("p") else F.sum)(F.col(name)).over(earlier).alias(f"{name}_0") for name in sums}
    blocks = rows.groupBy(key, block).agg(*[total.alias(name) for name, total in sums.items()])
    return blocks.select(key, block, *joined.values()).where(F.col(f"{next(iter(sums))}_0").isNotNull())


def _positions(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their place ``pos`` (from 1) in their conversation, and ``conv_id, own`` (turns of each).

    Rows are dealt by ranges of (conversation, turn, ...), so a conversation
    with very many turns lies in many ranges; a range numbers its own rows and
    adds how many of the conversation lie in earlier ranges.
    """
    order = [F.asc_nulls_first("turn"), F.asc("a"), F.asc("b"), F.asc("uid")]
    dealt = staged(staged(turns, "turns").repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "dealt")
    earlier = _before(dealt, "conv_id", "part", {"n": F.count("*")})
    local = dealt.withColumn("at", F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order)))
    placed = local.join(staged(earlier, "earlier"), ["conv_id", "part"], "left")
    pos = (F.col("at") + F.coalesce("n_0", F.lit(0))).alias("pos")
    return placed.select("conv_id", pos, "a", "b", "chars"), dealt.groupBy("conv_id").agg(F.count("*").alias("own"))


def _rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, total`` of all rebuilt conversations, and their turns ``conv_id, depth, a, b, chars``."""
    placed, sizes = _positions(_turns(conversations))
    placed, sizes = staged(placed, "placed"), staged(sizes, "sizes")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).alias("shared")
    convs = sizes.select("conv_id", "own", base.alias("base"), shared).join(
        sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own")), "base", "left")
    lead = F.least("shared", F.coalesce("base_own", F.lit(0)))
    convs = staged(convs.select("conv_id", "base", "shared", lead.alias("lead"),
                                (lead + F.greatest(F.col("own") - F.col("shared"), F.lit(0))).alias("total")), "convs")
    rest = placed.join(convs.select("conv_id", "shared", "lead"), "conv_id").where("pos > shared").select(
        "conv_id", (F.col("lead") + F.col("pos") - F.col("shared")).alias("depth"), "a", "b", "chars")
    # at most FAMILY conversations meet fewer than MOST_SHARED turns
    heads = placed.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < MOST_SHARED)).withColumnRenamed("conv_id", "base")
    led = heads.join(convs.select("conv_id", "base", "lead"), "base").where("pos <= lead").select(
        "conv_id", F.col("pos").alias("depth"), "a", "b", "chars")
    return convs.select("conv_id", "total"), staged(rest.unionByName(led), "rebuilt")


def _paths(conversations: DataFrame) -> DataFrame:
    """A row per conversation and prefix: ``conv_id, depth, p1, p2, up1, up2, chars, before, ends``.

    ``p1, p2`` is the prefix's digest, the exclusive or of the digests of
    (place, turn); ``up1, up2`` that of the prefix one turn shorter, ``before``
    the code points of all turns before the last one.
    """
    convs, turns = _rebuilt(conversations)
    turns = turns.withColumns({"p1": F.xxhash64("depth", "a", "b"), "p2": F.xxhash64("b", "a", "depth"), "block": F.floor(F.col("depth") / BLOCK)})
    earlier = _before(turns, "conv_id", "block", {"p1": F.bit_xor("p1"), "p2": F.bit_xor("p2"), "chars": F.sum("chars")})
    upto = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = turns.select("conv_id", "block", "depth", "chars", F.col("p1").alias("x1"), F.col("p2").alias("x2"),
                       *[F.bit_xor(p).over(upto).alias(p) for p in KEY], F.sum("chars").over(upto).alias("sum"))
    met = run.join(staged(earlier, "earlier"), ["conv_id", "block"], "left").join(convs, "conv_id")
    whole = [F.col(p).bitwiseXOR(F.coalesce(f"{p}_0", F.lit(0))) for p in KEY]
    below = met.select(
        "conv_id", "depth", *[w.alias(p) for w, p in zip(whole, KEY)], *[w.bitwiseXOR(F.col(f"x{i}")).alias(f"up{i}") for i, w in enumerate(whole, 1)],
        "chars", (F.col("sum") + F.coalesce("chars_0", F.lit(0)) - F.col("chars")).alias("before"), (F.col("depth") == F.col("total")).alias("ends"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), none.alias("up1"), none.alias("up2"),
                        zero.alias("chars"), zero.alias("before"), (F.col("total") == 0).alias("ends"))
    return staged(below.unionByName(root), "paths")


def _counters(p1: np.ndarray, p2: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The counter of each prefix in one row of the sketch."""
    mixed = (p1.view(np.uint64) + np.uint64(row) * p2.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def count_min(prefixes: DataFrame, bits: int) -> np.ndarray:
    """Count-min sketch of digests ``p1, p2``; a counter ends at 2, as all that is asked is whether it is 1.

    Tasks send the counters they touch, in blocks; the driver gets at most
    ROWS * 2^``bits`` bytes.
    """
    size = 1 << min(bits, SENT_BITS)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros((ROWS, 0), np.int64), np.zeros((ROWS, 0), np.int64)
        own: list[tuple[np.ndarray, np.ndarray]] = [(met[0][r], met[1][r]) for r in range(ROWS)]
        for batch in batches:
            p1, p2 = (batch.column(p).to_numpy() for p in KEY)
            for row in range(ROWS):
                places, inverse = np.unique(np.r_[own[row][0], _counters(p1, p2, row, bits)], return_inverse=True)
                counts = np.bincount(inverse, np.r_[own[row][1], np.ones(len(p1))], len(places))
                own[row] = places, np.minimum(counts, 2).astype(np.int64)
        for row, (places, counts) in enumerate(own):
            block = places // size
            first = np.searchsorted(block, np.unique(block))
            for a, b in zip(first, np.r_[first[1:], len(places)]):
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array([row], pa.int32()), "block": pa.array([int(block[a])], pa.int32()),
                    "places": [(places[a:b] % size).astype("<u4").tobytes()], "counts": [counts[a:b].astype(np.uint8).tobytes()]})

    def joined(pdf):
        whole = np.zeros(size, np.int64)
        for places, counts in zip(pdf["places"], pdf["counts"]):
            whole[np.frombuffer(places, "<u4")] += np.frombuffer(counts, np.uint8)
        return pdf.head(1).assign(counts=[np.minimum(whole, 2).astype(np.uint8).tobytes()])[["row", "block", "counts"]]

    sent = prefixes.select(*KEY).mapInArrow(touched, "row int, block int, places binary, counts binary")
    sketch = np.zeros((ROWS, 1 << bits), np.uint8)
    for found in sent.groupBy("row", "block").applyInPandas(joined, "row int, block int, counts binary").collect():
        sketch[found["row"], found["block"] * size : (found["block"] + 1) * size] = np.frombuffer(found["counts"], np.uint8)
    return sketch


def _screened(paths: DataFrame, bits: int) -> DataFrame:
    """Paths with ``many`` and ``up_many``: the estimate for the prefix, and for the one above it, is not 1."""
    sketch = count_min(paths, bits)

    def estimate(p1: pa.Array, p2: pa.Array) -> pa.Array:
        gone = p1.is_null()
        one, two = (p.fill_null(0).to_numpy() for p in (p1, p2))
        least = np.minimum.reduce([sketch[row][_counters(one, two, row, bits)] for row in range(ROWS)])
        return pa.array(np.where(gone.to_numpy(zero_copy_only=False), False, least > 1))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, up = (estimate(batch.column(f"{p}1"), batch.column(f"{p}2")) for p in ("p", "up"))
            yield pa.RecordBatch.from_arrays([*batch.columns, own, up], [*batch.schema.names, "many", "up_many"])

    schema = ", ".join(f"{name} {kind}" for name, kind in paths.dtypes)
    return staged(paths.mapInArrow(probe, f"{schema}, many boolean, up_many boolean"), "screened")


def _end_digests(ends: DataFrame) -> DataFrame:
    """``p1, p2, ends_sha256``: SHA-256 of the decimal conv_ids of each prefix in ascending order, comma-joined.

    Ranges of (prefix, conv_id) join their ids to texts first, so a prefix at
    which very many conversations end is a few rows when its texts meet.
    """

    def groups(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
        p1, p2 = (batch.column(p).to_numpy() for p in KEY)
        first = np.r_[0, np.flatnonzero((p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])) + 1]
        for a, b in zip(first, np.r_[first[1:], len(p1)]):
            yield int(p1[a]), int(p2[a]), int(a), int(b)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("conv_id").to_pylist()
                cut = [(p1, p2, ids[k : min(b, k + ENDS_PER_TEXT)]) for p1, p2, a, b in groups(batch) for k in range(a, b, ENDS_PER_TEXT)]
                yield pa.RecordBatch.from_pydict({
                    "p1": pa.array([c[0] for c in cut], pa.int64()), "p2": pa.array([c[1] for c in cut], pa.int64()),
                    "first": pa.array([c[2][0] for c in cut], pa.int64()), "ids": [",".join(map(str, c[2])) for c in cut]})

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def told(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "p1": pa.array([k[0] for k, _ in done], pa.int64()), "p2": pa.array([k[1] for k, _ in done], pa.int64()),
                "ends_sha256": pa.array([d.hexdigest() for _, d in done], pa.string())})

        for batch in batches:
            done, ids = [], batch.column("ids").to_pylist()
            for p1, p2, a, b in groups(batch) if batch.num_rows else ():
                if (p1, p2) != key:
                    if key is not None:
                        done.append((key, digest))
                    key, digest = (p1, p2), hashlib.sha256()
                    digest.update(ids[a].encode())
                    a += 1
                for text in ids[a:b]:
                    digest.update(b"," + text.encode())
            yield told(done)
        if key is not None:
            yield told([(key, digest)])

    sent = staged(ends.select(*KEY, "conv_id"), "ends").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    joined = sent.mapInArrow(texts, "p1 long, p2 long, first long, ids string")
    return joined.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashed, "p1 long, p2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, bits: int | None = None) -> DataFrame:
    """A row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``conversations(conv_id, turn, role, text)``.  Turns go by ``turn`` (null
    first), equal ones by the digest of role and text; null roles and texts are
    empty.  Rows without conv_id belong to no conversation and are left out;
    repeated rows are turns of their own; an empty table has no node, not even
    a root.  Other columns are ignored.

    A prefix whose estimate in the count-min sketch is 1 has one member, and so
    has all below it: its row is made where it stands.  All others are grouped
    exactly by digest, whatever the sketch holds (``bits``: counters of a
    row, by default four for each prefix).

    Sums over subtrees need no walk.  The smallest member owns a node, and the
    nodes that a conversation doesn't own are the beginning of its path; so a
    node's ``saved_tokens`` is what its members hold at or below it in nodes
    they don't own, and ``n_leaves`` the number of members that own a leaf.
    """
    paths = _paths(conversations)
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(4 * paths.count() + 1))))
    screened = _screened(paths, bits)
    shared, single = screened.where("many"), screened.where("not many")

    nodes = staged(shared.groupBy(*KEY).agg(
        F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.first("depth").alias("depth"),
        F.first("up1").alias("up1"), F.first("up2").alias("up2")), "nodes")
    above = nodes.select("up1", "up2").union(single.where("up_many").select("up1", "up2")).where("up1 is not null")
    children = above.groupBy(F.col("up1").alias("p1"), F.col("up2").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes = staged(nodes.join(children, KEY, "left").fillna(0, ["n_children"]), "nodes")

    met = shared.join(nodes.select(*KEY, "owner", "n_children"), KEY)
    foreign = F.when(F.col("owner") < F.col("conv_id"), F.col("chars")).otherwise(0)
    leaf = (F.col("ends") & (F.col("owner") == F.col("conv_id")) & (F.col("n_children") == 0)).cast("long")
    of_conv = met.select("conv_id", foreign.alias("foreign"), leaf.alias("leaf")).union(
        single.where("ends").select("conv_id", F.lit(0).cast("long"), F.lit(1).cast("long")))
    of_conv = staged(of_conv.groupBy("conv_id").agg(F.sum("foreign").alias("foreign"), F.sum("leaf").alias("leaf")), "of-conv")
    saved = F.greatest(F.col("foreign") - F.col("before"), F.lit(0))
    sums = shared.join(of_conv, "conv_id").groupBy(*KEY).agg(F.sum(saved).alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))

    nothing = F.sha2(F.lit("").cast("binary"), 256)
    exact = nodes.join(sums, KEY).join(_end_digests(shared.where("ends")), KEY, "left").select(
        F.col("owner").alias("conv_id"), "depth", "up1", "up2", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    one = F.lit(1).cast("long")
    tails = single.select(
        "conv_id", "depth", F.when(F.col("up_many"), F.col("up1")).alias("up1"), F.when(F.col("up_many"), F.col("up2")).alias("up2"), one.alias("n_convs"),
        (~F.col("ends")).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("ends"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(nothing).alias("ends_sha256"))
    parents = nodes.select(F.col("p1").alias("up1"), F.col("p2").alias("up2"), F.col("owner").alias("parent"))
    # nodes under a shared one are looked up; others have their own conversation as parent
    under = tails.where("up1 is not null").unionByName(exact).join(parents, ["up1", "up2"], "left")
    rest = tails.where("up1 is null").withColumn("parent", F.lit(None).cast("long"))
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
    return under.unionByName(rest).select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
