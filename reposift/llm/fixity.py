"""Merkle fixity audit of WARC replicas: compare roots, descend only into branches that differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reposift.llm.common import staged

#: Bytes of a lowest range, and nodes of one level below a node of the next.
RANGE_BYTES, FAN_OUT = 1 << 16, 16


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """Bytes of a WARC 1.1 resource record; null parts count as empty."""
    body = F.coalesce(html.cast("string"), F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def warc_file(page_id: Column, url: Column, pages_per_file: int = 1000) -> Column:
    """Number of the file a page is written to: a range of page ids; pages without id go to one of 65,536 files by url, below 0."""
    by_url = -1 - F.conv(F.substring(F.md5(F.coalesce(url, F.lit(""))), 1, 4), 16, 10).cast("long")
    return F.coalesce(F.floor(page_id / pages_per_file).cast("long"), by_url)


def record_entry(record: Column) -> Column:
    """What the audit keeps of a record: its length and SHA-256."""
    return F.struct(F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("sha256"))


def placed(entries: DataFrame, order: list[str]) -> DataFrame:
    """Add ``offset``: the lengths of the records before, in the given order within the file.  Payloads aren't moved."""
    before = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def _parents(nodes: DataFrame, file: Column, part: Column) -> DataFrame:
    """The nodes above: each hashes its children's places and hashes in order; at most FAN_OUT children are gathered."""
    line = F.concat_ws(":", F.col("file").cast("string"), F.col("part").cast("string"), F.col("hash"))
    child = F.struct("file", "part", line.alias("line"))
    return (
        nodes.groupBy("side", file.alias("up_file"), part.alias("up_part")).agg(F.array_sort(F.collect_list(child)).alias("children"))
        .select("side", F.col("up_file").alias("file"), F.col("up_part").alias("part"), F.sha2(F.array_join("children.line", "\n"), 256).alias("hash"))
    )


def merkle_levels(entries: DataFrame) -> list[tuple[str, DataFrame]]:
    """Levels of the trees of both sides, the lowest first, as (what halves a place, nodes (side, file, part, hash)).

    Records are hashed into ranges of RANGE_BYTES bytes of their file, ranges
    into wider ranges up to whole files, files into ranges of files up to one
    root per side.
    """
    line = F.concat_ws(":", "offset", "length", "sha256", "n")
    lowest = (
        entries.groupBy("side", "file", F.floor(F.col("offset") / RANGE_BYTES).alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("offset", "length", "sha256", line.alias("line")))).alias("records"))
        .select("side", "file", "part", F.sha2(F.array_join("records.line", "\n"), 256).alias("hash"))
    )
    levels = [("records", staged(lowest, "tree"))]
    top, low, high = levels[0][1].agg(F.max("part"), F.min("file"), F.max("file")).first()
    while top:
        levels.append(("ranges", staged(_parents(levels[-1][1], F.col("file"), F.floor(F.col("part") / FAN_OUT)), "tree")))
        top //= FAN_OUT
    while low is not None and low < high:
        apart = (low, high) == (-1, 0)  # halving never brings the two sides of zero together
        up = F.lit(0).cast("long") if apart else F.floor(F.col("file") / FAN_OUT)
        levels.append(("root" if apart else "files", staged(_parents(levels[-1][1], up, F.lit(0).cast("long")), "tree")))
        low, high = (0, 0) if apart else (low // FAN_OUT, high // FAN_OUT)
    return levels


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Places where two replicas differ: ``file, offset, status, left_sha256, right_sha256, left_length, right_length``.

    Both are entries (file, offset, length, sha256) of the records of the same
    files.  ``status`` is changed, missing (only on the left) or extra (only on
    the right).  Only the children of nodes that differ are compared; equal
    roots end the audit at once.  Repeated entries count as often as they
    occur.  Rows with a null file, offset or sha256 can't be placed and are not
    compared.  Empty replicas are equal.
    """
    sides = left.withColumn("side", F.lit(0)).select("side", "file", "offset", "length", "sha256").union(
        right.withColumn("side", F.lit(1)).select("side", "file", "offset", "length", "sha256"))
    sides = sides.where("file is not null and offset is not null and sha256 is not null")
    entries = staged(sides.groupBy("side", "file", "offset", "length", "sha256").agg(F.count("*").alias("n")), "entries")
    levels, suspect, below = merkle_levels(entries), None, None
    side = lambda which, value: F.max(F.when(F.col("side") == which, value))
    for kind, nodes in reversed(levels):
        if suspect is not None:
            nodes = nodes.join(suspect, _spot(below, F.col("file"), F.col("part")), "left_semi")
        differ = nodes.groupBy("file", "part").agg(side(0, F.col("hash")).alias("a"), side(1, F.col("hash")).alias("b")).where("not a <=> b")
        suspect = staged(differ.select(F.col("file").alias("up_file"), F.col("part").alias("up_part")), "suspects")
        below = kind
    part = F.floor(F.col("offset") / RANGE_BYTES)
    rows = entries.join(suspect, (F.col("file") == F.col("up_file")) & (part == F.col("up_part")), "left_semi")
    told = F.sort_array(F.collect_list(F.when(F.col("side") == 0, F.struct("sha256", "length", "n"))))
    other = F.sort_array(F.collect_list(F.when(F.col("side") == 1, F.struct("sha256", "length", "n"))))
    met = rows.groupBy("file", "offset").agg(told.alias("a"), other.alias("b")).where("a <> b")
    status = F.when(F.size("b") == 0, "missing").when(F.size("a") == 0, "extra").otherwise("changed")
    return met.select(
        "file", "offset", status.alias("status"), F.get("a", F.lit(0))["sha256"].alias("left_sha256"), F.get("b", F.lit(0))["sha256"].alias("right_sha256"),
        F.get("a", F.lit(0))["length"].alias("left_length"), F.get("b", F.lit(0))["length"].alias("right_length"))


def _spot(kind: str, file: Column, part: Column) -> Column:
    """Is a node a child of the suspect (up_file, up_part) of a level of this kind?"""
    if kind == "ranges":
        return (file == F.col("up_file")) & (F.floor(part / FAN_OUT) == F.col("up_part"))
    if kind == "files":
        return F.floor(file / FAN_OUT) == F.col("up_file")
    return F.col("up_file") == F.lit(0) * file
