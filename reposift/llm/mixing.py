"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reposift.llm.common import staged

# Fixed value: white space of the word rule
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one source that a task sums up in order.
ROWS_PER_BUCKET = 1024
#: Parts into which the search for the cut divides virtual time in each step; as many rows reach the driver.
PARTS = 1024
#: Copies around the cut that are put into order as one list.
LAST_COPIES = 8192


def source_targets(totals: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Add ``target`` to sources (src, source_size): weighted parts of ``share`` times all sizes, at most ``most`` times the own size.

    What a source can't take is shared by the others by weight, until none is
    above its limit.  Sources get the weights in turn, in the order of ``src``.
    The source table, one row each, is put into order as a whole.
    """
    everything = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy("src")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    table = totals.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    table = table.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    by_need = Window.orderBy(F.col("limit") / F.col("weight"), "src")
    before = F.coalesce(F.sum("limit").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    table = table.withColumn("level", (F.col("budget") - before) / rest).withColumn("place", F.row_number().over(by_need))
    free = F.col("level") * F.col("weight") < F.col("limit")
    table = table.withColumn("first", F.min(F.when(free, F.struct("place", "level"))).over(everything))
    target = F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("limit"))
    return table.select("src", "source_size", target.otherwise(F.col("first.level") * F.col("weight")).alias("target"))


def _running_sizes(rows: DataFrame, n_rows: int) -> DataFrame:
    """Add ``upto``: the sizes of the rows of a source up to each row, in shuffled order.

    The order is cut into buckets at fixed places of the hash, so that a hot
    source is many groups: totals are summed over two levels of buckets, rows
    inside one bucket.
    """
    bits = max(0, (n_rows // ROWS_PER_BUCKET).bit_length())
    if bits > 32:
        raise ValueError("more than 2^42 rows need a finer shuffle key")
    fine = F.shiftright(F.col("place"), 32 - bits) if bits else F.lit(0).cast("long")
    coarse = F.shiftright("bucket", bits // 2)
    rows = rows.withColumn("bucket", fine)
    sums = staged(rows.groupBy("src", "bucket").agg(F.sum("size").alias("size")).withColumn("coarse", coarse), "bucket-sizes")
    past = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    large = sums.groupBy("src", "coarse").agg(F.sum("size").alias("size"))
    large = large.select("src", "coarse", F.coalesce(F.sum("size").over(past("src").orderBy("coarse")), F.lit(0)).alias("ahead"))
    small = sums.withColumn("within", F.coalesce(F.sum("size").over(past("src", "coarse").orderBy("bucket")), F.lit(0)))
    ahead = small.join(large, ["src", "coarse"]).select("src", "bucket", (F.col("ahead") + F.col("within")).alias("ahead"))
    here = Window.partitionBy("src", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("within", F.sum("size").over(here))
    return summed.join(staged(ahead, "bucket-starts"), ["src", "bucket"]).withColumn("upto", F.col("ahead") + F.col("within"))


def _cut(copies: DataFrame, budget: float):
    """The first copy beyond the budget as (time, key, doc_id, size), or None: virtual time is divided until few copies are left.

    ``copies`` have time, key, doc_id and size.  Every step reads one sum per part.
    """
    low, high, spent, n = 0.0, 4.0, 0.0, None
    while n is None or n > LAST_COPIES and high - low > 1e-12:
        width = (high - low) / PARTS
        part = F.least(F.greatest(F.floor((F.col("time") - F.lit(low)) / F.lit(width)), F.lit(0)), F.lit(PARTS - 1))
        sums = copies.groupBy(part.alias("part")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        for row in sorted(sums):
            if spent + row["size"] > budget:
                break
            spent += row["size"]
        else:
            return None
        copies, n = copies.where(part == row["part"]), row["n"]
        low, high = low + row["part"] * width, low + (row["part"] + 1) * width
    order = Window.orderBy("time", "key", F.asc_nulls_first("doc_id"), "size")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return copies.withColumn("sum", upto).where(F.col("sum") > F.lit(budget - spent)).orderBy("sum").first()


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix",
    keep: Sequence[str] = (),
) -> DataFrame:
    """How often the mix takes each document: ``doc_id, source, size, source_size, target, times``, a row per document.

    A document's size is its number of words.  Each source's documents are
    shuffled by a hash of the doc_id and queued ``most`` times over; a copy's
    virtual finish time is the words of its source up to its end, over the
    source's target.  Copies of all sources are taken in the order of that time
    until the next one would exceed the budget, ``share`` times all sizes.
    The same rows always give the same mix.

    Null or empty texts have size 0 and are taken 0 times.  Null is a source of
    its own, last in order.  Rows of one doc_id go by size, repeated rows are
    documents of their own; a null doc_id is a value like others.  An empty
    table gives no row.  Of other columns only ``keep`` are carried along.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    src = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), src.alias("src"), size.alias("size"), key.alias("key"), *keep)
    own = staged(own, "sizes")
    totals = own.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = staged(source_targets(totals.select("src", "source_size"), weights, share, most), "targets")
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    queued = _running_sizes(own.withColumn("place", place), own.count()).join(targets, "src")
    queued = staged(queued.select("doc_id", "source", "key", "size", "source_size", "target", "upto", *keep), "queued")
    time = lambda turn: (F.col("upto") + F.lit(turn) * F.col("source_size")).cast("double") / F.col("target")
    turns = F.explode(F.array(*[time(i) for i in range(most)]))
    copies = queued.where("size > 0").select("key", "doc_id", "size", turns.alias("time"))
    budget = float(targets.agg(F.sum("target")).first()[0] or 0.0)
    last = _cut(copies, budget)
    if last is None:
        times = F.lit(most)
    else:
        end = F.struct(F.lit(last["time"]), F.lit(last["key"]), F.lit(last["doc_id"]).cast("long"), F.lit(last["size"]).cast("long"))
        taken = [(F.struct(time(i), F.col("key"), F.col("doc_id"), F.col("size")) < end).cast("int") for i in range(most)]
        times = sum(taken[1:], taken[0])
    return queued.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, times).otherwise(0).alias("times"), *keep)
