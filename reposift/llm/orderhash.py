"""Document fingerprints by Order MinHash, in DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reposift.llm.common import staged

#: A symbol is a piece of up to four characters of a word, a k-mer two adjacent symbols and what stands between them.
KMER = r"(?=(\S{1,4}\s*\S{1,4}))\S{1,4}"
PLACE_BITS = 30
PLACE, HASH = (1 << PLACE_BITS) - 1, ~((1 << PLACE_BITS) - 1)
#: Equal k-mers before one that are looked at in turn; more are counted by halving.
NEAR = 3
#: A slot is a 16-bit number less this, so that it fits a short.
LEAST_SLOT = 1 << 15


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _low(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(mask).cast("long"))


def _halving(n: Column) -> Column:
    """Powers of two up to ``n``, the largest first."""
    return F.transform(F.sequence(F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int"), F.lit(0)), lambda b: F.call_function("shiftleft", F.lit(1), b))


def _numbered(items: Column) -> Column:
    """Items (hash, place) in order, with the hash of a repeated k-mer replaced by one of the k-mer and its occurrence number."""

    def same(x: Column, i: Column) -> Column:
        return (i >= 0) & (_low(F.get(items, i), HASH) == _low(x, HASH))

    def occurrence(x: Column, i: Column) -> Column:
        first = F.aggregate(_halving(i + 1), i, lambda at, step: F.when(same(x, at - step), at - step).otherwise(at))
        found = F.when(~same(x, i - 1), F.lit(0))
        for n in range(2, NEAR + 2):
            found = found.when(~same(x, i - n), F.lit(n - 1))
        return found.otherwise(i - first)

    def item(x: Column, i: Column) -> Column:
        renamed = lambda n: _low(F.xxhash64(_low(x, HASH), n), HASH).bitwiseOR(_low(x, PLACE))
        return F.when(~same(x, i - 1), x).otherwise(_let(occurrence(x, i), renamed))

    return F.transform(items, item)


def _slot(items: Column, start: Column, length: int) -> Column:
    """Hash of the ``length`` items that follow ``start`` in hash order, round the end, in the order of the text."""
    n = F.size(items)
    before = F.aggregate(
        _halving(n), F.lit(0),
        lambda at, step: F.when((at + step <= n) & (F.get(items, at + step - 1) < start), at + step).otherwise(at))

    def taken(at: Column) -> Column:
        chosen = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.get(items, (at + i) % n))
        by_place = F.sort_array(F.transform(chosen, lambda x: F.shiftleft(_low(x, PLACE), 34).bitwiseOR(F.shiftrightunsigned(x, PLACE_BITS))))
        return F.xxhash64(F.transform(by_place, lambda x: _low(x, (1 << 34) - 1)))

    return (_low(_let(before, taken), 0xFFFF) - LEAST_SLOT).cast("short")


def signature(text: Column, starts: list[int], length: int = 2) -> Column:
    """Order MinHash of a text: an array of shorts, one per permutation.

    Every k-mer is hashed together with its occurrence number.  Permutation j
    orders these items by (hash - starts[j]) modulo 2^64, that is, one random
    order begun at another place; the ``length`` minimal items are put into
    their order in the text, and the tuple is hashed.  One sort serves all
    permutations.  A text too short for a k-mer is one itself.
    """
    kmers = F.regexp_extract_all(text, F.lit(KMER), F.lit(1))
    kmers = _let(kmers, lambda x: F.when(F.size(x) == 0, F.array(text)).otherwise(x))
    hashed = F.transform(kmers, lambda x, i: _low(F.xxhash64(x), HASH).bitwiseOR(i.cast("long")))
    places = F.array(*[F.lit(s).cast("long") for s in starts])
    return _let(F.sort_array(hashed), lambda items: _let(
        F.sort_array(_numbered(items)), lambda order: F.transform(places, lambda start: _slot(order, start, length))))


def starting_places(permutations: int, seed: int = 5) -> list[int]:
    """Evenly spread starting places with a hash-like offset, as signed 64-bit numbers."""
    step = (1 << 64) // permutations
    return [((seed * 0x9E3779B97F4A7C15 + i * step) % (1 << 64)) - (1 << 63) for i in range(permutations)]


def likeness(a: Column, b: Column) -> Column:
    """Part of the permutations on which two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def as_text(slots: Column) -> Column:
    """Four hexadecimal digits per permutation."""
    return F.array_join(F.transform(slots, lambda x: F.lpad(F.lower(F.hex(x.cast("int") + LEAST_SLOT)), 4, "0")), "")


def with_next(docs: DataFrame, id_column: str, carried: list[str], tie: list[str]) -> DataFrame:
    """Add ``next_<c>`` for each carried column, none of them null: its value in the next row by descending id, of the first row after the last.

    The ids are cut at quantiles into ranges; a row that ends a range is also
    sent to the range above it, whose last row it follows, and the largest id
    to the lowest range.  So a row is sent once or twice, and no range is
    larger than its share.  Null ids come last; rows of one id go by ``tie``.
    """
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    row = docs.agg(F.percentile_approx(id_column, shares, 50 * parts).alias("cuts"), F.max(id_column).alias("top")).first()
    cuts = sorted({*(row["cuts"] or []), row["top"]} - {None})
    ids, count = F.col(id_column), len(cuts)
    literal = F.array(*[F.lit(c).cast("long") for c in cuts]).cast("array<long>")
    powers = F.array(*[F.lit(1 << b) for b in range(count.bit_length() - 1, -1, -1)]).cast("array<int>")
    below = F.aggregate(powers, F.lit(0), lambda at, step: F.when(
        (at + step <= count) & (F.get(literal, at + step - 1) < ids), at + step).otherwise(at))
    ranged = docs.withColumn("_range", F.when(ids.isNull(), F.lit(0)).otherwise(below))
    own = F.struct(F.col("_range").alias("range"), F.lit(False).alias("copy"))
    above = F.struct(((F.col("_range") + 1) % max(1, count)).alias("range"), F.lit(True).alias("copy"))
    ends = F.coalesce(F.get(literal, F.col("_range")) == ids, F.lit(False))
    sent = ranged.withColumn("_to", F.explode(F.when(ends, F.array(own, above)).otherwise(F.array(own))))
    # plain columns, so that one exchange and one sort serve all windows and no value is sent twice
    sent = sent.select(*docs.columns, F.col("_to.range").alias("_range"), F.col("_to.copy").alias("_copy"))
    window = Window.partitionBy("_range").orderBy("_copy", F.desc_nulls_last(id_column), *tie)
    following = [F.coalesce(F.lead(c).over(window), F.first(c).over(window)).alias(f"next_{c}") for c in carried]
    return sent.select(*docs.columns, "_copy", *following).where(~F.col("_copy")).drop("_copy")


def order_fingerprints(docs: DataFrame, permutations: int = 64, length: int = 2, seed: int = 5) -> DataFrame:
    """``doc_id, text, slots``: the fingerprint of every whole text, a null text counting as empty.

    Equal texts have equal fingerprints.  Rows keep their doc_id, null or
    repeated; an empty table gives no row.  Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return own.withColumn("slots", signature(F.col("text"), starting_places(permutations, seed), length))


def edited_fingerprints(docs: DataFrame, part: int = 3, permutations: int = 64, length: int = 2, seed: int = 5) -> DataFrame:
    """Fingerprints of texts, of edited texts, and how alike they are, a row per document.

    ``doc_id, n_chars, edited, slots, edited_slots, near_edited, near_next``.
    The edited text has its last ``n_chars // part`` code points replaced by the
    first as many, or all, of the next document by descending doc_id; after the
    last document comes the first.  Null ids come last, rows of one id go by a
    hash of their texts and by the texts; a single document follows itself.
    """
    own = order_fingerprints(docs, permutations, length, seed)
    own = own.withColumn("hash", F.xxhash64("text"))
    chained = with_next(own, "doc_id", ["text", "slots"], ["hash", "text"])
    n = F.char_length("text")
    away = F.floor(n / part).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - away), F.substring("next_text", F.lit(1), away))
    chained = chained.select("doc_id", "slots", n.cast("long").alias("n_chars"), edited.alias("edited"),
                             likeness(F.col("slots"), F.col("next_slots")).alias("near_next"))
    chained = chained.withColumn("edited_slots", signature(F.col("edited"), starting_places(permutations, seed), length))
    return chained.withColumn("near_edited", likeness(F.col("slots"), F.col("edited_slots")))
