"""Token files: one concatenated id array, document boundaries and doc_ids in Elias-Fano form.

A file is a sequence of blocks, each followed by a line feed.  A block holds
the length of what follows, the number of the range partition and the ids of
that partition before the block, the width of an id, the number of documents
without doc_id (they come first), the boundaries (n + 1 values from 0), the
doc_ids, and the ids.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reposift.llm.bpe import byte_letters
from reposift.llm.common import staged
from reposift.llm.eliasfano import EliasFano

MAGIC = b"TOKENEF1"
HEAD = struct.Struct("<8sQQQBQ")
#: A block ends with the document that brings it to so many ids or documents; a file ends after so many blocks.
BLOCK_IDS, BLOCK_DOCS, FILE_BLOCKS = 1 << 20, 1 << 16, 16
CACHED_WORDS, CACHED_LENGTH = 250_000, 48


class WordTokens(dict):
    """The tokenizers library behind a cache from a UTF-8 word to its packed ids.

    Text is cut at blanks and line feeds only.  A tokenizer whose words never
    span white space, and which drops it and lower-cases, gives a text the ids
    of its pieces; a stop or comma behind a letter is a piece of its own.  Words
    of lower-case letters go straight to the library's model, as normalising and
    splitting leave them as they are.  The cache has two generations: words not
    met since the last full one are forgotten.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.kind = "H" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        self.width = array(self.kind).itemsize
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        found = self.old.get(word)
        if found is None:
            text = word.decode()
            if word[-1:] in (b".", b",") and word[-2:-1].isalpha():
                found = self[word[:-1]] + self[word[-1:]]
            elif text.isalpha() and text.islower() and (text.isascii() or is_normalized("NFC", text)):
                spelt = text if text.isascii() else word.decode("latin-1").translate(self.letters)
                found = array(self.kind, [t.id for t in self.model.tokenize(spelt)]).tobytes()
            else:
                found = array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(word) <= CACHED_LENGTH:
            self[word] = found
        return found

    @staticmethod
    def words(text: bytes | None) -> list[bytes]:
        """Pieces of a text, in lower case where that can't change special tokens or the composition of accents."""
        text = text or b""
        if not (b"<|" in text or b"\xcc" in text or b"\xcd" in text):
            text = text.lower()
        return text.replace(b"\n", b" ").split(b" ")

    def encode(self, text: bytes | None, end_id: int) -> bytes:
        """Packed ids of a text and the end id; a null text counts as empty."""
        if len(self) > CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, self.words(text))) + array(self.kind, [end_id]).tobytes()


@lru_cache(maxsize=2)
def tokens_of(path: str) -> WordTokens:
    """One per Python worker and file; the file must be at this path on every executor."""
    return WordTokens(path)


def block(part: int, before: int, width: int, doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    ends = np.cumsum([0, *(len(i) // width for i in ids)])
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    body = EliasFano.of(ends).to_bytes() + EliasFano.of(known).to_bytes() + b"".join(ids)
    return HEAD.pack(MAGIC, len(body), part, before, width, len(doc_ids) - len(known)) + body


class Block:
    """A block of a file: documents by position, or all of them."""

    def __init__(self, raw: memoryview, at: int):
        magic, length, self.part, self.before, self.width, self.nameless = HEAD.unpack_from(raw, at)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at += HEAD.size
        self.end = at + length
        self.bounds, at = EliasFano.read(raw, at)
        self.names, at = EliasFano.read(raw, at)
        self.ids = np.frombuffer(raw[at : self.end], f"<u{self.width}")

    def __len__(self) -> int:
        return self.bounds.n - 1

    def document(self, i: int) -> tuple[int | None, np.ndarray]:
        """doc_id and ids of the i-th document."""
        name = self.names.at(i - self.nameless) if i >= self.nameless else None
        return name, self.ids[self.bounds.at(i) : self.bounds.at(i + 1)]


def blocks(raw: bytes) -> Iterator[Block]:
    """The blocks of a file's content."""
    view, at = memoryview(raw), 0
    while at < len(view):
        found = Block(view, at)
        yield found
        at = found.end + 1


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    """Write the ids of every whole text, each document ended by ``end_id``, in ascending doc_id order.

    Rows are range-partitioned by doc_id; a partition's blocks are raw bytes
    that Spark's own text writer puts into files, so any file system works and
    a task that fails leaves no file.  A null text counts as empty and has the
    end id only.  Documents without doc_id come first, rows of one doc_id in the
    order of their texts.  An empty table gives no block.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, before = tokens_of(tokenizer), TaskContext.get().partitionId(), 0
        names, ids, size = [], [], 0
        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                names.append(name)
                ids.append(known.encode(text.as_py(), end_id))
                size += len(ids[-1]) // known.width
                if size >= BLOCK_IDS or len(names) >= BLOCK_DOCS:
                    yield pa.RecordBatch.from_pydict({"value": pa.array([block(part, before, known.width, names, ids)], pa.binary())})
                    before, names, ids, size = before + size, [], [], 0
        if names:
            yield pa.RecordBatch.from_pydict({"value": pa.array([block(part, before, known.width, names, ids)], pa.binary())})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = own.withColumn("hash", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(F.asc_nulls_first("doc_id"), "hash").sortWithinPartitions(F.asc_nulls_first("doc_id"), "hash", "text")
    # bytes pass through a string column unchanged, and the writer adds a line feed to each block
    raw = ordered.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    raw.write.option("maxRecordsPerFile", FILE_BLOCKS).option("lineSep", "\n").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``part, doc_id, start, n_tokens, ids`` of each document in the files; ``start`` counts from its partition's first id.

    ``ids`` are little-endian unsigned 32-bit integers.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for found in blocks(batch.column("content")[i].as_buffer().to_pybytes()):
                    bounds = found.bounds.all()
                    names = [None] * found.nameless + found.names.all().tolist()
                    wide = found.ids.astype("<u4")
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array(np.full(len(found), found.part, np.int64)), "doc_id": pa.array(names, pa.int64()),
                        "start": pa.array(found.before + bounds[:-1]), "n_tokens": pa.array(np.diff(bounds)),
                        "ids": pa.array([wide[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
                    })

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(unpack, "part long, doc_id long, start long, n_tokens long, ids binary")


def token_offsets(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` read from the files at ``path``; ``start`` counts from the first id of all.

    Only the totals of the range partitions, one row each, are summed up in order.
    """
    read = read_documents(spark, path).select("part", "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    own = staged(read, "token-offsets")
    totals = own.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    ahead = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = staged(totals.select("part", F.coalesce(ahead, F.lit(0)).alias("base")), "bases")
    return own.join(bases, "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
