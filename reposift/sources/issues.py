"""Issue dumps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from reposift.operators.validation import require_positive
from reposift.session import cut_lineage

ISSUE_SCHEMA = T.StructType([
    T.StructField("repo_name", T.StringType()),
    T.StructField("number", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("body", T.StringType()),
])
_CORRUPT = "_corrupt_record"


def read_issues(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Issues in every state: ``repo_name, issue_number, title, body``; JSON lines that can't be parsed are left out.

    :func:`read_issue_dumps` gives those lines as well.
    """
    if fmt == "json":
        return read_issue_dumps(spark, [path]).issues
    return _named(spark.read.schema(ISSUE_SCHEMA).format(fmt).load(path))


def _named(raw: DataFrame) -> DataFrame:
    return raw.select("repo_name", F.col("number").alias("issue_number"), "title", "body")


class Dumps(NamedTuple):
    """``issues``; ``broken(record, path)``: lines that can't be parsed; ``failed(path, reason)``: paths and files left out whole."""

    issues: DataFrame
    broken: DataFrame
    failed: DataFrame


def _reachable(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """Paths that are there and may be listed, and the others with the reason; metadata calls only."""
    context = spark.sparkContext
    good, failed = [], []
    for path in paths:
        try:
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            system = place.getFileSystem(context._jsc.hadoopConfiguration())
            if system.getFileStatus(place).isDirectory():
                system.listStatus(place)
            good.append(path)
        except Py4JJavaError as error:
            failed.append((path, error.java_exception.getClass().getSimpleName()))
    return good, failed


def _unsound_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, reason`` of gzip files that break off or are damaged.

    Spark's line reader hands on what precedes the damage, so the files are
    unpacked once more, each in one task and in slices; nothing but names of
    bad ones leaves it.
    """

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                reason = _gzip_fault(memoryview(content.as_buffer()))
                if reason:
                    bad.append((path, reason))
            yield pa.RecordBatch.from_pydict({
                "path": pa.array([p for p, _ in bad], pa.string()), "reason": pa.array([r for _, r in bad], pa.string())})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").load(paths)
    return files.select(F.col("_metadata.file_path").alias("path"), "content").mapInArrow(probe, "path string, reason string")


def _gzip_fault(content: memoryview, step: int = 1 << 20) -> str | None:
    """What is wrong with a gzip file of one or more members, or None."""
    unpacker, fed = zlib.decompressobj(wbits=31), False
    try:
        for at in range(0, len(content), step):
            data = bytes(content[at : at + step])
            while data:
                if unpacker.eof:
                    unpacker, fed = zlib.decompressobj(wbits=31), False
                unpacker.decompress(data, step)
                fed = True
                data = unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail
    except zlib.error:
        return "damaged"
    return "truncated" if fed and not unpacker.eof else None


def read_issue_dumps(spark: SparkSession, paths: list[str]) -> Dumps:
    """One read over the dumps of many repositories, one JSON object per line, plain or packed with gzip.

    What can't be read is left out and told, the rest is read: paths that are
    absent or closed, packed files that are damaged or break off (none of their
    lines is taken), lines that can't be parsed.  Nothing readable gives empty
    tables.
    """
    readable, failed = _reachable(spark, paths)
    lost = spark.createDataFrame(failed, "path string, reason string")
    if readable:
        unsound = cut_lineage(_unsound_files(spark, readable))
        lost = lost.unionByName(unsound)
        lines = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).text(readable)
        lines = lines.select("value", F.col("_metadata.file_path").alias("path")).join(unsound.select("path"), "path", "left_anti")
    else:
        lines = spark.createDataFrame([], "value string, path string")
    schema = T.StructType(ISSUE_SCHEMA.fields + [T.StructField(_CORRUPT, T.StringType())])
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    raw = lines.filter(F.trim("value") != "").select("path", parsed.alias("r")).select("path", "r.*")
    good = _named(raw.filter(F.col(_CORRUPT).isNull()))
    bad = raw.filter(F.col(_CORRUPT).isNotNull()).select(F.col(_CORRUPT).alias("record"), "path")
    return Dumps(good, bad, lost)


def cap_per_repo(issues: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` issues of each repository with their position, newest first.

    The rank filter is applied before and after the shuffle, so a task never
    receives more than ``limit`` rows per repository from any other task.
    """
    require_positive(limit=limit)
    newest = Window.partitionBy("repo_name").orderBy(F.desc("issue_number"))
    ranked = issues.withColumn("pos", F.row_number().over(newest)).filter(F.col("pos") <= limit)
    return ranked.withColumn("pos", F.col("pos").cast("bigint"))
