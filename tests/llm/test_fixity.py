"""Merkle audit against a direct comparison."""

import hashlib

import pytest
from pyspark.sql import functions as F

from reposift.llm import fixity

SCHEMA = "file long, offset long, length long, sha256 string"


def entry(file, offset, text):
    return (file, offset, len(text), hashlib.sha256(text.encode()).hexdigest())


def replica(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", side string").repartition(3)


def direct(left, right):
    places = {r[:2] for r in left + right if None not in r}
    out = set()
    for place in places:
        a, b = (sorted((r[3], r[2]) for r in side if r[:2] == place) for side in (left, right))
        if a != b:
            out.add((*place, "missing" if not b else "extra" if not a else "changed", a[0][0] if a else None, b[0][0] if b else None))
    return out


@pytest.mark.parametrize("files", [[0], [3], [-40, -1, 0, 2, 700], [-1, 0]])
def test_damage_is_located(spark, files):
    left = [entry(f, i * 9000, f"record {f} {i}") for f in files for i in range(150)]
    right = [r for k, r in enumerate(left) if k % 97 != 5]
    right[40] = entry(*right[40][:2], "harmed")
    right += [entry(files[-1], 77, "more"), entry(files[0], 10**8, "far behind")]
    got = {(r["file"], r["offset"], r["status"], r["left_sha256"], r["right_sha256"]) for r in fixity.audit(replica(spark, left), replica(spark, right)).collect()}
    assert got == direct(left, right) and len({x[2] for x in got}) == 3


def test_equal_empty_and_repeated(spark):
    rows = [entry(1, 0, "a"), entry(1, 0, "a"), entry(1, 5, "b"), (None, 1, 1, "x"), (1, None, 1, "y"), (2, 0, 0, None)]
    same, fewer = replica(spark, rows), replica(spark, rows[1:])
    assert fixity.audit(same, same).count() == 0
    assert [(r["offset"], r["status"]) for r in fixity.audit(same, fewer).collect()] == [(0, "changed")]
    nothing = same.limit(0)
    assert fixity.audit(nothing, nothing).count() == 0
    assert {r["status"] for r in fixity.audit(nothing, same).collect()} == {"extra"}


def test_one_root_and_only_differing_branches(spark):
    left = [entry(f, i * 9000, f"{f} {i}") for f in range(20) for i in range(60)]
    sides = replica(spark, left).withColumn("side", F.lit(0)).withColumn("n", F.lit(1))
    levels = [nodes for _, nodes in fixity.merkle_levels(sides)]
    assert levels[-1].count() == 1 and [n.count() for n in levels] == sorted((n.count() for n in levels), reverse=True)


def test_records(spark):
    pages = spark.createDataFrame([(1, "u", "<é>"), (None, None, None), (2001, "v", "")], "page_id long, url string, html string")
    record = fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    got = {r["page_id"]: r for r in pages.select("page_id", record.alias("r"), fixity.warc_file(F.col("page_id"), F.col("url")).alias("file")).collect()}
    head, body = bytes(got[1]["r"]).split(b"\r\n\r\n", 1)
    assert b"Content-Length: 4" in head and body == "<é>\r\n\r\n".encode() and head.startswith(b"WARC/1.1\r\n")
    assert bytes(got[None]["r"]).endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    assert (got[1]["file"], got[2001]["file"]) == (0, 2) and got[None]["file"] < 0
    entries = spark.createDataFrame([(1, 2, 5), (1, 1, 7), (2, 1, 3)], "file long, page_id long, length long")
    assert {tuple(r) for r in fixity.placed(entries, ["page_id"]).select("file", "page_id", "offset").collect()} == {(1, 1, 0), (1, 2, 7), (2, 1, 0)}
