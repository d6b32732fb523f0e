from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from reposift.functions import history as H


@pytest.mark.parametrize("path, wanted", [
    ("src/auth/login.tsx", ["src/auth", "src"]), ("README.md", []), ("/a/b", ["/a"]), ("//x", []), ("a//b/c", ["a/b", "a"]),
])
def test_parent_dirs(spark, path, wanted):
    assert spark.createDataFrame([(path,)], "p string").select(H.parent_dirs(F.col("p")).alias("d")).first().d == wanted


DATES = ["2024-01-01", "2024-01-01T10:20:30Z", "2024-01-01T10:20:30+05:30", "2024-01-01 10:20", "20240101", "2024-W01-1",
         "2024-W10", "2024-01-01T10:20:30.123456", "2024-01-01T10+02:00", "2024-01-01T10:20:30-0800", "2020-W53-7"]
NO_DATES = ["2024-01", "2024", " 2024-01-01", "x", "", "2024-13-01", "2024-02-30", "2024-W54-1", "2021-W53-1"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_dates_equal_python(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([(d,) for d in DATES + NO_DATES], "d string").select(
            "d", F.unix_micros(H.parse_commit_date(F.col("d"))).alias("m")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for row in rows:
        if row.d in NO_DATES:
            assert row.m is None, row
            continue
        moment = datetime.fromisoformat(row.d.replace("Z", "+00:00"))
        moment = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
        assert row.m == (moment - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1), row


@pytest.mark.parametrize("kind", ["string", "timestamp", "timestamp_ntz", "date"])
def test_decay_halves(spark, kind):
    as_of = datetime(2024, 6, 30)
    days = [0, 180, 360, -5]
    texts = [(d, (as_of - timedelta(days=d)).strftime("%Y-%m-%d")) for d in days]
    df = spark.createDataFrame(texts, "d int, t string").withColumn("t", F.col("t").cast(kind))
    got = {r.d: r.w for r in df.select("d", H.decayed_weight(F.lit(1.0), H.age_in_days(F.col("t"), kind, as_of)).alias("w")).collect()}
    assert [round(got[d], 12) for d in days] == [1, 0.5, 0.25, 1]


def test_no_date_keeps_weight(spark):
    df = spark.createDataFrame([("soon",), (None,)], "t string")
    age = H.age_in_days(F.col("t"), "string", datetime(2024, 1, 1))
    assert [r.w for r in df.select(H.decayed_weight(F.lit(3.0), age).alias("w")).collect()] == [3.0, 3.0]
