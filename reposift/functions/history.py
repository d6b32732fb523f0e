"""Paths, commit dates and time decay."""

from __future__ import annotations

import math
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from reposift import defaults

# Fixed formats of an ISO-8601 date or date-time: extended, basic and week form.
_TIME = r"([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6}\d*)?)?)?(Z|[+-]\d{2}:?\d{2})?)?"
EXTENDED_DATE = r"\A\d{4}-\d{2}-\d{2}" + _TIME + r"\z"
BASIC_DATE = r"\A\d{8}" + _TIME + r"\z"
WEEK_DATE = r"\A\d{4}-?W\d{2}(-?[1-7])?\z"

MICROS_PER_DAY = 86_400_000_000


def parent_dirs(path: Column) -> Column:
    """All ancestor directories, the nearest first; a root-level file has none."""
    parts = F.split(F.regexp_replace(path, "/+", "/"), "/")
    depth = F.size(parts)
    dirs = F.when(
        depth > 1,
        F.transform(F.sequence(depth - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/")),
    ).otherwise(F.array().cast("array<string>"))
    return F.filter(dirs, lambda d: d != "")


def parse_commit_date(text: Column) -> Column:
    """ISO-8601 text to TIMESTAMP; no zone means UTC, anything else is null.

    The zone is always written out before the cast, so the session time zone
    has no influence.
    """
    no_space = F.regexp_replace(F.regexp_replace(text, r"\A(.{8,10}) ", "$1T"), ",", ".")
    extended = F.when(text.rlike(BASIC_DATE), F.regexp_replace(no_space, r"\A(\d{4})(\d{2})(\d{2})", "$1-$2-$3"))
    extended = extended.when(text.rlike(EXTENDED_DATE), no_space)
    with_time = F.when(F.length(extended) == 10, F.concat(extended, F.lit("T00:00:00Z"))).otherwise(extended)
    # a zone is only understood after full seconds
    for shorter in (r"(T\d{2})(?=\z|Z|[+-])", r"(T\d{2}:\d{2})(?=\z|Z|[+-])"):
        with_time = F.regexp_replace(with_time, shorter, "$1:00")
    zoned = F.when(with_time.rlike(r"(Z|T.*[+-]\d{2}:?\d{2})\z"), with_time).otherwise(
        F.concat(with_time, F.lit("Z"))
    )
    colon_zone = F.regexp_replace(zoned, r"([+-]\d{2})(\d{2})\z", "$1:$2")
    return F.coalesce(colon_zone.try_cast("timestamp"), _parse_week_date(text))


def _parse_week_date(text: Column) -> Column:
    digits = F.when(text.rlike(WEEK_DATE), F.regexp_replace(text, "[-W]", ""))
    year = F.substring(digits, 1, 4).cast("int")
    week = F.substring(digits, 5, 2).cast("int")
    day = F.coalesce(F.substring(digits, 7, 1).try_cast("int"), F.lit(1))
    jan4 = F.make_date(year, F.lit(1), F.lit(4))
    week1_monday = F.date_sub(jan4, F.weekday(jan4))
    last_week = F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))
    found = F.date_add(week1_monday, (week - 1) * 7 + day - 1)
    valid = (week >= 1) & (week <= last_week)
    return F.when(valid, F.concat(found.cast("string"), F.lit("T00:00:00Z")).try_cast("timestamp"))


def _as_utc(as_of: datetime) -> datetime:
    return as_of.replace(tzinfo=timezone.utc) if as_of.tzinfo is None else as_of.astimezone(timezone.utc)


def age_in_days(column: Column, data_type: str, as_of: datetime) -> Column:
    """Whole days from the commit to ``as_of``; null when there is no usable date."""
    moment = _as_utc(as_of)
    if data_type == "timestamp_ntz":
        literal = F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
        return F.floor(F.timestamp_diff("MICROSECOND", column, literal) / MICROS_PER_DAY)
    if data_type == "date":
        return F.datediff(F.lit(moment.strftime("%Y-%m-%d")).cast("date"), column)
    instant = parse_commit_date(column) if data_type == "string" else column
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    delta = moment - epoch
    as_of_micros = (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds
    return F.floor((F.lit(as_of_micros) - F.unix_micros(instant)) / MICROS_PER_DAY)


def decayed_weight(weight: Column, age_days: Column, half_life_days: float = defaults.HALF_LIFE_DAYS) -> Column:
    """Half the weight per half-life; future commits and missing dates keep all of it."""
    days = F.greatest(F.lit(0), F.coalesce(age_days, F.lit(0)))
    return weight * F.exp(F.lit(-math.log(2) / half_life_days) * days)
