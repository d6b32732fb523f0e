"""Parameter checks at plan time and row checks as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposift import defaults


def require_positive(**params: int) -> None:
    for name, value in params.items():
        if value is None or value <= 0:
            raise ValueError(f"{name} must be greater than zero")


def require_text(**params: str) -> None:
    for name, value in params.items():
        if not value or not value.strip():
            raise ValueError(f"{name} cannot be empty")


def has_columns(df: DataFrame, names: list[str]) -> bool:
    return set(names) <= set(df.columns)


def not_blank(c: Column) -> Column:
    """Whether there is anything but white space; reading stops at the first such character."""
    return F.coalesce(c.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """Name of the first check that doesn't hold, null when all hold."""
    reason = F.lit(None).cast("string")
    for name, holds in reversed(checks):
        reason = F.when(F.coalesce(holds, F.lit(False)), reason).otherwise(F.lit(name))
    return reason


def split_valid(df: DataFrame, checks: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and rejected rows with the ``reason``."""
    judged = df.withColumn("reason", first_failure(checks))
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def enforce(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Strict mode: the job fails on the first bad row instead of setting it aside."""
    reason = first_failure(checks)
    first = df.columns[0]
    guarded = F.when(reason.isNull(), F.col(first)).otherwise(F.raise_error(reason).cast(df.schema[first].dataType))
    return df.withColumn(first, guarded)


def metadata_checks() -> list[tuple[str, Column]]:
    return [
        ("repo_name: blank", not_blank(F.col("repo_name"))),
        ("title: blank", not_blank(F.col("title"))),
        ("issue_number: not above 0", F.col("issue_number") > 0),
    ]


def dimension_check(dimension: int, column: str = "embedding") -> tuple[str, Column]:
    return (f"{column}: not {dimension} numbers", F.size(F.col(column)) == dimension)


def text_check(column: str = "text") -> tuple[str, Column]:
    return (f"{column}: blank", not_blank(F.col(column)))


def issue_checks() -> list[tuple[str, Column]]:
    """Surrounding blanks are stripped before lengths count."""
    return [
        ("repo_name", not_blank(F.col("repo_name"))),
        ("issue_number", F.col("issue_number").isNotNull()),
        ("title", not_blank(F.col("title"))),
    ]


def in_unit_range(c: Column) -> Column:
    return c.between(0.0, 1.0) & ~F.isnan(c)


def classification_checks() -> list[tuple[str, Column]]:
    return [
        ("is_duplicate", F.col("is_duplicate").isNotNull()),
        ("confidence", in_unit_range(F.col("confidence"))),
        ("duplicate_type", F.col("duplicate_type").isin(defaults.DUPLICATE_TYPES)),
        ("needs_review", F.col("needs_review").isNotNull()),
        ("reason", F.col("reason").isNotNull()),
    ]


def verification_checks() -> list[tuple[str, Column]]:
    return [
        ("is_duplicate", F.col("is_duplicate").isNotNull()),
        ("confidence", in_unit_range(F.col("confidence"))),
        ("duplicate_type", F.col("duplicate_type").isin(defaults.DUPLICATE_TYPES)),
        ("final_route", F.col("final_route").isin(defaults.FINAL_ROUTES)),
        ("agree_with_first_pass", F.col("agree_with_first_pass").isNotNull()),
        ("reason", F.col("reason").isNotNull()),
    ]


def verdict_checks() -> list[tuple[str, Column]]:
    """A duplicate verdict: its score lies between 0 and 1, and a duplicate names what it repeats."""
    return [
        ("is_duplicate", F.col("is_duplicate").isNotNull()),
        ("similarity_score", in_unit_range(F.col("similarity_score"))),
        ("duplicate_of_number", ~F.col("is_duplicate") | F.col("duplicate_of_number").isNotNull()),
    ]


def request_checks() -> list[tuple[str, Column]]:
    """A pull request to review."""
    return [
        ("repo_name", not_blank(F.col("repo_name"))),
        ("pr_number", F.col("pr_number").isNotNull()),
        ("author_username", not_blank(F.col("author_username"))),
    ]


def reviewer_checks() -> list[tuple[str, Column]]:
    """A recommended reviewer: a name and a score that isn't negative."""
    return [
        ("author", not_blank(F.col("author"))),
        ("relevance_score", (F.col("relevance_score") >= 0) & ~F.isnan(F.col("relevance_score"))),
    ]


def zip_aligned(df: DataFrame, arrays: list[str], keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Turn parallel arrays into rows; records of unequal lengths are rejected whole."""
    lengths = [F.size(a) for a in arrays]
    same = F.lit(True)
    for length in lengths[1:]:
        same = same & (lengths[0] == length)
    good, bad = split_valid(df, [("arrays: unequal lengths", same)])
    rows = good.select(*(keep or []), F.inline(F.arrays_zip(*[F.col(a) for a in arrays])))
    return rows, bad
