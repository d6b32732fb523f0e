"""Vector arithmetic on ARRAY<FLOAT|DOUBLE> columns.

Elements are widened to double first.  These expressions are meant for one
vector or one pair per row; joins over many pairs go through the block
kernel in ``operators.neighbours``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit length; the zero vector stays as it is."""
    length = norm(v)
    divisor = F.when(length > 0, length).otherwise(F.lit(1.0))
    return F.transform(v, lambda x: x.cast("double") / divisor)


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def distance_to_similarity(distance: Column) -> Column:
    return clip(F.lit(1.0) - distance, 0.0, 1.0)


def f1(precision: Column, recall: Column, epsilon: float) -> Column:
    return F.lit(2.0) * (precision * recall) / (precision + recall + F.lit(epsilon))
