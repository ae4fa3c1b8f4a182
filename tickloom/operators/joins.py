"""Joins beyond equality on a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(df: DataFrame, keys: list[str], at: str, value: str, back: int, tolerance: int | None = None):
    """The latest value at or before ``at - back`` of the same key, NULL if older than ``tolerance``.

    A range frame over the sorted series: no join, one exchange by key. ``at`` is a whole number.
    """
    frame = Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.unboundedPreceding, -back)
    last, when = F.last(value).over(frame), F.last(at).over(frame)
    return last if tolerance is None else F.when(F.col(at) - back - when <= tolerance, last)


def backward_return_bps(df: DataFrame, keys: list[str], at: str, price: str, back: int, tolerance: int) -> DataFrame:
    before = as_of(df, keys, at, price, back, tolerance)
    return df.withColumn("back_bps", F.try_divide(F.col(price), before) * 1e4 - 1e4)


def outcome(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Inner join, each side's first row of a key (by ``order``)."""

    def first(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(key).orderBy(order)
        return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", order)

    return first(left).join(first(right), key)
