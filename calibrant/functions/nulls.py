"""Aggregates that turn missing when any input is missing (SQL aggregates skip them)."""

from pyspark.sql import Column, WindowSpec, functions as F


def _if_complete(value: Column, result: Column) -> Column:
    return F.when(F.count(value) == F.count(F.lit(1)), result)


def strict_mean(value: Column) -> Column:
    return _if_complete(value, F.avg(value.cast("double")))


def strict_sum(value: Column, window: WindowSpec | None = None) -> Column:
    """Of a group, or of the rows of a window."""
    if window is None:
        return _if_complete(value, F.sum(value))
    return F.when(F.count(value).over(window) == F.count(F.lit(1)).over(window), F.sum(value).over(window))
