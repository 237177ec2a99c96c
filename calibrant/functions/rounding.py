"""Rounding of probabilities to calibration buckets."""

from pyspark.sql import Column, functions as F


def prob_bucket(prob: Column) -> Column:
    """Two places, half to even, decided on the first 15 decimals.

    Probabilities computed from fractions can miss a tie such as 0.625 by one bit; cutting
    to 15 decimals first puts them back on it. The narrow decimal is the fast one; numbers
    too large for it (only freak lines between 99 and 100 give any) take the wide one.
    """
    narrow = F.bround(prob.try_cast("decimal(18,15)"), 2).cast("double")
    wide = F.bround(prob.try_cast("decimal(38,15)"), 2).cast("double")
    return F.coalesce(narrow, wide)
