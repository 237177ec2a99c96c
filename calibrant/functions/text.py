"""Lenient parsing: bad text becomes null instead of failing the job."""

from pyspark.sql import Column, functions as F

# Java's own parser would also take "120d" or "0x1p3".
_NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def missing_to_null(text: Column) -> Column:
    """Empty fields and the word NA both mean missing."""
    return F.when(~text.isin("", "NA"), text)


def parse_date(text: Column) -> Column:
    """Month/day/year or ISO text to a date.

    The form is looked at first: trying a format on text of the other form is slow.
    """
    slashed = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(text, "M/d/yyyy"))
    iso = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text.try_cast("date"))
    return F.coalesce(iso, slashed)


def parse_number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def drop_first_plus(text: Column) -> Column:
    return F.regexp_replace(text, r"^([^+]*)\+", "$1")


def parse_moneyline(text: Column) -> Column:
    return parse_number(drop_first_plus(text))
