"""Crosswalk between the team codes of the games table and the city names of the lines table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from calibrant.schemas import NAMES

# Code and name of each team present in both tables. Teams that moved or were
# renamed are left out on purpose, so their lines fall out of the join.
TEAM_NAMES = [
    ("LAL", "L.A. Lakers"),
    ("MIA", "Miami"),
    ("CLE", "Cleveland"),
    ("GSW", "Golden State"),
    ("MIN", "Minnesota"),
    ("UTA", "Utah"),
    ("CHO", "Charlotte"),
    ("DET", "Detroit"),
    ("MEM", "Memphis"),
    ("BOS", "Boston"),
    ("PHI", "Philadelphia"),
    ("ORL", "Orlando"),
    ("PHO", "Phoenix"),
    ("LAC", "L.A. Clippers"),
    ("DAL", "Dallas"),
    ("DEN", "Denver"),
    ("CHI", "Chicago"),
    ("TOR", "Toronto"),
    ("ATL", "Atlanta"),
    ("SAS", "San Antonio"),
    ("IND", "Indiana"),
    ("HOU", "Houston"),
    ("NYK", "New York"),
    ("POR", "Portland"),
    ("MIL", "Milwaukee"),
    ("WAS", "Washington"),
    ("SAC", "Sacramento"),
    ("NOP", "New Orleans"),
    ("OKC", "Oklahoma City"),
    ("BRK", "Brooklyn"),
]


def team_names(spark: SparkSession) -> DataFrame:
    """The crosswalk as a literal relation: Spark knows its size and takes it as the small side."""
    rows = ", ".join(f"('{code}', '{name}')" for code, name in TEAM_NAMES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS crosswalk({', '.join(NAMES.names)})")
