"""Betting lines: cleaning, naming, favorite, and the join to games."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from calibrant.functions.odds import implied_prob, payout
from calibrant.functions.picks import favorite
from calibrant.functions.text import parse_date, parse_moneyline
from calibrant.operators.models import MONEY
from calibrant.schemas import GAME_KEYS

def clean_lines(raw: DataFrame) -> DataFrame:
    """Typed lines with implied probabilities; rows with anything missing or unreadable go.

    `inline` keeps the filter behind the parsing, which would otherwise run once more in it.
    """
    parsed = F.struct(
        parse_date(F.col("date")).alias("date"),
        "team1",
        "team2",
        "score1",
        "score2",
        *(parse_moneyline(F.col(c)).alias(c) for c in ("moneyline1", "moneyline2")),
    )
    typed = raw.select(F.inline(F.array(parsed))).dropna("any")
    return typed.withColumns(
        {f"moneyline_prob{side}": implied_prob(F.col(f"moneyline{side}")) for side in (1, 2)}
    )


def name_lines(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Team names to the codes that games use; lines of unknown teams fall out."""
    for side in (1, 2):
        named = names.select(F.col("name").alias(f"team{side}"), F.col("code").alias(f"code{side}"))
        lines = lines.join(named, f"team{side}").drop(f"team{side}").withColumnRenamed(f"code{side}", f"team{side}")
    return lines


def line_picks(named: DataFrame) -> DataFrame:
    """Favorite by implied probability and the profit of a won bet on either side."""
    return named.select(
        *GAME_KEYS,
        favorite(F.col("moneyline_prob1"), F.col("moneyline_prob2")).alias(MONEY),
        payout(F.col("moneyline1")).alias("payout1"),
        payout(F.col("moneyline2")).alias("payout2"),
    )


def join_lines(games: DataFrame, picks: DataFrame, swap_sides: bool = False) -> DataFrame:
    """Games that have a line, with the line's pick and payouts.

    With `swap_sides` the lines list the two teams the other way round than the games. The
    pick was made on the line's own sides before, so an even line still favors its second team.
    """
    if swap_sides:
        other = {"1": "2", "2": "1"}
        picks = picks.select(
            "date",
            MONEY,
            *(F.col(f"{c}{n}").alias(f"{c}{other[n]}") for c in ("team", "score", "payout") for n in "12"),
        )
    return games.join(picks, GAME_KEYS)


def side_payouts(named: DataFrame) -> DataFrame:
    """Two rows per line: each team with the profit of a won bet on it."""
    both = F.array(
        *(
            F.struct(F.col(f"team{n}").alias("team"), payout(F.col(f"moneyline{n}")).alias("payout"))
            for n in (1, 2)
        )
    )
    return named.select("date", "score1", "score2", "team1", "team2", F.inline(both))
