"""Profit of betting 100 on every model's favorite."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from calibrant.functions.nulls import strict_sum
from calibrant.functions.odds import settle
from calibrant.operators.tidy import to_long
from calibrant.schemas import GAME_KEYS


def settle_with_payouts(tidy: DataFrame, payouts: DataFrame) -> DataFrame:
    """Stored picks joined to the payouts of the team they favor, and settled."""
    return tidy.join(payouts, [*GAME_KEYS, "team"]).withColumn("payout", settle(F.col("won"), F.col("payout")))


def settle_joined(wide: DataFrame, models: list[str] | None = None) -> DataFrame:
    """The same from games that carry their line's payouts, without joining them again.

    `models` are the ones to settle, all that the games have by default.
    """
    profit = F.when(F.col("team") == F.col("team1"), F.col("payout1")).when(
        F.col("team") == F.col("team2"), F.col("payout2")
    )
    long = to_long(wide, models, keep=["payout1", "payout2"])
    return long.where(profit.isNotNull()).select(
        *(c for c in long.columns if not c.startswith("payout")), settle(F.col("won"), profit).alias("payout")
    )


def daily_winnings(settled: DataFrame) -> DataFrame:
    return settled.groupBy("season", "date", "model").agg(strict_sum(F.col("payout")).alias("days_winnings"))


def cumulative_winnings(daily: DataFrame) -> DataFrame:
    """Running total in each season, missing from the first missing day on. The groups hold one row per day."""
    so_far = Window.partitionBy("season", "model").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("cumulative_winnings", strict_sum(F.col("days_winnings"), so_far))


def annual_winnings(daily: DataFrame) -> DataFrame:
    """By calendar year, which is not the season."""
    return daily.groupBy("model", F.year("date").alias("year")).agg(
        strict_sum(F.col("days_winnings")).alias("years_winnings")
    )


def total_winnings(annual: DataFrame) -> DataFrame:
    return (
        annual.groupBy("model")
        .agg(strict_sum(F.col("years_winnings")).alias("total_winnings"))
        .orderBy(F.desc_nulls_last("total_winnings"), "model")
    )
