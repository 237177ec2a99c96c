"""Accuracy and calibration of forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from calibrant.functions.binomial import exact_band
from calibrant.functions.nulls import strict_mean, strict_sum
from calibrant.functions.rounding import prob_bucket
from calibrant.shipping import ship_package


def overall_accuracy(picks: DataFrame) -> DataFrame:
    """Share of games the favorite won; games without a result are skipped."""
    return picks.agg(F.avg(F.col("won").cast("double")).alias("accuracy"))


def accuracy_by(picks: DataFrame, *keys: str) -> DataFrame:
    """Share of games the favorite won per group; missing if any result in the group is."""
    return picks.groupBy(*keys).agg(strict_mean(F.col("won")).alias("accuracy"))


def model_ranking(picks: DataFrame) -> DataFrame:
    """Accuracy per model, best first."""
    return accuracy_by(picks, "model").orderBy(F.desc_nulls_last("accuracy"), "model")


def accuracy_against_overall(picks: DataFrame) -> DataFrame:
    """Accuracy per season and model beside the model's accuracy over all seasons.

    The picks are counted once; the totals of a model are sums over its few seasons.
    """
    won = F.col("won").cast("bigint")
    counted = picks.groupBy("season", "model").agg(
        F.sum(won).alias("wins"), F.count("won").alias("known"), F.count(F.lit(1)).alias("games")
    )

    def share(total) -> Column:
        """Wins by games over the rows that `total` sums, missing unless every result is known."""
        return F.when(total("known") == total("games"), total("wins").cast("double") / total("games"))

    over = Window.partitionBy("model")
    return counted.select(
        "model",
        "season",
        share(F.col).alias("accuracy"),
        share(lambda c: F.sum(c).over(over)).alias("overall"),
    )


def calibration(picks: DataFrame, *keys: str, skip_missing: bool = False) -> DataFrame:
    """Predicted against observed: games, wins and share won per rounded probability."""
    won = F.col("won").cast("bigint")
    wins: Column = F.sum(won) if skip_missing else strict_sum(won)
    return (
        picks.select(prob_bucket(F.col("prob")).alias("prob"), *keys, "won")
        .groupBy("prob", *keys)
        .agg(F.count(F.lit(1)).alias("games"), wins.alias("wins"))
        .withColumn("observed", F.col("wins") / F.col("games"))
    )


def with_bands(buckets: DataFrame) -> DataFrame:
    """95% exact limits around the expected, not the observed, number of wins of each bucket.

    Missing where that number is missing or not between 0 and the number of games.
    """
    ship_package(buckets.sparkSession)
    expected = (F.col("games").cast("double") * F.col("prob")).cast("bigint")
    return buckets.withColumn("band", exact_band(expected, F.col("games"))).select(
        *buckets.columns, "band.conf_low", "band.conf_high"
    )
