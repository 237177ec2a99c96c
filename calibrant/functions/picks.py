"""Choice of the favored side."""

from pyspark.sql import Column, functions as F


def favorite(prob1: Column, prob2: Column, team1: str = "team1", team2: str = "team2") -> Column:
    """Struct (won, prob, team) of the likelier side.

    Equal probabilities favor side 2. A missing probability gives a missing pick, so both
    branches are spelled out: `otherwise` would send nulls to side 2.
    """
    first, second = prob1 > prob2, prob1 <= prob2
    score1, score2 = F.col("score1"), F.col("score2")

    def pick(one: Column, two: Column) -> Column:
        return F.when(first, one).when(second, two)

    return F.struct(
        pick(score1 > score2, score2 > score1).alias("won"),
        pick(prob1, prob2).alias("prob"),
        pick(F.col(team1), F.col(team2)).alias("team"),
    )
