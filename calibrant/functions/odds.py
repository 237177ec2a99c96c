"""Probabilities and payouts as plain Column expressions."""

from pyspark.sql import Column, functions as F


def log5(a: Column, b: Column) -> Column:
    """Chance that a side with win share `a` beats one with win share `b`.

    Two winless or two unbeaten sides are an even match.
    """
    even = ((a == 0) & (b == 0)) | ((a == 1) & (b == 1))
    for_a, for_b = a * (1 - b), b * (1 - a)
    return F.when(even, F.lit(0.5)).otherwise(F.try_divide(for_a, for_a + for_b))


def implied_prob(moneyline: Column) -> Column:
    """Win probability that a moneyline stands for.

    The split lies at 100, not at 0, so a line between 0 and 100 comes out negative.
    """
    return F.when(moneyline < 100, -moneyline / (-moneyline + 100)).when(
        moneyline >= 100, F.lit(100.0) / (moneyline + 100)
    )


def payout(moneyline: Column, bet: float = 100.0) -> Column:
    """Profit of a won bet. A positive line is itself the profit, whatever the bet."""
    return F.when(moneyline < 0, F.lit(-bet * 100) / moneyline).when(moneyline >= 0, moneyline)


def settle(won: Column, profit: Column) -> Column:
    """Profit of a won bet or the flat stake of 100 lost; unknown outcomes stay unknown."""
    return F.when(won, profit).when(~won, F.lit(-100.0))
