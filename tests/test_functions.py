import datetime

import pytest
from pyspark.sql import functions as F

from calibrant.functions import nulls, odds, rounding, text
from calibrant.functions.picks import favorite


def evaluate(spark, expression, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_payout(spark):
    got = evaluate(spark, odds.payout(F.col("x")), "x double", [(-300.0,), (200.0,), (0.0,), (None,)])
    assert got == [pytest.approx(100 / 3), 200.0, 0.0, None]


def test_payout_ignores_the_bet_on_positive_lines(spark):
    got = evaluate(spark, odds.payout(F.col("x"), bet=50.0), "x double", [(-200.0,), (150.0,)])
    assert got == [25.0, 150.0]


def test_implied_probability_splits_at_one_hundred(spark):
    rows = [(-300.0,), (200.0,), (100.0,), (-100.0,), (50.0,), (0.0,), (None,)]
    got = evaluate(spark, odds.implied_prob(F.col("x")), "x double", rows)
    assert got == [0.75, pytest.approx(1 / 3), 0.5, 0.5, -1.0, 0.0, None]


def test_log5(spark):
    rows = [(0.0, 0.0), (1.0, 1.0), (0.6, 0.4), (1.0, 0.0), (0.0, 0.3), (None, 0.5), (0.5, None)]
    got = evaluate(spark, odds.log5(F.col("a"), F.col("b")), "a double, b double", rows)
    assert got == [0.5, 0.5, pytest.approx(0.36 / 0.52), 1.0, 0.0, None, None]


def test_log5_of_both_sides_adds_up_to_one(spark):
    grid = [(i / 20, j / 20) for i in range(21) for j in range(21)]
    both = odds.log5(F.col("a"), F.col("b")) + odds.log5(F.col("b"), F.col("a"))
    assert evaluate(spark, both, "a double, b double", grid) == pytest.approx([1.0] * len(grid))


def test_settle(spark):
    got = evaluate(
        spark, odds.settle(F.col("w"), F.col("p")), "w boolean, p double", [(True, 40.0), (False, 40.0), (None, 40.0)]
    )
    assert got == [40.0, -100.0, None]


def test_favorite(spark):
    schema = "p1 double, p2 double, score1 int, score2 int, team1 string, team2 string"
    rows = [
        (0.7, 0.3, 100, 90, "A", "B"),
        (0.3, 0.7, 100, 90, "A", "B"),
        (0.5, 0.5, 100, 90, "A", "B"),
        (0.7, 0.3, 90, 90, "A", "B"),
        (0.7, 0.3, None, None, "A", "B"),
        (None, 0.3, 100, 90, "A", "B"),
    ]
    got = [tuple(r) for r in evaluate(spark, favorite(F.col("p1"), F.col("p2")), schema, rows)]
    assert got == [
        (True, 0.7, "A"),
        (False, 0.7, "B"),
        (False, 0.5, "B"),
        (False, 0.7, "A"),
        (None, 0.7, "A"),
        (None, None, None),
    ]


def test_strict_aggregates_are_missing_when_any_input_is(spark):
    table = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 1.0), ("b", 2.0)], "k string, x double")
    got = table.groupBy("k").agg(
        nulls.strict_mean(F.col("x")).alias("mean"), nulls.strict_sum(F.col("x")).alias("sum")
    )
    assert {r["k"]: (r["mean"], r["sum"]) for r in got.collect()} == {"a": (None, None), "b": (1.5, 3.0)}


def test_prob_bucket_rounds_half_to_even_and_mends_last_bits(spark):
    rows = [(0.575,), (0.625,), (0.62500000000000011,), (0.615,), (0.005,), (-1.0,), (-1999.0,), (None,)]
    got = evaluate(spark, rounding.prob_bucket(F.col("p")), "p double", rows)
    assert got == [0.58, 0.62, 0.62, 0.62, 0.0, -1.0, -1999.0, None]


def test_parse_date(spark):
    rows = [("3/5/2010",), ("12/31/2010",), ("2010-03-05",), ("2010-3-5",), ("13/40/2010",), ("soon",), ("2010",), (None,)]
    got = evaluate(spark, text.parse_date(F.col("t")), "t string", rows)
    day = datetime.date(2010, 3, 5)
    assert got == [day, datetime.date(2010, 12, 31), day, day, None, None, None, None]


def test_parse_moneyline(spark):
    rows = [("+120",), ("-110",), ("PK",), (" 150 ",), ("1e3",), ("120d",), ("",), (None,), ("++5",)]
    got = evaluate(spark, text.parse_moneyline(F.col("t")), "t string", rows)
    assert got == [120.0, -110.0, None, 150.0, 1000.0, None, None, None, 5.0]


def test_drop_first_plus_only(spark):
    assert evaluate(spark, text.drop_first_plus(F.col("t")), "t string", [("a+b+c",), ("ab",)]) == ["ab+c", "ab"]
