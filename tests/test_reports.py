import datetime

import pytest
from pyspark.sql import functions as F

from calibrant.plans import catalog as C, reports, winnings

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def picks(spark):
    rows = [
        (2001, "m", True, 0.614), (2001, "m", None, 0.61), (2001, "n", True, 0.61), (2001, "n", False, 0.7),
        (2002, "m", False, 0.6), (2002, "n", True, 0.9),
    ]
    return spark.createDataFrame(rows, "season int, model string, won boolean, prob double")


@pytest.fixture(scope="module")
def tidy(spark):
    table = C.tidy(spark, SF).cache()
    table.count()
    yield table
    table.unpersist()


@pytest.fixture(scope="module")
def daily(spark):
    table = C.daily(spark, SF).cache()
    table.count()
    yield table
    table.unpersist()


def test_overall_accuracy_skips_missing_results(picks):
    assert reports.overall_accuracy(picks).first()[0] == pytest.approx(3 / 5)


def test_group_accuracy_is_missing_with_a_missing_result(picks):
    got = {(r[0], r[1]): r[2] for r in reports.accuracy_by(picks, "season", "model").collect()}
    assert got == {(2001, "m"): None, (2001, "n"): 0.5, (2002, "m"): 0.0, (2002, "n"): 1.0}


def test_ranking_puts_missing_last(picks):
    assert [r["model"] for r in reports.model_ranking(picks).collect()] == ["n", "m"]


def test_calibration_rules_for_missing_results(picks):
    strict = {(r["prob"], r["model"]): (r["games"], r["wins"], r["observed"]) for r in reports.calibration(picks, "model").collect()}
    assert strict[0.61, "m"] == (2, None, None)
    assert strict[0.61, "n"] == (1, 1, 1.0)
    skipping = {r["prob"]: (r["games"], r["wins"], r["observed"]) for r in reports.calibration(picks, skip_missing=True).collect()}
    assert skipping[0.61] == (3, 2, pytest.approx(2 / 3))


def test_bands_lie_around_the_expected_share(spark):
    buckets = spark.createDataFrame([(0.7, 10, 9, 0.9)], "prob double, games long, wins long, observed double")
    row = reports.with_bands(buckets).first()
    # 10 * 0.7 is 7 in doubles, cut to a whole number; the observed 9 plays no part.
    assert (row["conf_low"], row["conf_high"]) == pytest.approx((0.34754715, 0.93326049), abs=1e-8)


def test_buckets_hold_every_row(tidy):
    assert reports.calibration(tidy, "model").agg(F.sum("games")).first()[0] == tidy.count()


def test_every_game_has_five_models(tidy):
    counts = tidy.groupBy("game_id").agg(F.count("*").alias("n"), F.countDistinct("model").alias("m"))
    assert counts.where("n <> 5 or m <> 5").isEmpty()


def test_the_favored_team_plays_in_the_game(tidy):
    assert tidy.where("team not in (team1, team2)").isEmpty()
    assert tidy.where("prob < 0.5 and model <> 'money_winprob'").isEmpty()


def test_last_running_total_is_the_season_total(daily):
    running = winnings.cumulative_winnings(daily)
    last = running.groupBy("season", "model").agg(F.max_by("cumulative_winnings", "date").alias("last"))
    total = daily.groupBy("season", "model").agg(F.sum("days_winnings").alias("total"))
    assert last.join(total, ["season", "model"]).where("abs(last - total) > 1e-6").isEmpty()


def test_years_add_up_to_the_total(daily):
    annual = winnings.annual_winnings(daily)
    total = {r[0]: r[1] for r in winnings.total_winnings(annual).collect()}
    assert {r[0]: r[1] for r in daily.groupBy("model").agg(F.sum("days_winnings")).collect()} == pytest.approx(total)


def test_years_are_calendar_years(spark):
    rows = [(2002, datetime.date(2001, 11, 1), "m", 5.0), (2002, datetime.date(2002, 2, 1), "m", 7.0)]
    daily = spark.createDataFrame(rows, "season int, date date, model string, days_winnings double")
    assert {r["year"]: r["years_winnings"] for r in winnings.annual_winnings(daily).collect()} == {2001: 5.0, 2002: 7.0}


def test_totals_are_sorted_best_first(daily):
    totals = [r["total_winnings"] for r in winnings.total_winnings(winnings.annual_winnings(daily)).collect()]
    assert totals == sorted(totals, reverse=True) and len(totals) == 5


def test_running_winnings_stay_missing_after_a_missing_day(spark):
    rows = [(2001, datetime.date(2001, 1, i), "m", x) for i, x in ((1, 5.0), (2, None), (3, 7.0))]
    daily = spark.createDataFrame(rows, "season int, date date, model string, days_winnings double")
    running = winnings.cumulative_winnings(daily).orderBy("date").collect()
    assert [r["cumulative_winnings"] for r in running] == [5.0, None, None]
