import datetime

import pytest

from calibrant import schemas
from calibrant.operators import lines as L, models as M
from calibrant.operators.tidy import to_long
from calibrant.plans import winnings
from calibrant.sources.names import TEAM_NAMES, team_names

DAY = datetime.date(2010, 3, 6)


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        ("3/6/2010", "Miami", "Utah", 100, 90, "-300", "+200"),
        ("2010-03-06", "Boston", "Denver", 90, 100, "-110", "-110"),
        ("3/6/2010", "Seattle", "Utah", 100, 90, "-300", "+200"),
        ("3/6/2010", "Miami", "Seattle", 100, 90, "-300", "+200"),
        ("3/6/2010", "Miami", "Utah", 100, 90, "PK", "+200"),
        ("3/6/2010", "Miami", "Utah", 100, None, "-300", "+200"),
        ("some day", "Miami", "Utah", 100, 90, "-300", "+200"),
        (None, "Miami", "Utah", 100, 90, "-300", "+200"),
    ]
    return spark.createDataFrame(rows, schemas.LINES_RAW)


def test_clean_lines_drops_rows_with_anything_missing(raw):
    rows = L.clean_lines(raw).collect()
    assert len(rows) == 4
    assert {r["date"] for r in rows} == {DAY}
    first = next(r for r in rows if r["team1"] == "Miami" and r["team2"] == "Utah")
    assert (first["moneyline1"], first["moneyline2"]) == (-300.0, 200.0)
    assert (first["moneyline_prob1"], first["moneyline_prob2"]) == (0.75, pytest.approx(1 / 3))


def test_unknown_teams_fall_out(spark, raw):
    named = L.name_lines(L.clean_lines(raw), team_names(spark))
    assert sorted((r["team1"], r["team2"]) for r in named.collect()) == [("BOS", "DEN"), ("MIA", "UTA")]


def test_crosswalk_is_one_to_one():
    codes, names = zip(*TEAM_NAMES)
    assert len(set(codes)) == len(set(names)) == 30


def test_an_even_line_favors_the_second_team(spark, raw):
    picks = {r["team1"]: r for r in L.line_picks(L.name_lines(L.clean_lines(raw), team_names(spark))).collect()}
    assert tuple(picks["MIA"][M.MONEY]) == (True, 0.75, "MIA")
    assert tuple(picks["BOS"][M.MONEY]) == (True, pytest.approx(110 / 210), "DEN")
    assert (picks["MIA"]["payout1"], picks["MIA"]["payout2"]) == (pytest.approx(100 / 3), 200.0)


def joined(spark, make_games, raw, teams, swap):
    games = make_games([(1, "2010-03-06", 2010, *teams)])
    return L.join_lines(games, L.line_picks(L.name_lines(L.clean_lines(raw), team_names(spark))), swap)


def test_same_side_and_swapped_joins(spark, make_games, raw):
    same, other = ("BOS", "DEN", 90, 100), ("DEN", "BOS", 100, 90)
    assert joined(spark, make_games, raw, same, False).count() == 1
    assert joined(spark, make_games, raw, other, False).count() == 0
    assert joined(spark, make_games, raw, same, True).count() == 0
    row = joined(spark, make_games, raw, other, True).first()
    # The even line favors its own second team, which is the game's first.
    assert tuple(row[M.MONEY])[2] == "DEN"


def test_swapped_payouts_stay_with_their_team(spark, make_games, raw):
    row = joined(spark, make_games, raw, ("UTA", "MIA", 90, 100), True).first()
    assert (row["payout1"], row["payout2"]) == (200.0, pytest.approx(100 / 3))


def test_side_payouts(spark, raw):
    rows = L.side_payouts(L.name_lines(L.clean_lines(raw), team_names(spark))).collect()
    assert {r["team"]: r["payout"] for r in rows if r["team1"] == "MIA"} == {"MIA": pytest.approx(100 / 3), "UTA": 200.0}


def test_scores_must_agree(spark, make_games, raw):
    assert joined(spark, make_games, raw, ("BOS", "DEN", 91, 100), False).count() == 0


def test_both_ways_of_settling_agree(spark, make_games, raw):
    games = make_games(
        [(1, "2010-03-06", 2010, "BOS", "DEN", 90, 100), (2, "2010-03-06", 2010, "MIA", "UTA", 100, 90)]
    )
    named = L.name_lines(L.clean_lines(raw), team_names(spark))
    wide = L.join_lines(M.team_model_picks(games), L.line_picks(named))
    by_join = winnings.settle_with_payouts(to_long(wide), L.side_payouts(named))
    columns = sorted(by_join.columns)
    direct = winnings.settle_joined(wide)
    assert sorted(direct.columns) == columns
    got = sorted(map(tuple, direct.select(*columns).collect()))
    assert got == sorted(map(tuple, by_join.select(*columns).collect()))
    assert len(got) == 10
