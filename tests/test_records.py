import datetime
import random

import pytest

from calibrant import schemas
from calibrant.operators import models as M, records as R


@pytest.fixture(autouse=True, params=[R.PIECE_ROWS, 3], ids=["whole-seasons", "cut-seasons"])
def piece_rows(request, monkeypatch):
    """All tests also with every team's season cut into pieces."""
    monkeypatch.setattr(R, "PIECE_ROWS", request.param)


def record(games, **options):
    rows = R.running_record(games, **options).select("game_id", "side", "team", "wins", "losses", "win_pct").collect()
    return {(r["game_id"], r["side"]): tuple(r)[2:] for r in rows}


def random_games(make_games, count, seed, hot_share=0.0, days=28):
    """Many games a day; team A takes part in about `hot_share` of them."""
    draw = random.Random(seed)
    rows = []
    for i in draw.sample(range(-(10**12), 10**12), count):
        one, two = draw.sample("BCDEFGH", 2)
        if draw.random() < hot_share:
            one = "A"
        day = f"2001-{draw.randint(1, 2):02d}-{draw.randint(1, days):02d}"
        rows.append((i, day, draw.choice([2001, 2002]), one, two, draw.randint(80, 84), draw.randint(80, 84)))
    return rows, make_games(rows)


def brute_force(rows):
    result, seen = {}, {}
    for i, day, season, one, two, s1, s2 in sorted(rows, key=lambda r: (r[1], r[0])):
        for side, team, win in ((1, one, s1 > s2), (2, two, s2 > s1)):
            won, lost = seen.get((season, team), (0, 0))
            result[i, side] = (team, won, lost, won / (won + lost) if won + lost else 0.0)
            seen[season, team] = (won + win, lost + (not win))
    return result


def test_sides_are_two_per_game_and_a_tie_is_won_by_none(make_games):
    games = make_games([(1, "2001-01-01", 2001, "A", "B", 90, 80), (2, "2001-01-02", 2001, "A", "B", 90, 90)])
    rows = R.sides(games).select("game_id", "side", "team", "win").collect()
    assert sorted(map(tuple, rows)) == [(1, 1, "A", True), (1, 2, "B", False), (2, 1, "A", False), (2, 2, "B", False)]


def test_record_counts_earlier_games_of_the_season_only(make_games):
    games = make_games(
        [
            (9, "2001-01-01", 2001, "A", "B", 90, 80),
            (5, "2001-01-03", 2001, "B", "A", 90, 80),
            (7, "2001-01-05", 2001, "A", "B", 90, 90),
            (8, "2001-11-01", 2002, "A", "B", 90, 80),
        ]
    )
    got = record(games)
    assert got[9, 1] == ("A", 0, 0, 0.0)
    assert got[5, 2] == ("A", 1, 0, 1.0)
    assert got[7, 1] == ("A", 1, 1, 0.5)
    assert got[8, 1] == ("A", 0, 0, 0.0)


@pytest.mark.parametrize("hot_share", [0.0, 0.4, 0.95])
def test_record_equals_brute_force(make_games, hot_share):
    rows, games = random_games(make_games, 600, seed=3, hot_share=hot_share)
    assert record(games) == brute_force(rows)


def test_only_the_largest_seasons_are_cut(make_games, monkeypatch):
    monkeypatch.setattr(R, "HOT_SEASONS", 2)
    rows, games = random_games(make_games, 300, seed=4, hot_share=0.4)
    assert len(games.select(R._hot_seasons(games).alias("hot")).first()["hot"]) <= 2
    assert record(games) == brute_force(rows)


@pytest.mark.parametrize("bits", [2, 12])
def test_ids_cut_a_hot_day_into_pieces_wherever_they_lie(make_games, monkeypatch, bits):
    monkeypatch.setattr(R, "PIECE_BITS", bits)
    rows = [(i, "2001-01-01", 2001, "A", "B", i % 3, (i * 7) % 3) for i in range(500)]
    rows += [(2**61, "2001-01-01", 2001, "A", "B", 1, 0), (-(2**60), "2001-01-01", 2001, "B", "A", 1, 0)]
    assert record(make_games(rows)) == brute_force(rows)


def test_no_job_runs_while_the_record_is_planned(spark, make_games):
    games = make_games([(1, "2001-01-01", 2001, "A", "B", 90, 80)])
    spark.sparkContext.setJobGroup("planning", "")
    M.team_model_picks(games)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext.setJobGroup("", "")


def with_gaps(spark):
    """Missing ids, teams, seasons and days, and a game listed twice."""
    day = datetime.date(2001, 1, 2)
    rows = [
        (1, day, 2001, "A", "B", 90, 80, 0.6, 0.4),
        (2, day, 2001, "A", None, 90, 80, 0.6, 0.4),
        (None, day, 2001, "A", "B", 80, 90, 0.6, 0.4),
        (4, None, 2001, "B", "A", 80, 90, 0.6, 0.4),
        (5, day, None, "A", "B", 80, 90, 0.6, 0.4),
        (6, day, 2001, "B", "C", 80, 90, 0.6, 0.4),
        (6, day, 2001, "B", "C", 80, 90, 0.6, 0.4),
        (7, day, 2001, "C", "B", 80, 90, 0.6, 0.4),
    ]
    return rows, spark.createDataFrame(rows, schemas.GAMES)


def test_rows_with_gaps_are_all_kept(spark):
    rows, games = with_gaps(spark)
    sides = R.running_record(games).select("game_id", "side", "team", "wins", "losses").collect()
    assert len(sides) == 2 * len(rows)
    got = {(r["game_id"], r["side"]): (r["wins"], r["losses"]) for r in sides}
    # The game without a day comes first, then the one without an id.
    assert got[4, 2] == (0, 0) and got[None, 1] == (1, 0) and got[1, 1] == (1, 1) and got[2, 1] == (2, 1)
    # The two rows of one game do not count for each other, but both count later.
    assert got[6, 2] == (0, 0) and got[7, 1] == (2, 0)
    for rated in (M.with_live_pct(games), M.with_all_pct(games), M.with_season_pct(games)):
        assert rated.count() == len(rows)
    assert as_set(M.with_all_pct(games).drop("win_pct1", "win_pct2")) == as_set(M.with_season_pct(games))
    by_id = {r["game_id"]: r for r in M.with_season_pct(games).collect()}
    assert by_id[2]["current_avg2"] == 0.0 and by_id[5]["current_avg1"] == 0.0


def test_season_share_and_the_season_before(make_games):
    games = make_games(
        [
            (1, "2001-01-01", 2001, "A", "B", 90, 80),
            (2, "2001-01-02", 2001, "A", "B", 80, 90),
            (3, "2001-01-03", 2001, "A", "C", 90, 80),
            (4, "2003-01-01", 2003, "A", "B", 90, 80),
        ]
    )
    got = {(r["team"], r["season"]): (r["current_avg"], r["prev_avg"]) for r in R.team_season_pct(games).collect()}
    assert got == {
        ("A", 2001): (pytest.approx(2 / 3), 0.5),
        ("B", 2001): (0.5, 0.5),
        ("C", 2001): (0.0, 0.5),
        ("A", 2003): (1.0, pytest.approx(2 / 3)),  # the gap year is skipped
        ("B", 2003): (0.0, 0.5),
    }


def test_missing_score_makes_the_season_share_missing(make_games):
    games = make_games([(1, "2001-01-01", 2001, "A", "B", 90, 80), (2, "2001-01-02", 2001, "A", "C", None, None)])
    got = {r["team"]: r["current_avg"] for r in R.team_season_pct(games).collect()}
    assert got == {"A": None, "B": 0.0, "C": None}


def once_a_day(make_games):
    """A schedule in which no team plays twice a day."""
    draw = random.Random(5)
    rows, i = [], 0
    for season in (2001, 2002, 2003):
        for day in range(1, 29):
            teams = list("ABCDEFGH")
            draw.shuffle(teams)
            for one, two in zip(teams[:3], teams[3:6]):
                rows.append((i, f"{season}-01-{day:02d}", season, one, two, draw.randint(80, 84), draw.randint(80, 84)))
                i += 1
    return make_games(rows)


def rated_by_joins(games):
    """The running and season shares joined to the games once per side."""
    live = R.running_record(games).select("season", "date", "team", "win_pct")
    seasons = R.team_season_pct(games)
    for side in (1, 2):
        games = games.join(live.withColumnsRenamed({"team": f"team{side}", "win_pct": f"win_pct{side}"}), [f"team{side}", "season", "date"])
        games = games.join(
            seasons.withColumnsRenamed(
                {"team": f"team{side}", "current_avg": f"current_avg{side}", "prev_avg": f"prev_avg{side}"}
            ),
            [f"team{side}", "season"],
        )
    return games


def as_set(table):
    columns = sorted(table.columns)
    return sorted(map(tuple, table.select(*columns).collect()), key=repr), columns


def test_folded_sides_equal_the_joins(make_games):
    games = once_a_day(make_games)
    assert as_set(M.with_all_pct(games)) == as_set(rated_by_joins(games))


def test_season_joins_equal_the_fold(make_games):
    games = once_a_day(make_games)
    folded = M.with_all_pct(games).drop("win_pct1", "win_pct2")
    assert as_set(M.with_season_pct(games)) == as_set(folded)
    live = M.with_all_pct(games).select(*games.columns, "win_pct1", "win_pct2")
    assert as_set(M.with_live_pct(games)) == as_set(live)


def test_picks_of_the_first_game_are_even(make_games):
    row = M.team_model_picks(make_games([(1, "2001-01-01", 2001, "A", "B", 90, 80)])).first()
    assert tuple(row[M.LIVE]) == (False, 0.5, "B")
    assert tuple(row[M.CURRENT]) == (True, 1.0, "A")
    assert tuple(row[M.PREVIOUS]) == (False, 0.5, "B")
    assert tuple(row[M.RATING]) == (True, 0.6, "A")
