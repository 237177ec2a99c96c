"""Forecast models: for each, the favored side of every game as a struct (won, prob, team)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from calibrant.functions.odds import log5
from calibrant.functions.picks import favorite
from calibrant.operators.records import running_record, team_season_pct
from calibrant.schemas import GAME_KEYS

# Model labels: fixed values, they appear in the result tables.
RATING = "FiveThirtyEight"
LIVE = "wplive"
CURRENT = "wpcurrent"
PREVIOUS = "wpprev"
MONEY = "money_winprob"

TEAM_MODELS = [RATING, LIVE, CURRENT, PREVIOUS]
ALL_MODELS = [*TEAM_MODELS, MONEY]
TOP_MODELS = [RATING, CURRENT, MONEY]


def rating_pick() -> Column:
    """Favorite by the supplied rating probabilities."""
    return favorite(F.col("elo_prob1"), F.col("elo_prob2")).alias(RATING)


def _log5_pick(measure: str, label: str) -> Column:
    chance = log5(F.col(f"{measure}1"), F.col(f"{measure}2"))
    return favorite(chance, 1 - chance).alias(label)


def live_pick() -> Column:
    return _log5_pick("win_pct", LIVE)


def current_pick() -> Column:
    return _log5_pick("current_avg", CURRENT)


def previous_pick() -> Column:
    return _log5_pick("prev_avg", PREVIOUS)


_MEASURES = ["win_pct", "current_avg", "prev_avg"]


def fold_sides(rows: DataFrame, measures: list[str]) -> DataFrame:
    """Back to one row per game: each measure of the two side rows becomes `<m>1` and `<m>2`.

    The rows are placed by the columns that lines are joined on, so that join needs no
    second shuffle of the games. Both rows of a game differ in nothing but the measures. Games
    that are equal in all columns have equal measures; each of them gets its row back.
    """
    game = [c for c in rows.columns if c not in {"side", "team", "wins", "losses", *_MEASURES}]
    first = F.col("side") == 1
    folded = (
        rows.repartition(*GAME_KEYS)
        .groupBy(*game)
        .agg(
            F.count_if(first).alias("copies"),
            *(
                F.max(F.when(F.col("side") == side, F.col(m))).alias(f"{m}{side}")
                for m in measures
                for side in (1, 2)
            ),
        )
    )
    return folded.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")


def with_live_pct(games: DataFrame) -> DataFrame:
    """Games with both teams' running win shares, `win_pct1` and `win_pct2`."""
    return fold_sides(running_record(games), ["win_pct"])


def with_season_pct(games: DataFrame, seasons: DataFrame | None = None) -> DataFrame:
    """Games with both teams' whole-season and previous-season win shares.

    The season table is joined once per side. It is broadcast where Spark finds it small enough;
    otherwise adaptive execution splits the rows of a team that plays unusually often. A missing
    team or season meets its own row, as in `with_all_pct`.
    """
    seasons = team_season_pct(games) if seasons is None else seasons
    columns = games.columns
    for side in (1, 2):
        named = seasons.select(
            F.struct("season", "team").alias("team_season"),
            F.col("current_avg").alias(f"current_avg{side}"),
            F.col("prev_avg").alias(f"prev_avg{side}"),
        )
        keyed = games.withColumn("team_season", F.struct("season", F.col(f"team{side}").alias("team")))
        games = keyed.join(named, "team_season").drop("team_season")
    shares = [f"{m}{side}" for side in (1, 2) for m in _MEASURES[1:]]
    return games.select(*columns, *shares)


def with_all_pct(games: DataFrame) -> DataFrame:
    """Running, whole-season and previous-season shares of both teams together."""
    return fold_sides(running_record(games, with_seasons=True), _MEASURES)


_PICKS = {RATING: rating_pick, LIVE: live_pick, CURRENT: current_pick, PREVIOUS: previous_pick}


def team_model_picks(games: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Games with one pick column per model that needs no betting line; all four by default.

    Without the live model no running record is built.
    """
    wanted = [m for m in TEAM_MODELS if models is None or m in models]
    if LIVE in wanted:
        rated = with_all_pct(games)
    elif {CURRENT, PREVIOUS} & set(wanted):
        rated = with_season_pct(games)
    else:
        rated = games
    return rated.select(*games.columns, *(_PICKS[m]() for m in wanted))
