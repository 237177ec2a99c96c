"""Registered queries: each takes a session and the folder of the input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from calibrant.functions.odds import log5
from calibrant.operators import lines as L, models as M, records as R
from calibrant.operators.tidy import GAME, to_long
from calibrant.plans import reports, winnings
from calibrant.schemas import GAME_KEYS
from calibrant.sources import order_views as V, pages as P, tables as S
from calibrant.sources.names import team_names

PAGES_SINCE = "1996-10-01"
LINES_SINCE_SEASON = 1997

Query = Callable[[SparkSession, str], DataFrame]


def all_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.games(V.orders(spark, sf_dir))


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.played_games(all_games(spark, sf_dir), V.PLAYED_BEFORE, V.FIRST_SEASON)


def named_lines(spark: SparkSession, sf_dir: str, swap_sides: bool = False) -> DataFrame:
    played = games(spark, sf_dir)
    raw = V.raw_lines(V.club_games(played), swap_sides)
    return L.name_lines(L.clean_lines(raw), V.team_names(played))


def wide(spark: SparkSession, sf_dir: str, models: list[str] | None = None) -> DataFrame:
    """Games that have a line, with the picks of the models wanted, all five by default."""
    picks = L.line_picks(named_lines(spark, sf_dir))
    return L.join_lines(M.team_model_picks(games(spark, sf_dir), models), picks)


def wide_swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for lines that list the teams the other way round, from a later season on."""
    rated = M.team_model_picks(games(spark, sf_dir))
    return _join_swapped(rated, spark, sf_dir)


def _join_swapped(table: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = L.line_picks(named_lines(spark, sf_dir, swap_sides=True))
    return L.join_lines(table.where(F.col("season") >= LINES_SINCE_SEASON), picks, swap_sides=True)


def tidy(spark: SparkSession, sf_dir: str, models: list[str] | None = None) -> DataFrame:
    return to_long(wide(spark, sf_dir, models), models)


def team_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form of the four models that need no line, over all games."""
    return to_long(M.team_model_picks(games(spark, sf_dir)))


def rating_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return games(spark, sf_dir).select(*GAME, M.rating_pick()).select(*GAME, f"{M.RATING}.*")


def daily(spark: SparkSession, sf_dir: str, models: list[str] | None = None) -> DataFrame:
    return winnings.daily_winnings(winnings.settle_joined(wide(spark, sf_dir, models), models))


# Sums of doubles depend on their order in the last bits; they are shown to four places.
def _money(table: DataFrame) -> DataFrame:
    return table.withColumns({c: F.round(c, 4) for c in table.columns if c.endswith("winnings")})


def live_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _record(R.running_record(games(spark, sf_dir)))


def live_record_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running record beside the shares of the whole season and of the season before, from its totals."""
    return _record(R.running_record(games(spark, sf_dir), with_seasons=True), "current_avg", "prev_avg")


def _record(rows: DataFrame, *shares: str) -> DataFrame:
    return rows.select("game_id", "side", "season", "team", "date", "wins", "losses", "win_pct", *shares)


def _picked(rated: DataFrame, pick) -> DataFrame:
    return rated.select(*GAME, pick.alias("pick")).select(*GAME, "pick.*")


def log5_chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = M.with_season_pct(games(spark, sf_dir))
    chance = log5(F.col("current_avg1"), F.col("current_avg2"))
    return rated.select("game_id", "current_avg1", "current_avg2", chance.alias("win_prob1"), (1 - chance).alias("win_prob2"))


def games_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.shared_folder(spark, "games-csv")
    extra = all_games(spark, sf_dir).withColumn("raptor_prob1", F.col("elo_prob1"))
    S.write_csv(extra.select("date", "season", "raptor_prob1", *(c for c in extra.columns if c not in ("date", "season", "raptor_prob1"))), path)
    return S.read_games_csv(spark, path, V.PLAYED_BEFORE, V.FIRST_SEASON)


def lines_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.shared_folder(spark, "lines-csv")
    S.write_csv(V.raw_lines(V.club_games(games(spark, sf_dir))), path)
    return L.clean_lines(S.read_lines_csv(spark, path))


def tidy_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.shared_folder(spark, "tidy")
    S.write_tidy(tidy(spark, sf_dir), path)
    return S.read_tidy(spark, path)


def tidy_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.shared_folder(spark, "tidy-csv")
    S.write_csv(tidy(spark, sf_dir), path)
    return S.read_tidy_csv(spark, path)


def games_csv_unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games stored without ids and numbered on reading; the numbers are left out again."""
    path = S.shared_folder(spark, "games-csv-plain")
    S.write_csv(all_games(spark, sf_dir).drop("game_id"), path)
    return S.read_games_csv(spark, path, V.PLAYED_BEFORE, V.FIRST_SEASON).drop("game_id")


def slate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the games' odds pages, stored as lines, read back and cleaned."""
    path = S.shared_folder(spark, "slate-lines")
    S.write_csv(P.page_rows(V.game_pages(V.club_games(games(spark, sf_dir)))), path)
    return L.clean_lines(S.read_lines_csv(spark, path))


def games_with_slate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games with the lines their odds pages show."""
    played = games(spark, sf_dir)
    named = L.name_lines(slate_lines(spark, sf_dir), V.team_names(played))
    return _line_games(L.join_lines(played, L.line_picks(named)))


def settled_bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    payouts = L.side_payouts(named_lines(spark, sf_dir))
    return winnings.settle_with_payouts(tidy(spark, sf_dir), payouts)


def slate_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_urls(games(spark, sf_dir), V.PAGE_BASE, PAGES_SINCE)


def slate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_rows(V.stored_pages(V.orders(spark, sf_dir)))


def slate_rows_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the pages that the games ask for."""
    pages = V.stored_pages(V.orders(spark, sf_dir))
    return P.page_rows(pages.join(slate_urls(spark, sf_dir).select("url"), "url", "left_semi"))


def queries() -> dict[str, Query]:
    return {
        "games_scan": games,
        "games_csv": games_csv,
        "sides": lambda s, d: R.sides(games(s, d)).select("game_id", "season", "date", "side", "team", "win"),
        "favorite_elo": rating_picks,
        "accuracy_overall_elo": lambda s, d: reports.overall_accuracy(rating_picks(s, d)),
        "accuracy_by_season_elo": lambda s, d: reports.accuracy_by(rating_picks(s, d), "season"),
        "accuracy_by_season_uncut": lambda s, d: reports.accuracy_by(
            _picked(all_games(s, d), M.rating_pick()), "season"
        ),
        "calibration_elo": lambda s, d: reports.calibration(rating_picks(s, d), skip_missing=True),
        "calibration_bands": lambda s, d: _bands(reports.calibration(rating_picks(s, d), skip_missing=True)),
        "live_record": live_record,
        "live_record_split": live_record_split,
        "team_season_pct": lambda s, d: R.team_season_pct(games(s, d)),
        "log5": log5_chances,
        "wplive": lambda s, d: _picked(M.with_live_pct(games(s, d)), M.live_pick()),
        "wpcurrent": lambda s, d: _picked(M.with_season_pct(games(s, d)), M.current_pick()),
        "wpprev": lambda s, d: _picked(M.with_season_pct(games(s, d)), M.previous_pick()),
        "team_models": team_tidy,
        "accuracy_by_model_team": lambda s, d: reports.model_ranking(team_tidy(s, d)),
        "accuracy_by_season_model_team": lambda s, d: reports.accuracy_by(team_tidy(s, d), "season", "model"),
        "calibration_by_model_team": lambda s, d: reports.calibration(team_tidy(s, d), "model"),
        "lines_clean": lambda s, d: L.clean_lines(V.raw_lines(V.club_games(games(s, d)))),
        "lines_csv": lines_csv,
        "implied_prob": lambda s, d: L.clean_lines(V.raw_lines(V.club_games(games(s, d)))).select(
            *GAME_KEYS, "moneyline1", "moneyline_prob1", "moneyline2", "moneyline_prob2"
        ),
        "lines_named": named_lines,
        "lines_named_cities": lambda s, d: L.name_lines(
            L.clean_lines(V.raw_lines(V.city_games(games(s, d)))), team_names(s)
        ),
        "payouts": lambda s, d: L.side_payouts(named_lines(s, d)),
        "games_with_lines": lambda s, d: _line_games(
            L.join_lines(games(s, d), L.line_picks(named_lines(s, d)))
        ),
        "games_with_lines_swapped": lambda s, d: _line_games(_join_swapped(games(s, d), s, d)),
        "tidy": tidy,
        "tidy_swapped": lambda s, d: to_long(wide_swapped(s, d)).drop("team"),
        "tidy_roundtrip": tidy_roundtrip,
        "tidy_csv": tidy_csv,
        "accuracy_by_model": lambda s, d: reports.model_ranking(tidy(s, d)),
        "accuracy_by_season_model": lambda s, d: reports.accuracy_by(tidy(s, d), "season", "model"),
        "accuracy_against_overall": lambda s, d: reports.accuracy_against_overall(tidy(s, d)),
        "calibration_by_model": lambda s, d: reports.calibration(tidy(s, d), "model"),
        "calibration_top": lambda s, d: reports.calibration(tidy(s, d, M.TOP_MODELS), "model"),
        "settled_bets": settled_bets,
        "daily_winnings": lambda s, d: _money(daily(s, d)),
        "cumulative_winnings": lambda s, d: _money(winnings.cumulative_winnings(daily(s, d))),
        "winnings_series": lambda s, d: _money(winnings.cumulative_winnings(daily(s, d, M.TOP_MODELS))),
        "annual_winnings": lambda s, d: _money(winnings.annual_winnings(daily(s, d))),
        "total_winnings": lambda s, d: _money(winnings.total_winnings(winnings.annual_winnings(daily(s, d)))),
        "slate_urls": slate_urls,
        "slate_rows": slate_rows,
        "slate_rows_wanted": slate_rows_wanted,
        "slate_lines_csv": slate_lines,
        "games_with_slate_lines": games_with_slate_lines,
        "games_csv_unnumbered": games_csv_unnumbered,
    }


def _bands(buckets: DataFrame) -> DataFrame:
    limits = ("conf_low", "conf_high")
    return reports.with_bands(buckets).withColumns({c: F.round(c, 6) for c in limits})


def _line_games(joined: DataFrame) -> DataFrame:
    money = [F.col(f"{M.MONEY}.{f}").alias(f) for f in ("won", "prob", "team")]
    return joined.select(*GAME, *money, "payout1", "payout2")
