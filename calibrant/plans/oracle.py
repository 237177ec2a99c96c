"""The registered queries as SQL for DuckDB, written independently of the Spark plans."""

from __future__ import annotations

from calibrant.operators.models import ALL_MODELS, MONEY, RATING, TEAM_MODELS, TOP_MODELS
from calibrant.plans.catalog import LINES_SINCE_SEASON, PAGES_SINCE
from calibrant.sources.names import TEAM_NAMES
from calibrant.sources.order_views import DAYS, FIRST_DAY, FIRST_SEASON, PAGE_BASE, PLAYED_BEFORE

ALL_GAMES = f"""
all_games AS (
  SELECT k AS game_id, date, season,
         'L' || lg || 'T' || t1 AS team1, 'L' || lg || 'T' || t2 AS team2,
         CASE WHEN played THEN CAST(90 + b + CASE WHEN luck < strength THEN m ELSE 0 END AS INT) END AS score1,
         CASE WHEN played THEN CAST(90 + b + CASE WHEN luck < strength THEN 0 ELSE m END AS INT) END AS score2,
         strength / 1001e0 AS elo_prob1, 1 - strength / 1001e0 AS elo_prob2
  FROM (SELECT *, (t1 + 1 + k % 9) % 10 AS t2, 50 + (k * 31) % 901 AS strength, (k * 7919) % 1001 AS luck,
               k % 30 AS b, k % 15 AS m, date < DATE '{PLAYED_BEFORE}' AS played
        FROM (SELECT k, date, CAST(YEAR(date) + CASE WHEN MONTH(date) >= 10 THEN 1 ELSE 0 END AS INT) AS season, lg, t1
              FROM (SELECT o_orderkey AS k, DATE '{FIRST_DAY}' + CAST(o_orderkey % {DAYS} AS INT) AS date,
                           o_orderkey // {DAYS} AS lg, o_custkey % 10 AS t1
                    FROM orders))))"""

GAMES = f"""
games AS (SELECT * FROM all_games WHERE date < DATE '{PLAYED_BEFORE}' AND season >= {FIRST_SEASON})"""

SIDES = """
sides AS (
  SELECT game_id, season, date, 1 AS side, team1 AS team, score1 > score2 AS win FROM games
  UNION ALL
  SELECT game_id, season, date, 2 AS side, team2 AS team, score2 > score1 AS win FROM games)"""

LIVE = """
live AS (
  SELECT *, CASE WHEN wins + losses > 0 THEN CAST(wins AS DOUBLE) / (wins + losses) ELSE 0e0 END AS win_pct
  FROM (SELECT game_id, side, season, team, date,
               CAST(COALESCE(SUM(CASE WHEN win THEN 1 WHEN NOT win THEN 0 END) OVER w, 0) AS BIGINT) AS wins,
               CAST(COALESCE(SUM(CASE WHEN win THEN 0 WHEN NOT win THEN 1 END) OVER w, 0) AS BIGINT) AS losses
        FROM sides
        WINDOW w AS (PARTITION BY season, team ORDER BY date, game_id, side
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""

SEASONS = """
seasons AS (
  SELECT team, season, current_avg,
         LAG(current_avg, 1, 0.5e0) OVER (PARTITION BY team ORDER BY season) AS prev_avg
  FROM (SELECT team, season,
               CASE WHEN COUNT(win) = COUNT(*) THEN AVG(CASE WHEN win THEN 1e0 WHEN NOT win THEN 0e0 END) END
                 AS current_avg
        FROM sides GROUP BY team, season))"""


def _log5(a: str, b: str) -> str:
    return (
        f"CASE WHEN ({a} = 0 AND {b} = 0) OR ({a} = 1 AND {b} = 1) THEN 0.5e0 "
        f"ELSE {a} * (1 - {b}) / ({a} * (1 - {b}) + {b} * (1 - {a})) END"
    )


RATED = f"""
rated AS (
  SELECT g.*, c1.current_avg AS current_avg1, c2.current_avg AS current_avg2,
         {_log5('l1.win_pct', 'l2.win_pct')} AS p_live,
         {_log5('c1.current_avg', 'c2.current_avg')} AS p_current,
         {_log5('c1.prev_avg', 'c2.prev_avg')} AS p_prev
  FROM games g
  JOIN live l1 ON l1.game_id = g.game_id AND l1.side = 1
  JOIN live l2 ON l2.game_id = g.game_id AND l2.side = 2
  JOIN seasons c1 ON c1.team = g.team1 AND c1.season = g.season
  JOIN seasons c2 ON c2.team = g.team2 AND c2.season = g.season)"""

_GAME = "game_id, season, date, team1, team2, score1, score2"
_G = ", ".join(f"g.{c}" for c in _GAME.split(", "))


def _pick(p1: str, p2: str) -> str:
    one = f"{p1} > {p2}"
    two = f"{p1} <= {p2}"
    return (
        f"CASE WHEN {one} THEN score1 > score2 WHEN {two} THEN score2 > score1 END AS won, "
        f"CASE WHEN {one} THEN {p1} WHEN {two} THEN {p2} END AS prob, "
        f"CASE WHEN {one} THEN team1 WHEN {two} THEN team2 END AS team"
    )


def _picks(table: str, p1: str, p2: str) -> str:
    return f"SELECT {_GAME}, {_pick(p1, p2)} FROM {table}"


_MODEL_PROBS = {
    TEAM_MODELS[0]: ("elo_prob1", "elo_prob2"),
    TEAM_MODELS[1]: ("p_live", "(1 - p_live)"),
    TEAM_MODELS[2]: ("p_current", "(1 - p_current)"),
    TEAM_MODELS[3]: ("p_prev", "(1 - p_prev)"),
}

TEAM_TIDY = "\nteam_tidy AS (" + " UNION ALL ".join(
    f"SELECT {_GAME}, '{model}' AS model, {_pick(*probs)} FROM rated" for model, probs in _MODEL_PROBS.items()
) + ")"

CLUBS = """
clubs AS (SELECT g.* REPLACE ('Club ' || SUBSTR(team1, 2) AS team1, 'Club ' || SUBSTR(team2, 2) AS team2) FROM games g),
names AS (
  SELECT code, 'Club ' || SUBSTR(code, 2) AS name
  FROM (SELECT team1 AS code FROM games UNION SELECT team2 FROM games) WHERE code NOT LIKE '%0T9')"""

_CITIES = "[" + ", ".join(f"'{name}'" for name in [n for _, n in TEAM_NAMES] + ["Seattle", "New Jersey"]) + "]"
CITIES = f"""
clubs AS (
  SELECT g.* REPLACE ({_CITIES}[1 + game_id % 32] AS team1,
                      {_CITIES}[1 + (game_id % 32 + 1 + game_id % 29) % 32] AS team2) FROM games g),
names AS (SELECT * FROM (VALUES {', '.join(f"('{code}', '{name}')" for code, name in TEAM_NAMES)}) v(code, name))"""


def _raw_lines(own: str, other: str) -> str:
    return f"""
raw_lines AS (
  SELECT CASE WHEN game_id % 2 = 0 THEN CAST(date AS VARCHAR)
              ELSE MONTH(date) || '/' || DAY(date) || '/' || YEAR(date) END AS date,
         team1 AS team{own}, team2 AS team{other}, score1 AS score{own}, score2 AS score{other},
         CASE WHEN game_id % 53 = 0 THEN 'PK'
              WHEN p >= 0.5e0 THEN '-' || CAST(FLOOR(100 * p / (1 - p)) AS BIGINT)
              ELSE '+' || CAST(FLOOR(100 * (1 - p) / p) AS BIGINT) END AS moneyline{own},
         CASE WHEN game_id % 59 = 0 THEN NULL
              WHEN p < 0.5e0 THEN '-' || CAST(FLOOR(100 * (1 - p) / p) AS BIGINT)
              ELSE '+' || CAST(FLOOR(100 * p / (1 - p)) AS BIGINT) END AS moneyline{other}
  FROM (SELECT *, 0.03e0 + 0.94e0 * elo_prob1 AS p FROM clubs WHERE score1 IS NOT NULL))"""


def _implied(x: str) -> str:
    return f"CASE WHEN {x} < 100 THEN -{x} / (-{x} + 100) ELSE 100e0 / ({x} + 100) END"


def _payout(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN -10000e0 / {x} ELSE {x} END"


CLEAN = f"""
clean AS (
  SELECT *, {_implied('moneyline1')} AS moneyline_prob1, {_implied('moneyline2')} AS moneyline_prob2
  FROM (SELECT CAST(COALESCE(TRY_STRPTIME(date, '%m/%d/%Y'), TRY_STRPTIME(date, '%Y-%m-%d')) AS DATE) AS date,
               team1, team2, score1, score2,
               TRY_CAST(REPLACE(moneyline1, '+', '') AS DOUBLE) AS moneyline1,
               TRY_CAST(REPLACE(moneyline2, '+', '') AS DOUBLE) AS moneyline2
        FROM raw_lines)
  WHERE COLUMNS(*) IS NOT NULL)"""

NAMED = """
named AS (
  SELECT c.* REPLACE (n1.code AS team1, n2.code AS team2)
  FROM clean c JOIN names n1 ON n1.name = c.team1 JOIN names n2 ON n2.name = c.team2)"""

LINE_PICKS = f"""
line_picks AS (
  SELECT *, {_pick('moneyline_prob1', 'moneyline_prob2')},
         {_payout('moneyline1')} AS payout1, {_payout('moneyline2')} AS payout2
  FROM named)"""


def _joined(swap: bool) -> str:
    own, other = ("2", "1") if swap else ("1", "2")
    since = f" WHERE g.season >= {LINES_SINCE_SEASON}" if swap else ""
    return f"""
joined AS (
  SELECT g.*, l.won, l.prob, l.team, l.payout{own} AS payout1, l.payout{other} AS payout2
  FROM rated g JOIN line_picks l
    ON l.date = g.date AND l.team{own} = g.team1 AND l.team{other} = g.team2
   AND l.score{own} = g.score1 AND l.score{other} = g.score2{since})"""


TIDY = "\ntidy AS (" + " UNION ALL ".join(
    [f"SELECT {_GAME}, '{model}' AS model, {_pick(*probs)}, payout1, payout2 FROM (SELECT * EXCLUDE (won, prob, team) FROM joined)"
     for model, probs in _MODEL_PROBS.items()]
    + [f"SELECT {_GAME}, '{MONEY}' AS model, won, prob, team, payout1, payout2 FROM joined"]
) + ")"

DAILY = """
settled AS (
  SELECT * EXCLUDE (payout1, payout2),
         CASE WHEN won THEN CASE WHEN team = team1 THEN payout1 ELSE payout2 END ELSE -100e0 END AS payout
  FROM tidy),
daily AS (SELECT season, date, model, SUM(payout) AS days_winnings FROM settled GROUP BY season, date, model),
running AS (
  SELECT *, SUM(days_winnings) OVER (PARTITION BY season, model ORDER BY date
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative_winnings
  FROM daily),
annual AS (
  SELECT model, CAST(YEAR(date) AS INT) AS year, SUM(days_winnings) AS years_winnings FROM daily GROUP BY 1, 2)"""

BLOCKS = """
blocks AS (
  SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS k, o_custkey AS c FROM orders WHERE o_orderkey % 41 <> 0)"""

PAGE_ROWS = """SELECT date, 'Club ' || c % 50 AS team1, 'Club ' || (c + 1) % 50 AS team2,
  CAST(90 + k % 30 AS INT) AS score1, CAST(90 + k % 29 AS INT) AS score2,
  CAST(-110 - k % 90 AS DOUBLE) AS moneyline1,
  CASE WHEN k % 37 <> 0 THEN CAST(100 + k % 80 AS DOUBLE) END AS moneyline2
FROM blocks"""

SLATE_CLEAN = f"""
clean AS (
  SELECT *, {_implied('moneyline1')} AS moneyline_prob1, {_implied('moneyline2')} AS moneyline_prob2
  FROM (SELECT date, team1, team2, score1, score2, CAST(-110 - game_id % 90 AS DOUBLE) AS moneyline1,
               CAST(100 + game_id % 80 AS DOUBLE) AS moneyline2
        FROM clubs WHERE score1 IS NOT NULL AND game_id % 41 <> 0 AND game_id % 37 <> 0))"""

# Limits by bisection on the summed binomial tails, in logarithms scaled by the largest term.
BANDS = """
trials AS (SELECT *, CAST(TRUNC(games * prob) AS BIGINT) AS x FROM buckets),
terms AS (
  SELECT prob, games, x, k, LGAMMA(games + 1) - LGAMMA(k + 1) - LGAMMA(games - k + 1) AS w
  FROM trials, UNNEST(RANGE(0, games + 1)) AS r(k)),
search AS (
  SELECT 0 AS step, prob, games, x, 0e0 AS lo1, 1e0 AS hi1, 0e0 AS lo2, 1e0 AS hi2 FROM trials
  UNION ALL
  SELECT step + 1, prob, games, x,
         CASE WHEN above < 0.025 THEN m1 ELSE lo1 END, CASE WHEN above < 0.025 THEN hi1 ELSE m1 END,
         CASE WHEN below > 0.025 THEN m2 ELSE lo2 END, CASE WHEN below > 0.025 THEN hi2 ELSE m2 END
  FROM (SELECT s.step, s.prob, s.games, s.x, lo1, hi1, lo2, hi2,
               ANY_VALUE((lo1 + hi1) / 2) AS m1, ANY_VALUE((lo2 + hi2) / 2) AS m2,
               SUM(CASE WHEN t.k >= s.x THEN EXP(w + t.k * LN((lo1 + hi1) / 2)
                   + (s.games - t.k) * LN(1 - (lo1 + hi1) / 2)) ELSE 0 END) AS above,
               SUM(CASE WHEN t.k <= s.x THEN EXP(w + t.k * LN((lo2 + hi2) / 2)
                   + (s.games - t.k) * LN(1 - (lo2 + hi2) / 2)) ELSE 0 END) AS below
        FROM search s JOIN terms t ON t.prob = s.prob
        WHERE s.step < 40
        GROUP BY s.step, s.prob, s.games, s.x, lo1, hi1, lo2, hi2))"""


def _bucket(prob: str) -> str:
    return f"CAST(ROUND_EVEN(CAST({prob} AS DECIMAL(18,15)), 2) AS DOUBLE)"


def _strict(function: str, value: str) -> str:
    return f"CASE WHEN COUNT({value}) = COUNT(*) THEN {function}({value}) END"


_WON = "CAST(won AS INT)"
_ACCURACY = f"{_strict('AVG', _WON)} AS accuracy"
_CALIBRATION = (
    f"COUNT(*) AS games, CAST({_strict('SUM', _WON)} AS BIGINT) AS wins, "
    f"CAST({_strict('SUM', _WON)} AS DOUBLE) / COUNT(*) AS observed"
)
_CALIBRATION_SKIP = (
    f"COUNT(*) AS games, CAST(SUM({_WON}) AS BIGINT) AS wins, CAST(SUM({_WON}) AS DOUBLE) / COUNT(*) AS observed"
)
_ELO = _picks("games", "elo_prob1", "elo_prob2")
_TOP = "(" + ", ".join(f"'{m}'" for m in TOP_MODELS) + ")"


def _with(parts: list[str], select: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(parts) + "\n" + select


def oracle_sql() -> dict[str, str]:
    base = [ALL_GAMES, GAMES]
    rated = [*base, SIDES, LIVE, SEASONS, RATED]
    team = [*rated, TEAM_TIDY]
    lines = [*base, CLUBS, _raw_lines("1", "2"), CLEAN]
    named = [*lines, NAMED]
    line_parts = [CLUBS, _raw_lines("1", "2"), CLEAN, NAMED, LINE_PICKS]
    swapped_parts = [CLUBS, _raw_lines("2", "1"), CLEAN, NAMED, LINE_PICKS]
    joined = [*rated, *line_parts, _joined(False)]
    joined_swapped = [*rated, *swapped_parts, _joined(True)]
    tidy = [*joined, TIDY]
    money = [*tidy, DAILY]
    elo_buckets = f"\nbuckets AS (SELECT {_bucket('prob')} AS prob, {_CALIBRATION_SKIP} FROM ({_ELO}) GROUP BY 1)"
    tidy_rows = f"SELECT {_GAME}, model, won, prob, team FROM tidy"
    line_games = f"SELECT {_GAME}, won, prob, team, payout1, payout2 FROM joined"
    live = "SELECT game_id, side, season, team, date, wins, losses, win_pct FROM live"
    clean = "SELECT * FROM clean"

    def calibration(table: str, where: str = "") -> str:
        return f"SELECT {_bucket('prob')} AS prob, model, {_CALIBRATION} FROM {table} {where} GROUP BY 1, 2"

    return {
        "games_scan": _with(base, "SELECT * FROM games"),
        "games_csv": _with(base, "SELECT * FROM games"),
        "games_csv_unnumbered": _with(base, "SELECT * EXCLUDE (game_id) FROM games"),
        "slate_lines_csv": _with([*base, CLUBS, SLATE_CLEAN], clean),
        "games_with_slate_lines": _with(
            [*base, CLUBS, SLATE_CLEAN, NAMED, LINE_PICKS, _joined(False).replace("FROM rated g", "FROM games g")], line_games
        ),
        "sides": _with([*base, SIDES], "SELECT * FROM sides"),
        "favorite_elo": _with(base, _ELO),
        "accuracy_overall_elo": _with(base, f"SELECT AVG({_WON}) AS accuracy FROM ({_ELO})"),
        "accuracy_by_season_elo": _with(base, f"SELECT season, {_ACCURACY} FROM ({_ELO}) GROUP BY season"),
        "accuracy_by_season_uncut": _with(
            [ALL_GAMES],
            f"SELECT season, {_ACCURACY} FROM ({_picks('all_games', 'elo_prob1', 'elo_prob2')}) GROUP BY season",
        ),
        "calibration_elo": _with([*base, elo_buckets], "SELECT * FROM buckets"),
        "calibration_bands": _with(
            [*base, elo_buckets, BANDS],
            "SELECT b.*, ROUND(CASE WHEN x = 0 THEN 0 ELSE (lo1 + hi1) / 2 END, 6) AS conf_low, "
            "ROUND(CASE WHEN x = s.games THEN 1 ELSE (lo2 + hi2) / 2 END, 6) AS conf_high "
            "FROM buckets b JOIN search s ON s.prob = b.prob WHERE s.step = 40",
            recursive=True,
        ),
        "live_record": _with([*base, SIDES, LIVE], live),
        "live_record_split": _with(
            [*base, SIDES, LIVE, SEASONS],
            "SELECT game_id, side, season, team, date, wins, losses, win_pct, current_avg, prev_avg "
            "FROM live JOIN seasons USING (season, team)",
        ),
        "team_season_pct": _with([*base, SIDES, SEASONS], "SELECT * FROM seasons"),
        "log5": _with(
            rated,
            "SELECT game_id, current_avg1, current_avg2, p_current AS win_prob1, 1 - p_current AS win_prob2 FROM rated",
        ),
        "wplive": _with(rated, _picks("rated", "p_live", "(1 - p_live)")),
        "wpcurrent": _with(rated, _picks("rated", "p_current", "(1 - p_current)")),
        "wpprev": _with(rated, _picks("rated", "p_prev", "(1 - p_prev)")),
        "team_models": _with(team, "SELECT * FROM team_tidy"),
        "accuracy_by_model_team": _with(team, f"SELECT model, {_ACCURACY} FROM team_tidy GROUP BY model"),
        "accuracy_by_season_model_team": _with(
            team, f"SELECT season, model, {_ACCURACY} FROM team_tidy GROUP BY season, model"
        ),
        "calibration_by_model_team": _with(team, calibration("team_tidy")),
        "lines_clean": _with(lines, clean),
        "lines_csv": _with(lines, clean),
        "implied_prob": _with(
            lines,
            "SELECT date, team1, team2, score1, score2, moneyline1, moneyline_prob1, moneyline2, moneyline_prob2 FROM clean",
        ),
        "lines_named": _with(named, "SELECT * FROM named"),
        "lines_named_cities": _with([*base, CITIES, _raw_lines("1", "2"), CLEAN, NAMED], "SELECT * FROM named"),
        "payouts": _with(
            named,
            f"SELECT date, score1, score2, team1, team2, team1 AS team, {_payout('moneyline1')} AS payout FROM named "
            f"UNION ALL SELECT date, score1, score2, team1, team2, team2, {_payout('moneyline2')} FROM named",
        ),
        "games_with_lines": _with(joined, line_games),
        "games_with_lines_swapped": _with(joined_swapped, line_games),
        "tidy": _with(tidy, tidy_rows),
        "tidy_swapped": _with([*joined_swapped, TIDY], f"SELECT {_GAME}, model, won, prob FROM tidy"),
        "tidy_roundtrip": _with(tidy, tidy_rows),
        "tidy_csv": _with(tidy, tidy_rows),
        "accuracy_by_model": _with(tidy, f"SELECT model, {_ACCURACY} FROM tidy GROUP BY model"),
        "accuracy_by_season_model": _with(tidy, f"SELECT season, model, {_ACCURACY} FROM tidy GROUP BY season, model"),
        "accuracy_against_overall": _with(
            tidy,
            f"SELECT s.model, season, s.accuracy, o.accuracy AS overall "
            f"FROM (SELECT season, model, {_ACCURACY} FROM tidy GROUP BY season, model) s "
            f"JOIN (SELECT model, {_ACCURACY} FROM tidy GROUP BY model) o ON o.model = s.model",
        ),
        "calibration_by_model": _with(tidy, calibration("tidy")),
        "calibration_top": _with(tidy, calibration("tidy", f"WHERE model IN {_TOP}")),
        "settled_bets": _with(money, f"SELECT {_GAME}, model, won, prob, team, payout FROM settled"),
        "daily_winnings": _with(
            money, "SELECT season, date, model, ROUND(days_winnings, 4) AS days_winnings FROM daily"
        ),
        "cumulative_winnings": _with(money, _RUNNING),
        "winnings_series": _with(money, f"{_RUNNING} WHERE model IN {_TOP}"),
        "annual_winnings": _with(money, "SELECT model, year, ROUND(years_winnings, 4) AS years_winnings FROM annual"),
        "total_winnings": _with(
            money, "SELECT model, ROUND(SUM(years_winnings), 4) AS total_winnings FROM annual GROUP BY model"
        ),
        "slate_urls": _with(base, _URLS),
        "slate_rows": _with([BLOCKS], PAGE_ROWS),
        "slate_rows_wanted": _with(
            [*base, BLOCKS],
            f"{PAGE_ROWS} WHERE date IN (SELECT date FROM games WHERE date >= DATE '{PAGES_SINCE}')",
        ),
    }


_RUNNING = (
    "SELECT season, date, model, ROUND(days_winnings, 4) AS days_winnings, "
    "ROUND(cumulative_winnings, 4) AS cumulative_winnings FROM running"
)
_URLS = (
    f"SELECT DISTINCT date, '{PAGE_BASE}' || REPLACE(CAST(date AS VARCHAR), '-', '') AS url "
    f"FROM games WHERE date >= DATE '{PAGES_SINCE}'"
)
