"""Input tables of the engine, derived from an `orders` table.

Every order is one game. Each run of order keys as long as the calendar is a league of ten
teams that plays one game a day, so a team plays at most once a day, and leagues, teams and
games all grow with the data. See FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from calibrant.sources.names import TEAM_NAMES

FIRST_DAY = "1995-01-01"
DAYS = 2404
PLAYED_BEFORE = "2001-07-01"
FIRST_SEASON = 1995
PAGE_BASE = "https://odds.example.com/?date="
# Order keys are unique, so a stored page part holds at most this many blocks.
PAGE_BLOCKS = 4096


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def games(orders: DataFrame) -> DataFrame:
    """Games from 2001-07-01 on are not played yet; every fifteenth game ends level."""
    k, customer = F.col("o_orderkey"), F.col("o_custkey")
    season = F.year("date") + (F.month("date") >= 10).cast("int")
    first = customer % 10
    second = (first + 1 + k % 9) % 10
    strength = 50 + (k * 31) % 901
    margin = k % 15
    ahead = (k * 7919) % 1001 < strength
    played = F.col("date") < F.lit(PLAYED_BEFORE).cast("date")

    def team(number: Column) -> Column:
        return F.concat(F.lit("L"), F.floor(k / DAYS).cast("string"), F.lit("T"), number.cast("string"))

    def score(extra: Column) -> Column:
        return F.when(played, (90 + k % 30 + extra).cast("int"))

    return orders.withColumn("date", F.date_add(F.lit(FIRST_DAY).cast("date"), (k % DAYS).cast("int"))).select(
        k.alias("game_id"),
        "date",
        season.cast("int").alias("season"),
        team(first).alias("team1"),
        team(second).alias("team2"),
        score(F.when(ahead, margin).otherwise(0)).alias("score1"),
        score(F.when(ahead, 0).otherwise(margin)).alias("score2"),
        (strength / F.lit(1001.0)).alias("elo_prob1"),
        (1 - strength / F.lit(1001.0)).alias("elo_prob2"),
    )


def _club(code: Column) -> Column:
    return F.concat(F.lit("Club "), F.substr(code, F.lit(2)))


def team_names(games: DataFrame) -> DataFrame:
    """Names of all teams but one of every tenth league, whose lines must fall out."""
    return (
        games.select(F.explode(F.array("team1", "team2")).alias("code"))
        .distinct()
        .where(~F.col("code").like("%0T9"))
        .select("code", _club(F.col("code")).alias("name"))
    )


def club_games(games: DataFrame) -> DataFrame:
    """Games under the names that lines use."""
    return games.withColumns({c: _club(F.col(c)) for c in ("team1", "team2")})


def city_games(games: DataFrame) -> DataFrame:
    """Games between the clubs of the fixed crosswalk and two that it leaves out."""
    cities = F.array(*(F.lit(name) for _, name in TEAM_NAMES), F.lit("Seattle"), F.lit("New Jersey"))
    first = F.col("game_id") % 32
    second = (first + 1 + F.col("game_id") % 29) % 32
    return games.withColumns({"team1": F.get(cities, first), "team2": F.get(cities, second)})


def raw_lines(named_games: DataFrame, swap_sides: bool = False) -> DataFrame:
    """Lines of all played games, with mixed date formats, plus signs, a word and nulls."""
    k, day = F.col("game_id"), F.col("date")
    slashed = F.concat_ws("/", F.month(day), F.dayofmonth(day), F.year(day))
    p = F.lit(0.03) + F.lit(0.94) * F.col("elo_prob1")
    on = F.floor(100 * p / (1 - p)).cast("string")
    against = F.floor(100 * (1 - p) / p).cast("string")
    line1 = F.when(p >= 0.5, F.concat(F.lit("-"), on)).otherwise(F.concat(F.lit("+"), against))
    line2 = F.when(p < 0.5, F.concat(F.lit("-"), against)).otherwise(F.concat(F.lit("+"), on))
    own, other = ("2", "1") if swap_sides else ("1", "2")
    line = F.struct(
        F.when(k % 2 == 0, day.cast("string")).otherwise(slashed).alias("date"),
        F.col("team1").alias(f"team{own}"),
        F.col("team2").alias(f"team{other}"),
        F.col("score1").alias(f"score{own}"),
        F.col("score2").alias(f"score{other}"),
        F.when(k % 53 == 0, F.lit("PK")).otherwise(line1).alias(f"moneyline{own}"),
        F.when(k % 59 != 0, line2).alias(f"moneyline{other}"),
    )
    # A generated row, like a stored one, is computed once, not again in each later filter.
    return named_games.where(F.col("score1").isNotNull()).select(F.inline(F.array(line)))


def _block(k: Column, day: Column, teams: tuple[Column, Column], scores: tuple[Column, Column]) -> Column:
    def club(name: Column) -> Column:
        return F.concat(F.lit('<span class="team-name">'), name, F.lit("</span>"))

    def score(number: Column) -> Column:
        return F.concat(F.lit('<span class="current-score">'), number.cast("string"), F.lit("</span>"))

    def value(line: Column) -> Column:
        return F.concat(F.lit('<div class="eventLine-book-value">'), line, F.lit("</div>"))

    return F.concat(
        F.lit('<div class="holder-complete"><div class="'),
        F.when(k % 41 == 0, F.lit("status-pending")).otherwise(F.lit("status-complete")),
        F.lit('" rel="'),
        day.cast("string"),
        F.lit('"></div>'),
        club(teams[0]),
        score(scores[0]),
        club(teams[1]),
        score(scores[1]),
        F.lit('<div class="eventLine-book">'),
        value(F.concat(F.lit("-"), (110 + k % 90).cast("string"))),
        F.when(k % 37 == 0, F.lit("")).otherwise(value(F.concat(F.lit("+"), (100 + k % 80).cast("string")))),
        F.lit('</div><div class="eventLine-book">'),
        value(F.lit("-999")),
        F.lit("</div></div>"),
    )


def _pages(blocks: DataFrame) -> DataFrame:
    """One page per date and `PAGE_BLOCKS` keys, from rows of date, k and block."""
    return (
        blocks.select("date", F.floor(F.col("k") / PAGE_BLOCKS).alias("part"), F.struct("k", "block").alias("entry"))
        .groupBy("date", "part")
        .agg(F.array_sort(F.collect_list("entry")).alias("entries"))
        .select(
            "date",
            "part",
            F.concat(F.lit(PAGE_BASE), F.date_format("date", "yyyyMMdd")).alias("url"),
            F.array_join(F.col("entries.block"), "").alias("html"),
        )
    )


def stored_pages(orders: DataFrame) -> DataFrame:
    """Odds pages, one per day and `PAGE_BLOCKS` order keys; some blocks are still pending.

    Blocks are written out ahead of the shuffle, so that its partitions are sized by page text.
    """
    k, customer, day = F.col("o_orderkey"), F.col("o_custkey"), F.to_date("o_orderdate")
    teams = tuple(F.concat(F.lit("Club "), ((customer + i) % 50).cast("string")) for i in (0, 1))
    block = _block(k, day, teams, (90 + k % 30, 90 + k % 29))
    return _pages(orders.select(day.alias("date"), k.alias("k"), block.alias("block")))


def game_pages(named_games: DataFrame) -> DataFrame:
    """The odds pages of all played games, under the names and scores the games have."""
    k = F.col("game_id")
    block = _block(k, F.col("date"), (F.col("team1"), F.col("team2")), (F.col("score1"), F.col("score2")))
    played = named_games.where(F.col("score1").isNotNull())
    return _pages(played.select("date", k.alias("k"), block.alias("block")))
