"""Team records: two rows per game, running and whole-season win shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from calibrant.functions.nulls import strict_mean

# A team-season with more rows than this is cut into pieces, by day and by ranges of game ids
# that agree but for PIECE_BITS low bits. At most HOT_SEASONS are cut, the largest ones, so one that
# is not has no more than PIECE_ROWS rows or its share, one in HOT_SEASONS, of the table.
PIECE_ROWS = 100_000
PIECE_BITS = 12
HOT_SEASONS = 1024
# Stands for a missing id in the order of games: ahead of all others.
_FIRST_ID = -(1 << 62)


def sides(games: DataFrame) -> DataFrame:
    """Two rows per game, one per side. A tied score is won by neither side."""

    def side(number: int, own: str, other: str) -> Column:
        return F.struct(
            F.lit(number).alias("side"),
            F.col(f"team{number}").alias("team"),
            (F.col(own) > F.col(other)).alias("win"),
        )

    both = F.array(side(1, "score1", "score2"), side(2, "score2", "score1"))
    return games.select(*games.columns, F.inline(both))


def _with_previous(seasons: DataFrame) -> DataFrame:
    """`prev_avg`: the share of the team's row before, whatever year that is; 0.5 if none."""
    return seasons.withColumn(
        "prev_avg", F.lag("current_avg", 1, 0.5).over(Window.partitionBy("team").orderBy("season"))
    )


def team_season_pct(games: DataFrame) -> DataFrame:
    """Win share per team and season, and that of the team's season before (0.5 if none).

    The season before is the team's previous row: a team that sat out a year keeps its last one.
    """
    seasons = (
        sides(games.select("season", "team1", "team2", "score1", "score2"))
        .groupBy("team", "season")
        .agg(strict_mean(F.col("win").cast("double")).alias("current_avg"))
    )
    return _with_previous(seasons)


def _hot_seasons(games: DataFrame) -> Column:
    """Array of the team-seasons to cut, a scalar subquery: part of the plan, not a job ahead of it."""
    teams = F.explode(F.array(*(F.struct("season", F.col(f"team{n}").alias("team")) for n in (1, 2))))
    sizes = games.select(teams.alias("team_season")).groupBy("team_season").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.where(F.col("n") > PIECE_ROWS).orderBy(F.desc("n"), "team_season").limit(HOT_SEASONS)
    return largest.agg(F.collect_list("team_season")).scalar()


def _sums(window, suffix: str = "") -> list[Column]:
    return [F.coalesce(F.sum(c).over(window), F.lit(0)).alias(c + suffix) for c in ("win", "loss")]


def _ahead(*keys: str):
    return Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)


def _carried(rows: DataFrame, with_seasons: bool) -> DataFrame:
    """Per piece: what its team has won and lost ahead of it in the season, and the season shares."""
    pieces = rows.groupBy("piece").agg(F.sum("win").alias("win"), F.sum("loss").alias("loss"))
    pieces = pieces.withColumns(
        {"day": F.struct("piece.season", "piece.team", "piece.date"), "ids": F.col("piece.ids")}
    )
    pieces = pieces.select("piece", "day", *_sums(_ahead("day", "ids"), "_piece"))
    totals = [F.sum(c).alias(c) for c in ("win", "loss")]
    days = rows.groupBy("day").agg(*totals).withColumns(
        {"team_season": F.struct("day.season", "day.team"), "date": F.col("day.date")}
    )
    days = days.select("day", "team_season", *_sums(_ahead("team_season", "date"), "_day"))
    if with_seasons:
        share = strict_mean(F.col("win").cast("double")).alias("current_avg")
        seasons = rows.groupBy(F.col("team_season")).agg(share).select("team_season", "team_season.*", "current_avg")
        days = days.join(_with_previous(seasons).drop("season", "team"), "team_season")
    return pieces.join(days.drop("team_season"), "day").drop("day")


def running_record(games: DataFrame, with_seasons: bool = False) -> DataFrame:
    """Side rows with `wins`, `losses` and `win_pct` of the team's earlier games that season.

    Earlier means an earlier day, or the same day and a smaller game id; a missing day or id
    comes first. With no earlier game the share is 0. Rows with the same id, such as a game
    listed twice, do not count for each other. Missing seasons and teams are a season and a team
    like others. No row is dropped or added.

    Rows are shuffled once, by piece, and each piece is summed in order by itself. A team's season
    is one piece, unless it has an outsized number of rows: then each of its days, and each
    range of ids in a day, is a piece, and only the pieces' totals are summed in order, over the
    pieces of a day and then over the days of the season. So no task needs all games of such a team.
    `with_seasons` adds the team's share of the whole season and of the season before.
    """
    hot = F.array_contains(_hot_seasons(games), F.col("team_season"))
    order_id = F.coalesce("game_id", F.lit(_FIRST_ID))
    date, ids = (F.when(F.col("hot"), c) for c in (F.col("date"), F.shiftright(order_id, PIECE_BITS)))
    rows = (
        sides(games)
        .withColumn("loss", (~F.col("win")).cast("int"))
        .withColumn("win", F.col("win").cast("int"))
        # Keys in a struct also join where one of them is missing.
        .withColumn("team_season", F.struct("season", "team"))
        .withColumn("hot", hot)
        .withColumn("piece", F.struct("season", "team", date.alias("date"), ids.alias("ids")))
        .withColumn("day", F.struct("season", "team", date.alias("date")))
        .withColumn("order_id", F.struct("date", order_id.alias("id")))
    )
    kept = [c for c in rows.columns if c not in ("win", "loss", "team_season", "hot", "piece", "day", "order_id")]
    in_order = Window.partitionBy("piece").orderBy("order_id")
    so_far = _sums(in_order.rangeBetween(Window.unboundedPreceding, Window.currentRow), "_so_far")
    same = _sums(in_order.rangeBetween(Window.currentRow, Window.currentRow), "_same")
    counted = rows.select(*kept, "piece", *so_far, *same)

    # One piece per season has nothing ahead of it; without season shares only cut ones matter.
    carried = _carried(rows if with_seasons else rows.where("hot"), with_seasons)

    def earlier(c: str) -> Column:
        ahead = F.coalesce(F.col(f"{c}_piece") + F.col(f"{c}_day"), F.lit(0))
        return F.col(f"{c}_so_far") - F.col(f"{c}_same") + ahead

    seasons = ["current_avg", "prev_avg"] if with_seasons else []
    return (
        counted.join(carried, "piece", "left")
        .select(*kept, earlier("win").alias("wins"), earlier("loss").alias("losses"), *seasons)
        .withColumn(
            "win_pct", F.coalesce(F.try_divide(F.col("wins").cast("double"), F.col("wins") + F.col("losses")), F.lit(0.0))
        )
    )
