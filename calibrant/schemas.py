"""Column contracts of the tables that enter and leave the library."""

from pyspark.sql import types as T

GAMES = T.StructType(
    [
        T.StructField("game_id", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("season", T.IntegerType()),
        T.StructField("team1", T.StringType()),
        T.StructField("team2", T.StringType()),
        T.StructField("score1", T.IntegerType()),
        T.StructField("score2", T.IntegerType()),
        T.StructField("elo_prob1", T.DoubleType()),
        T.StructField("elo_prob2", T.DoubleType()),
    ]
)

# Lines as stored: dates and moneylines are still text and may be dirty.
LINES_RAW = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("team1", T.StringType()),
        T.StructField("team2", T.StringType()),
        T.StructField("score1", T.IntegerType()),
        T.StructField("score2", T.IntegerType()),
        T.StructField("moneyline1", T.StringType()),
        T.StructField("moneyline2", T.StringType()),
    ]
)

# Team names: `code` is what games use, `name` is what lines use.
NAMES = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("name", T.StringType()),
    ]
)

# One row per game and model.
TIDY = T.StructType(
    [
        T.StructField("game_id", T.LongType()),
        T.StructField("season", T.IntegerType()),
        T.StructField("date", T.DateType()),
        T.StructField("team1", T.StringType()),
        T.StructField("team2", T.StringType()),
        T.StructField("score1", T.IntegerType()),
        T.StructField("score2", T.IntegerType()),
        T.StructField("model", T.StringType()),
        T.StructField("won", T.BooleanType()),
        T.StructField("prob", T.DoubleType()),
        T.StructField("team", T.StringType()),
    ]
)

# Stored odds pages. A date's page may be stored in several parts under one url.
PAGES = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("part", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

# Rows read from pages: lines whose text is parsed already.
PAGE_ROWS = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("team1", T.StringType()),
        T.StructField("team2", T.StringType()),
        T.StructField("score1", T.IntegerType()),
        T.StructField("score2", T.IntegerType()),
        T.StructField("moneyline1", T.DoubleType()),
        T.StructField("moneyline2", T.DoubleType()),
    ]
)

GAME_KEYS = ["date", "team1", "team2", "score1", "score2"]
