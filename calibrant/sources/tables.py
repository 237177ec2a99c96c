"""Typed tables in and out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from calibrant.functions.text import missing_to_null
from calibrant.schemas import GAMES, LINES_RAW, TIDY


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder the cluster shares; a local one only for local sessions."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Names in the header of the first file; a column without a name has the empty one."""
    first = spark.read.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path).first()
    return [name or "" for name in first] if first else []


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns of CSV files as text. Each file's header is compared with the first one's."""
    fields = [T.StructField(name, T.StringType()) for name in csv_header(spark, path)]
    return (
        spark.read.schema(T.StructType(fields))
        .option("header", True)
        .option("enforceSchema", False)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, columns picked by name and cast to the schema.

    Column order and further columns do not matter, but all files of a folder must have the same
    header; reading one with another fails. Fields that do not fit their type become null.
    """
    return csv_text(spark, path).select(*_typed(schema))


def _typed(fields) -> list[Column]:
    return [missing_to_null(F.col(f"`{f.name}`")).try_cast(f.dataType).alias(f.name) for f in fields]


def played_games(games: DataFrame, before: str, first_season: int) -> DataFrame:
    """Games ahead of the cut-off day (postponed ones lie after it) from the first season on."""
    return games.where((F.col("date") < F.lit(before).cast("date")) & (F.col("season") >= first_season))


def read_games_csv(spark: SparkSession, path: str, before: str, first_season: int) -> DataFrame:
    """Games from CSV files; rows without a `game_id` column are numbered.

    Numbers follow the names of the files and the order of the rows in them. The rows are stored
    first: numbers given anew in each use of the table could differ, because a file may be
    split differently when executors come or go.
    """
    if "game_id" in csv_header(spark, path):
        return played_games(read_csv(spark, path, GAMES), before, first_season)
    text = csv_text(spark, path)
    fields = [f for f in GAMES if f.name != "game_id"]
    games = text.select(
        *_typed(fields),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    stored = shared_folder(spark, "games")
    games.write.parquet(stored)
    return played_games(_numbered(spark.read.schema(games.schema).parquet(stored)), before, first_season)


def _numbered(rows: DataFrame) -> DataFrame:
    """`game_id` from file, start of the block in it and row within the block.

    A row takes a byte at least, so the start of its block plus its place in the block is below
    the start of the next block. 2^40 bytes of each file are told apart, and 2^23 files.
    """
    blocks = rows.groupBy("file", "block").agg(F.min("row").alias("first"))
    files = rows.select("file").distinct().withColumn("n", F.row_number().over(Window.orderBy("file")) - 1)
    starts = blocks.join(files, "file")
    number = F.shiftleft(F.col("n").cast("long"), 40) + F.col("block") + F.col("row") - F.col("first")
    return rows.join(starts, ["file", "block"]).withColumn("game_id", number).select(*GAMES.names)


def read_lines_csv(spark: SparkSession, path: str) -> DataFrame:
    """Lines from a CSV file; a leading row-number column is left out."""
    return read_csv(spark, path, LINES_RAW)


def write_csv(table: DataFrame, path: str) -> None:
    """CSV part files with a header. Missing values are written as empty fields."""
    table.write.option("header", True).csv(path)


def write_tidy(tidy: DataFrame, path: str) -> None:
    """Parquet, one folder per season.

    The rebalance hint lets adaptive execution size the files: it merges small seasons'
    pieces and splits a season that holds an outsized share of the rows.
    """
    tidy.hint("rebalance", "season").write.partitionBy("season").parquet(path)


def read_tidy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TIDY).parquet(path).select(*TIDY.names)


def read_tidy_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, TIDY)
