import datetime
import os

import pytest
from pyspark.sql import functions as F, types as T

from calibrant.operators import records as R
from calibrant.sources import order_views as V, tables as S

CSV = """date,season,neutral,team1,team2,elo_prob1,elo_prob2,raptor_prob1,score1,score2
2001-01-01,2001,0,A,B,0.7,0.3,,100,90
2001-01-02,2001,0,"B",A,0.4,0.6,NA,NA,
1990-01-02,1990,0,B,A,0.4,0.6,0.1,90,80
2003-01-02,2003,0,B,A,0.4,0.6,0.1,90,80
2001-01-03,2001,0, C ,A,x,0.6,0.1,90,80.0
"""


@pytest.fixture
def games_csv(tmp_path):
    path = tmp_path / "games.csv"
    path.write_text(CSV)
    return str(path)


def test_games_csv_is_read_by_name(spark, games_csv):
    games = S.read_games_csv(spark, games_csv, before="2002-01-01", first_season=1995)
    assert games.columns == [
        "game_id", "date", "season", "team1", "team2", "score1", "score2", "elo_prob1", "elo_prob2",
    ]
    rows = [tuple(r)[1:] for r in games.orderBy("date").collect()]
    assert rows == [
        (datetime.date(2001, 1, 1), 2001, "A", "B", 100, 90, 0.7, 0.3),
        (datetime.date(2001, 1, 2), 2001, "B", "A", None, None, 0.4, 0.6),
        (datetime.date(2001, 1, 3), 2001, "C", "A", 90, None, None, 0.6),
    ]


def test_games_without_ids_are_numbered_in_file_order(spark, games_csv):
    games = S.read_games_csv(spark, games_csv, before="2002-01-01", first_season=1995)
    ordered = [r["date"].day for r in games.orderBy("game_id").collect()]
    assert ordered == [1, 2, 3]
    assert R.running_record(games.dropna(subset=["score1", "score2"])).count() == 2


def test_numbers_follow_file_names_and_rows(spark, tmp_path):
    """Spark reads the largest file first and cuts it; the numbers do not show that."""
    head = "date,season,team1,team2,score1,score2,elo_prob1,elo_prob2\n"
    names = ["a", "b", "c"]
    for name, count in zip(names, (3, 400, 40)):
        rows = "".join(f"2001-01-01,2001,{name}{i},x,{i},1,0.5,0.5\n" for i in range(count))
        (tmp_path / f"{name}.csv").write_text(head + rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        games = S.read_games_csv(spark, str(tmp_path), before="2002-01-01", first_season=1995)
        got = [(r["team1"][0], r["score1"]) for r in games.orderBy("game_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(n, i) for n, count in zip(names, (3, 400, 40)) for i in range(count)]


def test_a_folder_with_two_headers_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,team1,team2\n2001-01-01,A,B\n")
    (tmp_path / "b.csv").write_text("date,team2,team1\n2001-01-02,A,B\n")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("date", "team1", "team2")])
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        S.read_csv(spark, str(tmp_path), schema).collect()


def test_lines_csv_without_its_row_numbers(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text(
        '"","date","team1","team2","score1","score2","moneyline1","moneyline2"\n'
        '"1",2010-03-06,"Miami","Utah",100,90,-300,200\n"2",2010-03-06,"Miami","Utah",100,90,NA,200\n'
    )
    rows = [tuple(r) for r in S.read_lines_csv(spark, str(path)).collect()]
    assert rows == [
        ("2010-03-06", "Miami", "Utah", 100, 90, "-300", "200"),
        ("2010-03-06", "Miami", "Utah", 100, 90, None, "200"),
    ]


def test_cut_off_reaches_the_scan_of_a_stored_table(spark, tmp_path, capsys):
    path = str(tmp_path / "games")
    V.games(V.orders(spark, "/root/testdata/sf0.001")).write.parquet(path)
    games = S.played_games(spark.read.parquet(path), V.PLAYED_BEFORE, V.FIRST_SEASON)
    games.groupBy("season").agg(F.count("team1")).explain()
    plan = capsys.readouterr().out
    assert "LessThan(date,2001-07-01)" in plan and "GreaterThanOrEqual(season,1995)" in plan
    assert "ReadSchema: struct<date:date,season:int,team1:string>" in plan


def test_tidy_is_stored_by_season(spark, tmp_path, capsys):
    rows = [(1, 2001, datetime.date(2001, 1, 1), "A", "B", 1, 2, "m", True, 0.5, "A"),
            (2, 2002, datetime.date(2002, 1, 1), "A", "B", 1, 2, "m", None, None, None)]
    from calibrant.schemas import TIDY

    path = str(tmp_path / "tidy")
    S.write_tidy(spark.createDataFrame(rows, TIDY), path)
    assert {d for d in os.listdir(path) if "=" in d} == {"season=2001", "season=2002"}
    back = S.read_tidy(spark, path)
    assert back.columns == TIDY.names
    assert sorted(map(tuple, back.collect())) == rows
    back.where("season = 2001").explain()
    assert "PartitionFilters: [isnotnull(season" in capsys.readouterr().out


class Session:
    def __init__(self, **settings):
        self.conf = {k.replace("_", "."): v for k, v in settings.items()}


def test_shared_folder_follows_the_session():
    one, two = (S.shared_folder(Session(spark_master="local[2]"), "x") for _ in "ab")
    assert one != two
    configured = Session(spark_master="spark://host:7077", spark_checkpoint_dir="hdfs://store/shared/")
    assert S.shared_folder(configured, "x").startswith("hdfs://store/shared/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.shared_folder(Session(spark_master="spark://host:7077"), "x")


def test_a_team_plays_at_most_once_a_day(spark):
    games = V.games(V.orders(spark, "/root/testdata/sf0.01"))
    assert games.count() == V.orders(spark, "/root/testdata/sf0.01").count()
    assert R.sides(games).groupBy("team", "date").count().where("count > 1").isEmpty()
