import datetime
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
for folder in (ROOT, ROOT / "tests"):
    sys.path.insert(0, str(folder))

from calibrant import schemas  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_games(spark):
    """Games from tuples (game_id, date, season, team1, team2, score1, score2[, prob1, prob2])."""

    def make(rows):
        full = [(*r, 0.6, 0.4) if len(r) == 7 else r for r in rows]
        full = [(r[0], datetime.date.fromisoformat(r[1]), *r[2:]) for r in full]
        return spark.createDataFrame(full, schemas.GAMES)

    return make
