import os
import subprocess
import sys
from fractions import Fraction
from math import comb
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibrant.functions.binomial import exact_band, exact_limits


def limits(x, n):
    low, high = exact_limits(np.array([x]), np.array([n]))
    return low[0], high[0]


def at_least(x, n, p):
    p = Fraction(p)
    return float(sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x, n + 1)))


@pytest.mark.parametrize(
    "x, n, low, high", [(7, 10, 0.34754715, 0.93326049), (0, 10, 0.0, 0.30849711), (10, 10, 0.69150289, 1.0)]
)
def test_known_limits(x, n, low, high):
    assert limits(x, n) == pytest.approx((low, high), abs=1e-8)


@pytest.mark.parametrize("n", [1, 2, 7, 40, 150])
def test_limits_solve_the_tail_equations(n):
    for x in {0, 1, n // 3, n // 2, n - 1, n}:
        low, high = limits(x, n)
        assert low <= x / n <= high
        if x > 0:
            assert at_least(x, n, low) == pytest.approx(0.025, abs=1e-9)
        if x < n:
            assert 1 - at_least(x + 1, n, high) == pytest.approx(0.025, abs=1e-9)


def test_many_trials_approach_the_normal_limits():
    n = 10**12
    low, high = limits(n // 2, n)
    assert (0.5 - low) == pytest.approx(1.959964 * 0.5 / n**0.5, rel=1e-3)
    assert (high - 0.5) == pytest.approx(1.959964 * 0.5 / n**0.5, rel=1e-3)


def test_band_column(spark):
    table = spark.createDataFrame([(7, 10), (0, 10)], "x long, n long").select(exact_band(F.col("x"), F.col("n")).alias("b"))
    assert [tuple(r) for r in table.select("b.*").collect()] == [
        pytest.approx((0.34754715, 0.93326049), abs=1e-8),
        pytest.approx((0.0, 0.30849711), abs=1e-8),
    ]


def test_impossible_buckets_have_no_limits(spark):
    rows = [(-1, 10), (11, 10), (None, 10), (0, 0)]
    table = spark.createDataFrame(rows, "x long, n long").select(exact_band(F.col("x"), F.col("n")).alias("b"))
    assert [tuple(r) for r in table.select("b.*").collect()] == [(None, None), (None, None), (None, None), (0.0, 1.0)]


WORKER = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as contract
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", contract.queries()["calibration_bands"](spark, "/root/testdata/sf0.001").count())
"""


def test_band_runs_in_a_session_started_elsewhere(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", WORKER.format(root=root)], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=300
    )
    assert "ROWS 46" in done.stdout, done.stderr[-2000:]
