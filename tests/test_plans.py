"""The physical plans keep the properties that large inputs need."""

import re

import pytest

from calibrant.operators import records as R
from calibrant.plans import catalog as C

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plan_of(spark, capsys):
    def plan(build, broadcast=False):
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before if broadcast else "-1")
        try:
            build().explain()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        return re.sub(r"#\d+L?", "", capsys.readouterr().out)

    return plan


# Those that write a table first read it back with a plan of no interest.
STORING = {
    "games_csv", "games_csv_unnumbered", "lines_csv", "tidy_roundtrip", "tidy_csv", "slate_lines_csv", "games_with_slate_lines",
}
NAMES = sorted(set(C.queries()) - STORING)


@pytest.mark.parametrize("name", NAMES)
def test_no_forced_broadcast_no_product_no_row_python(spark, plan_of, name):
    plan = plan_of(lambda: C.queries()[name](spark, SF))
    for unwanted in ("Broadcast", "CartesianProduct", "BatchEvalPython", "MapInPandas", "FlatMapGroups"):
        assert unwanted not in plan
    assert plan.count("ArrowEvalPython") == (1 if name == "calibration_bands" else 0)
    assert "o_totalprice" not in plan and "o_orderstatus" not in plan


def test_rated_games_reach_the_line_join_without_another_shuffle(spark, plan_of):
    plan = plan_of(lambda: C.wide(spark, SF))
    by_game = re.findall(r"Exchange hashpartitioning\(date, team1, team2, score1, score2, \d+\)", plan)
    assert len(by_game) == 2  # one for the games, one for the lines
    assert plan.count("Exchange hashpartitioning(game_id") == 0


def test_side_rows_are_placed_once_and_by_piece(spark, plan_of):
    """All else that the record shuffles is totals, without the columns of the games."""
    plan = plan_of(lambda: R.running_record(C.games(spark, SF), with_seasons=True))
    rows = [line for line in plan.splitlines() if "Exchange hashpartitioning(piece," in line]
    assert len(rows) == 3  # the rows, their totals, and the totals carried back
    assert "Exchange hashpartitioning(season, team," not in plan
    windows = [line for line in plan.splitlines() if "windowspecdefinition(" in line and "piece, order_id" in line]
    assert len(windows) == 1


def test_three_models_build_no_running_record(spark, plan_of):
    full = plan_of(lambda: C.tidy(spark, SF)).count("FileScan")
    for name in ("calibration_top", "winnings_series"):
        plan = plan_of(lambda: C.queries()[name](spark, SF))
        assert "order_id" not in plan and plan.count("FileScan") <= full


def test_models_are_built_once_for_the_overall_accuracy(spark, plan_of):
    full = plan_of(lambda: C.tidy(spark, SF)).count("FileScan")
    assert plan_of(lambda: C.queries()["accuracy_against_overall"](spark, SF)).count("FileScan") == full


def test_crosswalk_is_the_small_side(spark, plan_of):
    plan = plan_of(lambda: C.queries()["lines_named_cities"](spark, SF), broadcast=True)
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("BuildRight") == 2
    assert "Exchange hashpartitioning" not in plan


def test_accuracy_counts_before_it_shuffles(spark, plan_of):
    plan = plan_of(lambda: C.queries()["accuracy_by_season_elo"](spark, SF))
    assert plan.count("Exchange") == 1 and "partial_avg" in plan
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan
