"""Every registered query against its SQL in DuckDB."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import oracle_check as check
import pytest

import __spark_entry__ as contract
from calibrant.plans import catalog, oracle

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    assert check.types_of(frame) == check.duck_types(duck, SQL[name])
    columns, rows = check.spark_rows(frame)
    expected_columns, expected = check.duck_rows(duck, SQL[name])
    assert columns == expected_columns
    assert rows == expected
    assert rows


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["season", "date", "model", "days_winnings", "cumulative_winnings"]
    assert frame.count() > 0


def test_the_contract_has_all_of_them():
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


def test_the_contract_works_without_the_text_subpackage(tmp_path):
    """The rest of the library neither imports it nor needs it."""
    root = Path(__file__).resolve().parent.parent
    leave_out = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(root / "calibrant", tmp_path / "calibrant", ignore=leave_out)
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as c; print('N', len(c.queries()), len(c.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})
    assert f"N {len(QUERIES)} {len(SQL)}" in done.stdout, done.stderr[-1000:]
