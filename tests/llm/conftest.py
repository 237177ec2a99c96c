import sys
import uuid
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from odd_rows import ODD  # noqa: E402


@pytest.fixture
def as_table(spark, tmp_path):
    """Rows (doc_id, text[, lang, source]) as a stored documents table with clashing extra columns."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), 1, "x", True) for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, kept boolean"
        path = str(tmp_path / uuid.uuid4().hex)
        spark.createDataFrame(full, schema).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture
def odd(as_table):
    return as_table(ODD)


@pytest.fixture
def empty(as_table):
    return as_table([])
