"""Operators that read stored results work first in a session started in another folder."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from calibrant.llm import catalog, packing, pieces, quality_gam, token_file
from calibrant.llm.word_tokens import vocabulary_path

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
path = sys.argv[2]
if sys.argv[1] == "decode":
    ids = spark.createDataFrame([(1, [264, 287])], "doc_id long, ids array<int>")
    found = pieces.decode_documents(ids, vocabulary_path(catalog.PIECES))
elif sys.argv[1] == "pack":
    found = packing.pack(spark.createDataFrame([(1, 5)], "doc_id long, length long"))
elif sys.argv[1] == "good":
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    found = quality_gam.good_documents(docs, quality_gam.Model(3.0))
else:
    found = token_file.read_documents(spark, path)
assert len(found.collect()) == 1
"""


def test_first_use_from_another_folder(spark, as_table, tmp_path):
    from calibrant.llm import catalog, token_file
    from calibrant.llm.word_tokens import vocabulary_path

    folder = str(tmp_path / "tokens")
    token_file.write_token_file(as_table([(1, "some text")]), folder, vocabulary_path(catalog.WORDS))
    for what in ("decode", "pack", "good", "read"):
        done = subprocess.run(
            [sys.executable, "-c", SCRIPT.format(root=str(ROOT)), what, folder], cwd=tmp_path, capture_output=True, text=True, timeout=300
        )
        assert done.returncode == 0, (what, done.stderr[-2000:])
