"""What several text operators share: the input columns, stored tables, slices of batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from calibrant.shipping import ship_package
from calibrant.sources.tables import shared_folder

# Bytes of text that one step inside a task works on, at least one document.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id` and `text` alone, whatever else the table carries; a missing text is empty."""
    ship_package(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def stored(table: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: cuts lineage, outlives executors."""
    spark = table.sparkSession
    path = shared_folder(spark, name)
    table.write.parquet(path)
    found = spark.read.schema(table.schema).parquet(path)
    found.stored_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Removes folders of `stored` tables, once what was computed from them is stored itself."""
    for table in tables:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(table.stored_path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


# Most keys that `join_hot` spreads, and the parts it deals their rows into. A key beyond them has at
# most one in HOT_KEYS of the rows.
HOT_KEYS, HOT_PARTS = 1024, 32


def join_hot(
    rows: DataFrame, table: DataFrame, keys: list[str], count: str, name: str, then: Callable[[DataFrame], DataFrame] = lambda x: x
) -> DataFrame:
    """Inner join with a table that has one row per key and how many `rows` there are of it; stored after `then`.

    The rows of the HOT_KEYS most frequent keys are dealt over HOT_PARTS tasks each; only the list of
    those keys is broadcast.
    """
    table = stored(table, "keys")
    hot = F.broadcast(table.orderBy(F.desc(count), *keys).limit(HOT_KEYS).select(*keys, F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(*(c for c in rows.columns if c not in keys)), F.lit(HOT_PARTS)))
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    spread_rows = rows.join(hot, keys, "left").withColumn("part", F.coalesce(salt, F.lit(0)).cast("int")).drop("hot")
    copies = table.join(hot, keys, "left").withColumn("part", F.explode(parts)).drop("hot", count)
    found = stored(then(spread_rows.join(copies.hint("merge"), [*keys, "part"]).drop("part")), name)
    discard(table)
    return found


def located(docs: DataFrame) -> tuple[DataFrame, Column]:
    """The documents and the column that says where each row is; other tables are stored first."""

    def place(table: DataFrame) -> Column:
        file = table.metadataColumn("_metadata")
        return F.struct(file["file_path"].alias("file"), file["row_index"].alias("row"))

    try:
        docs.select(place(docs).alias("at"))
    except AnalysisException:
        docs = stored(docs, "located")
    return docs, place(docs)


def slices(batch: pa.RecordBatch, column: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `chars` bytes of text each. Afterwards the worker, which
    lives on between tasks, gives back the memory that Arrow holds free.
    """
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        after = max(first + 1, int(np.searchsorted(ends, before + chars, side="right")))
        yield batch.slice(first, after - first)
        first = after
    pa.default_memory_pool().release_unused()


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i]+counts[i]-1 of all i, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
