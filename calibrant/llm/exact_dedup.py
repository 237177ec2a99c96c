"""Exact deduplication by a stateful stream over digests.

Each call adds rows (digest, id, locator) of its documents to a folder. A stream reads that folder
and keeps, per digest, the row with the largest id and the number of rows, in RocksDB state
that never expires. The locator (file and row) says where the full text is. Every hit, a row whose
digest belongs to another row too, is then checked byte by byte against the text at the kept
row's locator. Rows that only share the digest are grouped by their full texts instead.

With a `state` folder digests, stream and state last over calls: a digest seen years ago is still
known, and its text is read where its locator says, so earlier documents must stay where they were.
Results are those of this call's rows among all rows ever seen. What a call begins with is noted
before the stream goes on, so a call that failed can be run again under the same name.

Everything here is DataFrame and SQL operations. Hot groups: the stream counts before it
shuffles, and the joins are equi-joins whose outsized partitions Spark splits.

Defined cases: a missing text is empty; missing ids are smaller than all others; of equal
texts with the same id the one with the largest locator stays, so exactly one row is kept.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from calibrant.llm.common import located, stored
from calibrant.sources.tables import shared_folder

_STATE = "spark.sql.streaming.stateStore."
_ROCKSDB = {
    "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Without this each partition's store reserves several MB of disk for its logs.
    "rocksdb.allowFAllocate": "false",
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Files of digests that one micro-batch of the stream takes.
FILES_PER_BATCH = 1000


def normalized(text: Column) -> Column:
    """A-Z lowered, all else as it is. In an ASCII text `lower` does just that, faster."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def _rocksdb(spark: SparkSession):
    before = {k: spark.conf.get(_STATE + k, None) for k in _ROCKSDB}
    for k, value in _ROCKSDB.items():
        spark.conf.set(_STATE + k, value)
    try:
        yield
    finally:
        for k, value in before.items():
            spark.conf.unset(_STATE + k) if value is None else spark.conf.set(_STATE + k, value)


def update_state(spark: SparkSession, digests: str, checkpoint: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Runs the stream over all digest rows not seen yet; the state: digest, keep, group_size."""
    rows = (
        spark.readStream.schema(spark.read.parquet(digests).schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(digests)  # one folder per call
    )
    counted = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "at")).alias("keep"), F.count(F.lit(1)).alias("n"))
    with _rocksdb(spark):
        query = (
            counted.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
    return stored(
        state.select("key.digest", F.col("value.max").alias("keep"), F.col("value.count").alias("group_size")), "dedup-state"
    )


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _written_once(table: DataFrame, path: str) -> DataFrame:
    """The table stored at the path, unless a run before has done so."""
    spark = table.sparkSession
    if not _exists(spark, f"{path}/_SUCCESS"):
        table.write.mode("overwrite").parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def _known(spark: SparkSession, checkpoint: str) -> DataFrame | None:
    """The lasting state so far: digest, old_keep; nothing before the first call."""
    if not _exists(spark, f"{checkpoint}/commits/0"):
        return None
    with _rocksdb(spark):
        state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.digest", F.col("value.max").alias("old_keep"))


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, state: str | None = None, call: str | None = None
) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 and its locator `at`.

    `digest` maps the normalized text to a string; a weak one costs time, not correctness. `state` is the
    folder of a lasting state, the same for all calls; without it only this call's rows are compared.
    """
    spark = docs.sparkSession
    docs, place = located(docs)
    text = normalized(F.col(text_col))
    folder, call = state or shared_folder(spark, "dedup"), call or uuid.uuid4().hex
    checkpoint = f"{folder}/stream"
    hashed = docs.select(F.col(id_col).cast("long").alias("doc_id"), place.alias("at"), text.alias("text")).select(
        "doc_id", "at", digest(F.col("text")).alias("digest"), sha256(F.col("text")).alias("text_sha256")
    )
    known = _known(spark, checkpoint) if state else None
    rows = _written_once(hashed, f"{folder}/digests/call={call}")
    texts = docs.select(place.alias("at"), text.alias("text"))
    before = None
    if state:
        nothing = rows.select("digest", F.struct("doc_id", "at").alias("old_keep")).limit(0)
        met = known.join(rows.select("digest").distinct(), "digest", "left_semi") if known else nothing
        before = _written_once(met.select("digest", "old_keep"), f"{folder}/before/call={call}")
        before = None if before.isEmpty() else before
    grouped = rows.join(update_state(spark, f"{folder}/digests", checkpoint), "digest")
    if before is None:
        grouped = grouped.withColumn("same_as", F.col("keep"))
    else:
        # All earlier rows of a digest were found equal to the row kept then, or are noted as collided.
        grouped = grouped.join(before, "digest", "left").withColumn("same_as", F.coalesce("old_keep", "keep")).drop("old_keep")
        texts = texts.union(_earlier_texts(before.select("old_keep.at"), text_col))

    collided = stored(_collided(grouped, texts), "dedup-collided")
    if state:
        collided.write.mode("append").parquet(f"{folder}/collided")
        collided = spark.read.parquet(f"{folder}/collided").join(rows.select("digest").distinct(), "digest", "left_semi").distinct()
    found = grouped.drop("same_as")
    if not collided.isEmpty():
        found = _regrouped(found, collided, spark.read.parquet(f"{folder}/digests") if before is not None else rows, texts, text_col)
    return found.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("at") == F.col("keep.at")).alias("kept"), "text_sha256", "at"
    )


def _earlier_texts(places: DataFrame, text_col: str) -> DataFrame:
    """Normalized texts in the files that the locators name. The driver gets the files' names alone."""
    spark = places.sparkSession
    files = [r[0] for r in places.select("at.file").distinct().collect()]
    docs, place = located(spark.read.parquet(*files))
    return docs.select(place.alias("at"), normalized(F.col(text_col)).alias("text"))


def _collided(grouped: DataFrame, texts: DataFrame) -> DataFrame:
    """Digests of hits whose full text is not that of the row that stands for their digest."""
    several = grouped.where(F.col("group_size") > 1)
    places = several.select("at", "digest", F.lit(True).alias("hit")).where(F.col("at") != F.col("same_as.at")).union(
        several.select("same_as.at", "digest", F.lit(False)).distinct()
    )
    with_text = texts.join(places, "at")
    kept = with_text.where(~F.col("hit")).select("digest", F.col("text").alias("kept_text"))
    differs = F.encode("text", "UTF-8") != F.encode("kept_text", "UTF-8")
    return with_text.where("hit").join(kept, "digest").where(differs).select("digest").distinct()


def _regrouped(grouped: DataFrame, collided: DataFrame, all_rows: DataFrame, texts: DataFrame, text_col: str) -> DataFrame:
    """The rows of collided digests grouped by full text, among all rows ever seen; the others as they are."""
    members = stored(all_rows.join(collided, "digest", "left_semi").select("digest", "doc_id", "at"), "dedup-members")
    if "call" in all_rows.columns:
        texts = texts.union(_earlier_texts(members.select("at"), text_col)).distinct()
    with_text = members.join(texts, "at").select("digest", F.encode("text", "UTF-8").alias("bytes"), "doc_id", "at")
    own = with_text.groupBy("digest", "bytes").agg(F.max(F.struct("doc_id", "at")).alias("own_keep"), F.count(F.lit(1)).alias("own_size"))
    moved = with_text.join(own, ["digest", "bytes"]).select("at", "own_keep", "own_size")
    return (
        grouped.join(moved, "at", "left")
        .withColumn("keep", F.coalesce("own_keep", "keep"))
        .withColumn("group_size", F.coalesce("own_size", "group_size"))
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    docs, place = located(docs)
    kept = dedup(docs).where("kept").select("at")
    return docs.join(kept, place == kept["at"], "left_semi")
