"""Token ids in files of directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level 0 holds the first chunk of every id,
level 1 the second chunk of the ids that have one, and so on. A bitmap per level marks the ids
that continue; a directory counts its set bits ahead of every block of 512. The chunk of id i
on the next level stands at rank(i), so any id is read with one step per level, without
decoding its neighbors.

A file row is a segment: whole documents in ascending order of id, about SEGMENT_TOKENS ids.
Spark writes the rows as Parquet with binary columns, so files appear only when their task has
succeeded, and any store that Spark reaches will do. Missing document ids come first; documents
with the same id are ordered by their text. Any number of rows may lack an id: they are dealt over
the shards by the start of their text. Rows that share an id, or that have none and start with
the same _START characters, are written by one task. An empty text has only the end id, if there is one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from calibrant.llm.common import documents, ids_crc32, slices
from calibrant.llm.word_tokens import END_ID, word_tokens
from calibrant.shipping import ship_package

SEGMENT_TOKENS = 1 << 20
_BLOCK = 512
# Characters by which rows without an id are dealt; they agree with the order of the whole texts.
_START = 64

FILE_SCHEMA = (
    "shard int, segment int, first_token long, n_tokens long, doc_ids array<long>, doc_ends array<long>,"
    " levels array<struct<chunks: binary, continues: binary, ranks: binary>>"
)


def encode_levels(ids: np.ndarray) -> list[dict[str, bytes]]:
    """Chunks, continuation bitmap and rank directory of each level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        per_block = np.add.reduceat(more.astype(np.int64), np.arange(0, len(more), _BLOCK)) if len(more) else np.zeros(0, np.int64)
        levels.append(
            {
                "chunks": (rest & 0xFF).astype(np.uint8).tobytes(),
                "continues": bits.tobytes(),
                "ranks": (np.cumsum(per_block) - per_block).astype("<u4").tobytes(),
            }
        )
        rest = rest[more] >> 8
        if not len(rest):
            return levels


def decode_levels(levels: list[dict[str, bytes]]) -> np.ndarray:
    """All ids of a segment."""
    ids = np.zeros(0, np.uint32)
    for level in reversed(levels):
        low = np.frombuffer(level["chunks"], np.uint8).astype(np.uint32)
        more = np.unpackbits(np.frombuffer(level["continues"], np.uint8), count=len(low), bitorder="little") == 1
        low[more] |= ids << 8
        ids = low
    return ids


def ids_at(levels: list[dict[str, bytes]], positions: np.ndarray) -> np.ndarray:
    """The ids at any positions of a segment: one lookup per level, nothing else is decoded."""
    at = np.asarray(positions, np.int64)
    ids, open_ = np.zeros(len(at), np.uint32), np.arange(len(at))
    for k, level in enumerate(levels):
        ids[open_] |= np.frombuffer(level["chunks"], np.uint8)[at].astype(np.uint32) << (8 * k)
        bits = np.frombuffer(level["continues"], np.uint8)
        more = (bits[at >> 3] >> (at & 7)) & 1 == 1
        open_, at = open_[more], at[more]
        if not len(at):
            break
        ahead = np.frombuffer(level["ranks"], "<u4")[at // _BLOCK].astype(np.int64)
        at = ahead + _rank_in_block(bits, at)
    return ids


def _rank_in_block(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Set bits between the start of each position's block and the position."""
    padded = np.concatenate([bits, np.zeros(_BLOCK // 8, np.uint8)])
    block = padded[(at // _BLOCK * (_BLOCK // 8))[:, None] + np.arange(_BLOCK // 8)]
    marks = np.unpackbits(block, axis=1, bitorder="little")
    return (marks * (np.arange(_BLOCK) < (at % _BLOCK)[:, None])).sum(axis=1, dtype=np.int64)


def _segments(batches: Iterator[pa.RecordBatch], path: str, end_id: int | None, segment_tokens: int):
    shard = TaskContext.get().partitionId()
    encoder, target = word_tokens(path), None
    first, number, held, held_docs = 0, 0, [], []

    def segment() -> dict:
        ids = np.concatenate(held)
        return {
            "shard": shard,
            "segment": number,
            "first_token": first,
            "n_tokens": len(ids),
            "doc_ids": [d for d, _ in held_docs],
            "doc_ends": np.cumsum([n for _, n in held_docs]).tolist(),
            "levels": encode_levels(ids),
        }

    for batch in batches:
        for part in slices(batch):
            ids, offsets = encoder.encode(part.column("text"), end_id)
            for doc_id, start, end in zip(part.column("doc_id").to_pylist(), offsets[:-1], offsets[1:]):
                held.append(ids[start:end])
                held_docs.append((doc_id, end - start))
                target = (target or 0) + end - start
                if target >= segment_tokens:
                    yield segment()
                    first, number, held, held_docs, target = first + target, number + 1, [], [], None
    if held_docs:
        yield segment()


def write_token_file(
    docs: DataFrame, folder: str, path: str, end_id: int | None = END_ID, segment_tokens: int = SEGMENT_TOKENS
) -> None:
    """Ids of all documents, each with `end_id` behind it, in ascending order of `doc_id`."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _segments(batches, path, end_id, segment_tokens):
            yield pa.RecordBatch.from_pylist([row], schema=arrow_schema)

    spark = docs.sparkSession
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(spark.createDataFrame([], FILE_SCHEMA).schema)
    # Only for rows without an id, so that tables with ids sample and compare nothing but these.
    start = F.when(F.col("doc_id").isNull(), F.substring("text", 1, _START))
    ordered = documents(docs).repartitionByRange("doc_id", start).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, FILE_SCHEMA).write.parquet(folder)


def shard_starts(spark: SparkSession, folder: str) -> dict[int, int]:
    """Ids in all files before each shard. There are as many entries as files."""
    shards = (
        spark.read.schema(FILE_SCHEMA)
        .parquet(folder)
        .groupBy("shard")
        .agg(F.min(F.get("doc_ids", F.lit(0))).alias("first"), F.sum("n_tokens").alias("n"))
        .orderBy(F.col("first").asc_nulls_first(), "shard")
        .collect()
    )
    starts, total = {}, 0
    for row in shards:
        starts[row["shard"]] = total
        total += row["n"]
    return starts


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place among all ids, its length and the checksum of its ids, from the files."""
    ship_package(spark)
    starts = shard_starts(spark, folder)
    out = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = decode_levels(row["levels"])
                ends = np.array(row["doc_ends"], np.int64)
                begin = ends - np.diff(ends, prepend=0)
                crcs = [ids_crc32(ids[a:b]) for a, b in zip(begin, ends)]
                place = starts[row["shard"]] + row["first_token"] + begin
                columns = [pa.array(row["doc_ids"], pa.int64()), place, ends - begin, pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=out)

    return spark.read.schema(FILE_SCHEMA).parquet(folder).mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def tokens_at(spark: SparkSession, folder: str, positions: list[int]) -> dict[int, int]:
    """The ids at a few places among all ids. Only the segments that hold them are read."""
    starts = shard_starts(spark, folder)
    place = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[F.col("shard")] + F.col("first_token")
    wanted = F.array(*[F.lit(int(p)) for p in positions])
    rows = (
        spark.read.schema(FILE_SCHEMA)
        .parquet(folder)
        .select(place.alias("start"), "n_tokens", "levels")
        .withColumn("hits", F.filter(wanted, lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("n_tokens"))))
        .where(F.size("hits") > 0)
        .toLocalIterator()
    )
    found = {}
    for row in rows:
        at = np.array(row["hits"]) - row["start"]
        found.update(zip(row["hits"], ids_at([x.asDict() for x in row["levels"]], at).tolist()))
    return found
