"""Best-fit-decreasing packing of token sequences.

Texts are tokenized once into a stored table of pieces (ids' checksums and lengths, no ids).
Pieces are dealt by a hash into shards of about SHARD_PIECES rows; a shard is packed by one
task, longest piece first, each into the open sequence with the least room that still takes it.
A segment tree over the possible amounts of room finds that sequence in one descent.

A shard leaves a few sequences that are filled to less than FULL. Their pieces are packed again, by
the same step over fewer shards, until one shard is left or a step left more than RETRY of its
pieces loose: lengths that fill no sequence well are not packed better by trying again.

Missing texts are empty; their one piece is the end id. Rows with equal or missing ids, and equal
rows, are documents of their own: pieces are dealt to shards by their place in the table, so many
equal ones do not meet. A long text is tokenized as a whole and then cut. An empty table has no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from calibrant.llm.common import documents, ids_crc32, slices, stored
from calibrant.llm.word_tokens import END_ID, word_tokens
from calibrant.shipping import ship_package

CAPACITY = 4096
SHARD_PIECES = 1024
# A sequence filled to this share is left as it is; a step that leaves more than RETRY of its pieces loose is the last.
FULL, RETRY = 0.99, 0.9


class RoomTree:
    """Segment tree over amounts of room 0..capacity; a leaf counts the open bins with that room."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.base)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        node = self.base + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, room: int) -> tuple[int, int] | None:
        """Removes and gives an open bin with the least room of at least `room`, and that room."""
        node = self.base + room
        if not self.count[node]:
            # Up until a right neighbor holds bins, then down to its leftmost one.
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node *= 2
                if not self.count[node]:
                    node += 1
        found = node - self.base
        while node:
            self.count[node] -= 1
            node >>= 1
        return self.bins[found].pop(), found


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; the lengths must be in descending order."""
    tree, used = RoomTree(capacity), 0
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        taken = tree.take(length)
        bin_, room = taken if taken else (used, capacity)
        used += not taken
        bins[i], offsets[i] = bin_, capacity - room
        if room > length:
            tree.put(room - length, bin_)
    return bins, offsets


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most `capacity` tokens of every document, whose ids end with `end_id`.

    An empty or missing text has one piece, the end id alone.
    """
    out = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens(path)
        for batch in batches:
            for part in slices(batch):
                ids, offsets = encoder.encode(part.column("text"), end_id)
                sizes = np.diff(offsets)
                n = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                begin = offsets[doc] + start
                crcs = [ids_crc32(ids[a : a + b]) for a, b in zip(begin, length)]
                columns = [
                    part.column("doc_id").take(pa.array(doc)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(crcs, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return documents(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _pack_shards(items: DataFrame, n_items: int, capacity: int, shard_pieces: int) -> DataFrame:
    """`bin` (shard and number) and `at` of every item, a row with a `place` and a `length`."""
    shards = max(1, -(-n_items // shard_pieces))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "place"], ascending=[False, True], ignore_index=True)
        bins, offsets = best_fit(rows["length"].to_numpy(), capacity)
        fill = np.bincount(bins, weights=rows["length"], minlength=1).astype(np.int64)
        rows["bin"] = rows["shard"].astype(np.int64) * (1 << 32) + bins
        rows["at"], rows["fill"] = offsets, fill[bins] if len(rows) else offsets
        return rows.drop(columns="shard")

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    shard = F.pmod(F.xxhash64("place"), F.lit(shards))
    return items.withColumn("shard", shard).groupBy("shard").applyInPandas(pack, f"{kept}, bin long, at long, fill long")


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, full: float = FULL, retry: float = RETRY
) -> DataFrame:
    """The pieces, a table with a column `length` and any others, with their `sequence_id` and `offset`."""
    ship_package(pieces.sparkSession)
    columns = pieces.columns
    inner = {c: "length" if c == "length" else f"c{i}" for i, c in enumerate(columns)}
    todo = stored(
        pieces.select(*(F.col(f"`{c}`").alias(n) for c, n in inner.items()), F.monotonically_increasing_id().alias("place")), "pieces"
    )
    n, level, packed = todo.count(), 0, None
    while True:
        placed = stored(_pack_shards(todo, n, capacity, shard_pieces), "packed")
        loose = placed.where(F.col("fill") < full * capacity)
        left = loose.count()
        last = n <= shard_pieces or left == 0 or left > retry * n
        done = (placed if last else placed.where(F.col("fill") >= full * capacity)).select(
            *(F.col(n).alias(c) for c, n in inner.items()), (F.lit(level << 56) + F.col("bin")).alias("sequence_id"), F.col("at").alias("offset")
        )
        packed = done if packed is None else packed.union(done)
        if last:
            return packed
        todo, n, level = loose.drop("bin", "at", "fill"), left, level + 1


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Documents to packed pieces: tokenized once, cut at `capacity`, packed best fit decreasing."""
    return pack(token_pieces(docs, path, capacity), capacity, shard_pieces)
