"""Removal of passages that a document with a smaller id already has, by level-wise doubling.

Lengths double up to the wanted one: 7, 13, 25 and 50 words. The first level looks at windows of the
least length. Of every full window the one with the least hash is taken, so equal full windows
give equal ones, wherever they stand, and about one position in twenty is looked at. Windows
that occur in one document only are dropped; nothing they are part of can repeat. The others are
extended to about twice their length, to the left and to the right: a full window around them has
one of the two within it. A window stays if one of its extensions occurs in several documents. So
each level looks at what the one before has left, until full windows are reached or none is left.

All full windows that contain a window lie in its surroundings. Equal surroundings are settled at
once: every document but the first that has them loses all of their words. Only the first document
with each of several different surroundings of a window hashes its full windows one by one;
those that start in a document with a smaller id are removed too. The smallest document that has a
full window is always the first with its surroundings there, or an even smaller one has the
window as well, so nothing is missed. No longer windows are needed: their words are covered by
full ones.

A passage that many documents share has its first document and its number counted ahead of the
shuffle; its rows look these up in several tasks (`common.join_hot`).

Short windows and surroundings are compared by 64 bits each, together 128, full windows by 128.
Words are separated by ASCII white space. Missing texts have no words. A missing id is smaller
than all others; rows with the same id do not repeat each other.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from calibrant.llm.common import discard, documents, join_hot, slices, spread, stored

WINDOW = 50
# The first level's windows have at least this many words, if the wanted ones have.
LEAST = 7
_NO_ID = -(1 << 63)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words:
    """Words of many texts in a row, with hashes of any run of them."""

    def __init__(self, texts: pa.Array, hashed: bool = True):
        split = pc.ascii_split_whitespace(texts)
        flat = split.flatten()
        real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        self.flat = flat.filter(pa.array(real))
        ends = np.concatenate([[0], np.cumsum(real)])
        self.offsets = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        if hashed:
            coded = pc.dictionary_encode(self.flat)
            distinct, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            self.sums, self.scales = [], []
            for seed, base in enumerate(_BASES):
                codes = np.array([xxhash.xxh64_intdigest(w, seed) for w in distinct], np.uint64)[at]
                powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(at), base)]))
                inverse = np.uint64(pow(int(base), -1, 1 << 64))
                self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(codes * powers[:-1])]))
                self.scales.append(np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(at), inverse)])))

    def run_hash(self, start: np.ndarray, length, kind: int = 0) -> np.ndarray:
        """Hash of the words start .. start+length-1, the same wherever they stand."""
        total = self.sums[kind][start + length] - self.sums[kind][start]
        return _mix(total * self.scales[kind][start])


def level_lengths(window: int, least: int = LEAST) -> list[int]:
    """Lengths that double, as near as whole numbers go, up to the wanted one."""
    lengths = [window, (window + 1) // 2]
    while (lengths[-1] + 1) // 2 >= least:
        lengths.append((lengths[-1] + 1) // 2)
    return lengths[::-1]


def extensions(lengths: list[int]) -> list[list[int]]:
    """Per level, where the extensions to its length start ahead of the first level's window."""
    starts = [[0]]
    for short, long in zip(lengths, lengths[1:]):
        starts.append([s + step for s in starts[-1] for step in (0, long - short)])
    return starts


def least_windows(words: Words, window: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the first level's windows, their hashes, and the text each is in."""
    n = np.diff(words.offsets)
    starts = spread(words.offsets[:-1], np.maximum(n - window + 1, 0))
    if not len(starts):
        return starts, np.zeros(0, np.uint64), starts
    hashes = words.run_hash(np.arange(len(words.flat) - length + 1), length)
    # The least of the positions start .. start+steps, found by runs that double.
    steps = window - length
    least, best, run = hashes.copy(), np.arange(len(hashes)), 1
    while 2 * run <= steps + 1:
        lower = least[run:] < least[:-run]
        least, best = np.where(lower, least[run:], least[:-run]), np.where(lower, best[run:], best[:-run])
        run *= 2
    last = starts + (steps + 1 - run)
    at = np.unique(np.where(least[last] < least[starts], best[last], best[starts]))
    return at, hashes[at], np.searchsorted(words.offsets, at, side="right") - 1


def _surroundings(words: Words, at: np.ndarray, text: np.ndarray, window: int, length: int):
    """Where the run of all full windows around each short window starts, and its length."""
    low = np.maximum(at - (window - length), words.offsets[text])
    return low, np.minimum(at + window, words.offsets[text + 1]) - low


def _keys(texts: pa.Array) -> np.ndarray:
    """32 bits of each text, to tell rows with the same id apart."""
    return np.array([zlib.crc32(t.as_buffer()) if t.is_valid else 0 for t in texts], np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, _NO_ID).to_numpy(zero_copy_only=False)


def short_windows(docs: DataFrame, window: int, lengths: list[int]) -> DataFrame:
    """The first level's windows of all documents: hash, hash of the surroundings, document, spot, extensions.

    A spot is the key of the text in the upper, the position in the lower 32 bits. `level1`, `level2` ... are the
    hashes of the extensions to the levels' lengths; one that leaves the text is missing.
    """
    levels = list(zip(lengths, extensions(lengths)))[1:-1]
    schema = "short long, around long, doc long, spot long" + "".join(f", level{k + 1} array<long>" for k in range(len(levels)))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text")
                words = Words(texts)
                at, hashes, text = least_windows(words, window, lengths[0])
                low, length = _surroundings(words, at, text, window, lengths[0])
                around = _mix(words.run_hash(low, length, 1) + (length * window + (at - low)).astype(np.uint64))
                spot = (_keys(texts)[text] << 32) | (at - words.offsets[text])
                columns = [hashes.view(np.int64), around.view(np.int64), _ids(part.column("doc_id"))[text], spot]
                longer = []
                for size, ahead in levels:
                    start = at[:, None] - np.array(ahead)
                    inside = (start >= words.offsets[text][:, None]) & (start + size <= words.offsets[text + 1][:, None])
                    found = words.run_hash(np.where(inside, start, 0).ravel(), np.where(inside, size, 0).ravel())
                    values = pa.array(found.view(np.int64), mask=~inside.ravel())
                    offsets = np.arange(len(at) + 1, dtype=np.int32) * len(ahead)
                    longer.append(pa.ListArray.from_arrays(pa.array(offsets), values))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *longer], names)

    return documents(docs).mapInArrow(run, schema)


def _per_text(spots: DataFrame) -> DataFrame:
    """Positions by document and text key; a text has no more of them than words."""
    return spots.select("doc", F.shiftrightunsigned("spot", 32).alias("key"), F.col("spot").bitwiseAND(0xFFFFFFFF).alias("at"), "kind").groupBy(
        "doc", "key"
    ).agg(F.collect_list(F.struct("at", "kind")).alias("spots"))


def _with_key(docs: DataFrame) -> DataFrame:
    return documents(docs).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), F.crc32(F.col("text").cast("binary")).alias("key")
    )


def _spots(column: pa.Array) -> Iterator[dict[int, np.ndarray]]:
    """Per row, the positions of each kind."""
    for spots in column:
        values = spots.values if spots.is_valid else None
        if values is None or not len(values):
            yield {}
            continue
        at, kind = (values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        yield {k: at[kind == k] for k in np.unique(kind).tolist()}


_COVERED, _OPEN, _FULL = 1, 2, 3


def full_windows(docs: DataFrame, spots: DataFrame, window: int, length: int) -> DataFrame:
    """128-bit hashes of the full windows around open short windows: h1, h2, doc, spot."""
    out = pa.schema([(c, pa.int64()) for c in ("h1", "h2", "doc", "spot")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                starts, rows = [], []
                for i, found in enumerate(_spots(part.column("spots"))):
                    at = found.get(_OPEN, np.zeros(0, np.int64))
                    last = words.offsets[i + 1] - words.offsets[i] - window
                    near = np.unique(at[:, None] - np.arange(window - length + 1))
                    near = near[(near >= 0) & (near <= last)]
                    starts.append(near)
                    rows.append(np.full(len(near), i))
                start, row = np.concatenate(starts), np.concatenate(rows)
                first = words.offsets[row] + start
                key = part.column("key").to_numpy()[row]
                columns = [
                    words.run_hash(first, window, 0).view(np.int64),
                    words.run_hash(first, window, 1).view(np.int64),
                    part.column("doc").to_numpy()[row],
                    (key << 32) | start,
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=out)

    open_ = _per_text(spots.where(F.col("kind") == _OPEN))
    return _with_key(docs).join(open_, ["doc", "key"]).select("text", "doc", "key", "spots").mapInArrow(run, "h1 long, h2 long, doc long, spot long")


def _in_several(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur in more than one document, and how often."""
    ends = rows.groupBy(key).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("n"))
    return ends.where("lo < hi").select(key, "n")


def surviving_windows(docs: DataFrame, window: int) -> DataFrame:
    """`short`, `around`, `doc` and `spot` of the short windows that the levels leave."""
    lengths = level_lengths(window)
    rows = stored(short_windows(docs, window, lengths), "short-windows")
    alive = join_hot(rows, _in_several(rows, "short"), ["short"], "n", "windows")
    discard(rows)
    for k in range(1, len(lengths) - 1):
        longer = alive.withColumn("longer", F.explode(f"level{k}")).drop(f"level{k}").where("longer IS NOT NULL")
        before, alive = alive, join_hot(
            longer, _in_several(longer, "longer"), ["longer"], "n", "windows", lambda x: x.drop("longer").dropDuplicates(["doc", "spot"])
        )
        discard(before)
    return alive


def repeated_spots(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`doc`, `spot` and `kind` of covered short windows (1) and removed full windows (3)."""
    survivors = surviving_windows(docs, window)
    first = survivors.groupBy("short", "around").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n"))
    several = first.groupBy("short").agg(F.count(F.lit(1)).alias("kinds"))
    kinds = join_hot(first, several.select("short", (F.col("kinds") > 1).alias("open"), "kinds"), ["short"], "kinds", "surroundings")
    kind = F.when(F.col("first") < F.col("doc"), _COVERED).when(F.col("open"), _OPEN)
    spots = join_hot(
        survivors, kinds, ["short", "around"], "n", "window-spots",
        lambda x: x.select("doc", "spot", kind.alias("kind")).where("kind IS NOT NULL"),
    )
    discard(survivors, kinds)
    full = stored(full_windows(docs, spots, window, level_lengths(window)[0]), "full-windows")
    earlier = full.groupBy("h1", "h2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("n"))
    removed = join_hot(
        full, earlier.where("lo < hi").drop("hi"), ["h1", "h2"], "n", "removed-windows",
        lambda x: x.where("lo < doc").select("doc", "spot", F.lit(_FULL).alias("kind")),
    )
    discard(full)
    return spots.where(F.col("kind") == _COVERED).unionByName(removed)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and kept_text, the words left over."""
    length = level_lengths(window)[0]
    out = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), hashed=False)
                n = np.diff(words.offsets)
                removed, kept = [], []
                for i, found in enumerate(_spots(part.column("spots"))):
                    own = words.flat.slice(words.offsets[i], n[i])
                    ends = np.zeros(n[i] + 1, np.int64)
                    covered, full = found.get(_COVERED, np.zeros(0, np.int64)), found.get(_FULL, np.zeros(0, np.int64))
                    np.add.at(ends, np.concatenate([np.maximum(covered - (window - length), 0), full]), 1)
                    np.add.at(ends, np.minimum(np.concatenate([covered, full]) + window, n[i]), -1)
                    gone = np.cumsum(ends[:-1]) > 0
                    removed.append(int(gone.sum()))
                    left = own.filter(pa.array(~gone)) if removed[-1] else own
                    kept.append(" ".join(left.to_pylist()))
                digests = [hashlib.sha256(t.encode()).hexdigest() for t in kept]
                columns = [part.column("doc_id"), pa.array(n), pa.array(removed, pa.int64()), pa.array(digests), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    spots = _per_text(repeated_spots(docs, window))
    return (
        _with_key(docs)
        .join(spots, ["doc", "key"], "left")
        .select("doc_id", "text", "spots")
        .mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    )
