"""Near-duplicate join: word n-gram Jaccard similarity through a MinHash LSH forest.

1. One pass turns each text into a digest of its set of word n-grams and its labels, one per
   tree: TREES sequences of MinHash values. Equal sets are one class; the rest runs on classes.
2. A tree is the prefix trie of its labels, kept as sorted nodes with their sizes. The longest
   prefix by which a pair at the threshold is found with the target recall is where every class
   starts. A class shortens its prefixes, all trees alike, while its runs (classes with the same
   prefix) have at most FEW members in the mean; each step raises its recall. So where texts are dense
   prefixes are long, and where they are sparse short. The length must not be chosen tree by tree: a
   tree would look cheap just because a near copy is not in it, and the recall would be lost.
3. A class's runs, and the runs of others that it stands in, hold its candidates. Each pair is
   verified once, in the run of its longest common prefix. Runs with the same members are verified
   as one. The texts of a run meet in one task, which compares their n-gram sets exactly and
   returns, per class, the number of links and a spanning forest, never pairs.
4. Runs of more than SMALL classes are dense groups of near copies. Runs that share a class are
   one group; it is dealt into blocks of at most BLOCK_DOCS classes or BLOCK_BYTES, and each pair of
   blocks is a task of its own, so no cap is needed and nothing is left out.
5. The verified links give the final components.

Words are lower-cased and stripped of punctuation at both ends. A text of fewer words than n
has one n-gram, all of them; one without words has none and no links. Missing texts are empty.
Rows are told apart by their place in the table, whatever their ids: rows with the same or a
missing id are documents of their own. A missing id comes after all others, so a class is named by
one only if none of its rows has an id. Rows with equal sets belong to one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from calibrant.llm.common import discard, located, slices, stored
from calibrant.llm.components import SALTS, components
from calibrant.llm.word_tokens import word_occurrences
from calibrant.shipping import ship_package

N, THRESHOLD = 5, 0.8
TREES, MAX_DEPTH, TARGET_RECALL = 28, 10, 0.99
# No prefix is shorter than MIN_DEPTH; a class shortens its own while its runs hold FEW members in the mean.
MIN_DEPTH, FEW = 5, 2
# Runs of more classes are dense; their groups are dealt into blocks.
SMALL = 32
BLOCK_DOCS, BLOCK_BYTES = 128, 6_000_000
# Bits that tell a hash of a longer prefix apart below the shortest one.
_BITS = 15
_CODES, _HASHED = 2048, 4096
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def prefix_depth(threshold: float, trees: int, max_depth: int, recall: float) -> int:
    """The longest prefix by which a pair at the threshold is found with the wanted recall."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, n: int = N) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams."""
    words, at, offsets = word_occurrences(pc.utf8_lower(texts))
    words = pc.utf8_trim(words, _EDGE)
    codes = np.array([xxhash.xxh64_intdigest(w) for w in words.to_pylist()], np.uint64)
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    keep = real[at] if len(at) else np.zeros(0, bool)
    offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
    hashes = codes[at[keep]]
    grams = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
    for k in range(n):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(grams)]
    grams = _mix(grams)
    sets = []
    for start, end in zip(offsets[:-1], offsets[1:]):
        if end - start >= n:
            sets.append(np.unique(grams[start : end - n + 1]))
        elif end > start:
            sets.append(np.array([xxhash.xxh64_intdigest(hashes[start:end].tobytes(), seed=n)], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


class Forest:
    """Labels of shingle sets: per tree a key of the shortest prefix and the path below it."""

    def __init__(self, trees: int, shortest: int, longest: int):
        draw = np.random.default_rng(20_240_607)
        self.trees, self.shortest, self.longest = trees, shortest, longest
        self.add = draw.integers(0, 1 << 32, trees * longest, dtype=np.uint32)[:, None]
        self.times = (draw.integers(0, 1 << 32, trees * longest, dtype=np.uint32) | np.uint32(1))[:, None]

    def labels(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.add), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(low), _HASHED):
            hashed = (low[i : i + _HASHED] ^ self.add) * self.times
            hashed ^= hashed >> np.uint32(15)
            hashed *= np.uint32(0x2C1B3C6D)
            np.minimum(least, hashed.min(axis=1), out=least)
        label = least.reshape(self.trees, self.longest).astype(np.uint64)
        key = np.arange(self.trees, dtype=np.uint64)
        for k in range(self.shortest):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + label[:, k])
        path = np.zeros(self.trees, np.uint64)
        for k in range(self.shortest, self.longest):
            path = (path << np.uint64(_BITS)) | (_mix(label[:, k]) >> np.uint64(64 - _BITS))
        return key.view(np.int64), path.view(np.int64)


def signatures(docs: DataFrame, at: Column, n: int, forest: tuple[int, int, int]) -> DataFrame:
    """Per row: at, doc_id, digest of the n-gram set, bytes of text, number of n-grams, labels."""
    names = ["at", "doc_id", "digest", "n_bytes", "n_grams", "keys", "paths"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Forest(*forest)
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), n)
                labels = [make.labels(s) if len(s) else ([], []) for s in sets]
                columns = [
                    part.column("at"),
                    part.column("doc_id"),
                    pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pc.cast(pc.binary_length(part.column("text")), pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    *(pa.array([x[k] for x in labels], pa.list_(pa.int64())) for k in (0, 1)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return _texts(docs, at).mapInArrow(
        run,
        "at struct<file:string,row:bigint>, doc_id long, digest binary, n_bytes long, n_grams long, keys array<long>, paths array<long>",
    )


def _texts(docs: DataFrame, at: Column) -> DataFrame:
    ship_package(docs.sparkSession)
    return docs.select(
        at.alias("at"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )


def candidate_runs(classes: DataFrame, trees: int, shortest: int, longest: int, few: float = FEW) -> DataFrame:
    """`digest`, `run`, `depth` and `size` of every run with candidates, one row per member.

    A run is looked at if some member's prefixes have its length.
    """
    depths = list(range(shortest, longest + 1))
    entries = classes.select("digest", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("paths").alias("path"))))
    entries = entries.toDF("digest", "key", "path")

    def upto(depth: int) -> Column:
        return F.shiftright("path", _BITS * (longest - depth))

    # Nodes of the longest prefixes, counted ahead of the shuffle; those of shorter ones are sums of them.
    nodes = entries.groupBy("key", "path").agg(F.count(F.lit(1)).alias("n"))
    sizes = [F.sum("n").over(Window.partitionBy("key", upto(d))).alias(f"size{d}") for d in depths]
    shared = nodes.select("key", "path", *sizes).where(F.col(f"size{shortest}") > 1)
    # Both sides grow with the corpus; a merge join at every size keeps the plan the same.
    found = stored(entries.join(shared.hint("merge"), ["key", "path"]), "trie-entries")
    # A tree in which a class shares no prefix holds it alone.
    mean = [((F.sum(f"size{d}") + trees - F.count(F.lit(1))) / trees).alias(f"mean{d}") for d in depths]
    # Runs of longer prefixes are parts of those of shorter ones, so the means only fall.
    chosen = F.coalesce(*(F.when(F.col(f"mean{d}") <= few, F.lit(d)) for d in depths[:-1]), F.lit(longest))
    own = found.groupBy("digest").agg(*mean).select("digest", chosen.alias("own_depth"))
    deep = found.join(own.hint("merge"), "digest")
    run = F.array(
        *(F.struct(F.lit(d).alias("depth"), F.xxhash64("key", upto(d), F.lit(d)).alias("run"), F.col(f"size{d}").alias("size")) for d in depths)
    )
    in_runs = deep.select("digest", "own_depth", F.inline(run)).where("size > 1")
    looked_at = in_runs.where("depth = own_depth").select("run").distinct()
    return in_runs.join(looked_at.hint("merge"), "run", "left_semi").select("digest", "run", "depth", "size")


def verified_units(runs: DataFrame, small: int = SMALL) -> DataFrame:
    """`digest`, `unit`, `dense` and `owners`: which classes are compared where.

    A unit is a small run or a group of dense ones. Of small runs with the same members the deepest one
    stays. `owners` lists the units of a class, dense ones first, then by falling depth: a pair
    belongs to the first one that both lists have.
    """
    stars = runs.where(F.col("size") > small).groupBy("run").agg(F.min("digest").alias("first"))
    edges = runs.where(F.col("size") > small).join(stars.hint("merge"), "run").select(F.col("digest").alias("a"), F.col("first").alias("b"))
    found = components(edges, "candidates")
    dense = found.select(F.col("node").alias("digest"), F.col("root")).union(
        found.select(F.col("root").alias("digest"), F.col("root")).distinct()
    )
    few = runs.where(F.col("size") <= small)
    members = few.groupBy("run").agg(
        F.max("depth").alias("depth"),
        F.count(F.lit(1)).alias("n"),
        *(F.expr(f"bit_xor(xxhash64(digest, {k}))").alias(f"x{k}") for k in (1, 2)),
    )
    kept = members.groupBy("n", "x1", "x2").agg(F.max(F.struct("depth", "run")).alias("kept")).select("kept.run")
    rank = F.struct(F.lit(False).alias("small"), F.lit(0).alias("depth"), F.xxhash64("root").alias("unit"))
    places = few.join(kept.hint("merge"), "run", "left_semi").select(
        "digest", F.struct(F.lit(True).alias("small"), (-F.col("depth")).alias("depth"), F.col("run").alias("unit")).alias("place")
    ).union(dense.select("digest", rank.alias("place")))
    places = stored(places, "trie-units")
    owners = places.groupBy("digest").agg(F.array_sort(F.collect_list("place")).alias("places"))
    return places.join(owners.hint("merge"), "digest").select(
        "digest", F.col("place.unit").alias("unit"), (~F.col("place.small")).alias("dense"), F.col("places.unit").alias("owners")
    )


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, `_CODES` of the shared values at a time."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    owner, code = owner[shared], code[shared]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    _, code = np.unique(code, return_inverse=True)
    common = np.zeros((n, n), np.float32)
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, _CODES):
        a, b = np.searchsorted(code, [first, first + _CODES])
        has = np.zeros((n, _CODES), np.float32)
        has[owner[a:b], code[a:b] - first] = 1
        common += has @ has.T
    return common.astype(np.int64)


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Matrix of the pairs whose Jaccard similarity reaches the threshold."""
    sizes = np.array([len(s) for s in sets], np.int64)
    common = common_counts(sets)
    links = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    np.fill_diagonal(links, False)
    return links


def _roots(links: np.ndarray) -> np.ndarray:
    """Least member of each one's component."""
    root = np.arange(len(links))
    reach = links | np.eye(len(links), dtype=bool)
    while True:
        least = np.where(reach, root[None, :], len(links)).min(axis=1)
        least = np.minimum(least, least[least])
        if (least == root).all():
            return root
        root = least


def owned(owners: list[list[int]], unit: int) -> np.ndarray:
    """Matrix of the pairs whose first common unit is this one."""
    ahead = [set(x[: list(x).index(unit)]) for x in owners]
    found = np.ones((len(owners), len(owners)), bool)
    for i, mine in enumerate(ahead):
        if mine:
            for j in range(i):
                found[i, j] = found[j, i] = mine.isdisjoint(ahead[j])
    return found


def _verify(n: int, threshold: float):
    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("digest", ignore_index=True)
        mine = np.ones((len(rows), len(rows)), bool)
        if not rows["dense"].iloc[0]:
            mine = owned(list(rows["owners"]), rows["unit"].iloc[0])
        elif rows["low"].iloc[0] != rows["high"].iloc[0]:  # two blocks: links within one are counted elsewhere
            block = rows["block"].to_numpy()
            mine = block[:, None] != block[None, :]
        texts = pa.RecordBatch.from_arrays([pa.array(rows["text"], pa.string())], ["text"])
        links = linked([s for part in slices(texts) for s in shingle_sets(part.column("text"), n)], threshold) & mine
        root = _roots(links)
        return pd.DataFrame({"digest": rows["digest"], "links": links.sum(axis=1), "root": rows["digest"].to_numpy()[root]})

    return verify


def near_groups(
    docs: DataFrame,
    n: int = N,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    max_depth: int = MAX_DEPTH,
    recall: float = TARGET_RECALL,
    block_docs: int = BLOCK_DOCS,
    block_bytes: int = BLOCK_BYTES,
    few: float = FEW,
    small: int = SMALL,
) -> DataFrame:
    """Per row: doc_id, class_id, n_links, n_copies, digest, its place `at` and the group's `first` row.

    `class_id` is the least id among all documents that links connect to this one, `n_links` the
    number of other n-gram sets that this one's reaches the threshold with, `n_copies` the
    number of rows with the same set, this one included.
    """
    longest = prefix_depth(threshold, trees, max_depth, recall)
    shortest = max(min(MIN_DEPTH, longest), longest - 60 // _BITS)
    docs, at = located(docs)
    rows = stored(signatures(docs, at, n, (trees, shortest, longest)), "signatures")
    in_order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at")
    # Texts without words are each a class of their own.
    classes = stored(
        rows.where("n_grams > 0")
        .groupBy("digest")
        .agg(
            F.min(in_order).alias("one"),
            F.max("n_bytes").alias("n_bytes"),
            F.count(F.lit(1)).alias("n_copies"),
            F.first("keys").alias("keys"),
            F.first("paths").alias("paths"),
        ),
        "classes",
    )
    runs = stored(candidate_runs(classes, trees, shortest, longest, few), "trie-runs")
    units = stored(verified_units(runs, small), "units")
    discard(runs)
    checked = stored(_checked(docs, at, classes, units, n, threshold, block_docs, block_bytes), "checked")
    discard(units)
    links = checked.groupBy("digest").agg(F.sum("links").alias("n_links"))
    joined = components(checked.select(F.col("digest").alias("a"), F.col("root").alias("b")), "links")
    grouped = (
        classes.select("digest", "one", "n_copies")
        .join(links, "digest", "left")
        .join(joined.withColumnRenamed("node", "digest"), "digest", "left")
        .select("digest", "one", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "digest").alias("root"))
    )
    named = stored(grouped, "classes-linked")
    discard(checked, classes)
    first = named.groupBy("root").agg(F.min("one").alias("first"))
    of_class = named.join(first, "root").select("digest", "first", "n_links", "n_copies")
    with_words = rows.where("n_grams > 0").select("doc_id", "digest", "at").join(of_class, "digest")
    alone = rows.where("n_grams = 0").select(
        "doc_id", "digest", "at", in_order.alias("first"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies")
    )
    return with_words.select(alone.columns).union(alone).select(
        "doc_id", F.col("first.doc_id").alias("class_id"), "n_links", "n_copies", "digest", "at", "first"
    )


def _checked(
    docs: DataFrame, at: Column, classes: DataFrame, units: DataFrame, n: int, threshold: float, block_docs: int, block_bytes: int
) -> DataFrame:
    """Links and local root of every class in every unit, once per pair of blocks it is in."""
    placed = units.join(classes.select("digest", F.col("one.at").alias("at"), "n_bytes").hint("merge"), "digest")
    sizes = placed.where("dense").groupBy("unit").agg(
        F.ceil(
            F.greatest(F.count(F.lit(1)) / F.lit(block_docs), F.sum("n_bytes") / F.lit(block_bytes))
        ).cast("int").alias("blocks")
    )
    # The members of a group look its size up under salted keys.
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")
    blocks = F.when(F.col("dense"), F.col("blocks")).otherwise(F.lit(1))
    dealt = placed.withColumn("salt", salt).join(salted, ["unit", "salt"], "left").drop("salt").withColumn("blocks", blocks)
    # One text row per class, however many units it is in.
    wanted = dealt.groupBy("at").agg(F.collect_list(F.struct("digest", "unit", "dense", "owners", "blocks")).alias("uses"))
    members = _texts(docs, at).select("at", "text").join(wanted.hint("merge"), "at").select("text", F.inline("uses"))
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    spread = members.select("*", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    paired = spread.select(
        "unit", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "digest", "dense", "owners", "text"
    )
    return paired.groupBy("unit", "dense", "low", "high").applyInPandas(_verify(n, threshold), "digest binary, links long, root binary")


def one_per_group(docs: DataFrame) -> DataFrame:
    """The documents without those that a link connects to one with a smaller id, all columns kept.

    Of rows with the same least id the one that stands first in the table stays; others that have its
    id, or none, go only if a link or an equal set connects them to it.
    """
    docs, at = located(docs)
    gone = near_groups(docs).where(F.col("at") != F.col("first.at")).select(F.col("at").alias("gone_at"))
    return docs.join(gone, at == F.col("gone_at"), "left_anti")
