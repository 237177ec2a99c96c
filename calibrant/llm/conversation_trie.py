"""Prefix trie of conversations by burst tries.

1. Turns become 128-bit ids, digests of role and text; a conversation is the sequence of its ids.
2. All conversations start in one container under the root. A container with more than
   CONTAINER members bursts: its top becomes a head, members that end there stay with the head, and
   the others move on by their next turn's id to containers one turn deeper, of which they keep
   the suffix alone. Rounds go on while a container is oversized; a round touches only members of
   containers that burst.
3. The containers that remain are dealt to shards, sorted by their members' suffixes, and
   swept: a node opens where a suffix leaves the one before, and closes behind its last member.
4. Heads add up what the containers and heads below them hold.

Container sizes are counted ahead of the shuffle, and members look up whether theirs bursts under
salted keys, so a turn that most conversations share is in no task alone. The ids of conversations
that end at a head are sorted over all tasks and joined into runs; only the digest of the runs is
taken in order. One conversation's ids, 24 bytes a turn, are the unit that a task holds.

Missing roles and texts are empty. Turns come in the order of their numbers, missing ones
first; equal numbers in the order of the ids. Rows without a conversation id belong to no
conversation and are left out. Repeated rows are turns of their own. An empty table has no
nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from calibrant.llm.common import stored
from calibrant.shipping import ship_package

# Most members of a container, and copies of a burst container's key that members meet.
CONTAINER, SALTS = 256, 256
# Conversation ids in one run of a head's end digest.
_RUN = 4096

_TURNS = "array<struct<id:binary,chars:bigint>>"
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NODE_COLUMNS = [c.split()[0] for c in _NODE.split(", ")]


def turn_ids(role: Column, text: Column) -> Column:
    """16 bytes that tell turns apart: the start of a SHA-256 over role, its length, and text."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, 16)


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            turn_ids(role, text).alias("id"),
            F.char_length(text).cast("long").alias("chars"),
        ).alias("entry"),
    )


def _in_order(entries: Column) -> Column:
    return F.transform(F.array_sort(entries), lambda e: F.struct(e["id"].alias("id"), e["chars"].alias("chars")))


def sequences(conversations: DataFrame) -> DataFrame:
    """`conv_id` and `turns` as they are: ids and code points of the texts, in order."""
    return _turns(conversations).groupBy("conv_id").agg(_in_order(F.collect_list("entry")).alias("turns"))


def rebuilt_sequences(conversations: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """The same after each conversation's first h turns are replaced by those of its block's first one.

    Conversation c's block starts at c - c % `block`, h is crc32 of c's decimal digits % `most`.
    If that conversation is absent or shorter, so is the start. Turns are shuffled once, by block.
    """
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % most).cast("int")
    own = (
        _turns(conversations)
        .withColumn("block", c - c % block)
        .repartition("block")
        .groupBy("block", "conv_id")
        .agg(_in_order(F.collect_list("entry")).alias("turns"))
    )
    # At most `block` conversations meet in one window.
    start = F.max(F.when(c == F.col("block"), F.slice("turns", 1, most - 1))).over(Window.partitionBy("block"))
    none = F.array().cast(_TURNS)
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return own.withColumn("start", F.coalesce(start, none)).select(
        "conv_id", F.concat(F.slice("start", F.lit(1), h), rest).alias("turns")
    )


def _burst(rows: DataFrame, heads: DataFrame, depth: int, container: int, salts: int) -> tuple[DataFrame, DataFrame]:
    """The members of burst containers of `depth`, one turn on, and the containers to burst next."""
    next_turn = F.col("turns")[0]
    stepped = rows.where(F.size("turns") > 0).select(
        "conv_id",
        F.slice("turns", 2, F.size("turns")).alias("turns"),
        F.unhex(F.md5(F.concat("key", next_turn["id"]))).alias("key"),
        next_turn["chars"].alias("chars"),
        F.col("key").alias("parent"),
        F.col("first_conv").alias("parent_conv"),
    )
    sizes = stepped.groupBy("key", "parent", "parent_conv", "chars").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first_conv")
    )
    # Few beside the members, but they grow with the input.
    large = sizes.where(F.col("n") > container).join(
        heads.select(F.col("key").alias("parent"), "trail"), "parent"
    ).select("key", "parent_conv", "chars", "n", "first_conv", F.array_append("trail", F.col("parent")).alias("trail"))
    large = stored(large.withColumn("depth", F.lit(depth + 1).cast("long")), "trie-heads")
    marks = large.select("key", "first_conv", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = stepped.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(salts)).cast("int"))
    placed = salted.join(marks, ["key", "salt"], "left").drop("salt")
    return stored(placed, "trie-members"), large


class _Node:
    __slots__ = ("depth", "first", "n", "children", "leaves", "saved", "chars", "ends", "below")

    def __init__(self, depth: int, chars: int):
        self.depth, self.chars = depth, chars
        self.first, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends = None
        self.below: list[list] = []

    def end(self, conv_id: int) -> None:
        """A conversation ends here; they come in the order of their ids, ahead of the children."""
        if self.ends is None:
            self.ends, self.first = hashlib.sha256(b"%d" % conv_id), conv_id
        else:
            self.ends.update(b",%d" % conv_id)
        self.n += 1

    def close(self) -> list:
        """The node's row, without the parent's id, which its children's rows now get."""
        for row in self.below:
            row[2] = self.first
        ends = (self.ends or hashlib.sha256()).hexdigest()
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.chars
        return [self.first, self.depth, None, self.n, self.children, self.leaves, self.saved, ends]

    def add(self, child: _Node, row: list) -> None:
        self.first = child.first if self.first is None else min(self.first, child.first)
        self.n += child.n
        self.children += 1
        self.leaves += child.leaves
        self.saved += child.saved
        self.below.append(row)


def sweep(rows: Iterator[tuple]) -> Iterator[tuple[bytes, list[list]]]:
    """Container keys and the rows of their nodes, the top last.

    Input rows are (key, parent_conv, depth, chars, conv_id, ids, lengths), sorted by key, ids and conv_id.
    """
    key, parent_conv, before, path, found = None, None, [], [], []

    def close_to(length: int) -> None:
        while len(path) > length:
            node = path.pop()
            found.append(node.close())
            if path:
                path[-1].add(node, found[-1])
            else:
                found[-1][2] = parent_conv

    for row_key, row_parent, depth, chars, conv_id, ids, lengths in rows:
        if row_key != key:
            if path:
                close_to(0)
                yield key, found
            key, parent_conv, before, found = row_key, row_parent, [], []
            path.append(_Node(depth, chars))
        same = 0
        for a, b in zip(before, ids):
            if a != b:
                break
            same += 1
        close_to(same + 1)
        for i in range(same, len(ids)):
            path.append(_Node(depth + i + 1, lengths[i]))
        path[-1].end(conv_id)
        before = ids
    if path:
        close_to(0)
        yield key, found


def _swept(containers: DataFrame) -> DataFrame:
    """Nodes of all containers; a top also has its container's `key` and its parent's, `parent`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parents = {}

        def members():
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("key", "parent_conv", "depth", "chars", "conv_id", "ids", "lengths", "parent")]
                for *row, parent in zip(*columns):
                    parents.setdefault(row[0], parent)
                    yield tuple(row)

        found = []
        for key, nodes in sweep(members()):
            found.extend((*node, None) for node in nodes[:-1])
            found.append((*nodes[-1], parents.pop(key)))
            if len(found) >= 10_000:
                yield to_batch(found)
                found = []
        yield to_batch(found)

    def to_batch(found: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64()] * 7 + [pa.string(), pa.binary()]
        columns = list(zip(*found)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*NODE_COLUMNS, "parent"])

    in_order = (
        containers.select(
            "key", "parent", "parent_conv", "depth", "chars", "conv_id",
            F.col("turns.id").alias("ids"), F.col("turns.chars").alias("lengths"),
        )
        .repartition("key")
        .sortWithinPartitions("key", "ids", "conv_id")
    )
    return in_order.mapInArrow(run, f"{_NODE}, parent binary")


def end_digests(ends: DataFrame) -> DataFrame:
    """Per `key`: SHA-256 of its conversation ids in order, comma-joined, and never held whole."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def full() -> pa.RecordBatch:
            joined = ",".join(map(str, ids))
            return pa.RecordBatch.from_arrays(
                [pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([joined])], ["key", "first", "ids"]
            )

        for batch in batches:
            for k, conv_id in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (k != key or len(ids) >= _RUN):
                    yield full()
                    ids = []
                key = k
                ids.append(conv_id)
        if ids:
            yield full()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])

        for batch in batches:
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k == key:
                    digest.update(b"," + ids.encode())
                    continue
                if digest:
                    yield done()
                key, digest = k, hashlib.sha256(ids.encode())
        if digest:
            yield done()

    ship_package(ends.sparkSession)
    joined = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(
        runs, "key binary, first long, ids string"
    )
    return joined.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digests, "key binary, ends_sha256 string")


def _heads_summed(heads: DataFrame, tops: DataFrame, ends: DataFrame) -> DataFrame:
    """Node rows of the heads: what their own level, the heads and the containers below hold."""
    zero = F.lit(0).cast("long")
    upward = tops.select("parent", "n_leaves", "saved_tokens").groupBy("parent").agg(
        F.count(F.lit(1)).alias("tops"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    below = heads.where(F.size("trail") > 0).groupBy(F.element_at("trail", -1).alias("parent")).agg(
        F.count(F.lit(1)).alias("heads")
    )
    own = (
        heads.join(upward.withColumnRenamed("parent", "key"), "key", "left")
        .join(below.withColumnRenamed("parent", "key"), "key", "left")
        .withColumn("n_children", F.coalesce("tops", zero) + F.coalesce("heads", zero))
        .withColumn("own_leaves", F.coalesce("leaves", zero) + (F.col("n_children") == 0).cast("long"))
        .withColumn("own_saved", F.coalesce("saved", zero) + (F.col("n") - 1) * F.col("chars"))
    )
    subtree = (
        own.select(F.explode(F.array_append("trail", F.col("key"))).alias("key"), "own_leaves", "own_saved")
        .groupBy("key")
        .agg(F.sum("own_leaves").alias("n_leaves"), F.sum("own_saved").alias("saved_tokens"))
    )
    return (
        own.select("key", "first_conv", "depth", "parent_conv", "n", "n_children")
        .join(subtree, "key")
        .join(end_digests(ends), "key", "left")
        .select(
            F.col("first_conv").alias("conv_id"),
            "depth",
            F.col("parent_conv").alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )


def trie_nodes(members: DataFrame, container: int = CONTAINER, salts: int = SALTS) -> DataFrame:
    """Nodes of the prefix trie of `members`, rows (conv_id, turns) with unique ids.

    Per node: conv_id, the least of its members; depth; parent_conv_id; n_convs; n_children; n_leaves and
    saved_tokens of its subtree; ends_sha256 of the members that end there.
    """
    ship_package(members.sparkSession)
    none = F.lit(None).cast("long")
    # The root's name is stored with the rows, so that joins by it are joins like those below.
    rows = stored(
        members.select(
            "conv_id", "turns", F.lit("root").cast("binary").alias("key"), F.lit(0).cast("long").alias("chars"),
            F.lit(None).cast("binary").alias("parent"), none.alias("parent_conv"),
        ),
        "trie-conversations",
    )
    root = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first_conv"))
    root = root.where(F.col("n") > container).select(
        "key", none.alias("parent_conv"), F.lit(0).cast("long").alias("chars"), "n", "first_conv",
        F.array().cast("array<binary>").alias("trail"), F.lit(0).cast("long").alias("depth"),
    )
    large = stored(root, "trie-heads")
    burst = not large.isEmpty()
    first = large.select("first_conv").first()["first_conv"] if burst else None
    placed = rows.withColumn("first_conv", F.lit(first).cast("long"))
    depth, heads, containers, ends = 0, None, None, None

    def also(all_before: DataFrame | None, more: DataFrame) -> DataFrame:
        return more if all_before is None else all_before.unionByName(more)

    while True:
        kept = placed.where("first_conv IS NULL").withColumn("depth", F.lit(depth).cast("long"))
        containers = also(containers, kept.drop("first_conv"))
        if not burst:
            break
        heads = also(heads, large)
        inside = placed.where("first_conv IS NOT NULL")
        ends = also(ends, inside.where(F.size("turns") == 0).select("key", "conv_id"))
        placed, large = _burst(inside, large, depth, container, salts)
        burst = not large.isEmpty()
        depth += 1
    if heads is None:
        return _swept(containers).drop("parent")
    nodes = stored(_swept(containers), "trie-nodes")
    return nodes.drop("parent").union(_heads_summed(heads, nodes.where("parent IS NOT NULL"), ends))
