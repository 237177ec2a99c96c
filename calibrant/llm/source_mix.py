"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a budget of words: its weight's share of all words, but at most LIMIT times its own
size; what a source cannot take is shared out again by weight until none is above its limit. A
source takes as many complete epochs as its budget holds. For the rest its documents stand in
the order of their exponential keys, -ln(u) / quality with u drawn from a hash of the row, and are
taken from the front as long as the middle of a document lies within the budget.

No task needs a whole source. Keys are cut into cells of equal width in the logarithm, so that a
cell holds at most about one in a thousand of a source's documents whatever their qualities are. The
cells of a source are summed in order, and only within a cell are the rows sorted.

A missing text is empty; a text without words has size 0 and takes nothing. A missing source is
one of its own, behind all others; the empty one is a source like others. A missing quality
counts as the least one. A missing id is an id like others. Equal rows are told apart by their
place in the table, so some of them may be taken and others not. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from calibrant.llm.common import located, stored

# Weights of the sources by rank, repeating, and how often a source may be used up.
WEIGHTS, LIMIT = (5, 2, 1), 3
SEED = 20_240_913
# The least quality: a document of quality 0 is taken last, but not never.
LEAST_QUALITY = 0.01
_WORD = r"[^\x20\x09-\x0D]+"
# Cells of keys per doubling of the key.
_CELLS = 256


def sample_keys(row_hash: Column, quality: Column) -> Column:
    """Exponential keys: the smaller, the earlier a row is taken."""
    # 52 of the hash's bits, put in the middle of their interval: neither 0 nor 1.
    u = (F.shiftrightunsigned(row_hash, 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / F.greatest(F.coalesce(quality, F.lit(0.0)), F.lit(LEAST_QUALITY))


def keyed_documents(docs: DataFrame, quality: Column | None = None, seed: int = SEED) -> DataFrame:
    """Per row: at, doc_id, source, size in words, sampling key and the key's cell."""
    docs, at = located(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        at.alias("at"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.struct("source").alias("source"),  # in a struct a missing source also joins
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("size"),
        sample_keys(F.xxhash64(F.lit(seed), "doc_id", text), F.lit(1.0) if quality is None else quality).alias("sample_key"),
    )
    return rows.withColumn("cell", F.floor(F.log2("sample_key") * _CELLS).cast("int"))


def ranked_sources(rows: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """`source`, `source_size` and `weight`; sources rank by code point, a missing one last.

    The sources are sorted over all tasks; the rank is a row's place in its part of the sorted
    table behind the sizes of the parts before.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = sizes.orderBy(F.col("source.source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id())
    in_order = stored(in_order, "sources")
    part = F.shiftright("place", 33).alias("part")
    parts = in_order.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.col("ahead") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    return in_order.withColumn("part", part).join(parts.select("part", ahead.alias("ahead")), "part").select(
        "source", "source_size", weight.cast("long").alias("weight")
    )


def _exact(value: Column) -> Column:
    return value.cast("decimal(19,0)")


def with_targets(sources: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds `target`: equal shares by weight, none above `limit` times its source's size.

    The share of one unit of weight is what is left beside the full sources, over the weight of the
    others. It only grows as sources are found full, so rounds end when no more is. A round brings
    three numbers to the driver, exact ones.
    """
    total, full, weight, seen = 0, 0, 0, None
    is_full = F.lit(False)
    while seen != (full, weight):
        seen = full, weight
        total, full, weight = (
            int(x or 0)
            for x in sources.agg(
                F.sum(_exact(F.col("source_size"))),
                F.sum(F.when(is_full, _exact(F.col("source_size")) * limit)),
                F.sum(F.when(~is_full, _exact(F.col("weight")))),
            ).first()
        )
        if not weight:
            break
        left, of = F.lit(Decimal(total - full)), F.lit(Decimal(weight))
        is_full = _exact(F.col("source_size")) * limit * of <= left * _exact(F.col("weight"))
    share = F.lit(float(total - full)) * F.col("weight") / F.lit(float(weight or 1))
    most = F.col("source_size").cast("double") * limit
    return sources.withColumn("target", F.when(is_full, most).otherwise(F.least(share, most)))


def mix(
    docs: DataFrame,
    quality: Column | None = None,
    weights: Sequence[int] = WEIGHTS,
    limit: int = LIMIT,
    seed: int = SEED,
) -> DataFrame:
    """Per row: at, doc_id, source, size, source_size, target, `copies` to use and words `taken`.

    `quality` scores a row of `docs` from 0 to 1; without it all are alike. The same table and
    seed give the same result.
    """
    rows = stored(keyed_documents(docs, quality, seed), "sample-keys")
    sources = with_targets(stored(ranked_sources(rows, weights), "source-weights"), limit)
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # Sources and their cells are few beside the rows, but grow: a merge join at every size.
    placed = cells.select("source", "cell", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead")).join(
        sources.hint("merge"), "source"
    )
    in_cell = Window.partitionBy("source", "cell").orderBy("sample_key", "doc_id", "at")
    ahead = F.col("ahead") + F.coalesce(F.sum("size").over(in_cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    epochs = F.coalesce(F.least(F.floor(F.try_divide("target", "source_size")), F.lit(limit)), F.lit(0))
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    copies = F.col("epochs") + (F.col("ahead") + F.col("size") / 2 <= left).cast("long")
    return (
        rows.join(placed.hint("merge"), ["source", "cell"])
        .select("at", "doc_id", "source.source", "size", "source_size", "target", epochs.alias("epochs"), ahead.alias("ahead"))
        .withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.col("epochs")))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("epochs", "ahead")
    )


def mixed_documents(docs: DataFrame, quality: Column | None = None, **options) -> DataFrame:
    """The rows that the mix takes, all columns kept, each as often as it is taken."""
    docs, at = located(docs)
    copies = mix(docs, quality, **options).where("copies > 0").select("at", F.col("copies").alias("n"))
    names = [f"`{c}`" for c in docs.columns]
    whole = docs.select(F.struct(*names).alias("row"), at.alias("at")).join(copies, "at")
    return whole.select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")
