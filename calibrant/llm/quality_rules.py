"""Quality rules: counts of each text, and lines that too many documents of a host share.

Lines are normalized (lower case, digits to 0, single spaces) and hashed. For each host the
distinct documents that have a line are counted, equal texts once. Lines above both limits are
removed: a share of the host's documents, which means the same for hosts and tables of every size,
and MIN_DOCS documents, below which a share says nothing. A document that lost words and has too
few left, or too small a share of its words, is depleted and rejected.

A host has at most 1 / SHARE times the lines of its average document above the limit, so the
removed lines are few; they are still joined without a broadcast, since hosts are many.

Defined cases: a missing text has no words and fails the base rules; a missing host is one host, the
empty one another; rows with missing or equal ids are separate rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from calibrant.llm.common import located, stored
from calibrant.shipping import ship_package

REPEAT_WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
MIN_DOCS, SHARE = 4, 0.05
MIN_WORDS_LEFT, MIN_SHARE_LEFT = 10, 0.3

_SPACE, _SYMBOLS = b" \t\n\x0b\f\r", b"#*$%&|<>"
_DIGITS = re.compile(r"\d")


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words inside windows that occur twice or more in the text, the first time included.

    Ranks of runs are doubled, 1, 2, 4, 8 words, so equal ranks mean equal words. `window` is a
    power of two.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    rank = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    run = 1
    while run < window:
        pairs = rank[:-run] * (int(rank.max()) + 1) + rank[run:]
        _, rank, count = np.unique(pairs, return_inverse=True, return_counts=True)
        run *= 2
    starts = np.flatnonzero(count[rank] > 1)
    ends = np.zeros(len(words) + 1, np.int64)
    np.add.at(ends, starts, 1)
    np.add.at(ends, starts + window, -1)
    return int((np.cumsum(ends) > 0).sum())


def line_hash(line: bytes) -> int:
    normal = _DIGITS.sub("0", " ".join(line.decode().lower().split()))
    return xxhash.xxh64_intdigest(normal) - (1 << 63)


def measure(text: str) -> dict:
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(_SPACE)]
    counted: dict[int, int] = {}
    for line in lines:
        key = line_hash(line)
        counted[key] = counted.get(key, 0) + len(line.split())
    return {
        "n_words": len(words),
        "word_chars": len(text) - (len(data) - len(data.translate(None, _SPACE))),
        "n_symbols": len(data) - len(data.translate(None, _SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
        "content": xxhash.xxh64_intdigest(data) - (1 << 63),
        "lines": [{"line": k, "words": n} for k, n in counted.items()],
    }


_SCHEMA = (
    "at struct<file: string, row: long>, doc_id long, host string, n_words long, word_chars long, n_symbols long,"
    " n_dup_lines long, n_repeat_words long, content long, lines array<struct<line: long, words: long>>"
)


def measured(docs: DataFrame, host_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Counts and line hashes of every row, without its text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship_package(docs.sparkSession)
    docs, place = located(docs)
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], _SCHEMA).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t) for t in batch.column("text").to_pylist()]
            own = [batch.column(c) for c in ("at", "doc_id", "host")]
            rest = [pa.array([f[c] for f in found], schema.field(c).type) for c in schema.names[3:]]
            yield pa.RecordBatch.from_arrays(own + rest, schema=schema)

    return docs.select(
        place.alias("at"),
        F.col(id_col).cast("long").alias("doc_id"),
        # A name has a mark ahead, so that the empty one is not the missing one.
        F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("")).alias("host"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).mapInArrow(run, _SCHEMA)


def frequent_lines(rows: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """`host` and `line` of lines in at least `min_docs` documents and more than that share of the host's."""
    contents = rows.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    # Distinct first, by all three columns, so that no line's documents meet in one task.
    having = rows.select("host", "content", F.explode("lines.line").alias("line")).distinct()
    counted = having.groupBy("host", "line").agg(F.count(F.lit(1)).alias("line_docs"))
    often = counted.where(F.col("line_docs") >= min_docs).join(contents, "host")
    return often.where(F.col("line_docs") > share * F.col("host_docs")).select("host", "line")


def judge(
    docs: DataFrame, host_col: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE,
    min_words_left: int = MIN_WORDS_LEFT, min_share_left: float = MIN_SHARE_LEFT,
) -> DataFrame:
    """Per row: locator, doc_id, the counts, base_failed, n_removed_words, removed_lines, depleted, kept."""
    rows = stored(measured(docs, host_col), "line-counts")
    lines = rows.select("at", "host", F.inline("lines"))
    removed = (
        lines.join(frequent_lines(rows, min_docs, share), ["host", "line"])
        .groupBy("at")
        .agg(F.sum("words").alias("n_removed_words"), F.collect_list("line").alias("removed_lines"))
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    gone = F.coalesce("n_removed_words", F.lit(0))
    left = F.col("n_words") - gone
    depleted = (gone > 0) & ((left < min_words_left) | (left < min_share_left * F.col("n_words")))
    return rows.select("at", "doc_id", *counts).join(removed, "at", "left").select(
        "at", "doc_id", *counts, failed.alias("base_failed"), gone.alias("n_removed_words"), "removed_lines",
        depleted.alias("depleted"), (~failed & ~depleted).alias("kept"),
    )


def cleaned_documents(docs: DataFrame, host_col: str = "source", **limits) -> DataFrame:
    """The kept rows with all their columns, their text without the lines above the limits."""
    verdicts = judge(docs, host_col, **limits)
    docs, place = located(docs)
    kept = verdicts.where("kept").select(F.col("at").alias("_at"), F.col("removed_lines").alias("_gone"))

    @F.arrow_udf("string")
    def without(texts: pa.Array, gone: pa.Array) -> pa.Array:
        cut = []
        for text, lines in zip(texts.to_pylist(), gone.to_pylist()):
            drop = set(lines or [])
            kept_lines = [x for x in (text or "").split("\n") if not drop or not x.strip(_SPACE.decode()) or line_hash(x.encode()) not in drop]
            cut.append("\n".join(kept_lines))
        return pa.array(cut, pa.string())

    joined = docs.join(kept, place == kept["_at"])
    text = F.when(kept["_gone"].isNull(), docs["text"]).otherwise(without(docs["text"], kept["_gone"]))
    return joined.select(*(text.alias(c) if c == "text" else docs[c] for c in docs.columns))
