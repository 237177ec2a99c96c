"""Text quality by a generalized additive model with pairwise interactions.

Each feature has a lookup table over its bins and each chosen pair of features one over pairs of
bins. The tables are learned by cyclic boosting: round after round, one shallow tree per
feature is fitted to the gradient of the logistic loss and added, damped, to the feature's
table; then the same for the pairs that promise the largest gain. A score is the sigmoid of the
sum of the looked-up values, which a task adds up for a whole batch at once.

The model is fitted on the driver on at most TRAIN_ROWS labeled rows, chosen by a hash of the
id; everything else runs over all documents. Only the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from calibrant.llm.common import documents
from calibrant.shipping import ship_package

TRAIN_ROWS = 20_000
THRESHOLD = 0.7
BINS, PAIR_BINS, PAIRS = 32, 12, 6
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.1
_LEAST_ROWS, _DAMPING = 8.0, 4.0

FEATURES = [
    "log_words", "word_length", "upper_share", "symbols_per_word", "shouts_per_word", "bars_per_word",
    "digit_share", "stops_per_word", "distinct_share", "same_neighbor_share", "distinct_pair_share",
    "repeated_line_share", "log_line_words", "short_share", "other_bytes_share", "log_longest_word",
]

_UPPER, _LOWER, _DIGITS = (np.frombuffer(x, np.uint8) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"))
_SYMBOLS, _STOPS = np.frombuffer(b"#*$%&<>@^~=_\\{}[]", np.uint8), np.frombuffer(b".,;:?", np.uint8)
# Distinct words are counted over runs of this length, so the share does not sink as texts grow.
_RUN = 200


def features(text: str) -> list[float]:
    """Features of one whole text; an empty one has zeros throughout."""
    data = text.encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower = counts[_UPPER].sum(), counts[_LOWER].sum()
    lengths = np.fromiter(map(len, words), np.int64, n)
    runs = range(0, n, _RUN)
    pairs = list(zip(words, words[1:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        np.log1p(n),
        lengths.mean(),
        upper / max(upper + lower, 1),
        counts[_SYMBOLS].sum() / n,
        counts[ord("!")] / n,
        counts[ord("|")] / n,
        counts[_DIGITS].sum() / len(data),
        counts[_STOPS].sum() / n,
        sum(len(set(words[i : i + _RUN])) for i in runs) / n,
        sum(a == b for a, b in pairs) / n,
        (sum(len(set(pairs[i : i + _RUN])) for i in runs) / len(pairs)) if pairs else 1.0,
        1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        (lengths <= 3).mean(),
        counts[128:].sum() / len(data),
        np.log1p(lengths.max()),
    ]


@dataclass
class Model:
    """Lookup tables. `cuts` and `pair_cuts` are the upper edges of the bins of each feature."""

    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of a good text for each row of features."""
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[f], x[:, f])]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.pair_cuts[a], x[:, a]), np.searchsorted(self.pair_cuts[b], x[:, b])]
        return 1 / (1 + np.exp(-total))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def _best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray):
    """Gain, axis and bin of the best cut of a box of bins."""
    best = (1e-9, None, None)
    whole = g.sum() ** 2 / (h.sum() + _DAMPING)
    for axis in range(g.ndim):
        other = tuple(i for i in range(g.ndim) if i != axis)
        left_g, left_h, left_n = (np.cumsum(v.sum(axis=other))[:-1] for v in (g, h, n))
        if not len(left_g):
            continue
        right_g, right_h, right_n = g.sum() - left_g, h.sum() - left_h, n.sum() - left_n
        gain = left_g**2 / (left_h + _DAMPING) + right_g**2 / (right_h + _DAMPING) - whole
        gain[(left_n < _LEAST_ROWS) | (right_n < _LEAST_ROWS)] = 0
        at = int(np.argmax(gain))
        if gain[at] > best[0]:
            best = (gain[at], axis, at + 1)
    return best


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> tuple[np.ndarray, float]:
    """Leaf value of every bin for a tree on the binned gradients, and the gain of its cuts."""
    gain, axis, at = _best_split(g, h, n) if depth else (0.0, None, None)
    if axis is None:
        return np.full(g.shape, g.sum() / (h.sum() + _DAMPING)), 0.0
    sides = [
        shallow_tree(*(np.take(v, part, axis=axis) for v in (g, h, n)), depth - 1)
        for part in (range(at), range(at, g.shape[axis]))
    ]
    return np.concatenate([s[0] for s in sides], axis=axis), gain + sum(s[1] for s in sides)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Lookup tables for labels 0/1. One class or no rows at all give a constant score."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return model
    count = x.shape[1]
    model.cuts = [_edges(x[:, f], BINS) for f in range(count)]
    model.pair_cuts = [_edges(x[:, f], PAIR_BINS) for f in range(count)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, x[:, f]) for f, c in enumerate(model.cuts)]
    total = np.full(len(y), model.base)

    def binned(index: np.ndarray, shape: tuple[int, ...]):
        chance = 1 / (1 + np.exp(-total))
        weights = (y - chance, chance * (1 - chance), None)
        return [np.bincount(index, w, int(np.prod(shape))).astype(float).reshape(shape) for w in weights]

    for _ in range(ROUNDS):
        for f in range(count):
            step = RATE * shallow_tree(*binned(bins[f], model.tables[f].shape))[0]
            model.tables[f] += step
            total += step[bins[f]]

    coarse = [np.searchsorted(c, x[:, f]) for f, c in enumerate(model.pair_cuts)]
    shapes = {(a, b): (len(model.pair_cuts[a]) + 1, len(model.pair_cuts[b]) + 1) for a in range(count) for b in range(a + 1, count)}
    index = {(a, b): coarse[a] * shape[1] + coarse[b] for (a, b), shape in shapes.items()}
    gains = {p: shallow_tree(*binned(index[p], shapes[p]))[1] for p in shapes}
    model.pairs = sorted(shapes, key=lambda p: (-gains[p], p))[:PAIRS]
    model.pair_tables = [np.zeros(shapes[p]) for p in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, p in enumerate(model.pairs):
            step = RATE * shallow_tree(*binned(index[p], shapes[p]))[0]
            model.pair_tables[k] += step
            total += step.ravel()[index[p]]
    return model


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Model of `labels.quality`, from at most `rows` labeled documents outside the held-out ones.

    Labels that are missing or have no document teach nothing.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(found, pa.list_(pa.float64()))],
                ["doc_id", "quality", "features"],
            )

    # At most `rows` small rows on either side of the broadcast and back to the driver: of documents
    # that repeat an id, one teaches.
    sample = documents(docs).join(F.broadcast(chosen), "doc_id")
    measured = sample.mapInArrow(run, "doc_id long, quality int, features array<double>")
    found = sorted(map(tuple, measured.groupBy("doc_id", "quality").agg(F.min("features")).collect()))
    return fit(np.array([r[2] for r in found]).reshape(-1, len(FEATURES)), np.array([r[1] for r in found], float))


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """`doc_id`, `held_out`, `score` and `predicted` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    scored = documents(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    return model.score(np.array([features(t or "") for t in texts.to_pylist()]).reshape(-1, len(FEATURES)))


def scorer(model: Model):
    """A function of a text column that gives scores; a missing text counts as empty."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(_scores(model, texts))

    return score


def good_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text reaches the threshold, with all their columns."""
    ship_package(docs.sparkSession)
    return docs.where(scorer(model)(F.coalesce("text", F.lit(""))) >= threshold)
