"""Token counts of whole texts.

Before any text is read, every vocabulary string is encoded alone once; those that come out as
one token are proven. In the texts a part of a word that is such a string counts one and is not
merged; only the distinct rest goes through the library's merges. The list is proven once per
vocabulary file and worker, from the file alone.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from calibrant.llm.common import documents, slices
from calibrant.llm.word_tokens import PartEncoder, cuts_at_spaces, load, plain, word_occurrences, word_parts

LIMIT_TOKENS = 2048
# Counts of merged parts that a worker remembers; a full table is emptied.
CACHE_PARTS = 250_000


def proven_strings(path: str) -> list[str]:
    """Parts of words that encode alone as one token."""
    encoder = PartEncoder(path)
    ending = [t[: -len("</w>")] for t in encoder.bare.get_vocab() if t.endswith("</w>")]
    ascii_ones = sorted(t for t in ending if t and t.isascii() and pc.all(plain(pa.array([t]))).as_py() and t == t.lower())
    _, counts = encoder.encode(ascii_ones)
    return [t for t, n in zip(ascii_ones, counts) if n == 1]


class TokenCounter:
    def __init__(self, path: str, cache_parts: int = CACHE_PARTS):
        self.full, self.cache_parts = load(path), cache_parts
        self.by_word = cuts_at_spaces(path)
        if self.by_word:
            self.parts = PartEncoder(path)
            self.proven = pa.array(proven_strings(path), pa.string())
            self._empty()

    def _empty(self) -> None:
        self.merged: dict[str, int] = {}

    def _counts(self, keys: list[str], encode) -> np.ndarray:
        """Counts of distinct strings; those not met before go through `encode` together."""
        fresh = [k for k in keys if k not in self.merged]
        if fresh:
            self.merged.update(zip(fresh, encode(fresh)))
        return np.array([self.merged[k] for k in keys], np.int64)

    def _library(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]

    def word_counts(self, words: pa.Array) -> np.ndarray:
        if len(self.merged) > self.cache_parts:
            self._empty()
        easy = plain(words)
        split = word_parts(words.filter(easy))
        coded = pc.dictionary_encode(split.flatten())
        distinct = coded.dictionary
        whole = pc.is_in(distinct, value_set=self.proven).to_numpy(zero_copy_only=False)
        empty = pc.equal(distinct, "").to_numpy(zero_copy_only=False)
        counts = whole.astype(np.int64)
        rest = ~whole & ~empty
        counts[rest] = self._counts(distinct.filter(pa.array(rest)).to_pylist(), lambda p: self.parts.encode(p)[1].tolist())
        before = np.concatenate([[0], np.cumsum(counts[coded.indices.to_numpy()])])
        mask = easy.to_numpy(zero_copy_only=False)
        result = np.zeros(len(words), np.int64)
        result[mask] = np.diff(before[split.offsets.to_numpy()])
        # Upper-case or spaced keys cannot meet the parts' keys: odd words are none of those.
        result[~mask] = self._counts(words.filter(pc.invert(easy)).to_pylist(), self._library)
        return result

    def count(self, texts: pa.Array) -> np.ndarray:
        if not self.by_word:
            return np.array(self._library(texts.to_pylist()), np.int64)
        words, at, offsets = word_occurrences(texts)
        counts = self.word_counts(words)
        before = np.concatenate([[0], np.cumsum(counts[at])])
        return np.diff(before[offsets])


@functools.lru_cache(maxsize=2)
def token_counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT_TOKENS) -> DataFrame:
    """Bytes and tokens of every document and whether it has more tokens than `limit`.

    One row per input row; a missing text counts as empty, a missing id stays missing.
    """
    out = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(path)
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text")
                n = counter.count(texts)
                size = pc.cast(pc.binary_length(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n), pa.array(n > limit)], schema=out)

    return documents(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
