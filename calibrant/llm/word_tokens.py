"""Ids of whole texts from ids of their distinct words.

The vocabulary file `word_bpe_49k.json` drops white space and never lets a token cross it, so
the ids of a text are those of its space-delimited words in a row. Words repeat; each distinct
one is encoded once by the tokenizers library and looked up afterwards. Other vocabulary files
are encoded text by text.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from calibrant.llm.common import spread

END_ID = 1
# Parts of words that a worker remembers; a full table is emptied, which costs time and nothing else.
CACHE_PARTS = 250_000
_JOINED = 512

# Latin-1 words: no character here is white space, combines, or lowers depending on its neighbors.
_PLAIN = "^[!-~\xa1-\xac\xae-\xff]+$"
# The pattern that cuts words, for lower-case Latin-1.
_LETTERS, _DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_CUT = f"('s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+)"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts_at_spaces(path: str) -> bool:
    """Whether the file normalizes and cuts as described above."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
    cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        and cuts[0]["behavior"] == "Removed"
        and cuts[0]["invert"]
        and spec["model"]["end_of_word_suffix"] == "</w>"
        and not any(c.isspace() for t in spec["added_tokens"] for c in t["content"])
    )


def load(path: str):
    """The library's tokenizer, with neither truncation nor padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def word_occurrences(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the word index of every occurrence, and where each text's occurrences start."""
    split = pc.ascii_split_whitespace(texts)
    coded = pc.dictionary_encode(split.flatten())
    offsets = split.offsets.to_numpy().astype(np.int64)
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), offsets - offsets[0]


def plain(words: pa.Array) -> pa.Array:
    """Whether the pattern for Latin-1 cuts the word as the library does."""
    return pc.and_not(pc.match_substring_regex(words, _PLAIN), pc.match_substring(words, "<|"))


def word_parts(words: pa.Array) -> pa.ListArray:
    """Lower-cased parts of plain words, in the order of the word."""
    return pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(words), _CUT, "\\1 "))


class PartEncoder:
    """Encodes parts of words (already normalized and cut) many at a time."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        self.bare = load(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocab = self.bare.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts in a row and how many each has. A part's last id is one that ends a word."""
        joined = [" ".join(parts[i : i + _JOINED]) for i in range(0, len(parts), _JOINED)]
        encoded = self.bare.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in encoded)])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(parts):
            raise ValueError("the vocabulary does not mark where words end")
        return ids, np.diff(ends, prepend=0)


class IdStore:
    """Id runs of strings, back to back in one array. The empty string has none."""

    def __init__(self):
        self.at = {"": 0}
        self.starts, self.counts = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, keys: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids])
        self.at.update(zip(keys, range(len(self.at), len(self.at) + len(keys))))

    def places(self, keys: list[str], encode) -> np.ndarray:
        """Place of each of the distinct keys; `encode` gives ids and counts of those not yet known."""
        get = self.at.get
        found = [get(k, -1) for k in keys]
        fresh = [k for k, place in zip(keys, found) if place < 0]
        if fresh:
            first = len(self.at)
            self.learn(fresh, *encode(fresh))
            places = np.array(found, np.int64)
            places[places < 0] = np.arange(first, first + len(fresh))
            return places
        return np.array(found, np.int64)


class WordTokens:
    def __init__(self, path: str, cache_parts: int = CACHE_PARTS):
        self.full = load(path)
        self.by_word = cuts_at_spaces(path)
        self.cache_parts = cache_parts
        if self.by_word:
            self.parts = PartEncoder(path)
        self.known, self.known_odd = IdStore(), IdStore()

    def _encode_odd(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.full.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, not in order, and where each word's ids start and how many they are."""
        if len(self.known.at) > self.cache_parts:
            self.known = IdStore()
        if len(self.known_odd.at) > self.cache_parts:
            self.known_odd = IdStore()
        easy = plain(words).to_numpy(zero_copy_only=False)
        split = word_parts(words.filter(pa.array(easy)))
        coded = pc.dictionary_encode(split.flatten())
        places = self.known.places(coded.dictionary.to_pylist(), self.parts.encode)[coded.indices.to_numpy()]
        part_starts, part_counts = self.known.starts[places], self.known.counts[places]
        ids = self.known.ids[spread(part_starts, part_counts)]
        ends = np.concatenate([[0], np.cumsum(part_counts)])[split.offsets.to_numpy()]
        odd = self.known_odd.places(words.filter(pa.array(~easy)).to_pylist(), self._encode_odd)
        starts, counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        starts[easy], counts[easy] = ends[:-1], np.diff(ends)
        starts[~easy], counts[~easy] = len(ids) + self.known_odd.starts[odd], self.known_odd.counts[odd]
        return np.concatenate([ids, self.known_odd.ids]), starts, counts

    def encode(self, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each followed by `end_id` if given, and where each text starts."""
        if not self.by_word:
            ids, counts = self._encode_odd(texts.to_pylist())
            offsets = np.concatenate([[0], np.cumsum(counts)])
            if end_id is not None:
                ids = np.insert(ids, offsets[1:], end_id)
                offsets = offsets + np.arange(len(offsets))
            return ids, offsets
        words, at, offsets = word_occurrences(texts)
        ids, starts, counts = self.word_ids(words)
        starts, counts = starts[at], counts[at]
        if end_id is not None:
            starts = np.insert(starts, offsets[1:], len(ids))
            counts = np.insert(counts, offsets[1:], 1)
            ids = np.append(ids, np.uint32(end_id))
            offsets = offsets + np.arange(len(offsets))
        return ids[spread(starts, counts)], np.concatenate([[0], np.cumsum(counts)])[offsets]


@functools.lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """One per worker process and file."""
    return WordTokens(path)
