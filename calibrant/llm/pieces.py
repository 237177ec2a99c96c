"""SentencePiece BPE encoding and decoding by suffix-array matching.

The distinct words of a batch are concatenated and indexed by a suffix array, sorted as far as
the longest piece reaches. Every piece is searched in it by bisection, all pieces at once; the
suffixes in its range are its occurrences. Each occurrence is an edge of a graph over the
text's positions. Edges are sorted by the position they end at and relaxed in that order: an
edge extends the encoding that ends where it starts, if the last piece there and its own piece
stay apart when they stand alone. By the way BPE merges, exactly one edge per position does, and
it is the last piece of the encoding up to there.

Two pieces stay apart unless a merge across their border comes before the merges that build
them. That is decided by walking down the right side of the one and the left side of the other;
pairs once decided are remembered.

Texts are cut into words ahead of a run of spaces, which is exact as long as no piece has a
space behind another character; loading a model checks that. Characters outside the vocabulary
are words of their own and become bytes.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from calibrant.llm.common import documents, ids_crc32, slices, spread
from calibrant.llm.word_tokens import IdStore
from calibrant.shipping import ship_package

SPACE = "▁"
# Words and pairs that a worker remembers; full tables are emptied.
CACHE_WORDS, CACHE_PAIRS = 150_000, 2_000_000
_NONE = -1


class Pieces:
    """A model's pieces as strings, and how each is built by merges."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.strings = [model.id_to_piece(i) for i in range(n)]
        special = np.array([model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)])
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(self.strings[i][3:5], 16)] = i
        self.normal = np.flatnonzero(~special)
        self.id_of = {self.strings[i]: int(i) for i in self.normal}
        self.score = np.array([model.get_score(i) for i in range(n)])
        self._check(model)
        self.known = {s for s in self.id_of if len(s) == 1}
        self.longest = max(len(s) for s in self.id_of)
        self._build_merges()

    def _check(self, model) -> None:
        if any(re.search(f"[^{SPACE}]{SPACE}", s) for s in self.id_of):
            raise ValueError("a piece has a space behind another character")
        if any(c not in self.id_of for s in self.id_of for c in s):
            raise ValueError("a piece has a character that is no piece")
        if model.encode(" a  b", out_type=str)[0][0] != SPACE or model.decode(model.encode(" a  b ")) != " a  b ":
            raise ValueError("the model normalizes spaces")
        if not self.byte_ids.any():
            raise ValueError("the model has no byte pieces")

    def _build_merges(self) -> None:
        """Left and right half of every piece that merges can build, and rank of every merge."""
        n = len(self.strings)
        order = np.argsort(-self.score[self.normal], kind="stable")
        self.rank = np.full(n, np.iinfo(np.int64).max)
        self.rank[self.normal[order]] = np.arange(len(order))
        pairs: dict[tuple[int, int], int] = {}
        for s, i in self.id_of.items():
            for k in range(1, len(s)):
                a, b = self.id_of.get(s[:k]), self.id_of.get(s[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        self.left, self.right = np.full(n, _NONE), np.full(n, _NONE)
        self.built = np.zeros(n, bool)
        for s, i in self.id_of.items():
            if len(s) == 1:
                self.built[i] = True
                continue
            parts = [self.id_of[c] for c in s]
            while len(parts) > 1:
                merges = [(self.rank[pairs[p]], k) for k, p in enumerate(zip(parts, parts[1:])) if p in pairs]
                if not merges:
                    break
                k = min(merges)[1]
                merged = pairs[parts[k], parts[k + 1]]
                if len(parts) == 2:
                    self.left[i], self.right[i], self.built[i] = parts[0], parts[1], True
                parts[k : k + 2] = [merged]
        keys = np.array([a * n + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[order], self.rank[np.array(list(pairs.values()))[order]]

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; the largest number if there is none."""
        key = a * len(self.strings) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], np.iinfo(np.int64).max)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b, one behind the other, are encoded as just these two.

        Undoes the merges of both, the latest first. While a border pair exists (both its
        pieces there), it must not be able to merge before the next of the two is used up.
        """
        result = np.ones(len(a), bool)
        none = np.iinfo(np.int64).max
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        # The merge that ends the time in which the border pair (x, y) stands.
        until = np.full(len(a), none)
        while len(live):
            merge = self.merge_rank(x, y)
            # On equal ranks the left one goes first, and the border lies right of x's merge.
            lost = merge < until
            result[live[lost]] = False
            go = ~lost & ((self.left[x] != _NONE) | (self.left[y] != _NONE))
            live, x, y, until = live[go], x[go], y[go], until[go]
            rank_x = np.where(self.left[x] != _NONE, self.rank[x], -1)
            rank_y = np.where(self.left[y] != _NONE, self.rank[y], -1)
            undo_x = rank_x > rank_y
            # x's own last merge is ahead of the border in the text, y's behind it: a border
            # merge of equal rank comes after the one and before the other.
            until = np.where(undo_x, rank_x, rank_y + 1)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return result


class Encoder:
    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.known_words = IdStore()
        self.pair_keys, self.pair_apart = np.zeros(0, np.int64), np.zeros(0, bool)
        inner = "".join(re.escape(c) for c in sorted({c for s in self.pieces.id_of if len(s) > 1 for c in s} - {SPACE}))
        # Characters that no longer piece has never merge: each is cut off as a word.
        self.cut = re.compile(f" +[{inner}]*|[{inner}]+|[^ {inner}]")
        codes = {ord(c): k + 1 for k, c in enumerate(sorted(self.pieces.known))}
        self.width = len(codes).bit_length()
        self.per_key = 62 // self.width
        self.codes = codes

    def _coded(self, text: str) -> np.ndarray:
        """Dense numbers of the characters; 0 for those outside the vocabulary."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        if not hasattr(self, "_table"):
            self._table = np.zeros(0x110000, np.int64)
            self._table[list(self.codes)] = list(self.codes.values())
            piece_text = "".join(self.pieces.strings[i] for i in self.pieces.normal)
            lengths = np.array([len(self.pieces.strings[i]) for i in self.pieces.normal])
            starts = np.cumsum(lengths) - lengths
            coded = self._table[np.frombuffer(piece_text.encode("utf-32-le"), np.uint32)]
            self._piece_keys = self._keys(coded, starts, lengths)
            self._piece_lengths = lengths
        return self._table[points]

    def _keys(self, coded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Columns of integers that compare as the strings do, `per_key` characters in each."""
        columns = -(-self.pieces.longest // self.per_key)
        padded = np.concatenate([coded, np.zeros(columns * self.per_key, np.int64)])
        keys = np.zeros((columns, len(starts)), np.int64)
        for k in range(columns * self.per_key):
            inside = np.where(k < lengths, padded[starts + k], 0)
            keys[k // self.per_key] = (keys[k // self.per_key] << self.width) | inside
        return keys

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start in the concatenation, piece and length of every occurrence of a piece in a word."""
        coded = self._coded("".join(words))
        lengths = np.array([len(w) for w in words])
        ends = np.repeat(np.cumsum(lengths), lengths)
        position = np.arange(len(coded))
        room = ends - position
        keys = self._keys(coded, position, room)
        array = np.lexsort(keys[::-1])
        rows = keys[:, array]
        # Suffixes as one column each: rank of their keys among all keys, pieces' bounds included.
        bounds_low = self._piece_keys
        bounds_high = self._upper(self._piece_keys, self._piece_lengths)
        low, high = self._bisect(rows, bounds_low), self._bisect(rows, bounds_high)
        counts = high - low
        start = array[spread(low, counts)]
        which = np.repeat(np.arange(len(counts)), counts)
        return start, self.pieces.normal[which], self._piece_lengths[which]

    def _upper(self, keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Least keys behind all strings that start with each piece."""
        high = keys.copy()
        column, place = (lengths - 1) // self.per_key, (lengths - 1) % self.per_key
        step = np.int64(1) << ((self.per_key - 1 - place) * self.width).astype(np.int64)
        high[column, np.arange(len(lengths))] += step
        return high

    @staticmethod
    def _bisect(rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """First suffix not below each wanted key, bisecting column by column."""
        low, high = np.zeros(wanted.shape[1], np.int64), np.full(wanted.shape[1], rows.shape[1], np.int64)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            at = np.minimum(middle, max(rows.shape[1] - 1, 0))
            below = np.zeros(len(low), bool)
            for c in range(len(rows) - 1, -1, -1):
                below = (rows[c][at] < wanted[c]) | ((rows[c][at] == wanted[c]) & below)
            low, high = np.where(open_ & below, middle + 1, low), np.where(open_ & ~below, middle, high)
        return low

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * len(self.pieces.strings) + b
        distinct, at = np.unique(key, return_inverse=True)
        place = np.minimum(np.searchsorted(self.pair_keys, distinct), max(len(self.pair_keys) - 1, 0))
        found = self.pair_keys[place] == distinct if len(self.pair_keys) else np.zeros(len(distinct), bool)
        answer = np.zeros(len(distinct), bool)
        answer[found] = self.pair_apart[place[found]]
        fresh = distinct[~found]
        if len(fresh):
            answer[~found] = self.pieces.apart(fresh // len(self.pieces.strings), fresh % len(self.pieces.strings))
            if len(self.pair_keys) > CACHE_PAIRS:
                self.pair_keys, self.pair_apart = np.zeros(0, np.int64), np.zeros(0, bool)
            keys = np.concatenate([self.pair_keys, fresh])
            values = np.concatenate([self.pair_apart, answer[~found]])
            order = np.argsort(keys, kind="stable")
            self.pair_keys, self.pair_apart = keys[order], values[order]
        return answer[at]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and how many each has."""
        words = [w.replace(" ", SPACE) for w in words]
        outside = {k: w for k, w in enumerate(words) if len(w) == 1 and w not in self.pieces.known}
        lengths = np.array([len(w) for w in words])
        first = np.cumsum(lengths) - lengths
        start, piece, length = self.edges(words)
        usable = self.pieces.built[piece]
        start, piece, length = start[usable], piece[usable], length[usable]
        total = int(lengths.sum())
        word = np.repeat(np.arange(len(words)), lengths)
        inside = start - first[word[start]]
        order = np.argsort(inside + length, kind="stable")
        start, piece, length, inside = start[order], piece[order], length[order], inside[order]
        # last[p]: the last piece of the encoding of its word up to and including character p.
        last = np.full(total, _NONE)
        steps = np.concatenate([[0], np.cumsum(np.bincount(inside + length, minlength=1))]) if len(start) else [0]
        for a, b in zip(steps[:-1], steps[1:]):
            if a == b:
                continue
            s, p, n, at_front = start[a:b], piece[a:b], length[a:b], inside[a:b] == 0
            behind = last[s - 1]
            fits = at_front.copy()
            check = np.flatnonzero(~at_front & (behind != _NONE))
            fits[check] = self._apart(behind[check], p[check])
            last[s[fits] + n[fits] - 1] = p[fits]
        return self._walk_back(words, outside, first, lengths, last)

    def _walk_back(self, words, outside, first, lengths, last) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(s) for s in self.pieces.strings])
        plain = np.ones(len(words), bool)
        plain[list(outside)] = False
        at = first + lengths - 1
        live = np.flatnonzero(plain & (lengths > 0))
        found_word, found_id = [], []
        at = at[live]
        while len(live):
            ids = last[at]
            if (ids == _NONE).any():
                raise ValueError("a word has no encoding")
            found_word.append(live)
            found_id.append(ids)
            at = at - size[ids]
            more = at >= first[live]
            live, at = live[more], at[more]
        for k, w in outside.items():
            data = self.pieces.byte_ids[list(w.encode())]
            found_word.extend(np.array([k]) for _ in data)
            found_id.extend(data[i : i + 1] for i in range(len(data) - 1, -1, -1))
        word = np.concatenate([np.zeros(0, np.int64), *found_word])
        ids = np.concatenate([np.zeros(0, np.int64), *found_id])
        # Found from each word's end to its start.
        order = np.lexsort((-np.arange(len(word)), word))
        return ids[order].astype(np.uint32), np.bincount(word, minlength=len(words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and where each starts."""
        if len(self.known_words.at) > CACHE_WORDS:
            self.known_words = IdStore()
        cut = [self.cut.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        distinct: dict[str, int] = {}
        at = [distinct.setdefault(w, len(distinct)) for words in cut for w in words]
        places = self.known_words.places(list(distinct), self.encode_words)[np.array(at, np.int64)]
        counts = self.known_words.counts[places]
        ids = self.known_words.ids[spread(self.known_words.starts[places], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, ends[np.cumsum([0, *map(len, cut)])]


class Decoder:
    def __init__(self, pieces: Pieces):
        self.bytes = [s.replace(SPACE, " ").encode() for s in pieces.strings]
        for value, i in enumerate(pieces.byte_ids.tolist()):
            self.bytes[i] = bytes([value])

    def decode(self, ids: np.ndarray) -> str:
        """The text; bytes that are no valid UTF-8 become replacement characters."""
        text = b"".join([self.bytes[i] for i in ids.tolist()]).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id and `ids`; an empty or missing text has none."""
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, offsets = encoder(path).encode(part.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], schema=out)

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """`doc_id` and `text` from rows of `doc_id` and `ids`."""
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(encoder(path).pieces)
        for batch in batches:
            texts = [decoder.decode(np.array(ids, np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], schema=out)

    ship_package(encoded.sparkSession)
    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_crc32, and whether decoding the ids gives the text back."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("same_text", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own = encoder(path)
                decoder = Decoder(own.pieces)
                texts = part.column("text").to_pylist()
                ids, offsets = own.encode(texts)
                each = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
                columns = [
                    part.column("doc_id"),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array([ids_crc32(x) for x in each], pa.int64()),
                    pa.array([decoder.decode(x) == t for x, t in zip(each, texts)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, same_text boolean")
