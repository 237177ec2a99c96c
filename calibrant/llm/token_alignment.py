"""Alignment of two tokenizers' tokens over the same texts.

Texts are encoded by A, a byte-level BPE, with a space ahead, and by B, a SentencePiece model,
which adds that space itself. Byte offsets where a token of both ends cut a text into groups;
every A and B token of a group are linked. A pair of ids counts the documents that hold it linked.

Most groups are one A token and one B token with the same bytes. An identity map, from A id to
the B id of the same bytes, is made ahead, and pairs in it are counted in vectors as long as A's
vocabulary, one per task. Only the other pairs are shuffled. To score a document by its pairs'
counts, the HEAD most frequent of these go to all tasks beside the vectors, which bounds how many
rows any other pair has, and the rest is joined. Texts are encoded once; the joins work on the
stored ids.

Both encodings fall apart where a space or a line end follows a character that is no white
space, so texts are cut there and each distinct piece is aligned once per worker. What that relies
on is checked when the files are loaded; with other files, and in texts with a piece whose bytes do
not come out, whole texts are aligned.

A missing or empty text has no tokens, nor has one whose tokens' bytes differ from it, such as a text
with the character that B writes for a space. Rows with the same or a missing id are documents
of their own. A very long text or piece is aligned as a whole. An empty table gives empty results.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from calibrant.llm.common import documents, slices, spread, stored
from calibrant.shipping import ship_package

SPACE = "▁"
# Pairs outside the identity map whose counts are sent to all tasks, and distinct pieces and
# characters of aligned pieces that a worker remembers; full tables are emptied.
HEAD = 65_536
CACHE_PIECES, CACHE_CHARS = 300_000, 40_000_000
# Characters that one step of a task aligns, and that one call of a library encodes, at least one text.
_STEP, _CALL = 1_500_000, 20_000
# Groups with more links than this are linked by distinct ids.
_MANY = 4096

_OTHER_SPACE = re.compile(r"[^\S \n]")
_PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def pieces(text: str) -> list[str]:
    """The text cut ahead of each space or line end behind a character that is no white space."""
    return _CUT.split(text) if _OTHER_SPACE.search(text) else _PIECE.findall(text)


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies show printable Latin-1 bytes as they are, and the others from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class SideA:
    def __init__(self, path: str):
        from calibrant.llm.word_tokens import load

        self.tokenizer = load(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = spec["pre_tokenizer"] or {}
        self.cuts = spec["normalizer"] is None and steps.get("type") == "ByteLevel" and steps.get("use_regex") and not steps.get("add_prefix_space")
        place = byte_of_character()
        vocab = self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocab.values()) + 1)
        special = {t["id"] for t in spec["added_tokens"]}
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if i in special else bytes(place[c] for c in token)

    def encode(self, texts: list[str]) -> list[int]:
        return [i for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids]


class SideB:
    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = [
            bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace(SPACE, " ").encode() for i, name in enumerate(names)
        ]
        self.is_byte = [model.is_byte(i) for i in range(len(names))]
        self.space = model.piece_to_id(SPACE)
        self.cuts = (
            not any("\n" in name or re.search(f"[^{SPACE}]{SPACE}", name) for name in names)
            and self.bytes[model.encode("a\n")[0]].startswith(b" ")
            and model.encode("\n")[0] == self.space
        )

    def encode(self, texts: list[str]) -> list[int]:
        """Ids of texts with their first space; one that starts with a line end gets no space ahead."""
        found = self.model.encode([t.removeprefix(" ") for t in texts], num_threads=1)
        return [i for t, ids in zip(texts, found) for i in (ids if t.startswith(" ") else ids[1:])]


@dataclass
class Aligned:
    """Per text: counts, the groups as text, and the distinct linked pairs with their links."""

    whole: np.ndarray  # whether the tokens' bytes are the text
    sizes: np.ndarray  # n_a, n_b, n_groups, n_links, one row per text
    groups: list[str]
    starts: np.ndarray
    counts: np.ndarray
    pairs: np.ndarray
    links: np.ndarray


def _summed(owner: np.ndarray, value: np.ndarray, links: np.ndarray, count: int):
    """Links of equal (owner, value) added up: values and links by owner, and how many each has."""
    span = int(value.max()) + 1 if len(value) else 1
    both = owner * span + value
    order = np.argsort(both)
    both, links = both[order], links[order]
    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]][: len(both)])
    links = np.add.reduceat(links, first) if len(first) else links
    owner, value = np.divmod(both[first], span)
    return value, links, np.bincount(owner, minlength=count)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of the given lengths."""
    ahead = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0)])
    ends = np.cumsum(counts)
    return ahead[ends] - ahead[ends - counts]


def _calls(texts: list[str], joined: bool) -> list[str]:
    """The texts themselves, or joined up to about `_CALL` characters each.

    Nothing is joined behind white space, where the texts would not be cut.
    """
    if not joined:
        return texts
    found, run, size = [], [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= _CALL or text[-1].isspace():
            found.append("".join(run))
            run, size = [], 0
    return [*found, "".join(run)] if run else found


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = SideA(path_a), SideB(path_b)
        self.cuts = bool(self.a.cuts and self.b.cuts)
        self.width = len(self.b.bytes)
        self.length_a = np.array([len(x) for x in self.a.bytes], np.int64)
        self.length_b = np.array([len(x) for x in self.b.bytes], np.int64)
        self.names_a, self.names_b = ([str(i) for i in range(len(side.bytes))] for side in (self.a, self.b))
        self.same = self.identity()
        self.forget()

    def identity(self) -> np.ndarray:
        """B's id of the same bytes for each A id, -1 if there is none. A byte stands behind a piece."""
        at = {x: i for i, x in enumerate(self.b.bytes) if self.b.is_byte[i]}
        at |= {x: i for i, x in enumerate(self.b.bytes) if not self.b.is_byte[i]}
        return np.array([at.get(x, -1) for x in self.a.bytes], np.int64)

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.known = self.align([])
        self.chars = 0

    def encode(self, texts: list[str], data: bytes, joined: bool) -> list[np.ndarray] | None:
        """A's and B's ids of all texts in a row, if their bytes are the texts'."""
        found = []
        calls = _calls(texts, joined)
        for side in (self.a, self.b):
            ids, size, part = [], 0, []
            for text in calls:  # few texts a call: the libraries' results are large
                part.append(text)
                size += len(text)
                if size >= _CALL:
                    ids += side.encode(part)
                    part, size = [], 0
            ids += side.encode(part)
            if b"".join(map(side.bytes.__getitem__, ids)) != data:
                return None
            found.append(np.array(ids, np.int64))
        return found

    def align(self, texts: list[str], joined: bool = False) -> Aligned:
        """Alignment of each text by itself; `joined` ones are pieces that do not depend on each other."""
        data = [t.encode() for t in texts]
        whole = np.ones(len(texts), bool)
        flat = self.encode(texts, b"".join(data), joined)
        if flat is None:  # some text does not come out: find which
            alone = [self.encode([t], d, False) for t, d in zip(texts, data)]
            whole = np.array([x is not None for x in alone], bool)
            flat = [np.concatenate([np.zeros(0, np.int64), *(x[k] for x in alone if x)]) for k in (0, 1)]
        text_ends = np.cumsum([len(d) if ok else 0 for d, ok in zip(data, whole)], dtype=np.int64)
        ends = [np.cumsum(length[x]) for length, x in zip((self.length_a, self.length_b), flat)]
        cuts = np.intersect1d(*ends, assume_unique=True)
        owner = np.searchsorted(text_ends, cuts)
        group = [np.searchsorted(cuts, e) for e in ends]
        per_group = [np.bincount(g, minlength=len(cuts)) for g in group]
        n_groups = np.bincount(owner, minlength=len(texts))
        both = np.stack([*per_group, np.ones(len(cuts), np.int64), per_group[0] * per_group[1]], axis=1)
        pair, links, pair_owner = self._links(flat, per_group, owner)
        pair, links, counts = _summed(pair_owner, pair, links, len(texts))
        groups = self._written(flat, per_group, n_groups)
        return Aligned(whole, _sums(both, n_groups), groups, np.cumsum(counts) - counts, counts, pair, links)

    def _links(self, flat, per_group, owner):
        """Pairs of all groups with how often they are linked, and the text each belongs to."""
        count_a, count_b = per_group
        start_a, start_b = (np.cumsum(c) - c for c in per_group)
        few = np.flatnonzero(count_a * count_b <= _MANY)
        each_a = spread(start_a[few], count_a[few])
        of = np.repeat(few, count_a[few])
        a = np.repeat(flat[0][each_a], count_b[of])
        b = flat[1][spread(start_b[of], count_b[of])]
        found = [(a * self.width + b, np.ones(len(a), np.int64), np.repeat(owner[of], count_b[of]))]
        for g in np.flatnonzero(count_a * count_b > _MANY):
            (a, times_a), (b, times_b) = (
                np.unique(x[s[g] : s[g] + c[g]], return_counts=True)
                for x, s, c in zip(flat, (start_a, start_b), per_group)
            )
            pair = (a[:, None] * self.width + b[None, :]).ravel()
            found.append((pair, (times_a[:, None] * times_b[None, :]).ravel(), np.full(len(pair), owner[g])))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _written(self, flat, per_group, n_groups) -> list[str]:
        sides = []
        for x, counts, names in zip(flat, per_group, (self.names_a, self.names_b)):
            starts = np.cumsum(counts) - counts
            shown = list(map(names.__getitem__, x[starts].tolist()))
            for g in np.flatnonzero(counts > 1).tolist():
                shown[g] = ",".join(map(names.__getitem__, x[starts[g] : starts[g] + counts[g]].tolist()))
            sides.append(shown)
        written = [f"{a}|{b}" for a, b in zip(*sides)]
        ends = np.cumsum(n_groups).tolist()
        return [";".join(written[e - n : e]) for e, n in zip(ends, n_groups.tolist())]

    def _learn(self, texts: list[str]) -> None:
        more, old = self.align(texts, joined=True), self.known
        self.place.update(zip(texts, range(len(old.groups), len(old.groups) + len(texts))))
        self.chars += sum(map(len, more.groups))
        self.known = Aligned(
            np.concatenate([old.whole, more.whole]),
            np.concatenate([old.sizes, more.sizes]),
            old.groups + more.groups,
            np.concatenate([old.starts, len(old.pairs) + more.starts]),
            np.concatenate([old.counts, more.counts]),
            np.concatenate([old.pairs, more.pairs]),
            np.concatenate([old.links, more.links]),
        )

    def documents(self, texts: list[str]) -> Aligned:
        """The same for whole texts, each with a space ahead, through their distinct pieces."""
        if len(self.place) > CACHE_PIECES or self.chars > CACHE_CHARS:
            self.forget()
        cut = [(pieces(" " + t) if self.cuts else [" " + t]) if t else [] for t in texts]
        if fresh := list(set(chain.from_iterable(cut)).difference(self.place)):
            self._learn(fresh)
        known, get = self.known, self.place.__getitem__
        at = [list(map(get, x)) for x in cut]
        lengths = np.array([len(x) for x in at], np.int64)
        flat = np.fromiter(chain.from_iterable(at), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(texts)), lengths)
        whole = np.ones(len(texts), bool)
        whole[owner[~known.whole[flat]]] = False
        sizes = _sums(known.sizes[flat], lengths)
        groups = [";".join(map(known.groups.__getitem__, x)) for x in at]
        # Distinct pieces of each text, then the pairs of those.
        piece, times, n = _summed(owner, flat, np.ones(len(flat), np.int64), len(texts))
        piece_owner = np.repeat(np.arange(len(texts)), n)
        each = spread(known.starts[piece], known.counts[piece])
        pair, links, counts = _summed(
            np.repeat(piece_owner, known.counts[piece]),
            known.pairs[each],
            known.links[each] * np.repeat(times, known.counts[piece]),
            len(texts),
        )
        found = Aligned(whole, sizes, groups, np.cumsum(counts) - counts, counts, pair, links)
        return found if whole.all() else self._with_whole_texts(texts, found)

    def _with_whole_texts(self, texts: list[str], found: Aligned) -> Aligned:
        """Texts with a piece that did not come out, aligned without cuts; if that fails too, without tokens."""
        odd = np.flatnonzero(~found.whole)
        anew = self.align([" " + texts[i] for i in odd])
        groups = list(found.groups)
        sizes = found.sizes.copy()
        pairs = np.split(found.pairs, found.starts[1:])
        links = np.split(found.links, found.starts[1:])
        for k, i in enumerate(odd):
            own = slice(anew.starts[k], anew.starts[k] + anew.counts[k])
            sizes[i], groups[i], pairs[i], links[i] = anew.sizes[k], anew.groups[k], anew.pairs[own], anew.links[own]
        counts = np.array([len(x) for x in pairs], np.int64)
        return Aligned(
            found.whole, sizes, groups, np.cumsum(counts) - counts, counts, np.concatenate(pairs), np.concatenate(links)
        )


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker process and pair of files."""
    return Aligner(path_a, path_b)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


_ALIGNED = (
    "at long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "same array<long>, same_links array<long>, pairs array<long>, pair_links array<long>"
)


def aligned_documents(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """Stored, per row: at, doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and the linked pairs.

    `same` are the A ids linked to their B id of the same bytes, `pairs` all other pairs, as A id times B's
    vocabulary plus B id; `same_links` and `pair_links` say how often. With `with_groups` a column
    `groups` has the groups themselves, `a1,a2|b1;a3|b2,b3`; the digest is of that text.
    """
    schema = _ALIGNED + (", groups string" if with_groups else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = aligner(path_a, path_b)
        for batch in batches:
            for part in slices(batch, chars=_STEP):
                found = make.documents(part.column("text").to_pylist())
                a, b = np.divmod(found.pairs, make.width)
                same = make.same[a] == b
                owner = np.repeat(np.arange(part.num_rows), found.counts)
                n_same = np.bincount(owner[same], minlength=part.num_rows)
                columns = [
                    part.column("at"),
                    part.column("doc_id"),
                    *(pa.array(np.ascontiguousarray(found.sizes[:, k])) for k in range(4)),
                    pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found.groups], pa.string()),
                    _lists(a[same], n_same),
                    _lists(found.links[same], n_same),
                    _lists(found.pairs[~same], found.counts - n_same),
                    _lists(found.links[~same], found.counts - n_same),
                ]
                if with_groups:
                    columns.append(pa.array(found.groups, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    numbered = documents(docs).select("doc_id", "text", F.monotonically_increasing_id().alias("at"))
    return stored(numbered.mapInArrow(run, schema), "aligned")


def same_counts(aligned: DataFrame, ids: int) -> DataFrame:
    """`a` and `n`: how many documents link A id `a` to its B id of the same bytes. At most `ids` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(ids, np.int64)
        for batch in batches:
            count += np.bincount(batch.column("same").flatten().to_numpy(), minlength=ids)
        a = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(count[a])], ["a", "n"])

    ship_package(aligned.sparkSession)
    return aligned.select("same").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """`pair` and `n`: how many documents link the pair, for pairs outside the identity map."""
    return aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def all_counts(aligned: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """`a`, `b` and `n` of all linked pairs: what maps one vocabulary to the other."""
    make = aligner(path_a, path_b)
    same = same_counts(aligned, len(make.same))
    to_b = F.element_at(F.lit(make.same), (F.col("a") + 1).cast("int"))
    others = pair_counts(aligned).select(
        F.floor(F.col("pair") / make.width).alias("a"), F.pmod("pair", F.lit(make.width)).alias("b"), "n"
    )
    return same.select("a", to_b.alias("b"), "n").union(others)


def scored_documents(aligned: DataFrame, path_a: str, path_b: str, head: int = HEAD) -> DataFrame:
    """The documents with `n_best`, the links whose pair no other of its A id outnumbers, and `count_sum`.

    To the driver and back to all tasks go two numbers per A id and the `head` most frequent other pairs.
    """
    make = aligner(path_a, path_b)
    width, ids = make.width, len(make.same)
    counts = stored(pair_counts(aligned), "pair-counts")
    of_same = np.zeros(ids, np.int64)
    for a, n in same_counts(aligned, ids).collect():
        of_same[a] = n
    most = of_same.copy()
    for a, n in counts.groupBy(F.floor(F.col("pair") / width).alias("a")).agg(F.max("n").alias("n")).collect():
        most[a] = max(most[a], n)
    frequent = sorted(map(tuple, counts.orderBy(F.desc("n"), "pair").limit(head).collect()))
    head_pairs, head_counts = (np.array([r[k] for r in frequent], np.int64) for k in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the vectors and the head decide, and the other pairs."""

        def flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
            lists = batch.column(name)
            counts = np.diff(lists.offsets.to_numpy())
            return lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(lists)), counts)

        def summed(values: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
            total = np.zeros(rows, np.int64)
            np.add.at(total, owner, values)
            return total

        for batch in batches:
            rows = batch.num_rows
            same, owner = flat(batch, "same")
            links = flat(batch, "same_links")[0]
            best = summed(links * (of_same[same] == most[same]), owner, rows)
            total = summed(links * of_same[same], owner, rows)
            pair, owner = flat(batch, "pairs")
            links = flat(batch, "pair_links")[0]
            at = np.searchsorted(head_pairs, pair)
            here = at < len(head_pairs)
            here[here] = head_pairs[at[here]] == pair[here]
            n = head_counts[at[here]]
            best += summed(links[here] * (n == most[pair[here] // width]), owner[here], rows)
            total += summed(links[here] * n, owner[here], rows)
            left = np.bincount(owner[~here], minlength=rows)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in kept),
                    pa.array(best),
                    pa.array(total),
                    _lists(pair[~here], left),
                    _lists(links[~here], left),
                    _lists(most[pair[~here] // width], left),
                ],
                [*kept, "n_best", "count_sum", "pairs", "pair_links", "most"],
            )

    kept = [c for c in aligned.columns if c not in ("same", "same_links", "pairs", "pair_links")]
    types = dict(aligned.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in kept)
    known = stored(
        aligned.mapInArrow(run, f"{schema}, n_best long, count_sum long, pairs array<long>, pair_links array<long>, most array<long>"),
        "aligned-known",
    )
    rare = known.select("at", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("pair_links").alias("links"), F.col("most"))))
    # Both grow with the corpus; no pair left here has more rows than the least one of the head.
    sums = (
        rare.toDF("at", "pair", "links", "most")
        .join(counts.hint("merge"), "pair")
        .groupBy("at")
        .agg(
            F.sum(F.when(F.col("n") == F.col("most"), F.col("links")).otherwise(0)).alias("more_best"),
            F.sum(F.col("links") * F.col("n")).alias("more_sum"),
        )
    )
    zero = F.lit(0).cast("long")
    return known.join(sums.hint("merge"), "at", "left").select(
        *kept,
        (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", zero)).alias("count_sum"),
    )


def align_documents(docs: DataFrame, path_a: str, path_b: str, head: int = HEAD) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    aligned = aligned_documents(docs, path_a, path_b)
    return scored_documents(aligned, path_a, path_b, head).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
