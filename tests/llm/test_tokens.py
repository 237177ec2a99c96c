"""Token ids, counts, files and packing against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from calibrant.llm import packing, pieces, token_counts, token_file
from calibrant.llm.common import stored
from calibrant.llm.word_tokens import WordTokens, load, vocabulary_path
from calibrant.sources.tables import shared_folder

WORDS, BYTES, PIECES = (vocabulary_path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ALPHABET = "aAbBéÉßµ'sStT1½²!.,<|> \n\t́ΣσİıǅＡ中  \x1c\x85\xad😀"


@pytest.fixture(scope="module")
def library():
    return load(WORDS)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_ids_equal_the_library(library):
    draw = random.Random(1)
    texts = ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 60))) for _ in range(2000)]
    texts += ["", " ", "ΣΑΣ İx ﬁ", "b\x1cz\x85q <|endoftext|>a<|ENDOFTEXT|>", "I'LL don't's"]
    encoder, counter = WordTokens(WORDS, cache_parts=200), token_counts.TokenCounter(WORDS, cache_parts=200)
    for k in range(0, len(texts), 400):  # several batches: the tables are emptied in between
        part = pa.array(texts[k : k + 400])
        ids, offsets = encoder.encode(part)
        expected = [library.encode(t, add_special_tokens=False).ids for t in texts[k : k + 400]]
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [e + [1] for e in expected]
        assert counter.count(part).tolist() == [len(e) for e in expected]


def test_other_vocabularies_are_encoded_text_by_text():
    texts = ["", "Hello  world", "é\n\n"]
    ids, offsets = WordTokens(BYTES).encode(pa.array(texts))
    expected = [e.ids + [1] for e in load(BYTES).encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == expected


def test_proven_strings_are_one_token_each(library):
    proven = token_counts.proven_strings(WORDS)
    assert len(proven) > 20_000 and "the" in proven
    assert all(len(e.ids) == 1 for e in library.encode_batch(proven, add_special_tokens=False))


@pytest.mark.parametrize("bits", [1, 7, 8, 9, 16, 17, 32])
def test_any_id_is_read_without_its_neighbors(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 3000, dtype=np.uint64).astype(np.uint32)
    levels = token_file.encode_levels(ids)
    assert (token_file.decode_levels(levels) == ids).all()
    at = np.random.default_rng(0).permutation(3000)
    assert (token_file.ids_at(levels, at) == ids[at]).all()
    none = token_file.encode_levels(ids[:0])
    assert len(token_file.decode_levels(none)) == 0


def test_token_file_round_trip(spark, odd, empty, library):
    folder = shared_folder(spark, "tokens")
    token_file.write_token_file(odd, folder, WORDS, segment_tokens=50)
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    all_ids, expected = [], []
    for doc_id, text in order:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        expected.append((doc_id, len(all_ids), len(ids), crc(ids)))
        all_ids += ids
    got = sorted(map(tuple, token_file.read_documents(spark, folder).collect()), key=lambda r: r[1])
    assert got == expected
    places = [0, 5, len(all_ids) // 2, len(all_ids) - 1]
    assert token_file.tokens_at(spark, folder, places) == {p: all_ids[p] for p in places}
    folder = shared_folder(spark, "tokens")
    token_file.write_token_file(empty, folder, WORDS)
    assert token_file.read_documents(spark, folder).collect() == []


def test_rows_without_an_id_are_spread_over_shards(spark, as_table, library):
    """They come first, by text, whatever the rest of the table holds."""
    draw = random.Random(4)
    texts = ["".join(draw.choice("abcé中 ") for _ in range(draw.randint(0, 90))) for _ in range(600)]
    rows = [(None, t) for t in texts] + [(i, f"row {i}") for i in range(-20, 300)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    table, folder = as_table(rows), shared_folder(spark, "tokens")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # the table is small
    try:
        token_file.write_token_file(table, folder, WORDS, segment_tokens=200)
    finally:
        spark.conf.unset(coalesce)
    place, expected = 0, []
    for doc_id, text in order:
        ids = library.encode(text, add_special_tokens=False).ids + [1]
        expected.append((doc_id, place, len(ids), crc(ids)))
        place += len(ids)
    assert sorted(map(tuple, token_file.read_documents(spark, folder).collect()), key=lambda r: r[1]) == expected
    shards = spark.read.parquet(folder).where("doc_ids[0] IS NULL").groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()
    assert len(shards) >= 4 and max(r["n"] for r in shards) < place / 3


def test_counts_of_odd_rows(odd, empty, library):
    rows = sorted(map(tuple, token_counts.count_tokens(odd, WORDS, limit=7).collect()), key=repr)
    expected = []
    for doc_id, text in ODD:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        expected.append((doc_id, len((text or "").encode()), n, n > 7))
    assert rows == sorted(expected, key=repr)
    assert token_counts.count_tokens(empty, WORDS).collect() == []


def sequences(rows, capacity):
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for spots in filled.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= capacity
    return filled


def test_packing_of_odd_rows(odd, empty, library):
    rows = packing.pack_documents(odd, WORDS, capacity=16, shard_pieces=3).collect()
    sequences(rows, 16)
    expected = []
    for doc_id, text in ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        expected += [(doc_id, k // 16, k, len(ids[k : k + 16]), crc(ids[k : k + 16])) for k in range(0, len(ids), 16)]
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(expected, key=repr)
    assert packing.pack_documents(empty, WORDS).collect() == []


def test_best_fit_takes_the_least_room():
    """Against a plain search over all open bins."""
    lengths = np.sort(np.random.default_rng(3).integers(1, 101, 400))[::-1]
    rooms, expected = [], []
    for n in lengths:
        fits = [r for r in rooms if r >= n]
        if not fits:
            rooms.append(100)
            fits = [100]
        expected.append(100 - min(fits))
        rooms[rooms.index(min(fits))] -= n
    bins, offsets = packing.best_fit(lengths, 100)
    assert offsets.tolist() == expected and len(set(bins.tolist())) == len(rooms)


def test_shards_cost_few_sequences(spark):
    lengths = np.random.default_rng(1).integers(1, 400, 3000)
    table = stored(spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(lengths)], "doc_id long, piece int, length long"), "lengths")
    rows = packing.pack(table, 4096, shard_pieces=256).collect()
    assert len(rows) == 3000
    assert len(sequences(rows, 4096)) <= 1.02 * lengths.sum() / 4096 + 1


def test_pieces_equal_sentencepiece():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    draw = random.Random(0)
    texts = ["".join(draw.choice("aaabbethinoTA   .,1é中\n\t▁😀") for _ in range(draw.randint(0, 50))) for _ in range(1500)]
    texts += ["", " ", "  a  b\t\n x ﬁ", "a" * 5000, "▁a▁▁b", "\n\n"]
    encoder = pieces.Encoder(PIECES)
    ids, offsets = encoder.encode(texts)
    expected = model.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == expected
    decoder = pieces.Decoder(encoder.pieces)
    broken = [[0x80 + 3, 200, 300], encoder.pieces.byte_ids[[0xE4, 0x41]].tolist()]
    assert [decoder.decode(np.array(e, np.int64)) for e in expected] == model.decode(expected)
    assert decoder.decode(np.array(broken[1], np.int64)) == model.decode(broken[1])


def test_pieces_of_odd_rows(odd, empty):
    encoded = pieces.encode_documents(odd, PIECES)
    back = sorted(map(tuple, pieces.decode_documents(encoded, PIECES).collect()), key=repr)
    assert back == sorted(((i, t or "") for i, t in ODD), key=repr)
    assert all(r["same_text"] for r in pieces.round_trip(odd, PIECES).collect())
    assert pieces.round_trip(empty, PIECES).collect() == []


def test_equal_pieces_are_spread_over_all_shards(spark):
    """Equal rows, and columns named as the operator's own, are dealt by place."""
    table = spark.range(40_000).selectExpr("7L doc_id", "0 piece", "1500L length", "1L AS key", "2L AS bin", "3L AS at", "4 AS fill", "5 AS shard", "6L AS place")
    found = packing.pack(table, 4096, shard_pieces=1000)
    assert found.columns == [*table.columns, "sequence_id", "offset"]
    rows = found.select("sequence_id", "offset", "length", "key", "bin").collect()
    assert len(rows) == 40_000 and {(r["key"], r["bin"]) for r in rows} == {(1, 2)}
    assert len({(r["sequence_id"] >> 32) % 40 for r in rows if r["sequence_id"] >> 56 == 0}) == 40
    assert len({r["sequence_id"] for r in rows}) <= 20_000 + 40
