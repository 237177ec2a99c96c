"""Alignment of two tokenizers against a plain one over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from odd_rows import ODD

from calibrant.llm import catalog, token_alignment as T
from calibrant.llm.word_tokens import vocabulary_path

A, B = vocabulary_path(catalog.BYTES), vocabulary_path(catalog.PIECES)
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

WORDS = "the of Anthropic's don't über naïve 中文 日本語 😀 é 3.14 x_y --   I'll <|endoftext|> <s> </s> <unk> <0x41>".split(" ")
GAPS = [" ", " ", " ", "  ", "\n", "\n\n", " \n ", "\t", "\r\n", "\xa0", "　 ", "   ", "\x1c", "\x85", "\x0b"]


def plain(text):
    """Groups of a whole text: lists of A ids and B ids; none if the bytes differ."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not hasattr(plain, "a"):
        plain.a, plain.b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
        plain.a.encode_special_tokens = True
        plain.of_a, plain.of_b = T.SideA(A).bytes, T.SideB(B).bytes
    if not text:
        return []
    data = (" " + text).encode()
    a, b = plain.a.encode(" " + text, add_special_tokens=False).ids, plain.b.encode(text)
    if b"".join(plain.of_a[i] for i in a) != data or b"".join(plain.of_b[i] for i in b) != data:
        return []
    groups, at_a, at_b, left, right = [], 0, 0, [], []
    a, b = list(a), list(b)
    while a or b or left or right:
        if at_a == at_b and left:
            groups.append((left, right))
            left, right = [], []
            if not a:
                break
        if at_a <= at_b and a:
            left.append(a.pop(0))
            at_a += len(plain.of_a[left[-1]])
        else:
            right.append(b.pop(0))
            at_b += len(plain.of_b[right[-1]])
    return groups


def brute_force(rows):
    docs = [(d, plain(t)) for d, t in rows]
    links = [Counter((a, b) for x, y in groups for a in x for b in y) for _, groups in docs]
    count = Counter(pair for found in links for pair in found)
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    result = []
    for (d, groups), found in zip(docs, links):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        result.append(
            (
                d,
                sum(len(x) for x, _ in groups),
                sum(len(y) for _, y in groups),
                len(groups),
                sum(found.values()),
                sum(n for (a, b), n in found.items() if count[a, b] == most[a]),
                sum(n * count[p] for p, n in found.items()),
                hashlib.sha256(text.encode()).hexdigest() if text else "",
            )
        )
    return sorted(result, key=repr), count


def random_text(draw):
    letters = "abcdeABC éßñ中文😀'.,-\n \t▁" if draw.random() < 0.1 else "abcdeABC éßñ中文'.,-\n "
    parts = []
    for _ in range(draw.randint(0, 40)):
        word = draw.choice(WORDS) if draw.random() < 0.5 else "".join(draw.choices(letters, k=draw.randint(1, 9)))
        parts += [word, draw.choice(GAPS)]
    return "".join(parts)


def random_rows(seed, count):
    draw = random.Random(seed)
    return [(i, random_text(draw)) for i in range(count)] + [(5, "the of"), (5, "the of"), (None, "the the the")]


def scored(table, **options):
    found = T.align_documents(table, A, B, **options)
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("head", [0, 3, T.HEAD])
def test_documents_equal_whole_text_alignment(as_table, head):
    rows = random_rows(head, 250) + [(None, None), (900, ""), (901, " "), (902, "\n"), (903, "▁a"), (904, "a" * 3000), (905, "\x00 a")]
    assert scored(as_table(rows), head=head) == brute_force(rows)[0]


def test_pieces_give_the_ids_of_whole_texts():
    draw = random.Random(1)
    make = T.Aligner(A, B)
    assert make.cuts
    texts = [random_text(draw) for _ in range(1500)]
    found = make.documents(texts)
    for text, groups in zip(texts, found.groups):
        assert groups == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in plain(text)), repr(text)


def test_without_cuts_and_with_a_small_memory(monkeypatch):
    draw = random.Random(2)
    texts = [random_text(draw) for _ in range(60)]
    make, whole = T.Aligner(A, B), T.Aligner(A, B)
    whole.cuts = False
    monkeypatch.setattr(T, "CACHE_PIECES", 5)
    monkeypatch.setattr(T, "_MANY", 2)
    for first in range(0, 60, 7):
        one, other = make.documents(texts[first : first + 7]), whole.documents(texts[first : first + 7])
        for name in ("sizes", "pairs", "links", "counts"):
            assert (getattr(one, name) == getattr(other, name)).all()
        assert one.groups == other.groups


def test_counts_map_the_vocabularies(as_table):
    rows = random_rows(7, 80)
    aligned = T.aligned_documents(as_table(rows), A, B, with_groups=True)
    assert {(r["a"], r["b"]): r["n"] for r in T.all_counts(aligned, A, B).collect()} == brute_force(rows)[1]
    for r in aligned.collect():
        assert r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "")


def test_identity_joins_equal_bytes():
    make = T.Aligner(A, B)
    mapped = [(a, b) for a, b in enumerate(make.same.tolist()) if b >= 0]
    assert len(mapped) > 10_000 and all(make.a.bytes[a] == make.b.bytes[b] for a, b in mapped)
    assert not make.b.is_byte[make.same[make.a.bytes.index(b"a")]] and make.b.is_byte[make.same[make.a.bytes.index(b"\n")]]


def test_odd_and_empty_tables(as_table, odd, empty):
    assert scored(empty) == []
    assert scored(odd) == brute_force(ODD)[0]


def test_the_query_takes_whole_documents(spark):
    small = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    found = catalog.queries()["op11_token_alignment"](spark, small)
    assert sorted(map(tuple, found.select(COLUMNS).collect()), key=repr) == brute_force(rows)[0]
