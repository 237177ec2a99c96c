"""The prefix trie of conversations against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from calibrant.llm import catalog, conversation_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth long, key string, n long"


@pytest.fixture
def as_conversations(spark):
    return lambda rows: spark.createDataFrame([(*r, 7, "x", 1) for r in rows], SCHEMA)


def in_order(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            place = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, place, (role, text)))
    return {c: [t[-1] for t in sorted(turns)] for c, turns in own.items()}


def rebuild(own):
    found = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        found[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    return found


def brute_force(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        ends[tuple(turns)].append(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(members[node]) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        (
            min(m),
            len(node),
            min(members[node[:-1]]) if node else -1,
            len(m),
            children[node],
            leaves[node],
            saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, m in members.items()
    )


def nodes_of(table):
    assert table.columns == T.NODE_COLUMNS
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in map(tuple, table.collect()))


def random_rows(seed, count=120):
    """Few different turns, so that prefixes meet; copies, one long conversation, gaps."""
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(1000), count):
        for turn in range(draw.randint(1, 6)):
            rows.append((c, turn, draw.choice(["user", "bot"]), draw.choice(["a", "bb", "é中", ""])))
    for c in range(2000, 2040):
        rows += [(c, turn, "user", f"same {turn}") for turn in range(5)]
    rows += [(3000, turn, "user", "on and on") for turn in range(150)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("container", [1, 5, 2048])
def test_trie_equals_brute_force(as_conversations, container):
    rows = random_rows(container)
    own = in_order(rows)
    table = as_conversations(rows)
    assert nodes_of(T.trie_nodes(T.rebuilt_sequences(table), container=container, salts=3)) == brute_force(rebuild(own))
    if container == 5:
        assert nodes_of(T.trie_nodes(T.sequences(table), container=container, salts=3)) == brute_force(own)


def test_rebuilt_without_a_start_can_be_empty(as_conversations):
    rows = [(c, t, "user", f"{c} {t}") for c in range(201, 215) for t in range(2)]
    found = rebuild(in_order(rows))
    assert any(not turns for turns in found.values())
    assert nodes_of(T.trie_nodes(T.rebuilt_sequences(as_conversations(rows)), container=2)) == brute_force(found)


@pytest.mark.parametrize("container", [1, 2048])
def test_gaps_ties_and_repeated_rows(as_conversations, container):
    rows = [
        (1, 0, None, None), (1, 0, "", ""), (1, None, "user", "first"), (1, 2, "user", None),
        (2, 5, "b", "tie"), (2, 5, "a", "tie"), (2, 5, "a", "tie"), (2, None, "user", "x" * 100_000),
        (None, 1, "user", "no conversation"), (-7, 1, "user", "below zero"), (100, 1, "user:", "1"), (101, 1, "user", ":1"),
    ]
    found = nodes_of(T.trie_nodes(T.sequences(as_conversations(rows)), container=container))
    assert found == brute_force(in_order(rows))


def test_no_conversations_have_no_nodes(as_conversations):
    assert T.trie_nodes(T.rebuilt_sequences(as_conversations([]))).collect() == []


def test_long_end_lists_are_hashed_in_runs(spark, monkeypatch):
    monkeypatch.setattr(T, "_RUN", 7)
    rows = [(bytes([k]), i * (-1) ** i) for k in (1, 2) for i in range(50 * k)]
    ends = spark.createDataFrame(rows, "key binary, conv_id long").repartition(5)
    got = {bytes(r["key"]): r["ends_sha256"] for r in T.end_digests(ends).collect()}
    for k in (1, 2):
        ids = sorted(i for key, i in rows if key == bytes([k]))
        assert got[bytes([k])] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_the_query_bursts_nothing_away(spark):
    small = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes_of(catalog.queries()["op12_conversation_trie"](spark, small)) == brute_force(rebuild(in_order(rows)))
