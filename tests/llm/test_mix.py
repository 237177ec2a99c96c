"""Mixing sources: targets, epochs and the sampled rest against brute force."""

import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from calibrant.llm import catalog, source_mix as M


def targets(sizes, weights=M.WEIGHTS, limit=M.LIMIT):
    """Round by round: full sources keep their limit, the others share what is left by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(limit * sizes[s] for s in full)
        among = sum(weight[s] for s in names if s not in full)
        share = {s: Fraction(left * weight[s], among) for s in names if s not in full}
        above = {s for s in share if share[s] > limit * sizes[s]}
        if not above:
            return {s: Fraction(limit * sizes[s]) if s in full else share[s] for s in names}
        full |= above


def check(rows, found, limit=M.LIMIT):
    """`found` rows (doc_id, size, source_size, target, taken) agree with the input rows."""
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len(re.findall(M._WORD, text or ""))
    want = targets(sizes, limit=limit)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in found) == sorted(
        (d is None, d or 0, len(re.findall(M._WORD, t or ""))) for d, t, _, _ in rows
    )
    taken, longest = defaultdict(int), defaultdict(int)
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(want[r["source"]]))
        assert 0 <= r["taken"] <= limit * r["size"] and r["taken"] == r["copies"] * r["size"]
        epochs = int(want[r["source"]] // sizes[r["source"]]) if sizes[r["source"]] else 0
        assert r["copies"] in (epochs, epochs + 1)
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for source, words in taken.items():
        assert abs(words - want[source]) <= longest[source] / 2 + 1e-6


def random_rows(seed, count=400, hot=0.5):
    draw = random.Random(seed)
    names = ["a", "B", "é", "中", "", None, "tiny", "z9", "z10"]
    rows = []
    for i in range(count):
        source = "B" if draw.random() < hot else draw.choice(names)
        n = draw.choice([0, 1, 2, 5, 40]) if source != "tiny" else 1
        rows.append((i, " ".join("w" * draw.randint(1, 4) for _ in range(n)), "en", source))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_equals_brute_force(as_table, seed):
    rows = random_rows(seed)
    table = as_table(rows)
    found = M.mix(table).collect()
    check(rows, found)
    again = M.mix(table.repartition(5).sort("doc_id")).select("doc_id", "taken").collect()
    assert sorted(map(tuple, again)) == sorted((r["doc_id"], r["taken"]) for r in found)


def test_the_rest_is_the_front_in_the_order_of_the_keys(as_table):
    table = as_table(random_rows(4))
    keys = {r["doc_id"]: r for r in M.keyed_documents(table).collect()}
    found = {r["doc_id"]: r for r in M.mix(table).collect()}
    for source in {r["source"] for r in found.values()}:
        own = sorted((k["sample_key"], d) for d, k in keys.items() if k["source"]["source"] == source and k["size"])
        copies = [found[d]["copies"] for _, d in own]
        assert copies == sorted(copies, reverse=True)


def test_cells_keep_the_order_of_the_keys(as_table):
    rows = M.keyed_documents(as_table(random_rows(5, 2000)), F.col("doc_id") % 7 / 7).collect()
    cells = [r["cell"] for r in sorted(rows, key=lambda r: r["sample_key"])]
    assert cells == sorted(cells) and max(map(cells.count, set(cells))) < 0.02 * len(cells)


def test_better_documents_come_earlier(as_table):
    """A document of twice the quality stands ahead of another one two times of three."""
    rows = [(i, "one two", "en", "s") for i in range(6000)]
    quality = F.when(F.col("doc_id") % 2 == 0, 0.8).otherwise(0.4)
    keys = {r["doc_id"]: r["sample_key"] for r in M.keyed_documents(as_table(rows), quality).collect()}
    ahead = sum(keys[i] < keys[i + 1] for i in range(0, 6000, 2)) / 3000
    assert ahead == pytest.approx(2 / 3, abs=0.04)
    # One source cannot take more than there is, so all are taken once.
    assert {r["copies"] for r in M.mix(as_table(rows), quality).collect()} == {1}


def test_mixed_documents_are_repeated_as_often_as_taken(as_table):
    rows = random_rows(6) + [(3, "equal rows here", "en", "B")] * 4
    table = as_table(rows)
    copies = defaultdict(int)
    for r in M.mix(table).collect():
        copies[r["doc_id"]] += r["copies"]
    out = M.mixed_documents(table)
    assert out.columns == table.columns
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {d: n for d, n in copies.items() if n}


def test_odd_and_empty_tables(as_table, odd, empty):
    assert M.mix(empty).collect() == [] and M.mixed_documents(empty).collect() == []
    check([(*r, None, None) for r in ODD], M.mix(odd).collect())
    nothing = as_table([(1, None, "en", "a"), (2, " \t", "en", None)])
    assert [(r["size"], r["target"], r["taken"]) for r in M.mix(nothing).collect()] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_full_sources_share_out_their_excess(as_table, limit):
    rows = [(i, "w " * n, "en", s) for i, (s, n) in enumerate([("a", 1), ("b", 4), ("c", 9), ("d", 30), ("e", 500), ("f", 700), (None, 3)])]
    check(rows, M.mix(as_table(rows), limit=limit).collect(), limit)


def test_the_query_uses_all_documents(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = catalog.queries()["op13_source_mix"](spark, small)
    assert found.count() == docs.count()
    again = catalog.queries()["op13_source_mix"](spark, small)
    assert found.exceptAll(again).isEmpty()
