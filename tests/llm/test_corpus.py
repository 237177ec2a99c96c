"""Deduplication, repeats, quality, personal data and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from calibrant.llm import exact_dedup, ngram_join, packing, personal_data, quality_gam, quality_rules, substrings
from calibrant.llm.catalog import WORDS
from calibrant.llm.word_tokens import load, vocabulary_path

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def near_texts(seed, count, words=40):
    """Texts over few words, about half of them edited copies of earlier ones."""
    draw = random.Random(seed)
    texts = []
    for _ in range(count):
        if texts and draw.random() < 0.6:
            own = draw.choice(texts).split()
            for _ in range(draw.randint(0, 3)):
                own[draw.randrange(len(own))] = f"new{draw.randint(0, 99)}"
            texts.append(" ".join(own))
        else:
            texts.append(" ".join(f"w{draw.randint(0, 500)}" for _ in range(draw.randint(8, words))))
    return texts


# --- exact copies


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_copies(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lowered(text)].append(doc_id)
    least = -(1 << 70)
    out = []
    for text, ids in groups.items():
        keep = max(ids, key=lambda i: least if i is None else i)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return ordered(out), len(groups)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda text: F.substring(exact_dedup.sha256(text), 1, 1)])
def test_exact_copies(as_table, digest):
    rows = ODD + [(10 + i, t) for i, t in enumerate(["É a", "é A", "É A", "x", "X", "x"] * 3)]
    got = exact_dedup.dedup(as_table(rows), digest=digest).collect()
    expected, groups = brute_copies(rows)
    assert ordered((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == expected
    assert sum(r["kept"] for r in got) == groups


def test_stream_state_grows_over_micro_batches(spark, as_table):
    """A digest of the first micro-batch is still known in the last one."""
    rows = [(i, f"text {i % 7}") for i in range(60)]
    docs = as_table(rows).repartition(5)
    from calibrant.llm.common import stored
    from calibrant.sources.tables import shared_folder

    digests = shared_folder(spark, "digests")
    place = F.struct(F.lit("f").alias("file"), F.col("doc_id").alias("row"))
    stored(docs, "docs").select("doc_id", place.alias("at"), F.sha2("text", 256).alias("digest")).write.parquet(digests)
    state = exact_dedup.update_state(spark, digests, shared_folder(spark, "stream"), files_per_batch=1)
    expected = Counter(hashlib.sha256(t.encode()).hexdigest() for _, t in rows)
    assert {r["digest"]: r["group_size"] for r in state.collect()} == expected


# --- near copies


def shingles(text, n=5):
    words = [w for w in (x.strip(EDGE) for x in WORD.findall((text or "").lower())) if w]
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)] if words else [])


def brute_near(rows, threshold=0.8):
    sets = defaultdict(list)
    for i, (_, text) in enumerate(rows):
        s = shingles(text)
        sets[s or ("alone", i)].append(i)
    names = list(sets)
    root = {s: s for s in names}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    links = Counter()
    for a, b in combinations([s for s in names if isinstance(s, frozenset)], 2):
        both = len(a & b)
        if both and both >= threshold * (len(a) + len(b) - both) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = {}
    for s in names:
        for i in sets[s]:
            doc_id = rows[i][0]
            top = find(s)
            old = least.get(top, (1, 0))
            new = (1, 0) if doc_id is None else (0, doc_id)
            least[top] = min(old, new)
    named = lambda top: None if least[top][0] else least[top][1]
    return ordered((rows[i][0], named(find(s)), links[s], len(sets[s])) for s in names for i in sets[s])


@pytest.mark.parametrize("options", [{}, {"small": 1, "block_docs": 3}, {"small": 4, "block_docs": 3, "few": 100}, {"few": 0, "recall": 0.999}])
def test_near_copies(as_table, options):
    rows = ODD + [(10 + i, t) for i, t in enumerate(near_texts(5, 150))]
    found = ngram_join.near_groups(as_table(rows), **options)
    assert ordered(found.select("doc_id", "class_id", "n_links", "n_copies").collect()) == brute_near(rows)


def cumulative(calls, k):
    """Brute force over the rows of the first k+1 calls; the results of call k's rows."""
    rows = [(c, r) for c in range(k + 1) for r in calls[c]]
    groups = defaultdict(list)
    for c, (doc_id, text) in rows:
        groups[lowered(text)].append(doc_id)
    return ordered(
        (i, max(groups[lowered(t)]), len(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t in calls[k]
    )


@pytest.mark.parametrize("weak", [False, True])
def test_state_lasts_over_calls(as_table, tmp_path, weak):
    """Later calls hit rows of earlier ones; with a weak digest different texts share it, also across calls."""
    calls = [
        [(1, "Same"), (2, "other"), (3, "same"), (4, "only"), (5, None)],
        [(20, "SAME"), (21, "thing"), (0, "only"), (22, "fresh"), (23, "")],
        [(30, "thing"), (31, "other"), (7, "same"), (32, "unseen text")],
    ]
    digest = (lambda text: F.length(text).cast("string")) if weak else exact_dedup.sha256
    for k, rows in enumerate(calls):
        found = exact_dedup.dedup(as_table(rows), digest=digest, state=str(tmp_path / "state"), call=f"c{k}").collect()
        got = ordered((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found)
        assert got == cumulative(calls, k)
        assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in found)


def test_a_call_can_be_run_again(as_table, tmp_path):
    first, second = as_table([(1, "a"), (2, "b")]), as_table([(3, "A"), (4, "c")])
    options = {"state": str(tmp_path / "state")}
    exact_dedup.dedup(first, **options, call="one").collect()
    once = ordered(exact_dedup.dedup(second, **options, call="two").collect())
    assert ordered(exact_dedup.dedup(second, **options, call="two").collect()) == once
    assert {r[0]: r[2] for r in once} == {3: 2, 4: 1}


def test_near_copies_of_nothing(empty):
    assert ngram_join.near_groups(empty).collect() == []
    assert ngram_join.one_per_group(empty).collect() == []


def test_unrelated_documents_under_one_id_stay(as_table):
    copy = "one two three four five six seven"
    rows = [(5, copy), (None, copy), (None, "some text that nothing else is like"), (None, "yet another text of its own kind"), (5, "a third text under the same id here")]
    kept = ngram_join.one_per_group(as_table(rows)).select("doc_id", "text").collect()
    assert ordered(kept) == ordered([rows[0], *rows[2:]])


def edited_pairs(seed, count, low, high):
    """Pairs of texts whose sets of five-word grams have a similarity from `low` to `high`."""
    draw = random.Random(seed)
    while count:
        words = [f"x{draw.randint(0, 10**9)}" for _ in range(draw.randint(60, 160))]
        other = list(words)
        for _ in range(draw.randint(1, 4)):
            other[draw.randrange(len(other))] = "edited"
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words, other))
        if low <= len(a & b) / len(a | b) <= high:
            count -= 1
            yield " ".join(words), " ".join(other)


def test_recall_just_above_the_threshold(as_table):
    texts = [t for pair in edited_pairs(8, 600, 0.8, 0.85) for t in pair]
    found = ngram_join.near_groups(as_table(list(enumerate(texts)))).collect()
    linked = sum(r["n_links"] == 1 and r["class_id"] == r["doc_id"] // 2 * 2 for r in found) / len(texts)
    assert linked >= 0.99 and all(r["n_links"] <= 1 for r in found)


def test_dense_classes_keep_long_prefixes(spark):
    """Where most classes of a tree share short prefixes, prefixes stay long; elsewhere they get short."""
    draw = np.random.default_rng(1)
    trees, rows = 28, []
    for i in range(60):
        dense = i < 40
        keys = [t if dense else 1000 * (i // 2) + t for t in range(trees)]
        paths = [int(draw.integers(0, 1 << 45)) if dense else 7 for _ in range(trees)]
        rows.append((i.to_bytes(2, "big"), keys, paths))
    classes = spark.createDataFrame(rows, "digest binary, keys array<long>, paths array<long>")
    runs = ngram_join.candidate_runs(classes, trees, 5, 8).collect()
    of = defaultdict(set)
    for r in runs:
        of[int.from_bytes(r["digest"], "big") < 40].add(r["depth"])
        assert r["size"] == 2
    assert of[False] == {5} and 5 not in of[True]


def test_each_pair_belongs_to_its_first_common_unit():
    lists = [[7, 3, 9], [3, 9], [9, 4], [7, 9]]
    for unit in (7, 3, 9):
        here = [i for i, x in enumerate(lists) if unit in x]
        matrix = ngram_join.owned([lists[i] for i in here], unit)
        for a, i in enumerate(here):
            for b, j in enumerate(here):
                if i != j:
                    assert matrix[a, b] == (next(u for u in lists[i] if u in lists[j]) == unit)


# --- repeated passages


def brute_repeats(rows, window):
    first = {}
    split = [(-(1 << 63) if i is None else i, i, WORD.findall(t or "")) for i, t in rows]
    for key, _, words in split:
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            first[w] = min(first.get(w, key), key)
    out = []
    for key, doc_id, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < key:
                gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return ordered(out)


def test_lengths_double_and_extensions_lie_in_every_full_window():
    assert substrings.level_lengths(50) == [7, 13, 25, 50] and substrings.level_lengths(6) == [3, 6]
    for window in (6, 14, 27, 50):
        lengths = substrings.level_lengths(window)
        for length, ahead in zip(lengths[:-1], substrings.extensions(lengths)):
            for offset in range(window - lengths[0] + 1):
                assert any(offset - a >= 0 and offset - a + length <= window for a in ahead)


def test_levels_leave_fewer_windows(as_table):
    common, passage = "a few words that all share", " ".join(f"p{k}" for k in range(60))
    rows = [(i, f"{' '.join(f'u{i}x{k}' for k in range(60))} {common} {passage if i % 10 == 0 else ''} {i}") for i in range(100)]
    table = as_table(rows)
    lengths = substrings.level_lengths(50)
    short = substrings.short_windows(table, 50, lengths)
    left = substrings.surviving_windows(table, 50)
    assert {r["doc"] for r in left.select("doc").distinct().collect()} == set(range(0, 100, 10))
    assert short.count() > 3 * left.count() > 0


@pytest.mark.parametrize("window, seed", [(6, 1), (20, 3), (50, 2)])
def test_repeats(as_table, window, seed):
    draw = random.Random(seed)
    passages = [[f"p{draw.randint(0, 30)}" for _ in range(draw.randint(window - 2, 2 * window))] for _ in range(8)]
    rows = list(ODD) + [(30, "same " * 300), (31, "same " * 200)]
    for i in range(80):
        words = [f"u{draw.randint(0, 400)}" for _ in range(draw.randint(0, 40))]
        for _ in range(draw.randint(0, 3)):
            at = draw.randint(0, len(words))
            words[at:at] = draw.choice(passages)
        rows.append((draw.choice([40 + i, 40 + i // 2]), "  ".join(words)))
    assert ordered(substrings.remove_repeats(as_table(rows), window).drop("kept_text").collect()) == brute_repeats(rows, window)


# --- quality rules


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for k in range(len(words) - 7):
        windows[tuple(words[k : k + 8])].append(k)
    repeated = {p for at in windows.values() if len(at) > 1 for k in at for p in range(k, k + 8)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), n < 20 or 100 * len(repeated) > 30 * n)


def test_counts_of_each_text(as_table):
    draw = random.Random(4)
    pool = ["a", "b", "é中", "#x", "|", "long-word", "\n", "\n", "\x0b", "\x1c", "\x85", " "]
    rows = ODD + [(10 + i, " ".join(draw.choice(pool[: 2 + i % 11]) for _ in range(draw.randint(0, 80)))) for i in range(150)]
    got = quality_rules.judge(as_table(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert ordered(got.collect()) == ordered((i, *brute_counts(t)) for i, t in rows)


def test_lines_that_many_documents_of_a_host_share(as_table, empty):
    letters = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    body = lambda i: " ".join(f"w{letters(i)}x{k}" for k in range(25))
    rows = [(i, f"Visit  page {100 + i} now\n{body(i)}", "en", "busy") for i in range(30)]
    rows += [(100 + i, f"Visit page {100 + i} now\n{body(100 + i)}", "en", "calm") for i in range(3)]
    rows += [(110 + i, body(110 + i), "en", "calm") for i in range(5)]
    rows += [(200, "\n".join(["visit page 777 now"] * 6 + ["only these are left"]), "en", "busy"), (201, None, "en", None)]
    table = as_table(rows)
    got = {r["doc_id"]: r for r in quality_rules.judge(table).collect()}
    assert all(got[i]["n_removed_words"] == 4 and got[i]["kept"] for i in range(30))
    assert all(got[100 + i]["n_removed_words"] == 0 and got[100 + i]["kept"] for i in range(3))
    assert got[200]["n_removed_words"] == 24 and got[200]["depleted"] and not got[200]["kept"] and not got[201]["kept"]
    cleaned = {r["doc_id"]: r["text"] for r in quality_rules.cleaned_documents(table).collect()}
    assert cleaned[3] == body(3) and cleaned[102].startswith("Visit page 102 now\n") and 200 not in cleaned
    assert quality_rules.judge(empty).collect() == []


def brute_lines(rows):
    """Removed words and whether the document is depleted, per row, with the registered limits."""
    normal = lambda line: re.sub(r"\d", "0", " ".join(line.lower().split()))
    lines = [[x for x in (t or "").split("\n") if WORD.search(x)] for _, t, _, _ in rows]
    docs, having = defaultdict(set), defaultdict(set)
    for (_, text, _, host), own in zip(rows, lines):
        docs[host].add(text or "")
        for line in own:
            having[host, normal(line)].add(text or "")
    out = []
    for (doc_id, text, _, host), own in zip(rows, lines):
        often = lambda line: len(having[host, line]) >= 4 and len(having[host, line]) > 0.05 * len(docs[host])
        gone = sum(len(WORD.findall(x)) for x in own if often(normal(x)))
        n = len(WORD.findall(text or ""))
        depleted = gone > 0 and (n - gone < 10 or n - gone < 0.3 * n)
        out.append((doc_id, gone, depleted, not brute_counts(text)[-1] and not depleted))
    return ordered(out)


@pytest.mark.parametrize("size", [60, 600])
def test_frequent_lines_equal_brute_force(as_table, size):
    """Random hosts and lines; whatever the size, documents of nothing but a host's boilerplate go."""
    draw = random.Random(size)
    hosts = ["a.org", "b.org", "", None]
    shared = {h: [" ".join(f"{h}s{draw.randint(0, 10**6)}" for _ in range(draw.randint(3, 12))) for _ in range(6)] for h in hosts}
    rows = []
    for i in range(size):
        host = draw.choice(hosts)
        own = [" ".join(f"x{draw.randint(0, 10**6)}" for _ in range(draw.randint(1, 12))) for _ in range(draw.randint(0, 8))]
        own += [line.upper() if draw.random() < 0.3 else f" {line} " for line in shared[host] if draw.random() < 0.6]
        draw.shuffle(own)
        rows.append((i, "\n".join(own) if draw.random() < 0.95 else None, "en", host))
    rows += [(1000 + k, "\n".join(shared[h] * 2), "en", h) for k, h in enumerate(hosts)]
    got = {r["doc_id"]: r for r in quality_rules.judge(as_table(rows)).collect()}
    assert ordered((i, r["n_removed_words"], r["depleted"], r["kept"]) for i, r in got.items()) == brute_lines(rows)
    assert all(got[1000 + k]["depleted"] and not got[1000 + k]["kept"] for k in range(4))


# --- quality classifier


def test_scores_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_gam.score_documents(docs, quality_gam.train(docs, labels))
    rows = scored.join(labels.select("doc_id", "quality"), "doc_id").where("held_out AND quality IS NOT NULL").collect()
    good = np.array([r["score"] for r in rows if r["quality"] == 1])
    bad = np.array([r["score"] for r in rows if r["quality"] == 0])
    assert len(good) > 10 and len(bad) > 10
    assert (good[:, None] > bad[None, :]).mean() > 0.9
    assert scored.count() == docs.count()


def test_scores_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (None, 0), (77, 1), (4, None)], "doc_id long, quality int")
    model = quality_gam.train(odd, labels)
    rows = quality_gam.score_documents(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_gam.score_documents(empty, quality_gam.train(empty, labels)).collect() == []
    assert quality_gam.good_documents(odd, model, 0.0).count() == len(ODD)


def test_added_trees_find_an_interaction():
    x = np.random.default_rng(2).random((4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95


# --- personal data

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    odd = [int(d) for d in digits[::-1]]
    return (sum(odd[0::2]) + sum(sum(divmod(2 * d, 10)) for d in odd[1::2])) % 10 == 0


def base_passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15


def brute_base(text):
    text = text or ""
    # Without an at sign there is no address; searching a long text for one takes time in its square.
    kinds = [(n, k) for n, k in enumerate(BASE) if k != "email" or "@" in text]
    spans = [(m.start(), n, k, m.end()) for n, k in kinds for m in BASE[k].finditer(text) if base_passes(k, m[0])]
    listed = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))
    counts = Counter(k for _, _, k, _ in spans)
    return (*(counts[k] for k in BASE), hashlib.sha256(listed.encode()).hexdigest()), listed


def test_base_spans(as_table, empty):
    draw = random.Random(6)
    bits = ["a", "b.c", "@", ".", "+1", "4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.1", "300.1.1.1", "007.0.0.255", "1.2.3.4.5.6.7.8"]
    bits += ["+44 (20) 7946-0958", "555-123-4567", "x@y.com", "x@y..com", "me [at] site [dot] org", "é😀", " ", " ", "-", "\n", "12", "(", "card ", "é@z.de"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 14))) for _ in range(400)]
    rows = ODD + [(10 + i, t) for i, t in enumerate(texts)] + [(900, "1" * 5000), (901, "a." * 5000 + "@"), (902, "1." * 5000)]
    table = as_table(rows)
    found = personal_data.find_personal_data(table).collect()
    got = ordered((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in found)
    assert got == ordered((i, *brute_base(t)[0]) for i, t in rows)
    text_of = dict(rows)
    for r in found:
        if (r["doc_id"] or 0) >= 10:
            base = [s for s in brute_base(text_of[r["doc_id"]])[1].split(",") if s]
            assert set(base) <= set(r["spans"].split(","))
    masked = {r["doc_id"]: r["text"] for r in personal_data.masked_documents(table).collect()}
    for r in found:
        if (r["doc_id"] or 0) >= 10:
            text, out, end = text_of[r["doc_id"]], [], 0
            for kind, start, stop in (s.split(":") for s in r["spans"].split(",") if s):
                if int(stop) > end:
                    out += [text[end : max(end, int(start))], f"<{kind}>"]
                    end = int(stop)
            assert masked[r["doc_id"]] == "".join(out) + text[end:]
    assert personal_data.find_personal_data(empty).collect() == []


# Text ahead, a span the base cannot reach, and its kind; None for numbers and words that are no personal data.
ADDED = [
    ("call me at ", "(212) 555-0{n:03}", "phone"), ("phone: ", "415-555-0{n:03}", "phone"), ("Tel. ", "030 1234{n:03}", "phone"),
    ("my mobile is ", "0171-55 66 0{n:03}", "phone"), ("write to ", "jane.doe{n} [at] example [dot] org", "email"),
    ("e-mail ", "bob{n}(at)site.com", "email"), ("contact ", "x{n} [AT] mail.example.de", "email"),
    ("the part ", "100-555-0{n:03}", None), ("number ", "212-555-0{n:03}-77", None), ("as ", "4111 1111 1111 1{n:03}", None),
    ("section ", "two [at] least", None), ("version ", "300.{n}.1.1", None), ("of ", "99 1234567 {n:03}", None), ("in ", "0123/4{n:03}567890123", None),
]


def test_added_spans_are_right(as_table):
    """Precision and recall, by kind, of spans that only the method finds; none that failed its check without words ahead."""
    draw = random.Random(9)
    rows, truth = [], set()
    for i in range(600):
        ahead, form, kind = draw.choice(ADDED)
        shown = form.format(n=draw.randint(0, 999))
        text = f"Some words. {ahead}{shown} and then more."
        if draw.random() < 0.5:
            text = f"Mail to a{i}@example.com or +1 (555) 010-{i:04}, host 10.0.0.1. " + text
        rows.append((i, text))
        if kind:
            truth.add((i, f"{kind}:{text.index(shown)}:{text.index(shown) + len(shown)}"))
    found = set()
    for r in personal_data.find_personal_data(as_table(rows)).collect():
        base = set(brute_base(dict(rows)[r["doc_id"]])[1].split(","))
        found |= {(r["doc_id"], span) for span in r["spans"].split(",") if span and span not in base}
    for kind in ("email", "phone"):
        right, got = ({x for x in spans if x[1].startswith(kind)} for spans in (truth, found))
        assert len(got & right) >= 0.9 * len(got) and len(got & right) >= 0.9 * len(right) > 20
    assert {span.split(":")[0] for _, span in found} <= {"email", "phone"}


def test_labelers_vote(as_table):
    texts = ["pay by card 4111 1111 1111 1112", "see 4111 1111 1111 1112", "server 255.1.1.1", "call +1 (212) 555-0199", "a@b.zz"]
    _, found = personal_data.matches(as_table(list(enumerate(texts))))
    votes = personal_data.voted(personal_data.candidates(found)).select("match", "kind", "check", "gazetteer", "context").collect()
    got = {(r["match"], r["kind"]): tuple(r)[2:] for r in votes}
    assert got["255.1.1.1", "ip"] == (1, 0, 1) and got["a@b.zz", "email"] == (1, 0, -1)
    assert got["+1 (212) 555-0199", "phone"] == (1, 1, 1) and ("(212) 555-0199", "phone") not in got
    assert sorted(tuple(r)[2:] for r in votes if r["match"] == "4111 1111 1111 1112" and r["kind"] == "card") == [(0, 1, -1), (0, 1, 1)]


def test_expectation_maximization_finds_the_reliable_labelers():
    draw = random.Random(3)
    votes, truth = Counter(), defaultdict(list)
    right = (0.95, 0.9, 0.6)
    for _ in range(4000):
        true = draw.random() < 0.4
        p = ("card", *(int(true if draw.random() < a else not true) if draw.random() < 0.8 else -1 for a in right))
        votes[p] += 1
        truth[p].append(true)
    chance = personal_data.label_model(votes)
    agreed = sum((chance[p] > 0.5) == t for p, seen in truth.items() for t in seen) / 4000
    assert agreed > 0.88
    assert chance["card", 1, 1, 0] > 0.9 > 0.1 > chance["card", 0, 0, 1]  # the weak labeler is outvoted


# --- pipeline


def test_pipeline_equals_its_stages_by_brute_force(spark):
    """Every stage's rows from those of the one before, without Spark but for the trained model."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality_gam.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    good = [(i, t) for i, t in rows if model.score(np.array([quality_gam.features(t or "")]))[0] >= quality_gam.THRESHOLD]
    last = {}
    for i, t in good:
        last[lowered(t)] = max(last.get(lowered(t), i), i)
    single = [(i, t) for i, t in good if last[lowered(t)] == i]
    own = [r[0] for r in brute_near(single) if r[0] == r[1]]
    left = docs.where(F.col("doc_id").isin(own))
    texts = personal_data.masked_documents(left).select("doc_id", "text").collect()
    library = load(vocabulary_path(WORDS))
    expected = []
    for doc_id, text in texts:
        n = len(library.encode(text or "", add_special_tokens=False).ids) + 1
        expected += [(doc_id, k // packing.CAPACITY, k, min(packing.CAPACITY, n - k)) for k in range(0, n, packing.CAPACITY)]
    got = corpus_pipeline.run(spark, SMALL).select("doc_id", "piece", "start", "length").collect()
    assert ordered(got) == ordered(expected)
    assert 0 < len(own) < len(rows)


def test_stages_take_odd_rows_and_empty_tables(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            assert set(stage(spark, docs, SMALL).columns) == set(docs.columns)
        assert packing.pack_documents(docs, vocabulary_path(WORDS)).count() >= docs.count()
