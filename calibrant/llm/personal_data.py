"""Personal data in texts by weak supervision. DataFrame and SQL operations only.

Candidates are the matches of the four base patterns, also those that fail their check, and of
looser ones for what the base cannot reach: e-mail addresses with the at sign or the dots spelled
out, and phone numbers without a country code. Three labelers vote on each candidate, for, against or
not at all: the base pattern's check, a gazetteer of fixed values, and words in the text ahead.
Each looks at something else; how many digits there are is part of the check alone, since
labelers that see the same thing would count it twice. Expectation maximization finds how far
each labeler is right about each kind, from the counts of vote patterns alone, whose number is
fixed (4 kinds, 3 votes, 3 labelers), starting from labelers that are more often right than wrong.
Its posteriors weight the counts from which a naive Bayes classifier over span features is
trained, and that decides about candidates outside the base. A base match that failed its check
is taken only if the words ahead vote for it, a loose one only if some labeler does. Base spans
always stay.

Patterns start a match only where a run of their characters starts and use possessive
repetition, so a long text costs time in proportion to its length.

Defined cases: a missing text is empty; rows with missing or equal ids are separate rows.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, functions as F

from calibrant.llm.common import located, stored

# The kinds in the order they are listed in.
KINDS = ["email", "ip", "card", "phone"]

_LOCAL = "[A-Za-z0-9._%+-]"
_RUN = r"(?:\G|(?<!{0}))"
_LABEL = "[A-Za-z0-9-]++"
_AT, _DOT = (rf"[\[(<{{] ?(?i:{word}) ?[\])>}}]" for word in ("at", "dot"))
# No digits, separators or country code right ahead.
_NO_CODE = r"(?<![0-9+.-])(?<!\+[0-9]{1,3}[ .(-]{1,2})"
# Kind, whether it is a base pattern, a test that a text must pass first, and the pattern. The
# base patterns find the same matches as
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+      ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+                                  phone \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = [
    ("email", True, "@", _RUN.format(_LOCAL) + rf"{_LOCAL}++@{_LABEL}(?:\.{_LABEL})++"),
    ("ip", True, r"[0-9]\.[0-9]", _RUN.format("[0-9]") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", True, "[0-9]", r"[0-9](?:[ -]?[0-9])++"),
    ("phone", True, r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    ("email", False, r"(?i)[\[(<{] ?at ?[\])>}]", _RUN.format(_LOCAL) + rf"{_LOCAL}++ ?{_AT} ?{_LABEL}(?: ?(?:\.|{_DOT}) ?{_LABEL})++"),
    ("phone", False, "[0-9]{3}[ .-][0-9]{4}", rf"{_NO_CODE}\(?[0-9]{{3}}\)?[ .-][0-9]{{3}}[ .-][0-9]{{4}}(?![0-9.-]*[0-9])"),
    ("phone", False, "0[0-9]{1,4}[ /-][0-9]", rf"{_NO_CODE}0[0-9]{{1,4}}[ /-][0-9]{{2,8}}(?:[ -][0-9]{{2,4}}){{0,3}}(?![0-9.-]*[0-9])"),
]

# What the gazetteers list.
TOP_DOMAINS = ["com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "us"]
CARD_STARTS = "^(4|5[1-5]|2[2-7]|3[47]|36|6011|65)"
PHONE_STARTS = r"^(\+(1|44|49|33|34)|\(?[2-9][0-9]{2}\)?[ .-]|0[1-9])"
NO_HOSTS = r"^(0|127|255|22[4-9]|2[3-5][0-9])\."
CUES = {
    "email": "mail|contact|write to|correo|courriel",
    "ip": r"\bip\b|host|server|address|login",
    "card": "card|visa|pay|karte|carte|tarjeta|konto",
    "phone": r"phone|\bcall|\btel\b|\btel\.|fax|mobile|dial|rufnummer|\banruf",
}

LABELERS = ["check", "gazetteer", "context"]
# Ahead of the data a labeler counts as right TRUST times as often as wrong.
EM_ROUNDS, PRIOR, TRUST, ACCEPT = 30, 0.5, 4.0, 0.5
_AHEAD = 40


def matches(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The documents with their rows' locators, and per row what the patterns match."""
    docs, place = located(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(place.alias("at"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    none = F.array().cast("array<string>")
    found = base.select(
        "*",
        *(
            F.when(F.col("text").rlike(test), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none).alias(f"m{i}")
            for i, (_, _, test, pattern) in enumerate(PATTERNS)
        ),
    )

    def gaps(i: int) -> Column:
        return F.when(F.size(f"m{i}") > 0, F.split("text", PATTERNS[i][3], -1)).otherwise(none)

    def entry(i: int) -> Column:
        return F.struct(
            F.lit(i).alias("pattern"),
            F.col(f"m{i}").alias("match"),
            F.transform(f"g{i}", F.length).alias("gap"),
            F.transform(f"g{i}", lambda g: F.lower(F.right(g, F.lit(_AHEAD)))).alias("ahead"),
        )

    numbers = range(len(PATTERNS))
    cut = found.select("at", "doc_id", *(f"m{i}" for i in numbers), *(gaps(i).alias(f"g{i}") for i in numbers))
    return docs, cut.select("at", "doc_id", F.filter(F.array(*map(entry, numbers)), lambda e: F.size(e["match"]) > 0).alias("found"))


def candidates(found: DataFrame) -> DataFrame:
    """One row per match with its place, in code points: at, kind, base, start, end, match, ahead."""
    from pyspark.sql import Window

    rows = (
        found.select("at", F.explode("found").alias("f"))
        .select("at", F.col("f.pattern").alias("pattern"), F.posexplode(F.arrays_zip("f.match", "f.gap", "f.ahead")).alias("i", "m"))
        # One gap more than matches: the text behind the last one.
        .where("m.match IS NOT NULL")
    )
    so_far = Window.partitionBy("at", "pattern").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    length = F.length("m.match")
    end = F.sum(F.col("m.gap") + length).over(so_far)
    kind = F.element_at(F.array(*(F.lit(k) for k, *_ in PATTERNS)), F.col("pattern") + 1)
    base = F.element_at(F.array(*(F.lit(b) for _, b, *_ in PATTERNS)), F.col("pattern") + 1)
    return rows.select(
        "at", kind.alias("kind"), base.alias("base"), (end - length).alias("start"), end.alias("end"), F.col("m.match").alias("match"), F.col("m.ahead").alias("ahead")
    )


def passes(kind: Column, match: Column) -> Column:
    """The check that a base match must pass."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", small)
        .when(kind == "card", F.length(digits).between(14, 19) & F.call_function("luhn_check", F.substring(digits, 1, 19)))
        .otherwise(F.length(digits).between(10, 15))
    )


def voted(spans: DataFrame) -> DataFrame:
    """The candidates with `sure` (a base span), the labelers' votes and the features."""
    kind, match, ahead = F.col("kind"), F.col("match"), F.col("ahead")
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    ok = passes(kind, match)
    domain = F.lower(F.regexp_extract(F.right(match, F.lit(_AHEAD)), "([A-Za-z]+)$", 1))
    listed = (
        F.when(kind == "email", domain.isin(TOP_DOMAINS))
        .when(kind == "ip", ~match.rlike(NO_HOSTS))
        .when(kind == "card", digits.rlike(CARD_STARTS))
        .otherwise(match.rlike(PHONE_STARTS))
    )
    cue = F.lit(False)
    for name, words in CUES.items():
        cue = F.when(kind == name, ahead.rlike(words)).otherwise(cue)
    return spans.select(
        "*",
        (F.col("base") & ok).alias("sure"),
        # The loose patterns have no check, but the number of digits that a phone number has.
        F.when(F.col("base"), ok.cast("int")).when((kind == "phone") & ~n.between(8, 12), 0).otherwise(-1).alias("check"),
        listed.cast("int").alias("gazetteer"),
        F.when(cue, 1).otherwise(-1).alias("context"),
        F.least(n, F.lit(20)).alias("f_digits"),
        match.rlike("[ ().-]").cast("int").alias("f_split"),
        ahead.rlike(r"[\p{L}0-9]$").cast("int").alias("f_joined"),
    )


# What a span looks like; the check is left out, as it follows from the digits.
FEATURES = ["gazetteer", "context", "f_digits", "f_split", "f_joined"]


def label_model(patterns: dict[tuple, int]) -> dict[tuple, float]:
    """Chance of being personal per (kind, votes), by expectation maximization over their counts."""

    def start(votes: tuple) -> float:
        cast = [v for v in votes if v >= 0]
        return (sum(cast) + 0.5) / (len(cast) + 1)

    chance = {p: start(p[1:]) for p in patterns}
    for _ in range(EM_ROUNDS):
        mass = defaultdict(lambda: PRIOR)
        for kind in {p[0] for p in patterns}:
            for true in (0, 1):
                for j in range(len(LABELERS)):
                    mass[kind, true, j, true] = PRIOR * TRUST
                    mass[kind, true, j] = PRIOR * TRUST
        for p, n in patterns.items():
            for true, weight in ((1, chance[p] * n), (0, (1 - chance[p]) * n)):
                mass[p[0], true] += weight
                for j, vote in enumerate(p[1:]):
                    mass[p[0], true, j, vote] += weight
                    if vote >= 0:
                        mass[p[0], true, j] += weight
        for p in patterns:
            odds = math.log(mass[p[0], 1] / mass[p[0], 0])
            for j, vote in enumerate(p[1:]):
                if vote >= 0:
                    of = [mass[p[0], t, j, vote] / (mass[p[0], t, j] + PRIOR) for t in (1, 0)]
                    odds += math.log(of[0] / of[1])
            chance[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return chance


def span_classifier(spans: DataFrame) -> Column:
    """Chance that a candidate is personal, as a column over its features.

    What comes to the driver are counts per combination of votes and feature values, whose
    number does not depend on the corpus.
    """
    counted = spans.groupBy("kind", "check", *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns: dict[tuple, int] = defaultdict(int)
    for row in counted:
        patterns[tuple(row[c] for c in ("kind", *LABELERS))] += row["n"]
    chance = label_model(patterns)
    mass = defaultdict(lambda: PRIOR)
    values = defaultdict(set)
    for row in counted:
        p = chance[tuple(row[c] for c in ("kind", *LABELERS))]
        for true, weight in ((1, p * row["n"]), (0, (1 - p) * row["n"])):
            mass[row["kind"], true] += weight
            for f in FEATURES:
                mass[row["kind"], true, f, row[f]] += weight
                values[row["kind"], f].add(row[f])
    odds = {f"{k}": math.log(mass[k, 1] / mass[k, 0]) for k in KINDS}
    for (k, f), seen in values.items():
        for v in seen:
            of = [mass[k, t, f, v] / (mass[k, t] + PRIOR * len(seen)) for t in (1, 0)]
            odds[f"{k} {f} {v}"] = math.log(of[0] / of[1])
    table = F.create_map(*(F.lit(x) for pair in odds.items() for x in pair))
    total = table[F.col("kind")]
    for f in FEATURES:
        total = total + F.coalesce(table[F.concat_ws(" ", "kind", F.lit(f), F.col(f).cast("string"))], F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def personal_spans(found: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Per row with any: at, base and spans, arrays of (start, order, kind, end) in their order."""
    spans = stored(voted(candidates(found)), "span-votes")
    needed = F.when(F.col("check") == 0, F.col("context") == 1).otherwise((F.col("context") == 1) | (F.col("gazetteer") == 1))
    taken = F.col("sure") | (needed & (span_classifier(spans) >= accept))
    judged = spans.select("at", "kind", "start", "end", "sure", taken.alias("taken")).where("taken")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("start", order.alias("order"), "kind", "end")
    grouped = judged.groupBy("at").agg(
        F.collect_list(F.when(F.col("sure"), span)).alias("base"), F.collect_list(F.when(~F.col("sure"), span)).alias("more")
    )
    # A further span that touches a base one says nothing new.
    apart = F.filter(
        "more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    )
    return grouped.select("at", F.sort_array("base").alias("base"), F.sort_array(F.concat("base", apart)).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Per row: doc_id, counts of base spans by kind, digest of the base spans, and all spans."""
    _, found = matches(docs)
    found = stored(found, "span-matches")
    joined = found.select("at", "doc_id").join(personal_spans(found, accept), "at", "left")
    none = F.array().cast("array<struct<start:bigint,order:bigint,kind:string,end:bigint>>")
    base, spans = (F.coalesce(c, none) for c in ("base", "spans"))

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return joined.select("doc_id", *map(count, KINDS), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(spans).alias("spans"))


def masked_documents(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """All rows and columns, with every span in `text` replaced by its kind in angle brackets."""
    docs, found = matches(docs)
    spans = personal_spans(stored(found, "span-matches"), accept)
    places = spans.select(F.col("at").alias("_at"), F.col("spans").alias("_spans"))
    docs, place = located(docs)
    joined = docs.join(places, place == places["_at"], "left")
    text, found_spans = docs["text"], places["_spans"]

    def piece(span: Column, i: Column) -> Column:
        """Text between the span's start and the ends of those ahead of it, and its placeholder."""
        before = F.when(i > 0, F.array_max(F.transform(F.slice(found_spans, 1, i), lambda s: s["end"]))).otherwise(0)
        between = F.substring(text, (before + 1).cast("int"), F.greatest(span["start"] - before, F.lit(0)).cast("int"))
        return F.when(span["end"] > before, F.concat(between, F.lit("<"), span["kind"], F.lit(">"))).otherwise("")

    last = F.array_max(F.transform(found_spans, lambda s: s["end"]))
    masked = F.concat(
        F.array_join(F.transform(found_spans, piece), ""), F.substring(text, (last + 1).cast("int"), F.lit(2**31 - 1))
    )
    return joined.select(*(F.when(found_spans.isNull(), text).otherwise(masked).alias(c) if c == "text" else docs[c] for c in docs.columns))
