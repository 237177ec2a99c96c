"""Stored odds pages: which ones to look at, and the game rows in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from calibrant.functions.text import parse_date, parse_moneyline, parse_number


def page_urls(games: DataFrame, base: str, since: str) -> DataFrame:
    """One page address per day with games, from `since` on."""
    return (
        games.where(F.col("date") >= F.lit(since).cast("date"))
        .select("date")
        .distinct()
        .select("date", F.concat(F.lit(base), F.regexp_replace(F.col("date").cast("string"), "-", "")).alias("url"))
    )


# Marks that stand for tags while a page is taken apart: the start and the end of a tag, and the
# place where an element of interest opens.
_TAG, _END, _HERE = "\x01", "\x02", "\x03"

_DAY = r"""(?:(?=[^>]*?\s(?i:rel)\s*=\s*["']?(\d{4}[-/]\d{1,2}[-/]\d{1,2})))?"""
_CLASS = r"""(?:[^>]*?\s(?i:class)\s*=\s*(?:"([^">]*)"|'([^'>]*)'|([^"'\s>]+)))?"""
_SILENT = r"(?is:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>)"
_MARKED = rf"[\x01-\x03]|<(?:{_SILENT}|(/)?(?i:(d)iv|(s)pan)\b{_DAY}{_CLASS}[^>]*>)"


def _marked(html: Column) -> Column:
    """The page with its `div` and `span` tags reduced to marks, in one pass over the text.

    A mark holds a slash if the tag closes, the tag's first letter, its classes and its day. Comments,
    scripts, styles and control characters become marks that say nothing.
    """
    return F.regexp_replace(html, _MARKED, f"{_TAG}$1$2$3 $5$6$7 $4{_END}")


def _mark(tag: str, css_class: str, rest: str = f"[^{_END}]*") -> str:
    """Pattern of an opening tag's mark whose class list has the class."""
    return rf"{_TAG}(?i:{tag[0]}) (?:[^{_END}]*\s)?{css_class}\s{rest}{_END}"


def _texts(text: Column, tag: str, css_class: str) -> Column:
    """Content of every such element, in order."""
    return F.regexp_extract_all(text, F.lit(_mark(tag, css_class) + rf"((?s:.*?)){_TAG}/(?i:{tag[0]})"), F.lit(1))


def _cut(text: Column, css_class: str) -> Column:
    """The text cut at the opening tags of such `div` elements."""
    # Cutting at a single character needs no pattern, which would be compiled anew for every row.
    return F.split(F.regexp_replace(text, _mark("div", css_class), _HERE), _HERE)


# Character references of HTML; the ampersand comes last.
_REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def _plain(content: Column) -> Column:
    """Text of an element's content: inner tags dropped, character references resolved."""
    tagged = content.contains("<") | content.contains(_TAG)
    text = F.when(tagged, F.regexp_replace(content, f"<[^>]*>|{_TAG}[^{_END}]*{_END}", "")).otherwise(content)
    plain = text
    for reference, character in _REFERENCES:
        plain = F.replace(plain, F.lit(reference), F.lit(character))
    return F.when(text.contains("&"), plain).otherwise(text)


def _pieces(text: Column) -> Column:
    """The text cut ahead of every mark. What it starts with is no mark."""
    return F.split(F.concat(F.lit(_END), text), _TAG)


def _inside(pieces: Column) -> Column:
    """The text up to the `</div>` that closes the element whose content the pieces are.

    The state of the scan is one number, the pieces so far and the open elements, which is 0 at the end.
    """
    piece_more, elements = 1 << 32, (1 << 32) - 1

    def step(state: Column, piece: Column) -> Column:
        opened = state.bitwiseAND(F.lit(elements))
        div = piece.startswith("d ") | piece.startswith("D ")
        end = piece.startswith("/d") | piece.startswith("/D")
        return (
            F.when(opened == 0, state)
            .when(div, state + F.lit(piece_more + 1))
            .when(~end, state + F.lit(piece_more))
            .when(opened == 1, state - F.lit(1))
            .otherwise(state + F.lit(piece_more - 1))
        )

    found = F.aggregate(pieces, F.lit(1).cast("long"), step)
    return F.array_join(F.slice(pieces, F.lit(1), F.shiftright(found, 32).cast("int")), _TAG)


def page_rows(pages: DataFrame) -> DataFrame:
    """One row per finished game on the pages.

    A block without a finished status gives no row. Fields that a block lacks are null; lines
    come from its first book only, so a book with one line does not borrow from the next. The rows
    have the columns of `schemas.PAGE_ROWS`; scores are whole numbers, as lines and games have them.
    """
    opened = pages.select(_cut(_marked(F.col("html")), "holder-complete").alias("opened"))
    blocks = (
        opened.select(F.explode(F.slice("opened", 2, F.greatest(F.size("opened") - 1, F.lit(0)))).alias("rest"))
        .select(_pieces(F.col("rest")).alias("pieces"))
        .select(_inside(F.col("pieces")).alias("block"))
    )
    status = F.regexp_extract_all("block", F.lit(_mark("div", "status-complete", f"([^{_END}]*)")), F.lit(1))
    # Only a finished block is looked at any further.
    book = F.coalesce(F.get(_cut(F.col("block"), "eventLine-book"), F.lit(1)), F.lit(""))
    finished = blocks.select("block", F.explode(status).alias("status")).select("block", "status", _pieces(book).alias("book"))
    found = finished.select(
        "status",
        _texts(F.col("block"), "span", "team-name").alias("team"),
        _texts(F.col("block"), "span", "current-score").alias("score"),
        _texts(_inside(F.col("book")), "div", "eventLine-book-value").alias("moneyline"),
    )
    day = F.regexp_extract("status", r"(\d{4}[-/]\d{1,2}[-/]\d{1,2})$", 1)

    names = ("team", "score", "moneyline")
    fields = found.select(
        F.replace(day, F.lit("/"), F.lit("-")).alias("day"),
        *(_plain(F.get(c, F.lit(i))).alias(f"{c}{i + 1}") for c in names for i in (0, 1)),
    )
    return fields.select(
        parse_date(F.col("day")).alias("date"),
        "team1",
        "team2",
        *(parse_number(F.col(c)).try_cast("int").alias(c) for c in ("score1", "score2")),
        *(parse_moneyline(F.col(c)).alias(c) for c in ("moneyline1", "moneyline2")),
    )
