import datetime

import pytest

from calibrant import schemas
from calibrant.sources import pages as P

DAY = datetime.date(2010, 3, 6)


def rows(spark, *htmls):
    table = spark.createDataFrame([(DAY, i, "u", h) for i, h in enumerate(htmls)], schemas.PAGES)
    return sorted((tuple(r) for r in P.page_rows(table).collect()), key=repr)


def block(inner, css="holder-complete"):
    return f'<div class="{css}">{inner}</div>'


STATUS = '<div class="status-complete" rel="2010-03-06"></div>'
TEAMS = '<span class="team-name">Miami</span><span class="team-name">Utah</span>'
SCORES = '<span class="current-score">100</span><span class="current-score">90</span>'


def book(*values):
    inner = "".join(f'<div class="eventLine-book-value">{v}</div>' for v in values)
    return f'<div class="eventLine-book">{inner}</div>'


FULL = (DAY, "Miami", "Utah", 100.0, 90.0, -300.0, 200.0)


def test_full_block(spark):
    html = "<html><body>" + block(STATUS + TEAMS + SCORES + book("-300", "+200")) + "</body></html>"
    assert rows(spark, html) == [FULL]


def test_several_blocks_and_pages(spark):
    one = block(STATUS + TEAMS + SCORES + book("-300", "+200"))
    assert rows(spark, one + one, one, "<html></html>") == [FULL] * 3


def test_block_without_finished_status_gives_no_row(spark):
    pending = '<div class="status-pending" rel="2010-03-06"></div>'
    assert rows(spark, block(pending + TEAMS + SCORES + book("-300", "+200"))) == []


def test_every_finished_status_gives_a_row(spark):
    assert rows(spark, block(STATUS * 2 + TEAMS + SCORES + book("-300", "+200"))) == [FULL] * 2


def test_lines_come_from_the_first_book_only(spark):
    html = block(STATUS + TEAMS + SCORES + book("-300") + book("-999", "+999"))
    assert rows(spark, html) == [(DAY, "Miami", "Utah", 100.0, 90.0, -300.0, None)]


def test_values_outside_the_first_book_are_not_borrowed(spark):
    stray = '<div class="eventLine-opener"><div class="eventLine-book-value">-5</div></div>'
    html = block(STATUS + TEAMS + SCORES + stray + book("-300") + stray)
    assert rows(spark, html) == [(DAY, "Miami", "Utah", 100.0, 90.0, -300.0, None)]


def test_missing_fields_are_null_and_words_are_not_numbers(spark):
    assert rows(spark, block(STATUS)) == [(DAY, None, None, None, None, None, None)]
    html = block(STATUS + TEAMS + '<span class="current-score">-</span>' + book("PK", "+200"))
    assert rows(spark, html) == [(DAY, "Miami", "Utah", None, None, None, 200.0)]


def test_nothing_is_taken_from_behind_the_block(spark):
    later = block(TEAMS + SCORES, css="holder-scheduled")
    html = block(STATUS) + later + TEAMS
    assert rows(spark, html) == [(DAY, None, None, None, None, None, None)]


def test_untidy_markup(spark):
    html = (
        "<DIV id='x' class='event holder-complete wide'>"
        '<!-- <span class="team-name">Ghost</span> -->'
        '<script>var a = \'<span class="team-name">Ghost</span>\';</script>'
        '<div rel="2010/3/6 19:00" class="status-complete late"></div>'
        '<span title="t" class="team-name first"><a href="/m">Miami</a></span>'
        "<span class='team-name'>Tom &amp; Co</span>"
        '<span class="team-names">No</span>'
        '<span class="current-score"><b>100</b></span>\n<span class="current-score">\n90 </span>'
        '<div class="eventLine-book"><div class="eventLine-book-value x"><b>-300</b></div>'
        '<div class="eventLine-book-value"><b>+200</b></div></div></DIV>'
    )
    assert rows(spark, html) == [(DAY, "Miami", "Tom & Co", 100.0, 90.0, -300.0, 200.0)]


def test_page_urls(make_games):
    games = make_games(
        [
            (1, "2010-03-06", 2010, "A", "B", 1, 2),
            (2, "2010-03-06", 2010, "C", "D", 1, 2),
            (3, "2006-01-01", 2006, "C", "D", 1, 2),
        ]
    )
    got = [tuple(r) for r in P.page_urls(games, "http://x/?date=", "2006-10-31").collect()]
    assert got == [(DAY, "http://x/?date=20100306")]


@pytest.mark.parametrize("text", ["", None])
def test_empty_pages(spark, text):
    assert rows(spark, text) == []
