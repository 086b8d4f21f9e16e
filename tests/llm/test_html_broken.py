"""Pages that are broken, very long, wrapped in forms, or hold short text of their own."""

import time

import pytest

from cloudgrid.llm import html_text

PROSE = " ".join(["This is a sentence of the article that goes on for a while."] * 20)
BODY = f"<p>{PROSE}</p><p>{PROSE}</p>"


@pytest.mark.parametrize(
    ("page", "length"),
    [
        ("<" + "a" * 1_000_000, 1_000_001),
        ("<a " * 333_000, 333_000 * 3 - 1),
        ('<a href="x ' * 90_000, 90_000 * 11 - 1),
        ("<a '\">" * 160_000, None),
        ('<a b=" > c="' * 80_000, None),
        ("<a" + " " * 1_000_000 + ">x", 1),
        ("<div>" * 100_000 + "</x>" * 120_000, 0),
        ("<b><div>" + "<span>" * 70_000 + "</b>" * 120_000, 0),
        ("<span>" * 60_000 + "<div></div>" * 50_000, 0),
        ("<div>" * 80_000 + "<li></li>" * 50_000, 0),
        ("<script>" + "</script " * 110_000, 0),
        ("<!--" * 250_000, 0),
        ("<" * 1_000_000, 1_000_000),
        ("<a " * 100_000 + "<!" * 200_000, 299_999),
    ],
)
def test_a_megabyte_of_broken_markup_takes_seconds(page, length):
    start = time.process_time()
    text = html_text.main_text(page)
    assert time.process_time() - start < 20  # a walk down the stack or the page for each tag takes hours
    assert length is None or len(text) == length


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<form><h1>Title</h1><p>{PROSE}</p></form>", f"Title {PROSE}"),
        (f"<body><form><div><p>{PROSE}</p></div><label>Name</label><input><select><option>One</select><button>Send</button></form></body>", PROSE),
        (f"<body><article><h1>Title</h1>{BODY}</article><form><p>Write to us about what you think of it now</p><textarea>x</textarea></form></body>", f"Title {PROSE} {PROSE}"),
        (f"<article>Berlin, Monday.<div>{BODY}</div></article>", f"Berlin, Monday. {PROSE} {PROSE}"),
        (f"<body>In <b>Berlin</b> the old <i>town</i> council met.<div>{BODY}</div></body>", f"In Berlin the old town council met. {PROSE} {PROSE}"),
        (f"<body>Home page<div>{BODY}</div></body>", f"{PROSE} {PROSE}"),
        (f"<body><a href=x>Home</a> | <a href=y>News and more of all that is in town today</a><div>{BODY}</div></body>", f"{PROSE} {PROSE}"),
        ("<p>&#" + "1" * 5000 + "; &#00000000065; &#x41;</p>", "� A A"),
    ],
)
def test_forms_and_short_text(page, want):
    assert html_text.main_text(page) == want


def test_tokens_end_where_they_did():
    page = """a<b c='>' d=">">x</b ><!-- > --><!doctype q><a '>y<script>if (a < b) "</p>"</script >z</1><"""
    got = [(t, n, bool(c), a) for t, n, c, a in html_text.tokens(page)]
    assert got == [("a", "b", False, " c='>' d=\">\""), ("x", "b", True, " "), ("", None, False, ""), ("", None, False, ""), ("", "a", False, " '"), ("y", "script", False, ""), ("z</1><", None, False, "")]


def test_pages_without_or_of_one_id(spark):
    rows = [(None, f"<p>{PROSE}</p>"), (1, "<p>one two</p>"), (1, None), (None, "")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, html string"))
    assert sorted((str(r.page_id), r._text) for r in out.collect()) == [("1", ""), ("1", "one two"), ("None", ""), ("None", PROSE)]
