import time

import pytest

from termloom import vocab
from termloom.functions.html import main_text, read_page
from termloom.operators import content

LONG = "word " * 60


def text_of(html):
    return main_text(html)[0]


@pytest.mark.parametrize("tag", [t for t in vocab.BOILERPLATE_TAGS if t != "input"])
def test_boilerplate_tags(tag):
    assert text_of(f"<body>keep<{tag}>gone</{tag}> this</body>") == "keep this"


@pytest.mark.parametrize(
    "attr",
    ['role="dialog"', "aria-hidden='true'", "id=ads", 'id="my-cookie-x"', 'id="top_banner"',
     'class="x cookies"', 'class="modal-open"', 'class="a popup2"', 'class="bannerish"']
    + [f'class="a {c} b"' for c in vocab.BOILERPLATE_CLASSES],
)
def test_boilerplate_attributes(attr):
    assert text_of(f"<body>keep<div {attr}>gone<p>too</div> this</body>") == "keep this"


@pytest.mark.parametrize("attr", ['class="adx"', 'class="Ad"', 'id="ad"', 'role="note"', 'aria-hidden="false"',
                                  'class="sidebars"', 'data-class="ad"', 'id="Cookie"'])
def test_near_misses_stay(attr):
    assert text_of(f"<body>a<div {attr}>b</div>c</body>") == "abc"


@pytest.mark.parametrize(
    "open_tag,close_tag",
    [("<main>", "</main>"), ("<article>", "</article>"), ('<div role="main">', "</div>"),
     ('<div class="content">', "</div>"), ('<p id="content">', "</p>"), ('<div id="main">', "</div>"),
     ('<div class="post-content">', "</div>"), ('<div class="entry-content">', "</div>"),
     ('<section class="x article-body">', "</section>")],
)
def test_main_places(open_tag, close_tag):
    assert text_of(f"<body>around{open_tag}{LONG}{close_tag}around</body>") == LONG


def test_place_order_is_by_list_not_by_document():
    html = f"<body><article>A{LONG}</article><main>M{LONG}</main></body>"
    assert main_text(html) == (f"M{LONG}", "main")


def test_length_is_tested_on_trimmed_raw_text():
    exactly, more = "x" * 200, "x" * 201
    assert text_of(f"<body>b<main> {exactly} ﻿</main></body>").startswith("b")
    assert text_of(f"<body>b<main>{more}</main></body>") == more
    spaced = "x" + " " * 199 + "y"
    assert text_of(f"<body>b<main>{spaced}</main></body>") == spaced


def test_several_and_nested_matches():
    assert text_of(f"<article>{LONG}</article>-<article>two</article>") == LONG + "two"
    inner = f"<article>in{LONG}</article>"
    assert text_of(f"<body><article>out{inner}</article></body>") == f"outin{LONG}" + f"in{LONG}"


def test_removed_inside_main_does_not_count():
    html = f"<main>a<header>{LONG}</header>b</main>c"
    assert main_text(html) == ("abc", "body")


def test_broken_and_odd_html():
    assert text_of("no tags at all") == "no tags at all"
    assert text_of("<p>a<p>b<br>c") == "abc"
    assert text_of('<p class="ad">a<p>b') == "b"
    assert text_of("<ul><li class=ad>a<li>b</ul>c") == "bc"
    assert text_of("<div>a</p></span>b</div>c") == "abc"
    assert text_of("a < b and c <3 d") == "a < b and c <3 d"
    assert text_of("x<!-- <p>no</p> -->y<!DOCTYPE html>z") == "xyz"
    assert text_of('<a title="a > b">t</a>') == "t"
    assert text_of("x<div unclosed") == "x"
    assert text_of("&lt;b&gt; &amp; &eacute;&nbsp;&#65;") == "<b> & é A"
    assert text_of("<head><title>T</title></head><body>b</body>") == "b"
    assert text_of('<script>var a = "</p><div>";</script>b') == "b"
    assert text_of("<b>x<p>y</b>z</p>w") == "xyzw"
    assert text_of("<table><tr><td class=ad>a<td>b</table>c") == "bc"
    assert text_of('<body class="modal-open">gone</body>') == ""
    assert text_of("") == ""


def test_broken_tags_stay_linear():
    assert len(text_of("<a " * 50_000)) == 0
    assert text_of('<a b="' * 20_000 + ">") == ""
    assert text_of("<div>" * 3_000 + "x" + "</div>" * 3_000) == "x"


def test_extract_text_rows(spark):
    rows = [(1, "http://a", f"<main> {LONG}\n\n﻿ x</main>", None), (2, "http://b", None, None),
            (3, "http://c", f"<p>{LONG}", "HTTP 403 for http://c")]
    df = spark.createDataFrame(rows, "ord bigint, url string, html string, error string")
    got = {r.ord: r for r in content.gate_content(content.extract_text(df)).collect()}
    assert got[1].text == (LONG + "x") and got[1].place == "main" and got[1].error is None
    assert got[2].text is None and got[2].error == vocab.INSUFFICIENT_CONTENT
    assert got[3].error == "HTTP 403 for http://c" and got[3].text is None


def test_one_bad_page_becomes_an_error_row():
    row = read_page(object(), 200)
    assert row["text"] is None and row["error"]
    assert read_page(None, 200) == {"text": None, "place": None, "error": None}


@pytest.mark.parametrize(
    "html, text",
    [
        ("a<svg><title/></svg>b<p>c", "abc"),
        ("<div>a<svg/>b</div>c", "abc"),
        ("a<svg><style>b</style></svg>c", "ac"),
        ("a<math><mi>x</mi></math>b", "axb"),
        ("x<svg><g><p>y</p>z", "xyz"),
        ("a<!-->b<!-- x -->c", "abc"),
        ("a<!--->b", "ab"),
        ("a<!--x--!>b", "ab"),
        ("a<form>b<form>c</form>d</form>e", "ade"),
        ("<h1 class=banner>x</h2>y</h1>z", "yz"),
        ("<div>a<div>b</span>c</div>d</div>e", "abcde"),
    ],
)
def test_no_content_is_lost(html, text):
    assert text_of(html) == text


@pytest.mark.parametrize(
    "html",
    ["<div>" * 200_000, "<font>" * 100_000 + "<div>" * 100_000, "<p><table>" + "<div>" * 100_000, "<b><p>" * 60_000,
     "<li><span>" * 60_000, "<svg>" + "<g>" * 100_000, "<b>" + "<i></b>" * 50_000, "<table><td>" * 50_000],
)
def test_deep_pages_take_linear_time(html):
    begun = time.process_time()
    main_text(html)
    assert time.process_time() - begun < 6
