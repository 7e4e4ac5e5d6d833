"""Text of one HTML page: the only Python that runs on executors.

Built-in functions cannot follow nested elements, so a single regular expression walks the tags and
a stack tracks what is open. Spark hands the pages over in Arrow batches.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom import vocab

# Comments and declarations, or one tag with its attributes. The quantifiers are possessive, so a
# broken tag costs one pass; a tag cut off by the end of the page still matches.
_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^A-Za-z][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)"
    r"(?P<attrs>(?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(
    r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?"
)
_USED_ATTRIBUTE = re.compile(r"class|id|role|aria-hidden", re.I)
# A slash at the end of an unquoted value belongs to the value.
_VALUE_ENDS_IN_SLASH = re.compile(r"=\s*[^\s\"'>][^\s>]*/\Z")

# Element groups of the HTML standard.
_VOID = frozenset(
    "area base basefont bgsound br col embed frame hr img input keygen link meta param source "
    "track wbr".split()
)
# Raw text elements and what ends them.
_RAW_NAMES = "script style xmp iframe noembed noframes noscript textarea title".split()
_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW_NAMES}
_DECODED_RAW = frozenset(("textarea", "title"))
_HEAD_ONLY = frozenset(
    "base basefont bgsound link meta noframes noscript script style template title".split()
)
_FORMATTING = frozenset(
    "a b big code em font i nobr s small strike strong tt u".split()
)
_ENDS_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p "
    "plaintext pre search section summary table ul xmp".split()
)
_SPECIAL = _ENDS_P | frozenset(
    "applet button caption colgroup html body iframe marquee object tbody td template tfoot th "
    "thead tr select textarea".split()
)
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# Drawings and formulas: inside, a slash closes a tag and nothing is raw text. The second group holds
# their elements with HTML inside, the third the HTML elements that end them.
_FOREIGN = frozenset(("svg", "math"))
_HTML_INSIDE = frozenset(("foreignobject", "desc", "title", "annotation-xml"))
_ENDS_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li "
    "listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
_BARRIER = frozenset("applet caption html marquee object table td template th".split())
# Opening one of these ends the listed open elements, up to the nearest of the stoppers.
_IMPLIED_ENDS = {
    "p": (("p",), _BARRIER | {"button"}),
    "li": (("li",), _SPECIAL - {"address", "div", "p", "li"}),
    "dd": (("dd", "dt"), _SPECIAL - {"address", "div", "p", "dd", "dt"}),
    "option": (("option",), _SPECIAL),
    "td": (("td", "th"), frozenset(("table", "tr", "html"))),
    "tr": (("tr",), frozenset(("table", "html"))),
    "tbody": (("tbody", "thead", "tfoot"), frozenset(("table", "html"))),
    "a": (("a",), _BARRIER),
    "button": (("button",), _BARRIER),
}
_IMPLIED_ENDS["dt"] = _IMPLIED_ENDS["dd"]
_IMPLIED_ENDS["th"] = _IMPLIED_ENDS["td"]
_IMPLIED_ENDS["thead"] = _IMPLIED_ENDS["tfoot"] = _IMPLIED_ENDS["tbody"]

_LIST_BARRIER, _BUTTON_BARRIER = _BARRIER | {"ol", "ul"}, _BARRIER | {"button"}
_END_BARRIERS = {"li": _LIST_BARRIER, "p": _BUTTON_BARRIER}
# Every set of stoppers in use, and those that an element belongs to.
_STOPPER_SETS = {_BARRIER, _LIST_BARRIER, _BUTTON_BARRIER, _SPECIAL, _FOREIGN, _HTML_INSIDE, frozenset()} | {
    stoppers for _, stoppers in _IMPLIED_ENDS.values()
}
_STOPS = {
    tag: [stoppers for stoppers in _STOPPER_SETS if tag in stoppers]
    for tag in frozenset().union(*_STOPPER_SETS)
}

# White space that the length test trims.
_TRIM = (
    "\t\n\v\f\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

_TAGS = frozenset(vocab.BOILERPLATE_TAGS)
_CLASSES = frozenset(vocab.BOILERPLATE_CLASSES)
_IDS = frozenset(vocab.BOILERPLATE_IDS)


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), unescape(double or single or bare))
    return found


def _is_boilerplate(attrs: dict[str, str]) -> bool:
    classes, ident = attrs.get("class", ""), attrs.get("id", "")
    return (
        any(attrs.get(name) == value for name, value in vocab.BOILERPLATE_ATTRIBUTES)
        or not _CLASSES.isdisjoint(classes.split())
        or ident in _IDS
        or any(part in classes for part in vocab.BOILERPLATE_CLASS_PARTS)
        or any(part in ident for part in vocab.BOILERPLATE_ID_PARTS)
    )


def _main_places(tag: str, attrs: dict[str, str]) -> list[int]:
    have = {"tag": (tag,), "class": attrs.get("class", "").split(), "id": (attrs.get("id"),), "role": (attrs.get("role"),)}
    return [i for i, (kind, name) in enumerate(vocab.MAIN_PLACES) if name in have[kind]]


# The places of elements without attributes.
_TAG_PLACES = {name: _main_places(name, {}) for kind, name in vocab.MAIN_PLACES if kind == "tag"}


class _OpenElements:
    """The open elements, the text kept so far and the text span of every main place seen.

    The places of each name, of each set of stoppers and of drawings are kept, so that no tag takes a walk
    over the open ones. An element that ends before what it holds stays in the stack as None.
    """

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, list[list[int]]] | None] = []
        self.places: dict[str, list[int]] = {}
        self.stops: dict[frozenset[str], list[int]] = {stoppers: [] for stoppers in _STOPPER_SETS}
        self.drawings, self.html_inside = self.stops[_FOREIGN], self.stops[_HTML_INSIDE]
        self.removed = 0
        self.pieces: list[str] = []
        self.spans: dict[int, list[list[int]]] = {}

    def open(self, tag: str, attrs: dict[str, str]) -> None:
        at, begun = len(self.stack), []
        gone = tag in _TAGS or (bool(attrs) and _is_boilerplate(attrs))
        if gone:
            self.removed += 1
        elif not self.removed:
            for place in _main_places(tag, attrs) if attrs else _TAG_PLACES.get(tag, ()):
                span = [len(self.pieces), -1]
                self.spans.setdefault(place, []).append(span)
                begun.append(span)
        self.places.setdefault(tag, []).append(at)
        for stoppers in _STOPS.get(tag, ()):
            self.stops[stoppers].append(at)
        self.stack.append((tag, gone, begun))

    def drop(self, at: int) -> None:
        """End the nearest open element of its name."""
        tag, gone, begun = self.stack[at]
        self.stack[at] = None
        self.places[tag].pop()
        for stoppers in _STOPS.get(tag, ()):
            self.stops[stoppers].pop()
        self.removed -= gone
        for span in begun:
            span[1] = len(self.pieces)

    def close(self, names: tuple[str, ...], stoppers: frozenset[str]) -> None:
        """End the nearest open element called one of ``names``, with all inside it."""
        at = 0
        for name in names:
            places = self.places.get(name)
            if places and places[-1] > at:
                at = places[-1]
        if not at or ((stops := self.stops[stoppers]) and stops[-1] > at):
            return
        if self.stack[at][0] in _FORMATTING and not self.in_foreign():
            self.drop(at)  # what it holds stays open
        else:
            self.close_to(at)
        while self.stack and self.stack[-1] is None:
            self.stack.pop()

    def close_to(self, at: int) -> None:
        while len(self.stack) > at:
            if self.stack[-1] is not None:
                self.drop(len(self.stack) - 1)
            self.stack.pop()

    def in_foreign(self) -> bool:
        inside = self.html_inside
        return bool(self.drawings) and not (inside and inside[-1] > self.drawings[-1])

    def start_tag(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        """``closed``: the tag ends in a slash, which only drawings and formulas heed."""
        if self.drawings or tag in _FOREIGN:
            while self.in_foreign() and tag in _ENDS_FOREIGN:
                self.close_to(self.drawings[-1])
            if self.in_foreign() or tag in _FOREIGN:
                if not closed:
                    self.open(tag, attrs)
                return
        if tag == "form" and self.places.get("form"):
            return  # forms do not nest
        if tag in _ENDS_P and self.places.get("p"):
            self.close(*_IMPLIED_ENDS["p"])
        if tag in _IMPLIED_ENDS and tag != "p":
            self.close(*_IMPLIED_ENDS[tag])
        if tag not in _VOID:
            self.open(tag, attrs)

    def end_tag(self, tag: str) -> None:
        if self.in_foreign() and self.places.get(tag):
            if self.places[tag][-1] >= self.drawings[-1]:
                self.close_to(self.places[tag][-1])
                return
        if tag in _HEADINGS:
            self.close(_HEADINGS, _BARRIER)
        elif tag in _SPECIAL:
            self.close((tag,), _END_BARRIERS.get(tag, _BARRIER))
        elif tag in _FORMATTING:
            self.close((tag,), _BARRIER)
        elif tag in _FOREIGN:
            self.close((tag,), frozenset())
        else:
            self.close((tag,), _SPECIAL)

    def text(self, raw: str) -> None:
        if not self.removed:
            self.pieces.append(unescape(raw) if "&" in raw else raw)

    def place_text(self, place: int) -> str:
        end = len(self.pieces)
        return "".join(
            "".join(self.pieces[a : end if b < 0 else b]) for a, b in self.spans.get(place, ())
        )


def main_text(html: str, min_main_chars: int = 200) -> tuple[str, str]:
    """(text, name of the place it came from) of one page, white space as found."""
    page = _OpenElements()
    page.open("#root", {})
    in_body = False
    at, size, search = 0, len(html), _TAG.search

    def enter_body(attrs: dict[str, str]) -> None:
        nonlocal in_body
        if not in_body:
            in_body = True
            page.open("body", attrs)

    while at < size:
        match = search(html, at)
        begin, end = match.span() if match else (size, size)
        if begin > at and not (in_body and page.removed):
            text = html[at:begin]
            if not in_body and text.strip(" \t\r\n\f"):
                enter_body({})
                text = text.lstrip(" \t\r\n\f")
            if in_body:
                page.text(text)
        at = end
        if not match:
            break
        close, name, source = match.groups()
        if name is None:
            continue
        tag = name.lower()
        if close:
            if in_body and tag not in ("html", "body", "head"):
                page.end_tag(tag)
            continue
        attrs = _attributes(source) if source and _USED_ATTRIBUTE.search(source) else {}
        if tag == "body":
            enter_body(attrs)
        elif tag == "html":
            if not in_body and len(page.stack) == 1:
                page.open("html", attrs)
        elif tag != "head":
            if not in_body and tag not in _HEAD_ONLY:
                enter_body({})
            closed = bool(source) and source[-1] == "/" and not _VALUE_ENDS_IN_SLASH.search(source)
            raw = tag in _RAW and not (in_body and page.in_foreign())
            if in_body:
                page.start_tag(tag, attrs, closed)
            if raw:
                found = _RAW[tag].search(html, at)
                begin, at = at, found.start() if found else size
                if in_body and tag in _DECODED_RAW:
                    page.text(html[begin:at])
                elif in_body and not page.removed:
                    page.pieces.append(html[begin:at])

    for place, (_, place_name) in enumerate(vocab.MAIN_PLACES):
        found = page.place_text(place)
        if len(found.strip(_TRIM)) > min_main_chars:
            return found, place_name
    return page.place_text(len(vocab.MAIN_PLACES) - 1), "body"


_RESULT = pa.struct([("text", pa.string()), ("place", pa.string()), ("error", pa.string())])


def read_page(html: str | None, min_main_chars: int) -> dict[str, str | None]:
    """One result row; a page that cannot be read becomes an error, not a failed job."""
    row: dict[str, str | None] = {"text": None, "place": None, "error": None}
    try:
        if html is not None:
            row["text"], row["place"] = main_text(html, min_main_chars)
    except Exception as problem:  # noqa: BLE001 - reported in the row
        row["error"] = str(problem) or repr(problem)
    return row


def main_text_column(html: Column, min_main_chars: int) -> Column:
    """struct<text, place, error> of each page."""

    @F.arrow_udf("text string, place string, error string")
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([read_page(page.as_py(), min_main_chars) for page in pages], type=_RESULT)

    return extract(html)
