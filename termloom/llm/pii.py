"""Personal data in whole texts, also where it is disguised, with spans in the source text.

Plain identifiers are found in the text as it is. Then transducers rewrite the text: look-alike
characters to ASCII, spelled digits to digits, and spelled at and dot signs to the signs. Each keeps
for every character of its output the span of the source it stands for, so that what is found in the
rewritten text is mapped back. Every step takes time linear in the text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.top_domains import TOP_DOMAINS

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# Characters of the parts of an address, and the forms of numbers.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = "0123456789"


def emails(text: str) -> Iterator[Span]:
    """Addresses, found from their @ signs: the local part cannot reach over an earlier one."""
    free, at = 0, text.find("@")
    while at >= 0:
        local = at - free - len(text[free:at].rstrip(LOCAL))
        match = _DOMAIN.match(text, at) if local else None
        if match:
            yield at - local, match.end()
        free = match.end() if match else at + 1
        at = text.find("@", free)


def ips(text: str) -> Iterator[Span]:
    """Each four numbers in a row joined by points, if none is over 255."""
    for chain in _DOTTED.finditer(text):
        numbers = chain.group().split(".")
        start = chain.start()
        for k in range(0, len(numbers) - 3, 4):
            four = numbers[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(n.lstrip("0")) <= 3 and int(n.lstrip("0") or 0) <= 255 for n in four):
                yield start, end
            start = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        d = int(digit) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for match in _CARD.finditer(text):
        digits = match.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield match.span()


def phones(text: str) -> Iterator[Span]:
    for match in _PHONE.finditer(text):
        if 9 <= sum(map(match.group().count, _DIGITS)) <= 15:
            yield match.span()


def plain_spans(text: str) -> dict[str, list[Span]]:
    """Undisguised identifiers by kind; a cheap look for a needed sign comes first."""
    digits = any(d in text for d in _DIGITS)
    return {
        "email": list(emails(text)) if "@" in text else [],
        "ip": list(ips(text)) if digits and "." in text else [],
        "card": list(cards(text)) if digits else [],
        "phone": list(phones(text)) if digits and "+" in text else [],
    }


class Mapped:
    """A rewritten text and, for each of its characters, the source span it stands for."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.text = text
        self.starts = np.arange(len(text)) if starts is None else starts
        self.ends = np.arange(1, len(text) + 1) if ends is None else ends

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replace [start, end) by a text, for each of the edits, which are sorted and disjoint."""
        if not edits:
            return self
        texts, starts, ends, done = [], [], [], 0
        for a, b, new in edits:
            texts += [self.text[done:a], new]
            starts += [self.starts[done:a], np.full(len(new), self.starts[a])]
            ends += [self.ends[done:a], np.full(len(new), self.ends[b - 1])]
            done = b
        texts.append(self.text[done:])
        starts.append(self.starts[done:])
        ends.append(self.ends[done:])
        return Mapped("".join(texts), np.concatenate(starts), np.concatenate(ends))

    def source(self, span: Span) -> Span:
        return int(self.starts[span[0]]), int(self.ends[span[1] - 1])


# Letters of other scripts that look like Latin ones, and invisible characters.
LOOK_ALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТХУаеѕіјорсхуԁԛԝһ" "вгкмнптьѵӏӀґ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανιι" "ρκτυωγηχϲϳ" "օոսհցԼЅ" "ɑɡıɩʟʏꮯꮪ",
        "ABESIJKMHOPCTXYaesijopcxydqwh" "brkmhntbvllr" "ABEZHIKMNOPTYXoavii" "pktuwynxcj" "onuhgLS" "agiilycs",
    )
)
INVISIBLE = "­​‌‍⁠﻿᠎"
SIGNS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "·": ".", "․": "."}
# UTF-8 bytes from which look-alikes start; two characters below are named where this is used.
FIRST_LOOK_ALIKE_BYTE = 0xC9


@lru_cache(maxsize=None)
def plain_character(char: str) -> str:
    """The ASCII character that ``char`` looks like, else ``char``; nothing for an invisible one."""
    if char in INVISIBLE:
        return ""
    if char in LOOK_ALIKES or char in SIGNS:
        return LOOK_ALIKES.get(char) or SIGNS[char]
    digit = unicodedata.decimal(char, None)
    if digit is not None:
        return str(digit)
    if char.isspace():
        return " "
    folded = unicodedata.normalize("NFKC", char)
    if len(folded) == 1 and folded.isascii():
        return folded
    small_capital = _SMALL_CAPITAL.fullmatch(unicodedata.name(char, ""))
    return small_capital[1].lower() if small_capital else char


_SMALL_CAPITAL = re.compile("LATIN LETTER SMALL CAPITAL ([A-Z])")


_NON_ASCII = re.compile(r"[^\x00-\x7f]")


def undo_look_alikes(mapped: Mapped) -> Mapped:
    text = mapped.text
    if text.isascii():
        return mapped
    if np.frombuffer(text.encode(), np.uint8).max() < FIRST_LOOK_ALIKE_BYTE and not any(
        c in text for c in " ­²³·¹"
    ):
        return mapped
    edits = []
    for match in _NON_ASCII.finditer(text):
        new = plain_character(match.group())
        if new != match.group():
            edits.append((*match.span(), new))
    return mapped.rewrite(edits)


# Spelled digits and signs.
SPELLED = dict(zip("zero one two three four five six seven eight nine oh".split(), "01234567890"))
# Only ASCII letters spell a word: without the flag a, "ſ" and "İ" would match too.
_SPELLED = f"(?ai:{'|'.join(SPELLED)})"
_DIGIT = rf"(?:(?<![^\W\d_]){_SPELLED}(?![^\W\d_])|[0-9])"
_BETWEEN = r"(?:[\s,.;-]|(?<![^\W\d_])(?ai:dot|point|dash|hyphen|double|triple)(?![^\W\d_]))*+"
_NUMBER_RUN = re.compile(
    rf"(?<![^\W\d_])(?:(?ai:plus)[\s-]*+)?+(?:(?ai:double|triple)\s++)?+{_DIGIT}(?:{_BETWEEN}{_DIGIT})*+"
)
_NUMBER_PART = re.compile(
    r"(?<![^\W\d_])(?:(?P<sign>(?ai:plus))|(?P<times>(?ai:double|triple))"
    rf"|(?P<digit>{_SPELLED})|(?P<dot>(?ai:dot|point)))(?![^\W\d_])|(?P<plain>[0-9])"
    r"|(?P<full>(?<=[0-9])\.(?=[0-9]))"
)
_ANY_SPELLED = re.compile(_SPELLED)
LEAST_DIGITS = 4


def undo_spelled_digits(mapped: Mapped) -> list[Mapped]:
    """Runs of at least ``LEAST_DIGITS`` digits, some of them spelled, become digits and points.

    Plain digits that start a run stay as they are. What follows them may go on with their number or
    start another ("on 12 four one one one …"): if there are such runs, there are two readings.
    """
    text = mapped.text
    if not _ANY_SPELLED.search(text):
        return [mapped]
    joined, apart = [], []
    for run in _NUMBER_RUN.finditer(text):
        if not _ANY_SPELLED.search(text, *run.span()):
            continue
        digits, spelled, times, found, lead = 0, 0, 1, [], 0
        for part in _NUMBER_PART.finditer(text, *run.span()):
            kind = part.lastgroup
            if kind in ("plain", "full") and lead == len(found):
                lead += 1
            if kind == "times":
                times = 2 if part.group().lower() == "double" else 3
                found.append((*part.span(), ""))
                continue
            if kind == "digit":
                new = SPELLED[part.group().lower()] * times
                spelled += 1
            elif kind == "plain":
                new = part.group()
            else:
                new = "+" if kind == "sign" else "."
            times = 1
            found.append((*part.span(), new))
            digits += len(new) if kind in ("digit", "plain") else 0
        if spelled and digits >= LEAST_DIGITS:
            # What lies between the parts goes too; it belongs to no digit.
            at = run.start()
            if lead:
                at, gap = found[lead - 1][1], text[found[lead - 1][1] : found[lead][0]]
                if gap and found[lead][2] != ".":
                    joined += [] if gap == "." else [(at, at + len(gap), " ")]
                    apart.append((at, at + len(gap), "\n"))
                    at += len(gap)
            edits = []
            for a, b, new in found[lead:]:
                if a > at:
                    edits.append((at, a, ""))
                edits.append((a, b, new))
                at = b
            if run.end() > at:
                edits.append((at, run.end(), ""))
            joined += edits
            apart += edits
    return [mapped.rewrite(joined)] + ([mapped.rewrite(apart)] if apart != joined else [])


# Letters written for digits, in words of digits else; at most half of one.
_MIXED_NUMBER = re.compile(r"(?<![A-Za-z0-9])(?=[oOlI]*+[0-9])[0-9oOlI]++(?![A-Za-z0-9])")
_LETTER_DIGIT = re.compile("[oOlI]")


def undo_letter_digits(mapped: Mapped) -> Mapped:
    """"4o11 1l11" becomes "4011 1111"; the patterns and checks of the numbers decide what it is."""
    edits = []
    for number in _MIXED_NUMBER.finditer(mapped.text):
        letters = [(*m.span(), "0" if m.group() in "oO" else "1") for m in _LETTER_DIGIT.finditer(mapped.text, *number.span())]
        if 2 * len(letters) <= len(number.group()):
            edits += letters
    return mapped.rewrite(edits)


# A run of white space is tried from its first character only, so that long runs stay linear.
_GAP = r"(?<!\s)\s++"
_OPEN, _CLOSE = rf"(?:{_GAP})?+[\[({{<【«]\s*+", r"\s*+[\])}>】»]\s*+"
# Signs as web pages and addresses escape them.
_AT_ESCAPE, _DOT_ESCAPE = r"%40|&#(?:0*+64|x0*+40);|&commat;", r"%2e|&#(?:0*+46|x0*+2e);|&period;"
_AT = re.compile(
    rf"{_OPEN}(?:at|@){_CLOSE}|(?P<bare>{_GAP}(?:-at-|at|@)\s++|[_-]at[_-]|(?P<sign>{_AT_ESCAPE}))", re.I
)
_DOT = rf"(?:{_OPEN}(?:dot|\.){_CLOSE}|{_GAP}(?:-dot-|dot)\s++|[_-]dot[_-]|{_GAP}\.\s++|{_DOT_ESCAPE})"
_DOT_PATTERN = re.compile(_DOT, re.I)
_LABEL = r"[A-Za-z0-9]++(?:-(?!dot-)[A-Za-z0-9]++)*+"
_LABELS = re.compile(rf"{_LABEL}(?:(?:\.|{_DOT}){_LABEL})++", re.I)
_NAME_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
_POINT = re.compile(rf"{_DOT}|\.", re.I)
_NUMBER_DOT = re.compile(rf"(?<=[0-9]){_DOT}(?=[0-9])", re.I)

def _name_start(text: str, low: int, end: int, points: dict[int, int]) -> int | None:
    """Where the name before ``end`` starts, words and points in turn; None without a word.

    ``points`` holds the start of each spelled point by its end. The scan stops at ``low``.
    """
    start, at = None, end
    while True:
        word = at
        while word > low and text[word - 1] in _NAME_CHARACTERS:
            word -= 1
        if word == at:
            return start
        start = word
        if word > low and text[word - 1] == ".":
            at = word - 1
        elif points.get(word, -1) >= low:
            at = points[word]
        else:
            return start


def _domain_end(domain: str) -> int:
    """Where the last label ends that is a top-level domain and not the first; 0 without one."""
    end = len(domain)
    for point in reversed(list(_POINT.finditer(domain))):
        if domain[point.end() : end].lower() in TOP_DOMAINS:
            return end
        end = point.start()
    return 0


def undo_at_and_dot(mapped: Mapped) -> Mapped:
    """Spelled at signs with a name before and a domain after, and spelled points in both."""
    text = mapped.text
    edits: list[tuple[int, int, str]] = []
    points: dict[int, int] | None = None
    end = 0
    for at in _AT.finditer(text):
        if at.start() < end:
            continue
        domain = _LABELS.match(text, at.end())
        if not domain:
            continue
        site = domain.group()
        if at["bare"]:
            # A sign or "_at_" stands for itself; the word and hyphens need a spelled point, since
            # "at example.org" and "stay-at-home.org" are ordinary prose.
            sign = at["sign"] or "@" in at.group() or at.group().lower() == "_at_"
            stop = _domain_end(site)
            if not stop and "@" in at.group() and _DOT_PATTERN.search(site):
                stop = len(site)
            site = site[:stop]
            if not site or not (sign or any("dot" in d.lower() for d in _DOT_PATTERN.findall(site))):
                continue
        if not site[-2:].isalpha():
            continue
        if points is None:
            points = {m.end(): m.start() for m in _DOT_PATTERN.finditer(text)}
        # Every scan that finds a name moves ``end`` on, so no character is scanned twice.
        name = _name_start(text, end, at.start(), points)
        if name is None:
            continue
        for dot in _DOT_PATTERN.finditer(text, name, at.start()):
            edits.append((*dot.span(), "."))
        edits.append((*at.span(), "@"))
        end = at.end() + len(site)
        for dot in _DOT_PATTERN.finditer(text, at.end(), end):
            edits.append((*dot.span(), "."))
    taken = {e[:2] for e in edits}
    numbers = [(*m.span(), ".") for m in _NUMBER_DOT.finditer(text) if m.span() not in taken]
    return mapped.rewrite(_disjoint(sorted(edits + numbers)))


def _disjoint(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    kept, end = [], 0
    for edit in edits:
        if edit[0] >= end:
            kept.append(edit)
            end = edit[1]
    return kept


def _goes_on(text: str, known: Span, span: Span) -> bool:
    """Whether ``span`` holds ``known`` and more of the same word or number."""
    before, after = text[span[0] : known[0]], text[known[1] : span[1]]
    if span[0] > known[0] or span[1] < known[1] or not (before or after):
        return False
    return before[-1:].isalnum() or after[:1].isalnum() or len(_ANY_SPELLED.findall(after)) >= 2


def disguised_spans(text: str, plain: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Identifiers that only the rewritten text shows, as spans of the source text.

    A span that overlaps an earlier disguised one of its kind is not added, nor one that overlaps a
    plain one, unless it holds it and goes on where the plain pattern stops inside a word or number.
    """
    source = Mapped(text)
    added: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    for reading in undo_spelled_digits(undo_letter_digits(undo_look_alikes(source))):
        mapped = undo_at_and_dot(reading)
        if mapped is source:
            continue
        for kind, found in plain_spans(mapped.text).items():
            known, earlier = sorted(plain[kind]), added[kind]
            own: list[Span] = []
            at = there = 0
            for span in sorted(mapped.source(s) for s in found):
                while at < len(known) and known[at][1] <= span[0]:
                    at += 1
                while there < len(earlier) and earlier[there][1] <= span[0]:
                    there += 1
                last = at
                while last < len(known) and known[last][0] < span[1] and _goes_on(text, known[last], span):
                    last += 1
                clear = last == len(known) or known[last][0] >= span[1]
                clear = clear and (there == len(earlier) or earlier[there][0] >= span[1])
                if clear and (not own or own[-1][1] <= span[0]):
                    own.append(span)
            added[kind] = sorted(earlier + own)
    return added


_SPAN = pa.struct(
    [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())]
)
SPANS = "array<struct<kind:string,start:bigint,end:bigint,plain:boolean>>"


def find_spans(text: str | None) -> list[dict]:
    """All spans by kind, then start; ``plain`` tells the undisguised ones. Null or empty: none."""
    if not text:
        return []
    plain = plain_spans(text)
    added = disguised_spans(text, plain)
    rows = []
    for kind in KINDS:
        both = [(*s, True) for s in plain[kind]] + [(*s, False) for s in added[kind]]
        rows += [{"kind": kind, "start": a, "end": b, "plain": p} for a, b, p in sorted(both)]
    return rows


def personal_data(text: Column) -> Column:
    """The spans of each text as an array in the order of ``find_spans``."""

    @F.arrow_udf(SPANS)
    def find(texts: pa.Array) -> pa.Array:
        return pa.array([find_spans(t.as_py()) for t in texts], pa.list_(_SPAN))

    return find.asNondeterministic()(text)


def add_personal_data(docs: DataFrame, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """Add the spans found in ``text`` to every row; no row is lost or changed otherwise.

    Positions are code points, ends exclusive. Null and empty texts have an empty array. A column
    that is called ``spans`` already is replaced.
    """
    return docs.withColumn(spans, personal_data(F.col(text)))


def mask(text: str | None) -> str | None:
    """The text with each span replaced by its kind. Spans that overlap are one, of the kind of the first and longest."""
    if not text:
        return text
    pieces, done = [], 0
    for span in sorted(find_spans(text), key=lambda s: (s["start"], -s["end"])):
        if span["start"] >= done:
            pieces += [text[done : span["start"]], f"[{span['kind']}]"]
        done = max(done, span["end"])
    return "".join([*pieces, text[done:]])


def mask_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace ``text`` by its masked form; null stays null."""

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        return pa.array([mask(t.as_py()) for t in texts], pa.string())

    return docs.withColumn(text, masked.asNondeterministic()(F.col(text)))
