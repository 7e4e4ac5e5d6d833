"""Words of a text: runs of anything but the six ASCII white space characters."""

from __future__ import annotations

import re

# The white space that separates words.
WHITE_SPACE = " \t\n\v\f\r"
# The same as a pattern of Spark's (Java's) and Python's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

_WORD = re.compile(WORD)


def words(text: str | None) -> list[bytes]:
    """UTF-8 words in order; ``bytes.split`` knows exactly the white space above. Null: none."""
    return text.encode().split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """The words with A-Z in lower case; ``bytes.lower`` leaves all else alone."""
    return text.encode().lower().split() if text else []


def word_spans(text: str):
    """(start, end) of each word in code points."""
    return (m.span() for m in _WORD.finditer(text))
