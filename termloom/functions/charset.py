"""Text of HTML files, whose encoding only their bytes tell."""

from __future__ import annotations

import codecs
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Byte order marks, and how far into a page its declaration may be.
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_BE, "utf-16-be"), (codecs.BOM_UTF16_LE, "utf-16-le"))
_HEAD_BYTES = 1024
_COMMENT = re.compile(rb"<!--.*?(?:-->|\Z)", re.S)
_DECLARED = re.compile(rb"<meta\b[^>]*?\bcharset\s*=\s*[\"']?\s*([^\s\"'/>;]+)", re.I)
# The encodings that the web uses, and the wider ones that it reads some of them as.
_WEB = ("utf-8", "iso8859", "cp125", "cp866", "cp874", "cp932", "cp949", "koi8", "mac", "gb", "big5", "euc", "shift_jis", "iso2022_jp")
_READ_AS = {
    "ascii": "cp1252", "iso8859-1": "cp1252", "iso8859-9": "cp1254", "iso8859-11": "cp874", "shift_jis": "cp932",
    "gb2312": "gb18030", "gbk": "gb18030", "euc_kr": "cp949", "big5": "big5hkscs",
}
_FALLBACK = "cp1252"


def _declared(content: bytes) -> str | None:
    """The encoding that a ``meta`` element names, if it is one of the web's."""
    found = _DECLARED.search(_COMMENT.sub(b"", content[:_HEAD_BYTES]))
    if not found:
        return None
    try:
        name = codecs.lookup(found[1].decode("ascii")).name
    except (LookupError, UnicodeDecodeError):
        return None
    if name.startswith(("utf-16", "utf-32")):
        return "utf-8"  # the declaration itself was read byte by byte
    name = _READ_AS.get(name, name)
    return name if name.startswith(_WEB) else None


def decode_page(content: bytes) -> str:
    """Text by byte order mark, then by declaration, then as UTF-8 if it is, else as Windows-1252.

    Bytes that the encoding does not have become U+FFFD, and an unknown declaration counts as none.
    """
    for mark, name in _MARKS:
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace")
    name = _declared(content)
    if name is None:
        try:
            return content.decode("utf-8")
        except UnicodeDecodeError:
            name = _FALLBACK
    return content.decode(name, "replace")


def decoded(content: Column) -> Column:
    """The text of each page; null stays null."""

    @F.arrow_udf("string")
    def decode(pages: pa.Array) -> pa.Array:
        return pa.array([None if page is None else decode_page(page) for page in pages.to_pylist()], pa.string())

    return decode(content)
