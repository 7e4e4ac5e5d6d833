"""Words of many texts at once: their places and 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

from termloom.llm.words import WHITE_SPACE

# Bytes that are hashed at a time, of texts that are taken together, and of the longest word hashed this way.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(WHITE_SPACE.encode())] = True


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(
        np.multiply.accumulate(np.r_[np.uint64(1), np.full(PIECE, b, dtype=np.uint64)]) for b in (_BASE, inverse)
    )


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: a polynomial of its bytes, mixed. Words over ``PIECE`` bytes are hashed one by one."""
    powers, inverses = _powers()
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        low = int(starts[first])
        last = int(np.searchsorted(ends, low + PIECE, side="right"))
        if last <= first:
            out[first] = xxhash.xxh64_intdigest(raw[low : ends[first]].tobytes())
            first += 1
            continue
        own = slice(first, last)
        block = raw[low : ends[last - 1]].astype(np.uint64)
        block += np.uint64(1)
        block *= powers[: len(block)]
        sums = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum(block, out=sums[1:])
        begin = starts[own] - low
        hashes = (sums[ends[own] - low] - sums[begin]) * inverses[begin]
        for shift in (32, 29):
            hashes ^= hashes >> np.uint64(shift)
            hashes *= _MIX
        out[own] = hashes ^ (hashes >> np.uint64(32))
        first = last
    return out


@dataclass
class Words:
    """The words of some texts in order: ``text`` says whose each is."""

    data: bytes
    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    texts: int
    hashes: np.ndarray

    def of(self, places: np.ndarray) -> list[bytes]:
        spans = zip(self.starts[places].tolist(), self.ends[places].tolist())
        return [self.data[a:b] for a, b in spans]

    def last_non_ascii(self) -> np.ndarray:
        """The last byte of each word that is beyond ASCII, or 0."""
        if self.data.isascii():
            return np.zeros(len(self.starts), dtype=np.uint8)
        at = np.flatnonzero(self.raw >= 128)
        before = np.searchsorted(at, self.ends) - 1
        place = at[np.maximum(before, 0)]
        return np.where((before >= 0) & (place >= self.starts), self.raw[place], 0).astype(np.uint8)


def find_words(texts: list[bytes]) -> Words:
    """The lower-cased (A-Z) words of the texts."""
    data = b"\n".join(texts).lower()
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    stops = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))
    owner = np.searchsorted(stops, starts, side="right")
    return Words(data, raw, starts, ends, owner, len(texts), hash_spans(raw, starts, ends))


def grouped_texts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) for stretches of a column of about ``PIECE`` bytes, or one long text; null is empty."""
    start, held, size = 0, [], 0
    for row, item in enumerate(column.cast(pa.binary())):
        text = item.as_py() or b""
        if held and size + len(text) > PIECE:
            yield start, held
            start, held, size = row, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield start, held
