"""Byte-level BPE on Spark: encoding by batched merge rounds in numpy, and decoding.

The merges of a public tokenizer file are read once on the driver and broadcast: their number is
fixed by the file and does not grow with the texts. A task cuts its texts into pieces, keeps each
distinct piece once, and merges all pieces it has not met before together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from termloom.llm.ragged import offsets, ranges

# How the byte-level format cuts a text into pieces.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?{L}+| ?{N}+| ?[^\s{both}]+|\s+(?!\S)|\s+"
# Code points that newer Unicode tables call letters or numbers and the format's own
# tables do not know; they count as other characters.
UNKNOWN_TO_FORMAT = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D "
    "107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F "
    "12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123 1B128 1B168 1D6A6 1DF1F-1DF24 "
    "1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED "
    "1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
# A text whose UTF-8 bytes are all smaller holds none of them.
FIRST_UNKNOWN_BYTE = 0xD5

NO_RANK = np.int32(2**31 - 1)
# Bounds of working memory in a task; they change no result.
CACHED_PIECES = 200_000
CACHED_PIECE_CHARS = 64
GROUP_BYTES = 1_000_000


def _patterns() -> tuple[regex.Pattern, regex.Pattern]:
    plain = PIECES.format(L=r"\p{L}", N=r"\p{N}", both=r"\p{L}\p{N}")
    spans = "".join(
        "-".join(f"\\U{int(end, 16):08X}" for end in span.split("-")) for span in UNKNOWN_TO_FORMAT.split()
    )
    letters, numbers = rf"[\p{{L}}--[{spans}]]", rf"[\p{{N}}--[{spans}]]"
    exact = PIECES.format(L=letters, N=numbers, both=letters + numbers)
    return regex.compile(plain), regex.compile(exact, regex.V1)


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass(frozen=True)
class Vocabulary:
    """Merges as arrays sorted by pair key, and the bytes of every token."""

    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    merged_ids: np.ndarray  # by rank
    token_bytes: np.ndarray
    token_starts: np.ndarray
    special: tuple[tuple[str, int], ...]

    @property
    def size(self) -> int:
        return len(self.token_starts) - 1


def read_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE file of the tokenizers library."""
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    model = stored["model"]
    if model["type"] != "BPE" or stored["pre_tokenizer"]["type"] != "ByteLevel" or stored["normalizer"]:
        raise ValueError(f"{path} is no plain byte-level BPE file")
    ids, alphabet = model["vocab"], _byte_alphabet()
    special = {t["content"]: t["id"] for t in stored["added_tokens"]}
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in stored["added_tokens"]):
        raise ValueError("added tokens that change their neighbourhood are not supported")
    size = max(max(ids.values()), max(special.values(), default=0)) + 1
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left = np.array([ids[a] for a, _ in merges], dtype=np.int64)
    right = np.array([ids[b] for _, b in merges], dtype=np.int64)
    keys = left * size + right
    order = np.argsort(keys, kind="stable")
    spelled = [b""] * size
    for token, at in ids.items():
        spelled[at] = bytes(alphabet[c] for c in token)
    for token, at in special.items():
        spelled[at] = token.encode()
    byte_ids = np.zeros(256, dtype=np.int32)
    for char, byte in alphabet.items():
        byte_ids[byte] = ids[char]
    return Vocabulary(
        byte_ids,
        keys[order],
        order.astype(np.int32),
        np.array([ids[a + b] for a, b in merges], dtype=np.int32),
        np.frombuffer(b"".join(spelled), dtype=np.uint8),
        offsets(np.array([len(s) for s in spelled])),
        tuple(sorted(special.items())),
    )


def _pair_ranks(vocabulary: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    keys = left.astype(np.int64) * vocabulary.size + right
    at = np.minimum(np.searchsorted(vocabulary.pair_keys, keys), len(vocabulary.pair_keys) - 1)
    return np.where(vocabulary.pair_keys[at] == keys, vocabulary.pair_ranks[at], NO_RANK)


def merge_pieces(vocabulary: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all non-empty pieces one after the other, number of tokens of each piece).

    Each round merges, in every piece at once, all places of that piece's lowest-ranked pair. A pair
    that a merge creates always ranks after the merge, so this is the order of one-by-one merging.
    """
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    symbols = vocabulary.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    piece = np.repeat(np.arange(len(pieces)), lengths)
    ranks = np.full(len(symbols), NO_RANK)
    if len(symbols) > 1:
        inside = np.flatnonzero(piece[:-1] == piece[1:])
        ranks[inside] = _pair_ranks(vocabulary, symbols[inside], symbols[inside + 1])
    done_symbols, done_pieces = [], []
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
        sizes = np.diff(np.r_[starts, len(symbols)])
        lowest = np.minimum.reduceat(ranks, starts)
        finished = lowest == NO_RANK
        if finished.any():
            gone = np.repeat(finished, sizes)
            done_symbols.append(symbols[gone])
            done_pieces.append(piece[gone])
            symbols, piece, ranks = symbols[~gone], piece[~gone], ranks[~gone]
            if not len(symbols):
                break
            sizes, lowest = sizes[~finished], lowest[~finished]
        marked = ranks == np.repeat(lowest, sizes)
        # Of pairs that overlap, as in "aaa", the first, third, … are taken.
        places = np.flatnonzero(marked)
        run_start = np.r_[True, np.diff(places) != 1]
        nth = np.arange(len(places)) - np.maximum.accumulate(np.where(run_start, np.arange(len(places)), 0))
        places = places[nth % 2 == 0]
        symbols[places] = vocabulary.merged_ids[ranks[places]]
        keep = np.ones(len(symbols), dtype=bool)
        keep[places + 1] = False
        ranks[places] = -1  # to be looked up again
        symbols, piece, ranks = symbols[keep], piece[keep], ranks[keep]
        changed = ranks == -1
        changed[:-1] |= changed[1:] & (piece[:-1] == piece[1:])
        stale = np.flatnonzero(changed)
        ranks[stale] = NO_RANK
        stale = stale[stale + 1 < len(symbols)]
        stale = stale[piece[stale] == piece[stale + 1]]
        ranks[stale] = _pair_ranks(vocabulary, symbols[stale], symbols[stale + 1])
    if not done_symbols:
        return np.zeros(0, dtype=np.int32), np.zeros(len(pieces), dtype=np.int64)
    tokens, owner = np.concatenate(done_symbols), np.concatenate(done_pieces)
    order = np.argsort(owner, kind="stable")
    return tokens[order], np.bincount(owner, minlength=len(pieces))


class Encoder:
    """Encodes texts; pieces met before are looked up."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.plain, self.exact = _patterns()
        names = [regex.escape(name) for name, _ in vocabulary.special]
        self.cut = regex.compile("(" + "|".join(sorted(names, key=len, reverse=True)) + ")") if names else None
        self.special = dict(vocabulary.special)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.tokens = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)

    def _learn(self, pieces: list[str]) -> None:
        tokens, lengths = merge_pieces(self.vocabulary, [p.encode() for p in pieces])
        self._add(pieces, tokens, lengths)

    def _add(self, pieces: list[str], tokens: np.ndarray, lengths: np.ndarray) -> None:
        first = len(self.known)
        self.known.update(zip(pieces, range(first, first + len(pieces))))
        self.starts = np.concatenate([self.starts, len(self.tokens) + offsets(lengths)[:-1]])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.tokens = np.concatenate([self.tokens, tokens])

    def pieces(self, text: str) -> list[str]:
        found: list[str] = []
        for part in self.cut.split(text) if self.cut else (text,):
            if part in self.special:
                found.append(part)
            elif part:
                raw = part if part.isascii() else part.encode()
                rare = not part.isascii() and np.frombuffer(raw, np.uint8).max() >= FIRST_UNKNOWN_BYTE
                found += (self.exact if rare else self.plain).findall(part)
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts one after the other, number of tokens of each text)."""
        found, counts = [], []
        for text in texts:
            before = len(found)
            found += self.pieces(text)
            counts.append(len(found) - before)
        if len(self.known) > CACHED_PIECES:
            self._forget()
        if not self.known:
            tokens = np.array([t for _, t in self.vocabulary.special], dtype=np.int32)
            self._add(list(self.special), tokens, np.ones(len(tokens), dtype=np.int64))
        new = set(found).difference(self.known)
        if new:
            self._learn(list(new))
        at = np.fromiter(map(self.known.__getitem__, found), dtype=np.int64, count=len(found))
        lengths = self.lengths[at]
        tokens = self.tokens[ranges(self.starts[at], lengths)]
        if any(len(piece) > CACHED_PIECE_CHARS for piece in new):
            self._forget()  # do not hold on to huge pieces
        ends = offsets(lengths)[offsets(np.array(counts, dtype=np.int64))]
        return tokens, np.diff(ends)


def decode_tokens(vocabulary: Vocabulary, tokens: np.ndarray, counts: np.ndarray) -> list[str]:
    """Texts of the token rows; bytes that form no character become U+FFFD, unknown ids nothing."""
    known = (tokens >= 0) & (tokens < vocabulary.size)
    safe = np.where(known, tokens, 0)
    lengths = np.where(known, np.diff(vocabulary.token_starts)[safe], 0)
    flat = vocabulary.token_bytes[ranges(vocabulary.token_starts[safe], lengths)].tobytes()
    ends = offsets(lengths)[offsets(counts)]
    return [flat[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


@lru_cache(maxsize=2)
def _encoder(shared) -> Encoder:
    return Encoder(shared.value)


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    """Runs of texts of limited total length, so that few pieces exist at a time; null is empty."""
    sizes = np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64)
    part = np.cumsum(sizes) // GROUP_BYTES
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist() if len(sizes) else []
    for start, end in zip(edges, [*edges[1:], len(sizes)]):
        yield [text or "" for text in texts.slice(start, end - start).to_pylist()]


def _encode_batch(encoder: Encoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    tokens, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for group in _slices(texts):
        ids, lengths = encoder.encode(group)
        tokens.append(ids)
        counts.append(lengths)
    return np.concatenate(tokens), np.concatenate(counts)


def _lists(tokens: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    ends = pa.array(offsets(counts).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(tokens, type=pa.int32()))


class Tokenizer:
    """Column functions for one vocabulary file."""

    def __init__(self, spark: SparkSession, path: str):
        self.shared = spark.sparkContext.broadcast(read_vocabulary(path))

    # Encoding is dear: being called nondeterministic keeps the optimizer from repeating it for each
    # use of the column.

    def encode(self, text: Column) -> Column:
        """array<int> of each text. A null text counts as empty and gives an empty array.

        The text of a special token becomes that token; no other token is added.
        """
        shared = self.shared

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            return _lists(*_encode_batch(_encoder(shared), texts))

        return encode.asNondeterministic()(text)

    def decode(self, ids: Column) -> Column:
        """The text of each array of ids; null gives null, null or unknown ids are skipped."""
        shared = self.shared

        @F.arrow_udf("string")
        def decode(rows: pa.Array) -> pa.Array:
            counts = np.asarray(rows.value_lengths().fill_null(0), dtype=np.int64)
            tokens = np.asarray(rows.flatten().fill_null(-1), dtype=np.int64)
            texts = decode_tokens(shared.value, tokens, counts)
            return pa.array(texts, type=pa.string(), mask=np.asarray(rows.is_null()))

        return decode(ids)


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add the tokens of ``text`` to every row; other columns pass unchanged, no row is lost.

    Null and empty texts get an empty array. Repeated rows are encoded like any other. A column
    called ``ids`` that exists already is replaced.
    """
    return docs.withColumn(ids, Tokenizer(docs.sparkSession, path).encode(F.col(text)))


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``encode_documents`` plus ``decoded_text``, what the tokens decode to.

    Columns called ``token_ids`` and ``decoded_text`` are replaced, and one called ``_both`` is dropped.
    """
    added = ("token_ids", "decoded_text")
    kept = docs.drop(*added, "_both") if text not in added else docs.withColumnRenamed(text, "_text").drop(*added, "_both")
    shared = Tokenizer(docs.sparkSession, path).shared
    of = text if text not in added else "_text"
    schema = StructType([*kept.schema.fields, StructField(added[0], ArrayType(IntegerType())), StructField(added[1], StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A slice of texts at a time goes back, so that a task holds the tokens of one slice only.
        for batch in batches:
            start = 0
            for group in _slices(batch[of]):
                own = batch.slice(start, len(group))
                start += len(group)
                tokens, counts = _encode_batch(_encoder(shared), own[of])
                back = pa.array(decode_tokens(shared.value, tokens, counts), pa.string())
                yield pa.RecordBatch.from_arrays([*own.columns, _lists(tokens, counts), back], schema.fieldNames())

    done = kept.mapInArrow(run, schema)
    return done if of == text else done.drop(of)
