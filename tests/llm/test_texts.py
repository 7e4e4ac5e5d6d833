"""Operators that look at one text at a time."""

import random
import re
import time
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from termloom.llm import bpe, hashed_words, lengths, pii, repetition
from termloom.llm.words import WORD, lower_words, words

PATH = public_tokenizers.path("byte_bpe_50k.json")
# Null, empty, blank, repeated and very long texts, beside columns with the names of results.
TEXTS = [None, "", " \n\t ", "one two", "one two", "word " * 30_000, "é" * 50_000, "a\x1cb c\x85d ﻿😀"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, "x", 1.5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, kept string, n_tokens double").repartition(3)


def ordered(df):
    return df.orderBy("doc_id").collect()


def test_words_are_runs_without_ascii_white_space():
    for text in TEXTS[1:]:
        assert [w.decode() for w in words(text)] == re.findall(WORD, text)
    assert words(None) == []


# --- byte-level BPE


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_vocabulary(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def rows_of(tokens, counts):
    return [part.tolist() for part in np.split(tokens, np.cumsum(counts)[:-1])] if len(counts) else []


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_tokens_equal_the_library(encoder, library, text):
    text = text.encode("utf-8", "ignore").decode()
    assert rows_of(*encoder.encode([text])) == [library.encode(text, add_special_tokens=False).ids]


@pytest.mark.parametrize(
    "text",
    ["", "<|endoftext|>", "a <|endoftext|>  b", "aaaaaaaaa", "it's  \n\n x", "՘a\U00016ea0", "漢字 ٣ 😀", "x" * 5000],
)
def test_hard_texts_equal_the_library(encoder, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    tokens, counts = encoder.encode([text])
    assert rows_of(tokens, counts) == [ids]
    assert bpe.decode_tokens(encoder.vocabulary, tokens, counts) == [library.decode(ids, skip_special_tokens=False)]


def test_broken_token_rows_decode_as_the_library_does(encoder, library):
    draw = random.Random(1)
    rows = [[draw.randrange(50257) for _ in range(draw.randrange(6))] for _ in range(300)]
    flat = np.array([t for r in rows for t in r])
    found = bpe.decode_tokens(encoder.vocabulary, flat, np.array([len(r) for r in rows]))
    assert found == [library.decode(r, skip_special_tokens=False) for r in rows]


def test_encode_documents(spark, texts, library):
    found = ordered(bpe.round_trip(texts, PATH))
    assert [r.token_ids for r in found] == [library.encode(t or "").ids for t in TEXTS]
    assert [r.decoded_text for r in found] == [t or "" for t in TEXTS]
    assert [r.n_tokens for r in found] == [1.5] * len(TEXTS)
    plain = ordered(bpe.encode_documents(texts, PATH, ids="kept"))
    assert [r.kept for r in plain] == [r.token_ids for r in found]
    assert bpe.encode_documents(texts.limit(0), PATH).count() == 0


def test_decode_column(spark):
    ids = spark.createDataFrame([([31373],), ([],), (None,), ([None, 31373, 10**6],)], "ids array<int>")
    found = ids.select(bpe.Tokenizer(spark, PATH).decode(ids["ids"]).alias("t")).collect()
    assert [r.t for r in found] == ["hello", "", None, "hello"]


def test_length_histogram(spark, texts, library):
    counted = lengths.token_lengths(texts, PATH)
    sizes = [len(library.encode(t or "").ids) for t in TEXTS]
    assert [r.n_tokens for r in ordered(counted)] == sizes
    histogram = lengths.length_histogram(counted)
    rows = histogram.orderBy("length").collect()
    assert [r.length for r in rows] == sorted(set(sizes))
    for r in rows:
        assert r.docs_within == sum(s <= r.length for s in sizes)
        assert r.tokens_cut == sum(min(s, r.length) for s in sizes)
        assert r.tokens_lost == sum(sizes) - r.tokens_cut
        assert r.tokens_within == sum(s for s in sizes if s <= r.length)
        assert r.docs_over == len(sizes) - r.docs_within
    for limit in (0, 1, 5, 10**6):
        answer = lengths.limit_answer(histogram, limit).first()
        assert answer.tokens_cut == sum(min(s, limit) for s in sizes)
    assert lengths.quantile_length(histogram, 0.5).first().length == sorted(sizes)[3]
    assert lengths.length_histogram(counted.limit(0)).count() == 0
    assert lengths.limit_answer(lengths.length_histogram(counted.limit(0)), 5).first().tokens_cut == 0
    few = lengths.length_histogram(spark.createDataFrame([(5,), (7,), (7,), (None,)], "n_tokens bigint"))
    for limit, answer in {3: (0, 3, 9), 5: (1, 2, 15), 6: (1, 2, 17), 7: (3, 0, 19), 99: (3, 0, 19)}.items():
        assert tuple(lengths.limit_answer(few, limit).first()) == answer


# --- repetition


def brute_repeats(found, least):
    n = len(found)
    longest = [0] * n
    for i, j in product(range(n), repeat=2):
        k = 0
        while i != j and max(i, j) + k < n and found[i + k] == found[j + k]:
            k += 1
        longest[i] = max(longest[i], k)
    windows = {i + d for i in range(n) if longest[i] >= 3 for d in range(3)}
    spans = {p for i in range(n) if longest[i] >= least for p in range(i, i + longest[i])}
    return [len(windows), len(spans), max(longest, default=0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"ab"]), max_size=18), max_size=6))
def test_repeats_equal_brute_force(documents):
    expected = [brute_repeats(d, 4) for d in documents]
    assert repetition.measure_words(documents, 4).tolist() == expected


def test_judged_texts(spark, texts):
    found = ordered(repetition.judge_repetition(texts))
    assert [r.n_words for r in found] == [len(words(t)) for t in TEXTS]
    assert [r.kept for r in found] == [False] * len(TEXTS)
    assert found[5].longest_repeat == 29_999 and found[5].n_repeat_words == 30_000
    fine = " ".join(f"w{i}" for i in range(400))
    passage = " ".join(f"p{i}" for i in range(60))
    cases = [fine, f"{fine}\n{passage}\n{passage}", f"a line\nb\n a line\na line\n\n\n{fine} #*"]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    rows = ordered(repetition.judge_repetition(df))
    assert [r.kept for r in rows] == [True, False, True]
    assert (rows[2].n_dup_lines, rows[2].n_symbols) == (1, 2)
    assert repetition.judge_repetition(df.limit(0)).count() == 0


# --- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    found = {}
    for kind, pattern in PATTERNS.items():
        found[kind] = []
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match.group())
            fits = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in match.group().split(".")),
                "card": 13 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }
            if fits[kind]:
                found[kind].append(match.span())
    return found


@settings(max_examples=400, deadline=None)
@given(st.one_of(*[st.text(a, max_size=40) for a in ("ab.@-_ 1", "0123456789 .-", "+123456789 ().-", "a@.é5+%")]))
def test_plain_spans_equal_the_patterns(text):
    assert pii.plain_spans(text) == brute_spans(text)


@pytest.mark.parametrize(
    "text, kind, hidden",
    [
        ("mail john dot smith [at] example dot com now", "email", "john dot smith [at] example dot com"),
        ("é user (at) host.example.com!", "email", "user (at) host.example.com"),
        ("call plus one five five five oh one two three four end", "phone", "plus one five five five oh one two three four"),
        ("card four one one one 1111 1111 1111 x", "card", "four one one one 1111 1111 1111"),
        ("ip one nine two dot one six eight dot zero dot one ok", "ip", "one nine two dot one six eight dot zero dot one"),
        ("ѕарса@example.com", "email", "ѕарса@example.com"),
        ("４１１１１１１１１１１１１１１１", "card", "４１１１１１１１１１１１１１１１"),
        ("192 [dot] 168 [dot] 1 [dot] 20 yes", "ip", "192 [dot] 168 [dot] 1 [dot] 20"),
        ("john​.doe@exa​mple.com", "email", "john​.doe@exa​mple.com"),
        ("jane@examρle.com", "email", "jane@examρle.com"),
        ("jane@mаıl.сoм", "email", "jane@mаıl.сoм"),
        ("mail jane【at】example.com ok", "email", "jane【at】example.com"),
        ("x jane%40example.com y", "email", "jane%40example.com"),
        ("x jane&#64;example&#x2E;com y", "email", "jane&#64;example&#x2E;com"),
        ("go jane -at- example -dot- com now", "email", "jane -at- example -dot- com"),
        ("pay 4l11 1111 1111 1111 now", "card", "4l11 1111 1111 1111"),
        ("host 192.168.1o.2O1 up", "ip", "192.168.1o.2O1"),
        (f"{'x' * 500} x.y.{'ab [dot] ' * 40}z [at] example [dot] com", "email", f"x.y.{'ab [dot] ' * 40}z [at] example [dot] com"),
        (f"{'ab [dot] ' * 3000}z [at] example [dot] com", "email", f"{'ab [dot] ' * 3000}z [at] example [dot] com"),
    ],
)
def test_disguised_data_is_found_in_the_source(text, kind, hidden):
    found = [(s["kind"], text[s["start"] : s["end"]]) for s in pii.find_spans(text) if not s["plain"]]
    assert found == [(kind, hidden)]


def test_long_texts_of_at_signs_stay_linear():
    for piece in ("a [at] ", "ab [dot] ", "x [at] y [dot] ", "- [at] example.com ", "1l1o "):
        text = piece * 40_000
        start = time.process_time()
        pii.find_spans(text)
        assert time.process_time() - start < 20, piece


def test_mask_covers_spans_of_two_kinds():
    text = "at 10.0.0.1@example.com and 4111 1111 1111 1111@example.com end"
    masked = pii.mask(text)
    assert not re.search("[0-9@]", masked) and masked.startswith("at ") and masked.endswith(" end")


def test_prose_is_left_alone():
    for text in ("it is 40% at home. Then dot the i", "100%40 units", "10l and 2O of them", "look [at] this", "a «dot» on the map"):
        assert pii.find_spans(text) == [], text


BRACKETS = ["[]", "()", "{}", "<>", "【】", "«»"]
IN_BRACKETS = [f"{gap}{o}{pad}%s{pad}{c}{gap}" for o, c in BRACKETS for pad in ("", " ") for gap in ("", " ")]
BARE_ATS = [" at ", " @ ", "_at_", "-at-", " -at- ", "%40", "&#64;", "&commat;"]
AT_FORMS = [form % sign for form in IN_BRACKETS for sign in ("at", "AT", "@")] + BARE_ATS
SPELLED_DOTS = [form % "dot" for form in IN_BRACKETS] + [" dot ", "_dot_", "-dot-"]
DOT_FORMS = SPELLED_DOTS + [form % "." for form in IN_BRACKETS] + [" . "]


def hidden_data(text):
    return [(s["kind"], text[s["start"] : s["end"]]) for s in pii.find_spans(text) if not s["plain"]]


def test_every_at_and_dot_is_found_with_nothing_else_around():
    for at in AT_FORMS:
        for dot in SPELLED_DOTS if at in BARE_ATS else [".", *DOT_FORMS]:
            text = f"jane{at}example{dot}com"
            assert hidden_data(text) == [("email", text)]
            assert pii.mask(f"Write to {text} today") == "Write to [email] today"
    for dot in DOT_FORMS:
        text = dot.join(["192", "168", "1", "20"])
        assert hidden_data(text) == [("ip", text)]
    assert hidden_data("Hi.\njane ( at ) example.com\nBye.\n") == [("email", "jane ( at ) example.com")]


@pytest.mark.parametrize(
    "text, kind, hidden",
    [
        ("call +44 20 7946 oh nine five now", "phone", "+44 20 7946 oh nine five"),
        ("call +1 415 555 01two3 now", "phone", "+1 415 555 01two3"),
        ("call +44 20 79461 oh nine five", "phone", "+44 20 79461 oh nine five"),
        ("card 4111 1111 1111 11 one one", "card", "4111 1111 1111 11 one one"),
        ("card 4111 1111 1111 111 one", "card", "4111 1111 1111 111 one"),
        ("İ card four one one one 1111 1111 1111", "card", "four one one one 1111 1111 1111"),
        ("on 12 four one one one 1111 1111 1111 x", "card", "four one one one 1111 1111 1111"),
        ("in 2024 one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
        ("192.168.1.one", "ip", "192.168.1.one"),
        ("192 dot 168 dot one dot 20", "ip", "192 dot 168 dot one dot 20"),
    ],
)
def test_numbers_of_which_a_part_is_spelled(text, kind, hidden):
    assert hidden_data(text) == [(kind, hidden)]
    assert pii.mask(text) == text.replace(hidden, f"[{kind}]")


@pytest.mark.parametrize(
    "hidden",
    ["jane @ example.com", "jane_at_example.com", "j.doe_at_mail.example.co.uk", "jane @ example . com"]
    + ["jane_at_mail dot sg"]
    + [f"jane at mail dot {last}" for last in ("sg", "il", "tw", "ua", "xyz", "museum", "com")],
)
def test_bare_at_signs_before_plain_domains_and_any_top_domain(hidden):
    for after in (", please", " . Thanks", " dot Thanks"):
        assert hidden_data(f"write to {hidden}{after}") == [("email", hidden)]
    assert hidden_data("jane @ mail dot corp") == [("email", "jane @ mail dot corp")]


@pytest.mark.parametrize(
    "text", ["stay-at-home.org", "we meet at example.com", "two @ 3.50 each", "start_at_index.value", "dots at dotty.com"]
)
def test_at_without_an_address(text):
    assert pii.find_spans(text) == []


def test_words_after_a_whole_number_are_left_alone():
    assert pii.mask("call +1 415 555 0123 one of us") == "call [phone] one of us"
    assert pii.mask("10.0.0.1 one two, in 2019 one of ſix fİve") == "[ip] one two, in 2019 one of ſix fİve"


@pytest.mark.parametrize(
    "text",
    ["look at that dot on the i", "we met at example.com yesterday", "one two three four things", "at four dot five", ""],
)
def test_ordinary_prose_is_left_alone(text):
    assert pii.find_spans(text) == []
    assert pii.mask(text) == text


@pytest.mark.parametrize("part", ["a", "1", "a@", "1.", "+1", " at ", "one ", "a dot ", "1 dot ", "[at] x.", "(", " ", "< "])
def test_long_runs_stay_fast(part):
    pii.find_spans(part * (100_000 // len(part)) + "dot")


def test_personal_data_of_documents(spark, texts):
    found = ordered(pii.add_personal_data(texts, spans="kept"))
    assert all(r.kept == [] for r in found)
    case = "a@b.co +1 (268) 555-4977 and 10.0.0.1"
    df = spark.createDataFrame([(0, case, 1), (1, None, 1), (2, "", 1)], "doc_id bigint, text string, pii_spans int")
    rows = ordered(pii.add_personal_data(df))
    assert [(s.kind, case[s.start : s.end], s.plain) for s in rows[0].pii_spans] == [
        ("email", "a@b.co", True), ("ip", "10.0.0.1", True), ("phone", "+1 (268) 555-4977", True),
    ]
    assert [r.text for r in ordered(pii.mask_personal_data(df))] == ["[email] [phone] and [ip]", None, ""]
    assert pii.add_personal_data(df.limit(0)).count() == 0


# --- hashed words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("aB é\t\n\x0b\r\x1c\x85  ߿x", max_size=30), max_size=6))
def test_hashed_words_are_the_words(found):
    got = hashed_words.find_words([t.encode() for t in found])
    expected = [(k, w) for k, t in enumerate(found) for w in lower_words(t)]
    assert list(zip(got.text.tolist(), got.of(np.arange(len(got.starts))))) == expected
    by_hash = {}
    for number, (_, word) in zip(got.hashes.tolist(), expected):
        assert by_hash.setdefault(number, word) == word
    assert len(by_hash) == len({w for _, w in expected})
    assert got.last_non_ascii().tolist() == [next((b for b in reversed(w) if b >= 128), 0) for _, w in expected]


def test_a_hash_does_not_depend_on_the_place(monkeypatch):
    monkeypatch.setattr(hashed_words, "PIECE", 64)
    hashed_words._powers.cache_clear()
    draw = random.Random(2)
    known = ["".join(draw.choices("abcdefé", k=draw.choice([1, 2, 5, 30, 63, 64, 65, 200]))).encode() for _ in range(300)]
    alone = [int(hashed_words.find_words([w]).hashes[0]) for w in known]
    text = b" ".join(known)
    assert hashed_words.find_words([b"q", text, b""]).hashes[1:].tolist() == alone
    column = pa.array([None, *map(bytes.decode, known), ""])
    rows = [(start, len(texts)) for start, texts in hashed_words.grouped_texts(column)]
    assert sum(n for _, n in rows) == 302 and rows[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:]))
    hashed_words._powers.cache_clear()
    assert hashed_words.find_words([]).hashes.tolist() == [] == hashed_words.find_words([b"", b" "]).hashes.tolist()
