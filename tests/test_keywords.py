import random
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plain_scoring import kept, ranked_keywords
from termloom.operators import content
from termloom.operators import keywords as kw
from termloom.params import Params
from termloom.vocab import STOP_WORDS

OPEN = Params(min_content_chars=0)
BY_ROWS = replace(OPEN, in_row_max_chars=-1)
BY_CHUNKS = replace(BY_ROWS, chunk_chars=9)


def texts_frame(spark, texts):
    rows = [(i, f"http://t/{i}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "ord bigint, url string, text string")


def answers(df):
    found = {}
    for r in df.orderBy("ord", "rank").collect():
        found.setdefault(r.ord, []).append((r.keyword, r.n, r.score, r.rank, r.first_pos))
    return found


def random_texts(seed, count=40):
    rng = random.Random(seed)
    words = ["visa", "fee", "permit", "work", "the", "élan", "h1b", "co-op", "it's", "ab", "constructor",
             "extraordinary", "abcdefghij", "abcdefghijk", "WORK", "12", "naïve", "слово"]
    joins = [" ", ", ", "\n", " - ", ". "]
    return [
        "".join(rng.choice(words) + rng.choice(joins) for _ in range(rng.choice([0, 1, 2, 3, 8, 60, 400])))
        for _ in range(count)
    ]


CASES = [
    None,
    "",
    "   \n\t ",
    "the and of 12 345 ab",
    "visa",
    "visa permit",
    "visa permit visa permit",
    "Visa VISA visa vIsA",
    "it's a co-op naïve café h1b 4ever under_score",
    " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)),
    " ".join(["the"] * 49 + ["alpha", "beta"] + ["the"] * 98 + ["gamma", "delta"]),
    "abc abcdefghij abcdefghijk",
    "constructor toString constructor",
    "zeta yota xena " * 30,
]


@pytest.mark.parametrize("params", [OPEN, BY_ROWS, BY_CHUNKS], ids=["in_row", "by_rows", "by_chunks"])
def test_scores_equal_the_definition(spark, params):
    texts = CASES + random_texts(1)
    found = answers(kw.extract_keywords(texts_frame(spark, texts), params=params))
    for i, text in enumerate(texts):
        assert found.get(i, []) == ranked_keywords(text or ""), (i, text)


@pytest.mark.parametrize("two,three", [(1, 1), (3, 2), (2, 4)])
@pytest.mark.parametrize("form", [OPEN, BY_CHUNKS], ids=["in_row", "by_chunks"])
def test_phrase_thresholds(spark, two, three, form):
    params = replace(form, bigram_min_freq=two, trigram_min_freq=three, max_keywords=7)
    texts = random_texts(2, 12)
    found = answers(kw.extract_keywords(texts_frame(spark, texts), params=params))
    for i, text in enumerate(texts):
        assert found.get(i, []) == ranked_keywords(text, params=params)


def test_early_positions(spark):
    # Positions 49, 50 and 149, 150 of the unfiltered text.
    found = answers(kw.extract_keywords(texts_frame(spark, [CASES[10]]), params=OPEN))[0]
    scores = {k: s for k, _, s, _, _ in found}
    assert scores == {"alpha": 19, "beta": 13, "gamma": 14, "delta": 11}


@pytest.mark.parametrize("params", [OPEN, BY_ROWS, BY_CHUNKS], ids=["in_row", "by_rows", "by_chunks"])
def test_lexicon_takes_the_bonus(spark, params):
    texts = CASES + random_texts(3)
    lexicon = spark.createDataFrame(
        [("Visa", False), ("permit", True), ("work", False), ("work", True), ("unseen", False), (None, False), ("fee", None)],
        "word string, is_noun boolean",
    )
    expected = {i: ranked_keywords(t or "", {"visa", "work"}) for i, t in enumerate(texts)}
    found = answers(kw.extract_keywords(texts_frame(spark, texts), lexicon=lexicon, params=params))
    assert {i: found.get(i, []) for i in expected} == expected


def many_words(seed):
    """Texts of far more words than keywords, with counts that the bonus decides."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(220)]
    return words, [" ".join(rng.choices(words, weights=range(1, 221), k=rng.choice([80, 400, 1500]))) for _ in range(8)]


def test_lexicon_of_most_words(spark):
    """Terms that may still be among the best are kept, whichever words the lexicon names."""
    words, texts = many_words(6)
    for share in (0.0, 0.5, 1.0):
        rng = random.Random(share)
        plain = {w for w in words if rng.random() < share}
        lexicon = spark.createDataFrame([(w, False) for w in sorted(plain)], "word string, is_noun boolean")
        for most in (5, 50):
            params = replace(OPEN, max_keywords=most)
            found = answers(kw.extract_keywords(texts_frame(spark, texts), lexicon=lexicon, params=params))
            assert found == {i: ranked_keywords(t, plain, params) for i, t in enumerate(texts)}


def test_few_terms_meet_the_lexicon(spark):
    """The page table that meets the lexicon holds no text, and of the terms only those that may win."""
    words, texts = many_words(7)
    params = replace(OPEN, max_keywords=5)
    lexicon = spark.createDataFrame([(w, False) for w in words], "word string, is_noun boolean")
    found = kw.analyze_pages(texts_frame(spark, texts * 3), lexicon=lexicon, params=replace(params, in_row_max_chars=None))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "contenders" in str(found.inputFiles()) and "text" not in plan
    full = texts_frame(spark, texts).select(
        kw.tx.page_terms(F.col("text"), (), (), params, lambda t: F.struct(F.size(t).alias("all"), F.size(kw.tx.contending_terms(t, params)).alias("few"))).alias("n")
    ).select("n.*")
    for r in full.collect():
        assert 5 <= r.few < r["all"] / 2


def test_page_words_keep_unfiltered_positions(spark):
    texts = [CASES[8], CASES[3], CASES[10]]
    rows = kw.page_words(texts_frame(spark, texts)).collect()
    expected = {(i, pos, w) for i, t in enumerate(texts) for pos, w in kept(t)}
    assert {tuple(r) for r in rows} == expected and len(rows) == len(expected)


def test_gate_is_strict_and_keeps_earlier_errors(spark):
    rows = [(0, "x" * 99, None), (1, "x" * 100, None), (2, None, None), (3, "x" * 500, "HTTP 403 for u"),
            (4, "x" * 500, "")]
    df = spark.createDataFrame(rows, "ord bigint, text string, error string")
    got = {r.ord: (r.n_chars, r.error) for r in content.gate_content(df).collect()}
    short = "Insufficient content extracted"
    assert got == {0: (99, short), 1: (100, None), 2: (0, short), 3: (500, "HTTP 403 for u"), 4: (500, None)}


def test_pages_without_keywords_stay(spark):
    df = texts_frame(spark, ["the of and " * 20, "visa " * 40, "short"])
    lexicon = spark.createDataFrame([("visa", True)], "word string, is_noun boolean")
    for in_row, words in ((10**6, None), (-1, None), (10**6, lexicon), (-1, lexicon)):
        got = {r.ord: (r.error, len(r.keywords))
               for r in kw.analyze_pages(df, lexicon=words, params=Params(in_row_max_chars=in_row)).collect()}
        assert got == {0: (None, 0), 1: (None, 3), 2: ("Insufficient content extracted", 0)}


def test_routes_agree_on_mixed_sizes(spark):
    texts = random_texts(4)
    one = kw.extract_keywords(texts_frame(spark, texts), params=OPEN)
    mixed = kw.extract_keywords(texts_frame(spark, texts), params=replace(OPEN, in_row_max_chars=300))
    assert one.count() == mixed.count() and one.exceptAll(mixed).isEmpty()


def test_chunks_hold_whole_tokens(spark):
    cases = ["", " ", "abc def", "abcdefghijkl mno", "a" * 50, "Слово naïve İstanbul K ΑΣ.Α 😀😀 " * 9, "--- --- ---", "x\n\r\ty" * 9]
    df = texts_frame(spark, cases)
    for chars in (1, 4, 7, 10**6):
        rows = df.select(
            F.lower("text").alias("low"), kw.tx.text_chunks(F.col("text"), chars).alias("chunks"),
            kw.tx.tokenize(F.col("text")).alias("tokens"),
            F.flatten(F.transform(kw.tx.text_chunks(F.col("text"), chars), kw.tx.tokenize)).alias("by_chunk"),
        ).collect()
        for r in rows:
            assert "".join(r.chunks) == r.low and r.by_chunk == r.tokens
            assert chars > 100 or len(r.chunks) >= min(len(r.tokens), 1)


def test_a_size_that_is_not_known(spark):
    """A null size hint routes a page, and never changes its answer."""
    texts = [t or "" for t in random_texts(8, 9)]
    rows = [(i, "u", t, [None, len(t), 10**7][i % 3]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "ord bigint, url string, text string, size_hint bigint")
    found = answers(kw.extract_keywords(df, params=OPEN))
    assert {i: found.get(i, []) for i in range(9)} == {i: ranked_keywords(t) for i, t in enumerate(texts)}


def test_pages_are_scored_without_an_exchange(spark):
    df = texts_frame(spark, CASES)
    df.write.mode("overwrite").parquet(f"{spark.sparkContext.getCheckpointDir()}/plain")
    stored = spark.read.parquet(f"{spark.sparkContext.getCheckpointDir()}/plain")
    scored = stored.select("ord", F.lit(None).alias("x"), "text").select(
        "ord", kw.tx.page_keywords(F.col("text"), ["the"], (), OPEN).alias("k")
    )
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<ord:bigint,text:string>" in plan


def test_term_counts_exchange_no_terms(spark):
    """Words and phrases are counted in the page's row: what is exchanged are keys, and pages that share one."""
    texts = CASES + random_texts(9, 20)
    counts = kw.term_counts(texts_frame(spark, texts), params=OPEN)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    of_terms = [line for line in plan.splitlines() if "Aggregate [ord" in line and "term" in line]
    assert len(of_terms) == 1 and "ArrowEvalPython" in plan
    found = {}
    for r in counts.collect():
        found.setdefault(r.ord, set()).add((r.term, r.n, (r.tenths + 5) // 10, r.first_pos))
    params = replace(OPEN, max_keywords=10**6)
    for i, text in enumerate(texts):
        assert found.get(i, set()) == {(k, n, score, at) for k, n, score, _, at in ranked_keywords(text or "", params=params)}


@pytest.mark.parametrize("count", [kw.term_counts, kw.chunked_term_counts])
def test_pages_that_share_a_key_count_as_one(spark, count):
    rows = [(1, "visa fee work"), (1, "permit visa fee"), (2, "visa fee"), (None, "alpha beta alpha beta"), (3, None)]
    df = spark.createDataFrame(rows, "ord bigint, text string")
    found = {(r.ord, r.term): (r["count"], r.first_pos) for r in count(df, params=OPEN).collect()}
    assert found[2, "visa"] == (1, 0) and (2, "visa fee") not in found
    if count is kw.term_counts:
        assert found[1, "visa"] == (2, 0) and found[1, "visa fee"] == (2, 0) and found[1, "permit"] == (1, 0)
        assert found[None, "alpha beta"] == (2, 0)


@pytest.mark.parametrize("part_chars", [1, 30, 200])
def test_phrases_across_parts(spark, monkeypatch, part_chars):
    """Chunks are counted by parts of a page; places and phrases go on across the seams of both."""
    monkeypatch.setattr(kw, "PART_CHARS", part_chars)
    texts = CASES + random_texts(10, 25)
    lexicon = spark.createDataFrame([("visa", False), ("work", False)], "word string, is_noun boolean")
    for words, plain in ((None, ()), (lexicon, {"visa", "work"})):
        found = answers(kw.extract_keywords(texts_frame(spark, texts), lexicon=words, params=BY_CHUNKS))
        assert found == {i: k for i, t in enumerate(texts) if (k := ranked_keywords(t or "", plain))}


def test_by_chunks_exchanges_the_best_terms_only(spark):
    """Of a page of one part no more terms are exchanged than may be among its best."""
    _, texts = many_words(11)
    params = replace(BY_CHUNKS, max_keywords=5)
    counts = kw.chunked_term_counts(texts_frame(spark, texts), (), (), params, kw.scoring.counted_best)
    assert counts.groupBy("ord").count().agg(F.max("count")).first()[0] == 5


def test_pieces_of_a_batch(monkeypatch):
    """The numbers of a batch are made piece by piece; where it is cut does not matter."""
    texts = pa.array([t.lower() if t is not None else None for t in CASES + random_texts(12)])
    stop, none = pa.array(sorted(STOP_WORDS)), pa.array([], pa.string())
    for size in (1, 300, 1 << 20):
        monkeypatch.setattr(kw.scoring, "PIECE_BYTES", size)
        found = []
        for begin, piece in kw.scoring.pieces(texts):
            assert begin == len(found)
            words = kw.scoring.find_words(piece, stop, OPEN)
            found += kw.scoring.best_rows(words, kw.scoring.count_terms(words, none, OPEN), len(piece), OPEN).to_pylist()
        for text, keywords in zip(texts.to_pylist(), found, strict=True):
            assert [tuple(k.values()) for k in keywords] == ranked_keywords(text or "")


def test_terms_are_sorted_as_one_number(monkeypatch):
    """What terms are ranked and grouped by is one number; where 63 bits do not hold it, several give the same order."""
    texts = pa.array([t.lower() if t is not None else None for t in CASES + random_texts(13)])
    stop, none = pa.array(sorted(STOP_WORDS)), pa.array([], pa.string())
    words = kw.scoring.find_words(texts, stop, OPEN)
    terms = kw.scoring.count_terms(words, none, OPEN)
    several = kw.scoring._best_first(replace(terms, at=terms.at << 40), terms.order)
    with monkeypatch.context() as patched:
        patched.setattr(kw.scoring.np, "lexsort", None)
        one = kw.scoring._best_first(terms, terms.order)
    assert all((a == b).all() for a, b in zip(one, several, strict=True))
    key = words.page * len(words.names) + words.code
    narrow, wide = kw.scoring._grouped(key), kw.scoring._grouped(key << 45)
    assert all((a == b).all() for a, b in zip(narrow, wide, strict=True))


def test_words_next_to_other_characters():
    """Words end where a chunk does, and at a character of two bytes that is no letter."""
    lists = pa.array([["visa", "fee"], None, [], ["я", "visa"], ["", "fee", "éwork"]], pa.list_(pa.string()))
    found = kw.scoring.find_words(lists, pa.array([], pa.string()), OPEN)
    names = found.names.take(pa.array(found.code)).to_pylist()
    assert list(zip(found.page.tolist(), found.pos.tolist(), names)) == [
        (0, 0, "visa"), (0, 1, "fee"), (3, 1, "visa"), (4, 0, "fee"), (4, 1, "work")
    ]
    assert found.tokens.tolist() == [2, 0, 0, 2, 2]
