"""The pipeline's stages on small tables, and the registered queries."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from __spark_entry__ import queries
from termloom.llm import mixing, pii
from termloom.llm.queries import QUERIES
from termloom.llm.words import lower_words

TABLES = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert {*QUERIES, "pipeline"} <= set(queries())
    assert [name for name, _ in pipeline.STAGES] == ["quality", "near_copies", "personal_data", "mixing", "encoding"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_has_a_row_for_each_input(spark, name):
    found = QUERIES[name](spark, TABLES)
    if name == "op11_divergence":
        groups = spark.read.parquet(f"{TABLES}/documents.parquet").select("lang", "source").distinct().count()
        assert found.where("part = 'pair'").select("lang", "source").distinct().count() == groups
        return
    if name == "op13_trie":
        ids = spark.read.parquet(f"{TABLES}/conversations.parquet").select("conv_id").distinct().count()
        assert found.where("depth = 0").select("n_convs", "parent_conv_id").collect() == [(ids, None)]
        return
    key = {"op1_warc": ("pages", "page_id"), "op8_hamming": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
    if name == "op5_token_lengths":
        assert found.agg(F.sum("n_docs")).first()[0] == spark.read.parquet(f"{TABLES}/documents.parquet").count()
        return
    expected = spark.read.parquet(f"{TABLES}/{key[0]}.parquet").select(key[1]).collect()
    assert Counter(found.select(key[1]).collect()) == Counter(expected)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def test_near_copies_leave_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(4, text, "a"), (2, text + " end", "b"), (9, text, "a"), (9, text, "a"), (5, None, "a"), (6, "", "a")]
    rows += [(7, "quite another text of words", None)]
    kept = pipeline.drop_near_copies(spark, frame(spark, rows), TABLES)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6, 7]
    assert kept.columns == list(pipeline.COLUMNS)


def test_near_copies_are_told_apart_by_text(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(100)) for x in "abcd")
    rows = [(1, a, "a"), (None, a + " end", "a"), (None, b, "a"), (None, b + " end", "b"), (None, c, "a"), (None, c, "a")]
    rows += [(7, d, "a"), (7, a + " too", "a"), (None, None, "a"), (None, None, "b"), (None, " ", "a"), (7, "one more", "b")]
    kept = [(r.doc_id, r.text) for r in pipeline.drop_near_copies(spark, frame(spark, rows), TABLES).collect()]
    one_b = [k for k in kept if k in ((None, b), (None, b + " end"))]
    assert len(one_b) == 1
    rest = [(1, a), (None, c), (7, d), (None, None), (None, None), (None, " "), (7, "one more")]
    assert Counter(kept) == Counter(one_b + rest)


def sizes_by_source(taken):
    words = Counter()
    for r in taken.collect():
        words[r.source] += len(lower_words(r.text))
        assert r.n_chars == len(r.text)
    assert taken.columns == list(pipeline.COLUMNS)
    return words


def test_mixing_takes_effect(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 7)), "abc"[i % 3] if i % 5 else None) for i in range(60)]
    rows += [(100, "", "a"), (101, None, "b"), (3, rows[3][1], "a")]
    docs = frame(spark, rows)
    mixed, _ = mixing.mix_documents(docs)
    targets = {r.source: r.target for r in mixed.select("source", "target").distinct().collect()}
    taken = pipeline.mix_sources(spark, docs, TABLES)
    words = sizes_by_source(taken)
    for source, target in targets.items():
        assert abs(words[source] - target) <= 11  # a document
    assert {(r.doc_id, r.text) for r in taken.collect()} <= {(i, t) for i, t, _ in rows}


def test_mixing_keeps_texts_whole(spark):
    """Many sources of few documents, and one whose last document is very long; white space stays."""
    rows = [(i, f"a\n\n{i}\t b" + "  x" * (i % 40), f"s{i % 50}") for i in range(150)]
    rows += [(1000, "long " * 40_000, "s3"), (1001, "long " * 40_000, "s3")] + [(None, f"no  id {k}" + " y" * k, "s4") for k in range(30)]
    docs = frame(spark, rows)
    targets = {r.source: r.target for r in mixing.mix_documents(docs)[0].select("source", "target").distinct().collect()}
    taken = pipeline.mix_sources(spark, docs, TABLES)
    assert {(r.doc_id, r.text, r.source) for r in taken.collect()} <= set(rows)
    words = sizes_by_source(taken)
    for source, target in targets.items():
        longest = max(len(t.split()) for _, t, s in rows if s == source)
        assert abs(words[source] - target) <= longest / 2 + 1, source


def test_stages_pass_empty_tables(spark):
    docs = frame(spark, [(1, "x", "a")]).limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, TABLES).count() == 0


def test_pipeline_equals_stage_by_stage(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    good = pipeline.keep_quality(spark, docs, TABLES)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    ids = {r.doc_id for r in good.select("doc_id").collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in ids for i in clean) / len(clean) > 0.9
    unique = pipeline.drop_near_copies(spark, good, TABLES)
    masked = pipeline.mask_personal_data(spark, unique, TABLES)
    before = {r.doc_id: r.text for r in unique.collect()}
    assert {r.doc_id: r.text for r in masked.collect()} == {i: pii.mask(t) for i, t in before.items()}
    encoded = pipeline.run(spark, TABLES).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mixed = pipeline.mix_sources(spark, masked, TABLES).collect()
    assert all(r.decodes for r in encoded)
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in encoded) == Counter(
        (r.doc_id, tuple(library.encode(r.text).ids)) for r in mixed
    )
