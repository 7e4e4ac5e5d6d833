"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import (
    bpe, conversations, divergence, fourier, hamming, jaccard, lengths, mixing, pii, recurrent, repetition, unlabelled,
    warc,
)

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def remainder(divisor: int):
    """crc32 of the doc_id as text, modulo ``divisor``."""
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def op1_warc(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    folder = warc.archive_folder(pages)
    records = warc.read_records(warc.write_archives(pages, folder), folder, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_recurrent(spark: SparkSession, sf: str) -> DataFrame:
    return recurrent.score_documents(table(spark, sf, "documents"), remainder(10) == 0)


def op3_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.shingle_components(table(spark, sf, "documents"))


def op4_repetition(spark: SparkSession, sf: str) -> DataFrame:
    judged = repetition.judge_repetition(table(spark, sf, "documents").select("doc_id", "text"))
    return judged.drop("text")


def op5_token_lengths(spark: SparkSession, sf: str) -> DataFrame:
    docs = lengths.token_lengths(table(spark, sf, "documents").select("text"), VOCABULARY)
    return lengths.length_histogram(docs)


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf, "documents"))[0].drop("source")


def op7_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = bpe.round_trip(table(spark, sf, "documents").select("doc_id", "text"), VOCABULARY)
    digits = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return docs.select(
        "doc_id",
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(digits, 256).alias("ids_sha256"),
        F.sha2("decoded_text", 256).alias("decoded_sha256"),
    )


def op8_hamming(spark: SparkSession, sf: str) -> DataFrame:
    return hamming.near_duplicates(table(spark, sf, "embeddings"))


def op9_quality(spark: SparkSession, sf: str) -> DataFrame:
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    model, measured = fourier.fit_quality(
        table(spark, sf, "documents"), table(spark, sf, "labels"), ~held_out
    )
    scored = measured.select(
        "doc_id", held_out.alias("held_out"), fourier.score_column(model, F.col("statistics")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op10_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.add_personal_data(table(spark, sf, "documents").select("doc_id", "text"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("pii_spans", lambda s: s["plain"])

    def number(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [number(kind) for kind in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans")
    )


def op11_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf, "documents"))


def op12_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    model, words = unlabelled.fit_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"), ~held_out)
    scored = words.select(
        "doc_id", held_out.alias("held_out"), unlabelled.score_column(model, F.col("words")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op13_trie(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.prefix_trie(table(spark, sf, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_warc, op2_recurrent, op3_jaccard, op4_repetition, op5_token_lengths, op6_mixing, op7_bpe, op8_hamming,
        op9_quality, op10_pii, op11_divergence, op12_toxicity, op13_trie,
    )
}

# The other queries rest on hashes, models or a tokenizer; tests hold them to brute force.
SQL: dict[str, str] = {
    "op1_warc": """
        WITH payloads AS (
          SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
        last AS (SELECT html, max(page_id) AS page_id FROM payloads WHERE n >= 1000 GROUP BY html)
        SELECT p.page_id, n::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
               CASE WHEN l.page_id > p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN l.page_id > p.page_id THEN l.page_id END AS refers_to
        FROM payloads p LEFT JOIN last l ON l.html = p.html""",
    "op3_jaccard": r"""
        WITH RECURSIVE found AS (
          SELECT doc_id, regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x20\x09-\x0D]+') AS words
          FROM documents),
        shingles AS (
          SELECT DISTINCT doc_id, unnest(
            CASE WHEN len(words) >= 5 THEN [array_to_string(words[i:i + 4], ' ') for i in range(1, len(words) - 3)]
                 WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle
          FROM found),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (
          SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
          FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (
          SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
          WHERE 100 * c >= 75 * (s.n + t.n - c)),
        reached(doc_id, root) AS (
          SELECT doc_id, doc_id FROM documents
          UNION SELECT y, root FROM reached JOIN links ON x = doc_id)
        SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(root) AS component_id
        FROM reached d LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op11_divergence": r"""
        WITH docs AS (
          SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
          FROM documents),
        words AS (SELECT doc, lang, source, unnest(terms) AS term FROM docs),
        kept AS (
          SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
        counts AS (
          SELECT w.lang, w.source, w.term, count(*) AS c
          FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
        sizes AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS lang_n FROM kept GROUP BY lang),
        groups AS (
          SELECT g.lang, g.source, coalesce(v, 0)::HUGEINT AS v, coalesce(lang_n, 0) AS lang_n,
                 coalesce((SELECT sum(c) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0)::HUGEINT AS n
          FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sizes s ON s.lang = g.lang),
        shares AS (
          SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
                 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (g.n + g.v) AS p,
                 1 + (1000000000::HUGEINT * (k.total + 1)) // (g.lang_n + g.v) AS q
          FROM groups g JOIN kept k ON k.lang = g.lang
          LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        summed AS (
          SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
          FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        terms AS (
          SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value
          FROM shares WHERE c > 0 AND p > q)
        SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
        FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
        QUALIFY part = 'pair' OR rank <= 200""",
    "op13_trie": r"""
        WITH crc_table AS (
          SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                   lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crcs
          FROM (SELECT unnest(range(256)) AS i)),
        digits AS (
          SELECT conv_id, xor(4294967295, list_reduce(
                   [4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ord(d)::BIGINT),
                   lambda c, b: xor(crcs[xor(c & 255, b) + 1], c >> 8))) % 6 AS h
          FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc_table),
        keyed AS (
          SELECT conv_id, turn, length(coalesce(text, '')) AS n,
                 sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key
          FROM conversations WHERE conv_id IS NOT NULL),
        own AS (
          SELECT conv_id, list(key || ':' || n ORDER BY turn NULLS FIRST, key) AS turns FROM keyed GROUP BY conv_id),
        rebuilt AS (
          SELECT o.conv_id, coalesce(b.turns, [])[1:h::BIGINT] || o.turns[h::BIGINT + 1:] AS turns
          FROM own o JOIN digits USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
        members AS (
          SELECT conv_id, depth, len(turns) = depth AS ends, array_to_string(turns[1:depth], ',') AS path,
                 CASE WHEN depth > 0 THEN array_to_string(turns[1:depth - 1], ',') END AS above,
                 CASE WHEN depth > 0 THEN string_split(turns[depth], ':')[2]::BIGINT ELSE 0 END AS n
          FROM (SELECT *, unnest(range(len(turns) + 1)) AS depth FROM rebuilt)),
        nodes AS (
          SELECT depth, path, any_value(above) AS above, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
          FROM members GROUP BY depth, path),
        kids AS (SELECT depth - 1 AS depth, above AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
        counted AS (
          SELECT n.*, coalesce(n_children, 0) AS n_children
          FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path),
        below AS (
          SELECT DISTINCT a.depth, a.path, b.depth AS d, b.path AS p
          FROM members a JOIN members b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
        subtrees AS (
          SELECT b.depth, b.path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * n) AS saved_tokens
          FROM below b JOIN counted c ON c.depth = b.d AND c.path = b.p GROUP BY ALL)
        SELECT c.conv_id::BIGINT AS conv_id, c.depth::BIGINT AS depth, parent.conv_id::BIGINT AS parent_conv_id,
               c.n_convs::BIGINT AS n_convs, c.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
               saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
        FROM counted c JOIN subtrees s ON s.depth = c.depth AND s.path = c.path
        LEFT JOIN counted parent ON parent.depth = c.depth - 1 AND parent.path = c.above""",
}
