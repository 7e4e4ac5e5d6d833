"""The registered queries: every operator over the whole of a given table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.charset import decoded
from termloom.operators import aggregate, content, gap, prompts, topics
from termloom.operators import keywords as kw
from termloom.params import Params
from termloom.plans.analysis import analyze_url_list
from termloom.sinks import reports
from termloom.sources import crawl, urls
from termloom.sources.pages import look_up_pages, read_documents, read_page_table
from termloom.storage import materialize

# The texts are invented, so few of them share keywords or name real topics. The ratios and the
# syllable taxonomy below give every step something to do.
BASE = Params(common_ratio=0.1)
LOW_RATIO = replace(BASE, common_ratio=0.02)
FIRST_URLS = 100
SYLLABLES = {
    "A": ("tion", "thon"),
    "B": ("ing", "ble"),
    "C": ("que", "des"),
    "D": ("heit", "ver"),
}
TAXONOMY = topics.Taxonomy.of(SYLLABLES)

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_documents(spark, f"{sf}/documents.parquet", "lang")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_page_table(spark, f"{sf}/pages.parquet")


def analysis(spark: SparkSession, sf: str) -> DataFrame:
    return kw.analyze_pages(documents(spark, sf), params=BASE)


def stored_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """For queries that read the page table more than once."""
    return materialize(analysis(spark, sf), "pages")


def content_gate(spark, sf):
    return content.gate_content(documents(spark, sf), BASE).select("ord", "n_chars", "error")


def tokens_filtered(spark, sf):
    return kw.page_words(documents(spark, sf), params=BASE)


def _good(spark, sf):
    return content.gate_content(documents(spark, sf), BASE).where(content.succeeded())


def word_scores(spark, sf):
    counts = kw.term_counts(_good(spark, sf), params=BASE).where("n = 1")
    return counts.select("ord", F.col("term").alias("word"), "tenths", "count", "first_pos")


def ngram_counts(spark, sf):
    counts = kw.term_counts(_good(spark, sf), params=BASE).where("n > 1")
    return counts.select("ord", "n", F.col("term").alias("phrase"), "count", "first_pos")


def keywords_top50(spark, sf):
    return kw.keywords(analysis(spark, sf))


def benchmark_lexicon(spark, sf):
    """Calls the words of the benchmark texts with an odd number of letters no nouns."""
    texts = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("ord"), "text")
    words = kw.page_words(texts, params=BASE).select(F.col("token").alias("word")).distinct()
    return words.withColumn("is_noun", F.length("word") % 2 == 0)


def keywords_lexicon(spark, sf):
    found = kw.analyze_pages(documents(spark, sf), lexicon=benchmark_lexicon(spark, sf), params=BASE)
    return kw.keywords(found)


def page_counters(spark, sf):
    return aggregate.page_counters(analysis(spark, sf), TAXONOMY)


def keyword_totals(spark, sf):
    return aggregate.keyword_totals(analysis(spark, sf))


def _totals_stats(found: DataFrame, params: Params, group=()):
    return aggregate.keyword_totals(found, group), aggregate.page_stats(found, group, params)


def common_keywords(spark, sf):
    return aggregate.common_keywords(*_totals_stats(stored_analysis(spark, sf), LOW_RATIO))


def common_by_lang(spark, sf):
    found = stored_analysis(spark, sf)
    return aggregate.common_keywords(*_totals_stats(found, LOW_RATIO, ["lang"]), ["lang"])


def keyword_topics(spark, sf):
    return topics.keyword_topics(analysis(spark, sf), TAXONOMY)


def page_topics(spark, sf):
    found = analysis(spark, sf).select(
        "ord", F.explode_outer(topics.page_topics(F.col("keywords"), TAXONOMY)).alias("t")
    )
    return found.where(F.col("t").isNotNull()).select(
        "ord", F.col("t.topic").alias("topic"), F.array_join("t.keywords", ", ").alias("keywords")
    )


def merged_topics(spark, sf):
    return topics.merged_topics(aggregate.keyword_totals(analysis(spark, sf)), TAXONOMY)


def merged_topics_by_lang(spark, sf):
    return topics.merged_topics(aggregate.keyword_totals(analysis(spark, sf), ["lang"]), TAXONOMY, ["lang"])


def _run_stats(spark, sf, group):
    found = stored_analysis(spark, sf)
    totals, stats = _totals_stats(found, LOW_RATIO, group)
    totals = materialize(totals, "totals")
    common = aggregate.common_keywords(totals, stats, group)
    return aggregate.run_stats(found, totals, common, group, LOW_RATIO)


def run_stats(spark, sf):
    return _run_stats(spark, sf, [])


def run_stats_by_lang(spark, sf):
    return _run_stats(spark, sf, ["lang"])


def url_filter_mixed(spark, sf):
    """A third of the URLs have another scheme or case, or white space before them."""
    kind = F.col("ord") % 3
    odd = F.when(kind == 0, F.concat(F.lit("ftp:"), "url")).when(
        (kind == 1) & (F.col("ord") % 2 == 0), F.concat(F.lit(" "), "url")
    )
    return urls.keep_http(pages(spark, sf).select("ord", F.coalesce(odd, "url").alias("url")))


def odd_documents(spark, sf):
    """The documents, of which some have a null, empty or blank text."""
    kind = F.col("ord") % 7
    text = (
        F.when(kind == 0, F.lit(None).cast("string")).when(kind == 1, "").when(kind == 2, F.lit(" \n\t"))
        .otherwise(F.col("text"))
    )
    return documents(spark, sf).withColumn("text", text).drop("size_hint")


def content_gate_odd(spark, sf):
    return content.gate_content(odd_documents(spark, sf), BASE).select("ord", "n_chars", "error")


def keywords_odd(spark, sf):
    return kw.keywords(kw.analyze_pages(odd_documents(spark, sf), params=BASE))


def keywords_by_rows(spark, sf):
    """Every page takes the relational form that huge pages take."""
    return kw.keywords(kw.analyze_pages(documents(spark, sf), params=replace(BASE, in_row_max_chars=0)))


def keywords_by_chunks(spark, sf):
    """The same with chunks of a few words, so that most phrases lie across a seam."""
    small = replace(BASE, in_row_max_chars=0, chunk_chars=40)
    return kw.keywords(kw.analyze_pages(documents(spark, sf), lexicon=own_lexicon(spark, sf), params=small))


def own_lexicon(spark, sf):
    """All words of the documents; those with an odd number of letters are no nouns."""
    words = kw.page_words(documents(spark, sf), params=BASE).select(F.col("token").alias("word")).distinct()
    return words.withColumn("is_noun", F.length("word") % 2 == 0)


def keywords_large_lexicon(spark, sf):
    return kw.keywords(kw.analyze_pages(documents(spark, sf), lexicon=own_lexicon(spark, sf), params=BASE))


def keyword_topics_by_table(spark, sf):
    seeds = [(i, topic, seed) for i, (topic, words) in enumerate(SYLLABLES.items(), 1) for seed in words]
    table = spark.createDataFrame(seeds, "topic_order int, topic string, seed string")
    return topics.assign_topics_by_table(keywords_top50(spark, sf), table).select(
        "ord", "url", "keyword", "topic_order", "topic", "rank"
    )


def keyword_topics_by_words(spark, sf):
    """A taxonomy with a seed for two thirds of all words of the documents, by whole words."""
    words = kw.page_words(_good(spark, sf), params=BASE).select(F.col("token").alias("seed")).distinct()
    letters = F.length("seed")
    seeds = words.where(letters % 3 != 0).select(
        letters.alias("topic_order"), F.concat(F.lit("letters "), letters.cast("string")).alias("topic"), "seed"
    )
    return topics.assign_topics_by_table(keywords_top50(spark, sf), seeds, match="word").select(
        "ord", "url", "keyword", "topic_order", "topic", "rank"
    )


def page_text_odd(spark, sf):
    """The pages with fragments before the article that a careless reading loses or keeps in error."""
    before = F.lit(
        "<!--><svg><title/><path d='x'/></svg><form>f<form>g</form></form><h2 class=banner>n</h3><!--x--!>"
    )
    odd = pages(spark, sf).withColumn("html", F.regexp_replace("html", "<article>", F.concat(before, F.lit("<article>"))))
    texts = content.extract_text(odd, BASE)
    return content.gate_content(texts, BASE).select("ord", "url", "place", "n_chars", "error", "text")


def url_filter(spark, sf):
    # A list with both spellings of the column: even pages fill ``URL``, odd ones only ``url``.
    even = F.col("ord") % 2 == 0
    listed = pages(spark, sf).select(
        "ord",
        F.when(even, F.col("url")).otherwise("").alias("upper"),
        F.when(~even, F.col("url")).alias("lower"),
    )
    chosen = listed.select("ord", urls.choose_urls(F.col("upper"), F.col("lower")).alias("url"))
    return urls.keep_http(chosen)


def first_urls(spark, sf):
    listed = urls.keep_http(pages(spark, sf).select("ord", "url"))
    return urls.first_urls(listed, replace(BASE, max_urls=FIRST_URLS))


def url_list(crawled: DataFrame) -> DataFrame:
    """Every crawled URL listed twice, once as it is and once as a URL that was never crawled."""
    return crawled.select(
        F.explode(
            F.array(
                F.struct((F.col("ord") * 2).alias("ord"), F.col("url").alias("url")),
                F.struct((F.col("ord") * 2 + 1).alias("ord"), F.concat("url", F.lit("#lost")).alias("url")),
            )
        ).alias("u")
    ).select("u.*")


def url_lookup(spark, sf):
    # Every page was crawled twice; the second time, which counts, it had three more characters.
    crawled = pages(spark, sf).select("ord", "url", F.length("html").cast("bigint").alias("html_chars"))
    again = crawled.select(
        (F.col("ord") + 1_000_000_000).alias("ord"), "url", (F.col("html_chars") + 3).alias("html_chars")
    )
    return look_up_pages(url_list(crawled), crawled.unionByName(again)).select("ord", "url", "html_chars", "error")


def url_list_counters(spark, sf):
    crawled = pages(spark, sf)
    found = analyze_url_list(url_list(crawled), crawled, BASE)
    return aggregate.page_counters(found, TAXONOMY)


def crawl_resolve(spark, sf):
    crawled = pages(spark, sf)
    kind = F.col("ord") % 8
    primary = crawled.select(
        "ord",
        "url",
        F.when(kind == 0, 403).when(kind == 1, 401).when(kind == 2, 429).when(kind > 4, 200).alias("status"),
        F.when(kind == 4, "Navigation Timeout exceeded")
        .when(kind == 5, "Execution context was destroyed")
        .when(kind == 6, "socket closed")
        .alias("message"),
        F.when(kind == 7, F.col("html")).alias("html"),
    )
    lost = F.col("ord") % 5 == 0
    fallback = crawled.select(
        "ord",
        F.when(lost, 404).otherwise(200).alias("status"),
        F.lit(None).cast("string").alias("message"),
        F.when(~lost, F.col("html")).alias("html"),
    )
    return crawl.resolve_crawl(primary, fallback).select(
        "ord", "url", F.length("html").cast("bigint").alias("html_chars"), "attempt", "error"
    )


def page_text(spark, sf):
    texts = content.extract_text(pages(spark, sf), BASE)
    return content.gate_content(texts, BASE).select("ord", "url", "place", "n_chars", "error", "text")


def page_text_encodings(spark, sf):
    """The pages as bytes of six kinds: declared or not, with byte order marks that outdo a declaration, or plain."""
    kind = F.col("ord") % 6
    undeclared = F.regexp_replace("html", '<meta charset="utf-8">', "")
    latin = F.regexp_replace("html", 'charset="utf-8"', "charset=Latin1")
    content_bytes = (
        F.when(kind == 0, F.encode("html", "UTF-8"))
        .when(kind == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("html", "UTF-16LE")))
        .when(kind == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode("html", "UTF-16BE")))
        .when(kind == 3, F.encode(latin, "ISO-8859-1"))
        .when(kind == 4, F.encode(undeclared, "ISO-8859-1"))
        .otherwise(F.encode(undeclared, "UTF-8"))
    )
    read = pages(spark, sf).select("ord", "url", decoded(content_bytes).alias("html"))
    texts = content.extract_text(read, BASE)
    return content.gate_content(texts, BASE).select("ord", "url", "place", "n_chars", "error", "text")


def page_failures(spark, sf):
    """A fifth of the pages hold a character reference of more digits than the parser reads."""
    digits = F.concat(F.lit("<article>&#"), F.repeat(F.lit("9"), 5000), F.lit(";"))
    broken = F.when(F.col("ord") % 5 == 0, F.regexp_replace("html", "<article>", digits)).otherwise(F.col("html"))
    read = pages(spark, sf).withColumn("html", broken)
    found = kw.analyze_pages(content.extract_text(read, BASE), params=BASE)
    reason = F.substring_index("error", " (", 1)
    return found.select("ord", "url", "place", "n_chars", reason.alias("error"), F.size("keywords").alias("n_keywords"))


def page_keywords(spark, sf):
    return kw.extract_keywords(content.extract_text(pages(spark, sf), BASE), params=BASE)


def prompt_blocks(spark, sf):
    return prompts.page_blocks(stored_analysis(spark, sf), TAXONOMY, [], BASE)


def gap_prompt(spark, sf):
    return prompts.gap_prompts(prompt_blocks(spark, sf), params=BASE)


def gap_prompt_by_lang(spark, sf):
    small = replace(BASE, pages_per_prompt=100)
    blocks = prompts.page_blocks(stored_analysis(spark, sf), TAXONOMY, ["lang"], small)
    return prompts.gap_prompts(blocks, ["lang"], params=small)


def gap_prompt_by_size(spark, sf):
    small = replace(BASE, prompt_chars=20_000, pages_per_prompt=50)
    blocks = prompts.page_blocks(stored_analysis(spark, sf), TAXONOMY, ["lang"], small)
    return prompts.gap_prompts(blocks, ["lang"], params=small)


def model_responses(spark, sf):
    """Answers of every shape, made from the documents' own columns."""
    kind = F.col("ord") % 7
    word = F.concat_ws(" ", "lang", F.col("ord").cast("string"))
    items = F.concat(F.lit('["'), word, F.lit(' a", "'), word, F.lit(' b"]'))
    full = F.concat(
        F.lit('{"commonly_used_keywords": '), items,
        F.lit(', "underutilized_opportunities": '), items,
        F.lit(', "long_tail_opportunities": ["'), F.col("url"),
        F.lit('"], "semantic_keywords": [], "ranking_recommendations": '), items, F.lit("}"),
    )
    partial = F.concat(F.lit('{"semantic_keywords": '), items, F.lit("}"))
    return documents(spark, sf).select(
        F.col("ord").alias("group_id"),
        F.when(kind == 0, full)
        .when(kind == 1, F.concat(F.lit("\n\t ```json\n"), full, F.lit("\n```\n")))
        .when(kind == 2, F.concat(F.lit("```\n"), partial, F.lit("\n```  ")))
        .when(kind == 3, F.concat(F.lit("Here it is: "), full))
        .alias("response_text"),
        F.when(kind == 4, "429 Too Many Requests")
        .when(kind == 5, "Quota used up")
        .when(kind == 6, "connection reset")
        .alias("error_message"),
    )


def parse_responses(spark, sf):
    parsed = prompts.parse_gap_responses(model_responses(spark, sf))
    return prompts.response_items(parsed)


def response_errors(spark, sf):
    return prompts.parse_gap_responses(model_responses(spark, sf)).select("group_id", "error")


def gap_common(spark, sf):
    return gap.gap_common(*_totals_stats(stored_analysis(spark, sf), BASE), (), BASE)


def gap_underutilized(spark, sf):
    return gap.gap_underutilized(*_totals_stats(stored_analysis(spark, sf), BASE), (), BASE)


def gap_underutilized_by_lang(spark, sf):
    found = stored_analysis(spark, sf)
    return gap.gap_underutilized(*_totals_stats(found, BASE, ["lang"]), ["lang"], BASE)


def gap_long_tail(spark, sf):
    return gap.gap_long_tail(*_totals_stats(stored_analysis(spark, sf), BASE), (), BASE)


def _gap_inputs(spark, sf, group=()):
    found = stored_analysis(spark, sf)
    totals, stats = _totals_stats(found, BASE, group)
    return found, materialize(totals, "totals"), stats


def gap_semantic(spark, sf):
    return gap.gap_semantic(*_gap_inputs(spark, sf), (), BASE)


def gap_semantic_by_lang(spark, sf):
    return gap.gap_semantic(*_gap_inputs(spark, sf, ["lang"]), ["lang"], BASE)


def gap_missing(spark, sf):
    return gap.gap_missing(*_gap_inputs(spark, sf))


def gap_recommendations(spark, sf):
    return gap.gap_recommendations(*_totals_stats(stored_analysis(spark, sf), BASE), (), BASE)


def gap_report(spark, sf):
    report = reports.gap_report(gap.keyword_gap(*_gap_inputs(spark, sf), (), BASE))
    return report.select(*[F.to_json(c).alias(c) for c in report.columns])


def url_report(spark, sf):
    report = reports.url_report(analysis(spark, sf), TAXONOMY)
    maps = ["keyword_frequency_map", "topic_clusters"]
    return report.select("ord", "url", *[F.to_json(c).alias(c) for c in maps])


def common_report(spark, sf):
    report = reports.common_report(*_totals_stats(stored_analysis(spark, sf), LOW_RATIO))
    return report.select(F.to_json("common_keywords").alias("common_keywords"))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        content_gate, tokens_filtered, word_scores, ngram_counts, keywords_top50, keywords_lexicon,
        page_counters, keyword_totals, common_keywords, common_by_lang, keyword_topics, page_topics,
        merged_topics, merged_topics_by_lang, run_stats, run_stats_by_lang, url_filter, first_urls,
        url_lookup, url_list_counters, crawl_resolve, page_text, page_keywords, prompt_blocks, gap_prompt,
        gap_prompt_by_lang, parse_responses, response_errors, gap_common, gap_underutilized,
        gap_underutilized_by_lang, gap_long_tail, gap_semantic, gap_semantic_by_lang, gap_missing,
        gap_report, url_report, common_report, gap_recommendations, url_filter_mixed, content_gate_odd,
        keywords_odd, keywords_by_rows, keywords_by_chunks, keywords_large_lexicon, keyword_topics_by_table,
        keyword_topics_by_words, page_text_odd, page_text_encodings, page_failures, gap_prompt_by_size,
    )
}

