"""Exact token counts: a histogram of encoded lengths answers every question on context limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.bpe import Tokenizer
from termloom.llm.running import with_running_sums
from termloom.storage import materialize


def token_lengths(docs: DataFrame, path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of each text; null and empty texts have none. A column called ``name`` is replaced."""
    ids = Tokenizer(docs.sparkSession, path).encode(F.col(text))
    return docs.withColumn(name, F.size(ids).cast("bigint"))


def length_histogram(lengths: DataFrame, name: str = "n_tokens") -> DataFrame:
    """One row per length that occurs; for a context limit of that many tokens it tells

    ``n_docs`` documents of just this length, ``docs_within`` and ``tokens_within`` of those no longer,
    ``docs_over`` that are longer, ``tokens_cut`` that remain if all are truncated to the limit,
    ``tokens_lost`` by it, and ``share_within``, so that a length is the quantile of its share.
    Any limit between two lengths is answered by the row of the lower one (``limit_answer``).
    Repeated rows count each; a null length is no document. An empty table gives no rows.
    """
    per_length = materialize(
        lengths.where(F.col(name).isNotNull())
        .groupBy(F.col(name).alias("length"))
        .agg(F.count(F.lit(1)).alias("n_docs"))
        .withColumn("n_tokens", F.col("length") * F.col("n_docs")),
        "lengths",
    )
    above = with_running_sums(
        per_length, [], [F.col("length").desc()], {"docs_over": "n_docs", "tokens_over": "n_tokens"}
    )
    totals = per_length.agg(F.sum("n_docs").alias("all_docs"), F.sum("n_tokens").alias("all_tokens"))
    joined = above.crossJoin(F.broadcast(totals))
    within = F.col("all_tokens") - F.col("tokens_over")
    cut = within + F.col("docs_over") * F.col("length")
    return joined.select(
        "length",
        "n_docs",
        (F.col("all_docs") - F.col("docs_over")).alias("docs_within"),
        within.alias("tokens_within"),
        "docs_over",
        cut.alias("tokens_cut"),
        (F.col("all_tokens") - cut).alias("tokens_lost"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("share_within"),
    )


def limit_answer(histogram: DataFrame, limit: int) -> DataFrame:
    """One row for any context limit: documents within it, over it, and tokens after truncation.

    The suffix sums of the greatest length within the limit hold the answer; below all lengths, nothing is within.
    """
    fitting = F.when(F.col("length") <= limit, F.col("length"))
    row = F.max_by(F.struct("docs_within", "docs_over", "tokens_within"), fitting)
    found = histogram.agg(row.alias("row"), F.max(F.col("docs_within") + F.col("docs_over")).alias("docs"))
    zero = F.lit(0).cast("bigint")
    over = F.coalesce("row.docs_over", "docs", zero)
    return found.select(
        F.coalesce("row.docs_within", zero).alias("docs_within"),
        over.alias("docs_over"),
        (F.coalesce("row.tokens_within", zero) + over * limit).alias("tokens_cut"),
    )


def quantile_length(histogram: DataFrame, share: float) -> DataFrame:
    """The smallest length within which at least ``share`` of the documents lie."""
    return histogram.where(F.col("share_within") >= share).agg(F.min("length").alias("length"))
