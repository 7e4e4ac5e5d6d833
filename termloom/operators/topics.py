"""Topics: a keyword belongs to the first topic that has a seed inside it."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.joins import join_on, join_to_groups
from termloom.functions.ranking import number_slices, sort_into_slices
from termloom.functions.text import let
from termloom.operators.keywords import keywords
from termloom.storage import materialize
from termloom.vocab import FALLBACK_TOPIC, TOPIC_SEEDS

@dataclass(frozen=True)
class Taxonomy:
    """Topics in priority order with their seeds, and the topic of all other keywords.

    ``match`` is "substring" (a seed anywhere in the keyword) or "word" (a seed as whole words of it). The
    taxonomy is a list of the caller's and travels inside the plan; one too long for that is a table,
    for ``assign_topics_by_table``.
    """

    topics: tuple[tuple[str, tuple[str, ...]], ...]
    fallback: str = FALLBACK_TOPIC
    match: str = "substring"

    def __post_init__(self) -> None:
        if self.match not in ("substring", "word"):
            raise ValueError("match is 'substring' or 'word'")

    @classmethod
    def of(
        cls, seeds: Mapping[str, Iterable[str]], fallback: str = FALLBACK_TOPIC, match: str = "substring"
    ) -> Taxonomy:
        return cls(tuple((topic, tuple(words)) for topic, words in seeds.items()), fallback, match)

    @classmethod
    def from_rows(cls, rows: Iterable[tuple[int, str, str]]) -> Taxonomy:
        """From ``(topic_order, topic, seed)`` rows, such as a small table collected by the caller."""
        seeds: dict[str, list[str]] = {}
        for _, topic, seed in sorted(rows, key=lambda row: row[0]):
            seeds.setdefault(topic, []).append(seed)
        return cls.of(seeds)

    @property
    def names(self) -> list[str]:
        return [topic for topic, _ in self.topics] + [self.fallback]

    def order_of(self, keyword: Column) -> Column:
        """1, 2, … in priority order; the fallback topic comes last. One search per topic."""
        around = "(?:^| )(?:{})(?:$| )" if self.match == "word" else "{}"
        found = [
            F.when(F.lower(keyword).rlike(around.format("|".join(re.escape(s) for s in seeds))), place)
            for place, (_, seeds) in enumerate(self.topics, 1)
            if seeds
        ]
        return F.coalesce(*found, F.lit(len(self.topics) + 1))

    def name_of(self, order: Column) -> Column:
        return F.element_at(F.array(*[F.lit(name) for name in self.names]), order)


DEFAULT_TAXONOMY = Taxonomy.of(TOPIC_SEEDS)


def assign_topics(keyword_rows: DataFrame, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Add ``topic_order`` and ``topic`` to keyword rows. A projection: no join, no exchange."""
    return keyword_rows.withColumn("topic_order", taxonomy.order_of(F.col("keyword"))).withColumn(
        "topic", taxonomy.name_of(F.col("topic_order"))
    )


def _substrings(keyword: Column, lengths: Column) -> Column:
    """Every part of the keyword that has one of the lengths."""
    fitting = F.filter(lengths, lambda n: n <= F.length(keyword))
    parts = F.transform(
        fitting,
        lambda n: F.transform(F.sequence(F.lit(1), F.length(keyword) - n + 1), lambda i: F.substring(keyword, i, n)),
    )
    return F.flatten(parts)


def _word_runs(keyword: Column, lengths: Column) -> Column:
    """Every run of whole words of the keyword that has one of the lengths, in words."""
    return let(
        F.split(keyword, " "),
        lambda words: F.flatten(
            F.transform(
                F.filter(lengths, lambda n: n <= F.size(words)),
                lambda n: F.transform(
                    F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")
                ),
            )
        ),
    )


def assign_topics_by_table(
    keyword_rows: DataFrame, seeds: DataFrame, fallback: str = FALLBACK_TOPIC, match: str = "substring"
) -> DataFrame:
    """``assign_topics`` with a table ``seeds(topic_order, topic, seed)`` of any size.

    Distinct keywords, which are short, are cut into parts that meet the seeds in one equi-join; the first
    topic in order is kept. Only parts as long as some seed are made: substrings by their characters, or
    for ``match="word"`` runs of whole words by their words. Null seeds match nothing. Both tables are read
    several times and may be the end of a long job, so they are stored first.
    """
    if match not in ("substring", "word"):
        raise ValueError("match is 'substring' or 'word'")
    keyword_rows = materialize(keyword_rows, "keywords")
    seeds = materialize(seeds.select("topic_order", "topic", "seed"), "seeds")
    cut, length = (_substrings, F.length("seed")) if match == "substring" else (_word_runs, F.size(F.split("seed", " ")))
    lengths = seeds.where(F.col("seed").isNotNull()).agg(F.collect_set(length)).scalar()
    names = keyword_rows.select("keyword").where(F.col("keyword").isNotNull()).distinct()
    lower = names.select("keyword", F.lower("keyword").alias("_lower"), lengths.alias("_lengths"))
    parts = lower.select(
        "keyword", F.explode(F.array_distinct(cut(F.col("_lower"), F.col("_lengths")))).alias("seed")
    )
    first = (
        parts.join(seeds, "seed")
        .groupBy("keyword")
        .agg(F.min(F.struct("topic_order", "topic")).alias("_first"))
    )
    last = F.coalesce(seeds.agg(F.max("topic_order")).scalar(), F.lit(0)) + 1
    return keyword_rows.join(first, "keyword", "left").select(
        *keyword_rows.columns,
        F.coalesce("_first.topic_order", last).cast("int").alias("topic_order"),
        F.coalesce("_first.topic", F.lit(fallback)).alias("topic"),
    )


def keyword_topics(analysis: DataFrame, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """``(ord, url, keyword, topic_order, topic, rank)``."""
    return assign_topics(keywords(analysis), taxonomy).select(
        "ord", "url", "keyword", "topic_order", "topic", "rank"
    )


def page_topics(found: Column, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> Column:
    """array<struct<topic, keywords>> of one page, in topic order, without empty topics."""
    placed = F.transform(
        found,
        lambda k: F.struct(taxonomy.order_of(k["keyword"]).alias("o"), k["keyword"].alias("keyword")),
    )
    orders = F.array(*[F.lit(i) for i in range(1, len(taxonomy.names) + 1)])

    def of_topic(pairs: Column, order: Column) -> Column:
        mine = F.filter(pairs, lambda p: p["o"] == order)
        return F.struct(
            taxonomy.name_of(order).alias("topic"),
            F.transform(mine, lambda p: p["keyword"]).alias("keywords"),
        )

    one_row = F.transform(
        F.array(placed), lambda pairs: F.transform(orders, lambda order: of_topic(pairs, order))
    )
    return F.filter(F.element_at(one_row, 1), lambda t: F.size(t["keywords"]) > 0)


def topic_names(found: Column, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> Column:
    """array<string>: the topics of ``page_topics`` alone, for which no keywords are listed."""
    orders = F.transform(found, lambda k: taxonomy.order_of(k["keyword"]))
    some = F.coalesce(F.array_distinct(orders), F.array().cast("array<int>"))
    return F.transform(F.array_sort(some), taxonomy.name_of)


def merged_topics(
    totals: DataFrame,
    taxonomy: Taxonomy = DEFAULT_TAXONOMY,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """``(…group, topic, topic_rank, keyword, total, rank)``: the keywords of ``keyword_totals`` by topic.

    Topics are ordered by the first page that has them, keywords by total score, then by where they
    were first seen. A single word is left out where a phrase of the same topic contains it.

    A topic depends on the keyword alone, so distinct keywords are classified. Each phrase also emits
    its words as markers, and one grouping spots the fragments without a join.
    """
    group = list(group_cols)
    tagged = assign_topics(totals, taxonomy)
    real = F.struct(F.col("keyword").alias("term"), F.lit(False).alias("inside"))
    markers = F.transform(
        F.array_distinct(F.split("keyword", " ")),
        lambda w: F.struct(w.alias("term"), F.lit(True).alias("inside")),
    )
    entries = F.when(F.col("n") > 1, F.concat(F.array(real), markers)).otherwise(F.array(real))
    own = ["total", "first_ord", "first_rank"]
    emitted = tagged.select(*group, *own, "topic_order", F.explode(entries).alias("m"))
    merged = (
        emitted.groupBy(*group, "topic_order", F.col("m.term").alias("keyword"))
        .agg(
            # A keyword has one row that is no marker, so this is the value of that row.
            *[F.max(F.when(~F.col("m.inside"), F.col(name))).alias(name) for name in own],
            F.max("m.inside").alias("fragment"),
        )
        .where(F.col("total").isNotNull())
    )
    # Fragments sort behind the other keywords of their topic, so dropping them leaves no gaps. They
    # stay until the topics are ordered: a topic may first occur with a fragment.
    order = [F.col("fragment").asc(), F.desc("total"), F.asc("first_ord"), F.asc("first_rank")]
    keys = [*group, "topic_order"]
    sliced = sort_into_slices(merged, keys, order)
    by_first_page = Window.partitionBy(*group).orderBy("first_ord", "topic_order")
    topics = (
        sliced.groupBy(*keys)
        .agg(F.min("first_ord").alias("first_ord"))
        .select(*keys, F.row_number().over(by_first_page).alias("topic_rank"))
    )
    ranked = number_slices(sliced, keys, order, "rank").where(~F.col("fragment"))
    if group:
        placed = join_to_groups(ranked, topics, keys)
    else:
        placed = join_on(ranked, F.broadcast(topics), keys)  # one row per topic of the taxonomy
    return placed.select(
        *group,
        taxonomy.name_of(F.col("topic_order")).alias("topic"),
        "topic_rank",
        "keyword",
        "total",
        "rank",
    )
