"""Prompts for a language model, one table row each, and the parsing of its answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.joins import join_to_groups
from termloom.functions.ranking import number_slices, sort_into_slices, with_rank
from termloom.functions.text import WHITE_SPACE
from termloom.operators.content import succeeded
from termloom.operators.topics import DEFAULT_TAXONOMY, Taxonomy, topic_names
from termloom.params import DEFAULT_PARAMS, Params
from termloom.vocab import GAP_SECTIONS

DEFAULT_DOMAIN = "immigration"

# What each section of an answer should hold; ``{domain}`` is filled in.
SECTION_NOTES = (
    "keywords that most of these pages compete on",
    "{domain} keywords that these pages hardly use",
    "longer {domain} phrases that few pages target",
    "{domain} terms that support the topic",
    "steps that would help a new page rank above these",
)

DEFAULT_TEMPLATE = """You plan search content about {domain}.
The pages below rank well for one {domain} query. Each is listed with its strongest keywords and topics.

{pages}

Compare the pages as a whole, then answer with one JSON object and nothing else. It has these keys,
each an array of 8 to 15 short texts:
{sections}"""


def number_pages(
    analysis: DataFrame, group_cols: Sequence[str] = ()
) -> DataFrame:
    """``(…group, ord, page_no)``: the successful pages of each group, counted from 1."""
    good = analysis.where(succeeded()).select(*group_cols, "ord")
    return with_rank(good, list(group_cols), [F.asc("ord")], "page_no", "bigint")


def page_blocks(
    analysis: DataFrame,
    taxonomy: Taxonomy = DEFAULT_TAXONOMY,
    group_cols: Sequence[str] = (),
    params: Params = DEFAULT_PARAMS,
) -> DataFrame:
    """``(…group, ord, page_no, block)``: each page as a prompt shows it.

    Only the narrow page keys are sorted to number the pages; the texts are joined to them.
    """
    numbers = number_pages(analysis, group_cols).select("ord", "page_no")
    names = F.transform(
        F.slice("keywords", 1, params.prompt_keywords), lambda k: k["keyword"]
    )
    # Fixed format: three lines per page.
    tail = F.concat(
        F.lit(": "),
        "url",
        F.lit("\nTop Keywords: "),
        F.array_join(names, ", "),
        F.lit("\nTopics: "),
        F.array_join(topic_names(F.col("keywords"), taxonomy), ", "),
    )
    texts = analysis.where(succeeded()).select(*group_cols, "ord", tail.alias("_tail"))
    return texts.join(numbers, "ord").select(
        *group_cols,
        "ord",
        "page_no",
        F.concat(F.lit("URL "), F.col("page_no").cast("string"), F.col("_tail")).alias("block"),
    )


def prompt_parts(template: str, domain: str) -> tuple[str, str]:
    """The text before and after the pages."""
    if template.count("{pages}") != 1:
        raise ValueError("the template needs {pages} exactly once")
    sections = "\n".join(
        f"- {name}: {note.format(domain=domain)}" for name, note in zip(GAP_SECTIONS, SECTION_NOTES)
    )
    before, after = (
        part.replace("{domain}", domain).replace("{sections}", sections)
        for part in template.split("{pages}")
    )
    return before, after


def gap_prompts(
    blocks: DataFrame,
    group_cols: Sequence[str] = (),
    template: str = DEFAULT_TEMPLATE,
    domain: str = DEFAULT_DOMAIN,
    params: Params = DEFAULT_PARAMS,
) -> DataFrame:
    """``(…group, prompt_no, n_pages, prompt)``.

    A group gets one prompt, or several if it has more than ``pages_per_prompt`` pages or
    ``prompt_chars`` characters: every page is in exactly one, in page order, and no row grows with the group.
    """
    before, after = prompt_parts(template, domain)
    by_pages = F.floor((F.col("page_no") - 1) / params.pages_per_prompt) + 1
    numbered = blocks.withColumn("prompt_no", by_pages.cast("bigint"))
    cut = ["prompt_no"]
    if params.prompt_chars is not None:
        numbered = _cut_by_size(numbered, group_cols, params.prompt_chars)
        cut.append("_stretch")
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "block")))
    packed = numbered.groupBy(*group_cols, *cut).agg(ordered.alias("b"))
    if params.prompt_chars is not None:
        order = [F.asc(name) for name in cut]
        packed = with_rank(packed, list(group_cols), order, "_number", "bigint").withColumn("prompt_no", F.col("_number"))
    return packed.select(
        *group_cols,
        "prompt_no",
        F.size("b").alias("n_pages"),
        F.concat(
            F.lit(before),
            F.array_join(F.transform("b", lambda b: b["block"]), BETWEEN),
            F.lit(after),
        ).alias("prompt"),
    )


BETWEEN = "\n\n"


def _cut_by_size(blocks: DataFrame, group_cols: Sequence[str], most: int) -> DataFrame:
    """Add ``_stretch``, non-decreasing in page order: pages of equal stretch have at most ``most`` characters.

    A running sum says where each page starts; pages that start within the same stretch go together. It is
    shorter than ``most`` by the longest page of its group, which may start at its very end, but half of
    ``most`` at least. A page longer than that half counts as whole stretches, so that it stays alone.
    """
    group = list(group_cols)
    half = max(most // 2, 1)
    length = F.length("block") + len(BETWEEN)
    sliced = sort_into_slices(blocks.withColumn("_chars", length.cast("bigint")), group, [F.asc("page_no")])
    longest = sliced.where(F.col("_chars") <= half).groupBy(*group).agg(F.max("_chars").alias("_longest"))
    sized = join_to_groups(sliced, longest, group) if group else sliced.withColumn("_longest", longest.scalar())
    room = F.greatest(F.lit(most) - F.coalesce("_longest", F.lit(half)), F.lit(1))
    is_long = F.col("_chars") > half
    # A long page starts and ends a stretch of its own.
    padded = sized.withColumn("_room", room).withColumns(
        {"_long": F.when(is_long, 1).otherwise(0), "_short": F.when(is_long, 0).otherwise(F.col("_chars"))}
    )
    starts = number_slices(padded, group, [F.asc("page_no")], "_at", "bigint", {"_before": "_short", "_longs": "_long"})
    stretch = F.struct(F.col("_longs"), F.col("_long"), F.floor(F.col("_before") / F.col("_room")))
    return starts.select(*blocks.columns, stretch.alias("_stretch"))


# Signs of an exhausted quota in an error message.
QUOTA_SIGNS = ("429", "quota", "Quota")


def strip_fences(text: Column) -> Column:
    """The answer without white space and Markdown code fences around it."""
    space = WHITE_SPACE.removesuffix("+") + "*"
    opened = rf"(?i)\A{space}(?:```json{space})?(?:```{space})?"
    closed = rf"{space}(?:```)?{space}\z"
    return F.regexp_replace(F.regexp_replace(text, opened, ""), closed, "")


def error_class(message: Column) -> Column:
    """``quota`` or ``error``; NULL without a message."""
    quota = F.lit(False)
    for sign in QUOTA_SIGNS:
        quota = quota | message.contains(sign)
    return F.when(quota, "quota").when(message.isNotNull(), "error")


def parse_gap_responses(responses: DataFrame, key: str = "group_id") -> DataFrame:
    """``responses(key, response_text, error_message)`` → key, ``error`` and one array per section.

    A failed call or an answer that is no JSON object gives five empty arrays and an error class;
    a missing section gives an empty array.
    """
    body = strip_fences(F.col("response_text"))
    schema = ", ".join(f"{name} array<string>" for name in GAP_SECTIONS)
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), F.lit(False))
    message = F.nullif(F.col("error_message"), F.lit(""))
    parsed = responses.select(
        key,
        F.coalesce(error_class(message), F.when(~is_object, "error")).alias("error"),
        F.from_json(body, schema).alias("_gap"),
    )
    empty = F.array().cast("array<string>")
    return parsed.select(
        key,
        "error",
        *[
            F.when(F.col("error").isNull(), F.coalesce(F.col(f"_gap.{name}"), empty))
            .otherwise(empty)
            .alias(name)
            for name in GAP_SECTIONS
        ],
    )


def response_items(parsed: DataFrame, key: str = "group_id") -> DataFrame:
    """The parsed sections as rows ``(key, section, rank, item)``."""
    sections = F.array(
        *[F.struct(F.lit(name).alias("section"), F.col(name).alias("items")) for name in GAP_SECTIONS]
    )
    return (
        parsed.select(key, F.explode(sections).alias("s"))
        .select(key, F.col("s.section").alias("section"), F.posexplode("s.items").alias("i", "item"))
        .select(key, "section", (F.col("i") + 1).alias("rank"), "item")
    )
