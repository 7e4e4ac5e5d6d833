"""From HTML to gated plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.html import main_text_column
from termloom.functions.text import collapse_white_space
from termloom.params import DEFAULT_PARAMS, Params
from termloom.vocab import INSUFFICIENT_CONTENT


def succeeded(error: Column | None = None) -> Column:
    """True for pages without an error; the empty text counts as none."""
    return F.coalesce(F.col("error") if error is None else error, F.lit("")) == ""


def extract_text(pages: DataFrame, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Replace ``html`` by ``text``, ``place`` (where the text came from) and ``error``.

    A page whose fetch already failed keeps its error and is not parsed. ``html_chars`` is kept so
    that later steps can route huge pages without running the parser again.
    """
    carried = [c for c in pages.columns if c not in ("html", "error")]
    html, before = F.col("html"), F.lit(None).cast("string")
    if "error" in pages.columns:
        before = F.col("error")
        html = F.when(succeeded(), html)
    parsed = pages.select(
        *carried,
        before.alias("_before"),
        F.length(html).alias("html_chars"),
        main_text_column(html, params.min_main_chars).alias("_page"),
    )
    return parsed.select(
        *carried,
        "html_chars",
        collapse_white_space(F.col("_page.text")).alias("text"),
        F.col("_page.place").alias("place"),
        F.when(~succeeded(F.col("_before")), F.col("_before"))
        .otherwise(F.col("_page.error"))
        .alias("error"),
    )


def gate_content(texts: DataFrame, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Add ``n_chars`` and set ``error`` on pages with too little text. Lengths are code points."""
    known = F.col("error") if "error" in texts.columns else F.lit(None).cast("string")
    n_chars = F.coalesce(F.length("text"), F.lit(0))
    short = F.when(n_chars < params.min_content_chars, F.lit(INSUFFICIENT_CONTENT))
    return texts.withColumns(
        {
            "n_chars": n_chars.cast("bigint"),
            "error": F.when(~succeeded(known), known).otherwise(short),
        }
    )
