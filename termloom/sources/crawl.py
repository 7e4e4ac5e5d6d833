"""Crawl logs: what each attempt brought, and which attempt to use.

An attempt is a row ``(ord, url, status, message, html)``; ``ord`` is unique per attempt table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The statuses that count as blocked, those (and the messages) a second attempt may
# mend, and the texts of the errors.
BLOCKED_STATUSES = (401, 403, 429)
RETRY_STATUSES = (401, 403)
RETRY_MESSAGES = ("Execution context was destroyed", "navigation")
TIMEOUT_ERROR = "Timeout fetching "
NO_RESPONSE_ERROR = "No response received for "
FIRST_FAILED_ERROR = "Puppeteer failed for "
BOTH_FAILED_ERROR = "Both Puppeteer and axios failed for "
STATUS_ERROR = "Request failed with status code "


def attempt_error(status: Column, message: Column, url: Column) -> Column:
    """NULL for a good attempt, else its error text."""
    return (
        F.when(F.lower(message).contains("timeout"), F.concat(F.lit(TIMEOUT_ERROR), url))
        .when(
            status.isin(*BLOCKED_STATUSES),
            F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" for "), url),
        )
        .when(message.isNotNull(), F.concat(F.lit(FIRST_FAILED_ERROR), url, F.lit(": "), message))
        .when(status.isNull(), F.concat(F.lit(NO_RESPONSE_ERROR), url))
    )


def may_retry(status: Column, message: Column) -> Column:
    """Blocked or lost by navigation. A timeout or status 429 keeps its first error."""
    lost = F.lit(False)
    for part in RETRY_MESSAGES:
        lost = lost | F.coalesce(message.contains(part), F.lit(False))
    timeout = F.coalesce(F.lower(message).contains("timeout"), F.lit(False))
    return (F.coalesce(status.isin(*RETRY_STATUSES), F.lit(False)) | lost) & ~timeout


def resolve_crawl(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """``(ord, url, html, attempt, error)``: the attempt to use for every page.

    Only pages that a second attempt may mend meet it in a join, without the first attempt's HTML; the
    others stay where they were scanned.
    """
    first = primary.select(
        "ord",
        "url",
        "html",
        attempt_error(F.col("status"), F.col("message"), F.col("url")).alias("_error"),
        may_retry(F.col("status"), F.col("message")).alias("_retry"),
    )
    second = fallback.select(
        "ord",
        F.col("html").alias("_html2"),
        F.coalesce(
            "message",
            F.when(
                ~F.col("status").between(200, 299),
                F.concat(F.lit(STATUS_ERROR), F.col("status").cast("string")),
            ),
            F.when(F.col("status").isNull(), F.lit("no response")),
        ).alias("_error2"),
        F.lit(True).alias("_tried"),
    )
    retry = F.col("_error").isNotNull() & F.col("_retry")
    good = F.col("_error").isNull()
    settled = first.where(~retry).select(
        "ord",
        "url",
        F.when(good, F.col("html")).alias("html"),
        F.when(good, "primary").alias("attempt"),
        F.col("_error").alias("error"),
    )
    mended = F.col("_tried").isNotNull() & F.col("_error2").isNull()
    both = F.concat(
        F.lit(BOTH_FAILED_ERROR),
        F.col("url"),
        F.lit(": "),
        F.coalesce("_error2", F.lit("no response")),
    )
    tried = first.where(retry).select("ord", "url").join(second, "ord", "left").select(
        "ord",
        "url",
        F.when(mended, F.col("_html2")).alias("html"),
        F.when(mended, "fallback").alias("attempt"),
        F.when(~mended, both).alias("error"),
    )
    return settled.unionByName(tried)
