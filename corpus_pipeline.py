"""From raw documents to training tokens: five stages, each over all that the one before kept.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir), where docs has the columns of
the table documents, and returns such a table; the last returns tokens. ``run`` writes what a stage
returns to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions.membership import mark_possible_members
from termloom.llm import bpe, fourier, jaccard, mixing, pii
from termloom.llm.queries import VOCABULARY, remainder, table
from termloom.llm.words import WORD
from termloom.storage import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_QUALITY = 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose calibrated quality is under ``LEAST_QUALITY``.

    The model learns from the labels whose documents are still there, but for the held-out quarter.
    Without any label nothing can be judged, and all documents stay. Null, empty and very long texts are
    judged like others, by their statistics; rows alike get the same score, and a score at the limit stays.
    """
    model, _ = fourier.fit_quality(docs, table(spark, sf_dir, "labels"), remainder(4) != 2)
    if model is None:
        return docs.select(*COLUMNS)
    scored = docs.select(*COLUMNS, fourier.score_text(model, F.col("text")).alias("_score"))
    return scored.where(F.col("_score") >= LEAST_QUALITY).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents keep the one with the smallest doc_id, null last.

    Texts without words are in no group and stay. Rows are told apart by doc_id and text, so rows that
    share a doc_id, or have none, go only for what their own texts are. Of rows alike in both one stays.
    """
    keys = ["doc_id", "_text"]
    copies = jaccard.near_copies(docs).where(~F.col("first"))
    dropped = copies.select("doc_id", F.col("text_hash").alias("_text"))
    hashed = docs.select(*COLUMNS, F.xxhash64("text").alias("_text"))
    repeated = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    # Only rows that may be among these two are exchanged; the texts of all others stay where they are.
    # The filter has some sixteen bits for each copy, and is 16 MB at most.
    bits = min(27, max(18, dropped.count().bit_length() + 4))
    marked = mark_possible_members(hashed, dropped.union(repeated), keys, "_suspect", bits)
    gone = dropped.withColumnsRenamed({key: f"_gone{key}" for key in keys})
    match = F.col("doc_id").eqNullSafe(F.col("_gonedoc_id")) & (F.col("_text") == F.col("_gone_text"))
    kept = marked.where("_suspect").join(gone, match, "left_anti")
    wordless = F.when(~F.coalesce(F.col("text").rlike(WORD), F.lit(False)), F.monotonically_increasing_id())
    same = Window.partitionBy("doc_id", "_text", "_alone").orderBy("doc_id")
    numbered = kept.withColumn("_alone", wordless).withColumn("_nth", F.row_number().over(same))
    alone = marked.where("not _suspect").select(*COLUMNS)
    return alone.unionByName(numbered.where("_nth = 1").select(*COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets; ``n_chars`` follows. Null and empty texts stay as they are."""
    masked = pii.mask_personal_data(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, each time whole.

    A document is repeated for each pass of its source's stream. The last one of a source, of which the mix
    takes a part, is in once more if that part is half of it or more: a source is off its target by half
    a document at most. Texts without words, null and empty ones, are not taken. Documents are told apart
    by doc_id and text; rows alike in both share what is taken of them, rounded for each.
    """
    sized = docs.select(
        *COLUMNS, mixing.word_count(F.col("text")).alias("_size"), F.xxhash64("doc_id", "text").alias("_row")
    )
    rows = sized.select(F.col("_row").alias("doc_id"), "source", F.col("_size").alias("size"))
    mixed, _ = mixing.mix_documents(rows, size="size")
    part = F.sum("taken") / (F.count(F.lit(1)) * F.col("size"))
    taken = mixed.where("size > 0").groupBy("doc_id", "source", "size").agg(F.floor(part + 0.5).cast("int").alias("_times"))
    few = taken.where("_times > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_of"), "_times"
    )
    match = (F.col("_row") == F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_size") == F.col("_of"))
    joined = sized.join(few, match)
    return joined.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every row, repeated ones too, and whether they decode to its text.

    A null text counts as empty, which has no tokens; texts of any length are encoded whole.
    """
    both = bpe.round_trip(docs.select(*COLUMNS), VOCABULARY)
    return both.select(
        "doc_id",
        "lang",
        "source",
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        "token_ids",
        (F.col("decoded_text") == F.coalesce("text", F.lit(""))).alias("decodes"),
    )


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode),
]

# Models, hashing orders and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
