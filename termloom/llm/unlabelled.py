"""Toxicity from confirmed toxic examples and unlabelled text.

Nobody confirms that a text is harmless, so there are no negatives to learn from. The risk of a
classifier is written with the share of toxic texts (class prior) instead: what the unlabelled texts cost
as negatives, less what the toxic ones among them would. Where that difference falls below zero, which
no true risk can, the step goes the other way (non-negative positive-unlabelled learning). The model is
logistic over hashed words; risks and gradients are sums over partitions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.ragged import offsets
from termloom.llm.sums import sum_over_partitions
from termloom.storage import materialize

_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 18  # of the hashed words; a rare word that shares one changes little
    features: int = 4096  # buckets that the model weighs, those that tell most
    least_deviation: float = 3.0  # of a bucket's toxic texts from what the others lead one to expect
    sure_deviation: float = 30.0  # from which a bucket's weight is free to move
    stems: tuple[int, ...] = (4, 5, 6)  # bytes
    examples: int = 1 << 16  # confirmed toxic documents at most, those of the smallest hashes
    rounds: int = 40
    rate: float = 0.3
    ridge: float = 4e-4
    slack: float = 0.0  # how far the corrected risk may fall below zero
    prior: float | None = None  # share of toxic texts; None: that of the usable labels


@dataclass(frozen=True)
class Model:
    prior: float
    chosen: np.ndarray  # buckets; a text holds places in this array
    weights: np.ndarray
    bias: float

    def score(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of toxic for texts whose places lie one after the other in ``flat``."""
        return 1 / (1 + np.exp(-(row_sums(self.weights[flat], lengths) + self.bias)))


def row_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(row, values, len(lengths))


def text_buckets(text: str | None, settings: Settings = Settings()) -> list[int]:
    """The distinct buckets of a text: its lower-case words, their stems, and stems of several words.

    An insult is inflected and compounded, so its first letters tell more than one form of it; a stem
    that several words of a text share is a mark of its own. Null and empty texts have none.
    """
    words = {w.encode() for w in _WORD.findall(text.lower())} if text else ()
    marks = list(words)
    for length in settings.stems:
        # A stem is so many bytes, of words that are longer; the mark's first byte tells lengths apart.
        counts = Counter([w[:length] for w in words if len(w) > length])
        marks += [b"\1" + stem for stem in counts]
        marks += [b"\2" + stem for stem, n in counts.items() if n > 1]
    return list({crc32(mark) % settings.buckets for mark in marks})


def toxic_labels(labels: DataFrame) -> DataFrame:
    """One ``toxic`` (boolean) per doc_id: what most of its labels say. Rows with a null are left out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    return known.groupBy("doc_id").agg((F.avg("toxic") > 0.5).alias("toxic"))


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat = np.asarray(column.flatten())
    return flat, np.asarray(column.value_lengths()).astype(np.int64)


def choose_buckets(
    toxic: np.ndarray, texts: np.ndarray, n_toxic: int, n_texts: int, settings: Settings
) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that toxic texts hold most unlike all texts, and how freely each may be weighed.

    Both go by the deviation of the count in toxic texts from the one to expect. A bucket that deviates
    little does so by chance perhaps: its weight moves in proportion.
    """
    expected = texts * (n_toxic / n_texts)
    deviation = np.abs(toxic - expected) / np.sqrt(expected + 0.25)
    best = np.argsort(-deviation, kind="stable")[: settings.features]
    chosen = np.sort(best[deviation[best] >= settings.least_deviation])
    return chosen, np.minimum(1.0, (deviation[chosen] / settings.sure_deviation) ** 2)


def risk_sums(flat: np.ndarray, lengths: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Three blocks of (loss, gradient, slope of the bias): toxic as toxic, toxic as clean, all as clean.

    ``weights`` ends with the bias; the loss is logistic.
    """
    margin = row_sums(weights[flat], lengths) + weights[-1]
    chance = 1 / (1 + np.exp(-margin))
    as_toxic, as_clean = np.logaddexp(0, -margin), np.logaddexp(0, margin)
    out = []
    for use, loss, slope in ((toxic, as_toxic, chance - 1), (toxic, as_clean, chance), (None, as_clean, chance)):
        w = slope if use is None else slope * use
        gradient = np.bincount(flat, np.repeat(w, lengths), len(weights) - 1)
        out.append(np.r_[(loss if use is None else loss * use).sum(), gradient, w.sum()])
    return np.concatenate(out)


def risk_gradient(sums: np.ndarray, n_toxic: int, n_texts: int, prior: float, slack: float) -> np.ndarray:
    """Gradient of the non-negative risk, from the sums of ``risk_sums`` over all rows."""
    plus, minus, everything = sums.reshape(3, -1)
    found = prior * plus / n_toxic
    clean = everything / n_texts - prior * minus / n_toxic
    # Below zero the classifier only fits the sample: climb back on that part alone.
    return (found + clean if clean[0] >= -slack else -clean)[1:]


def descend(start: np.ndarray, freedom: np.ndarray, gradient_at, settings: Settings) -> np.ndarray:
    """Steps of a rate that adapts to each weight (Adam), on weights in units of their freedom."""
    units = np.r_[freedom, 1.0]
    inside = start / units
    mean, square = np.zeros_like(start), np.zeros_like(start)
    for k in range(1, settings.rounds + 1):
        gradient = gradient_at(inside * units) * units + np.r_[inside[:-1], 0.0] * settings.ridge
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        scale = np.sqrt(square / (1 - 0.99**k)) + 1e-8
        inside = inside - settings.rate * (mean / (1 - 0.9**k)) / scale
    return inside * units


def _bucket_counts(docs: DataFrame, settings: Settings) -> np.ndarray | None:
    """Toxic texts and all texts per bucket, then the numbers of both kinds of texts."""
    size = settings.buckets

    def counts(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(2 * size + 2, dtype=np.int64)
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"].to_pylist()):
                at = np.array(text_buckets(text.as_py(), settings), dtype=np.int64)
                total[size + at] += 1
                total[at] += toxic
                total[-2:] += toxic, 1
        return total

    return sum_over_partitions(docs.select("text", "toxic"), counts, np.int64)


def _chosen_rows(docs: DataFrame, place: np.ndarray, settings: Settings) -> DataFrame:
    """Stored rows (doc_id, toxic, words): of each text the places of its chosen buckets."""

    @F.arrow_udf("array<int>")
    def chosen(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts:
            at = place[np.array(text_buckets(text.as_py(), settings), dtype=np.int64)]
            rows.append(at[at >= 0])
        ends = pa.array(offsets(np.array([len(r) for r in rows], dtype=np.int64)), pa.int32())
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32()))

    return materialize(docs.select("doc_id", "toxic", chosen.asNondeterministic()("text").alias("words")), "chosen")


def fit(marked: DataFrame, prior: float, settings: Settings = Settings()) -> tuple[Model | None, DataFrame | None]:
    """Fit on ``marked`` (doc_id, text, toxic: confirmed); every row counts as unlabelled text.

    Texts are read twice: to count buckets, and for the chosen ones, which are stored; those few are read
    once a round. The second result is that table, by which the rows are scored. Neither is there
    without a toxic row.
    """
    total = _bucket_counts(marked, settings)
    if total is None or not total[-2]:
        return None, None
    size, (n_toxic, n_texts) = settings.buckets, map(int, total[-2:])
    chosen, freedom = choose_buckets(total[:size], total[size : 2 * size], n_toxic, n_texts, settings)
    place = np.full(size, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    few = _chosen_rows(marked, place, settings)

    def gradient_at(weights: np.ndarray) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            sums = np.zeros(3 * (len(weights) + 1))
            for batch in batches:
                flat, lengths = _ragged(batch["words"])
                sums += risk_sums(flat, lengths, np.asarray(batch["toxic"].cast(pa.int64())), weights)
            return sums

        sums = sum_over_partitions(few.select("words", "toxic"), partial)
        return risk_gradient(sums, n_toxic, n_texts, prior, settings.slack)

    start = np.zeros(len(chosen) + 1)
    start[-1] = np.log(prior / (1 - prior))
    weights = descend(start, freedom, gradient_at, settings)
    return Model(prior, chosen, weights[:-1], float(weights[-1])), few


def score_column(model: Model | None, words: Column) -> Column:
    """Probability of toxic from the places of chosen buckets; without a model every row scores 0."""
    if model is None:
        return F.lit(0.0)

    @F.arrow_udf("double")
    def score(rows: pa.Array) -> pa.Array:
        return pa.array(model.score(*_ragged(rows)))

    return score(words)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, use: Column | None = None, settings: Settings = Settings()
) -> tuple[Model | None, DataFrame]:
    """(model, table of doc_id and ``words``, the model's view of each row of ``docs``).

    Every row is unlabelled text; ``use`` selects the rows (by their doc_id) whose labels may be learned.
    Of those, the toxic ones are the confirmed examples (a sample of ``settings.examples`` if there are
    more), and their share is the class prior unless ``settings`` has one. The model reads text only;
    null and empty texts have no words and score by the bias. Repeated rows count as often as they
    occur; a null doc_id matches no label; contradicting labels count by their majority. Without a
    toxic label there is no model (None) and ``words`` is null. Texts of any length are read whole.
    Other columns are not read.
    """
    allowed = F.lit(True) if use is None else F.coalesce(use, F.lit(False))
    ids = docs.select("doc_id").where(allowed).distinct()
    usable = materialize(toxic_labels(labels).join(ids, "doc_id"), "toxic-labels")
    share = settings.prior or usable.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    known = usable.where("toxic").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.examples)
    rows = docs.select("doc_id", "text")
    # As many ids as settings.examples at most: small enough to send to every task.
    marked = rows.join(F.broadcast(known.withColumn("_toxic", F.lit(True))), "doc_id", "left").select(
        "doc_id", "text", F.coalesce("_toxic", F.lit(False)).alias("toxic")
    )
    model, few = fit(marked, min(max(share, 1e-6), 0.99), settings) if share else (None, None)
    if model is None:
        return None, rows.select("doc_id", F.lit(None).cast("array<int>").alias("words"))
    return model, few.select("doc_id", "words")
