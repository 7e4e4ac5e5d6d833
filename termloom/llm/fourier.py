"""Quality classifier: random Fourier features of text statistics, ridge scores, isotonic calibration.

The cosine features approximate a Gaussian kernel, so a linear fit becomes a kernel machine. Its
normal equations are sums over rows: every partition adds up its own and the sums are added in a
tree. Calibration needs only counts per score bin.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log1p
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.sums import sum_over_partitions
from termloom.llm.words import lower_words
from termloom.storage import materialize

STATISTICS = (
    "words chars word_length long_words distinct_words top_word same_next upper upper_words digits "
    "exclaims periods commas bars symbols other_marks non_ascii lines line_words repeated_lines "
    "short_lines distinct_pairs"
).split()

_BYTES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digits": b"0123456789",
    "exclaims": b"!",
    "periods": b".",
    "commas": b",",
    "bars": b"|",
    "symbols": b"#*$%&<>=@~^_",
    "other_marks": b"?;:'\"()[]{}/\\-+`",
}
_GROUPS = np.zeros((256, len(_BYTES)))
for _k, _chars in enumerate(_BYTES.values()):
    _GROUPS[list(_chars), _k] = 1.0


def text_statistics(text: str | None) -> list[float]:
    """The numbers of ``STATISTICS``; of a null or empty text all are 0."""
    raw = (text or "").encode()
    words = lower_words(text)
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    shares = counts @ _GROUPS / len(raw)
    seen = Counter(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    plain = raw.split()
    return [
        log1p(n),
        log1p(len(raw)),
        len(raw) / n,
        sum(len(w) > 16 for w in seen) / len(seen),
        len(seen) / n**0.8,
        max(seen.values()) / n,
        sum(map(eq, words, words[1:])) / n,
        shares[0],
        sum(map(bytes.isupper, plain)) / n,
        shares[1],
        *shares[2:],
        counts[128:].sum() / len(raw),
        log1p(len(lines)),
        log1p(n / len(lines)),
        1 - len(set(lines)) / len(lines),
        sum(len(line) < 20 for line in lines) / len(lines),
        len(set(zip(words, words[1:]))) / n,
    ]


def add_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the column ``statistics`` (array<double>), which depends on the text alone."""

    @F.arrow_udf("array<double>")
    def measure(texts: pa.Array) -> pa.Array:
        return pa.array([text_statistics(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return docs.withColumn("statistics", measure.asNondeterministic()(F.col(text)))


@dataclass(frozen=True)
class Settings:
    features: int = 256
    width: float = 3.0  # of the Gaussian kernel, in standard deviations of the statistics
    ridge: float = 1e-3  # per row
    folds: int = 4  # calibration scores come from fits without the row's fold
    bins: int = 1024
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """Everything needed to score a text; a few thousand numbers, whatever the corpus."""

    settings: Settings
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    values: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))

    def cosines(self, statistics: np.ndarray) -> np.ndarray:
        """Random Fourier features of standardised statistics, and a constant."""
        s = self.settings
        draw = np.random.default_rng(s.seed)
        directions = draw.normal(size=(statistics.shape[1], s.features)) / s.width
        phases = draw.uniform(0, 2 * np.pi, s.features)
        x = np.clip((statistics - self.mean) / self.scale, -8, 8)
        waves = np.cos(x @ directions + phases) * np.sqrt(2 / s.features)
        return np.concatenate([waves, np.ones((len(x), 1))], axis=1)

    def score(self, statistics: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1."""
        return np.interp(self.cosines(statistics) @ self.weights, self.steps, self.values)


def isotonic(ones: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Non-decreasing shares of ones that fit the bins best (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for one, row in zip(ones.tolist(), rows.tolist()):
        blocks.append([one, row, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.concatenate([np.full(int(k), one / row) for one, row, k in blocks] or [np.zeros(0)])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch["statistics"].flatten()).reshape(-1, len(STATISTICS))


def _ridge(gram: np.ndarray, settings: Settings) -> np.ndarray:
    """Solve from the Gram matrix of (features, constant, label)."""
    size = len(gram) - 1
    penalty = settings.ridge * max(gram[-2, -2], 1.0) * np.ones(size)
    penalty[-1] = 1e-9  # the constant is free
    return np.linalg.solve(gram[:size, :size] + np.diag(penalty), gram[:size, -1])


def fit(rows: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Fit on ``rows``: ``statistics``, ``label`` (0 to 1) and ``fold`` (0 … folds - 1).

    The rows are read three times, so pass a stored table. Without rows there is no model (None).
    """
    moments = rows.select(
        F.posexplode("statistics").alias("at", "x")
    ).groupBy("at").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation")).orderBy("at").collect()
    if not moments:
        return None
    mean = np.array([m["mean"] for m in moments])
    scale = np.maximum(np.array([m["deviation"] for m in moments]), 1e-6)
    blank = Model(settings, mean, scale, np.zeros(settings.features + 1))
    size = settings.features + 2

    def grams(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((settings.folds, size, size))
        for batch in batches:
            z = np.concatenate([blank.cosines(_matrix(batch)), np.asarray(batch["label"])[:, None]], axis=1)
            for fold in range(settings.folds):
                own = z[np.asarray(batch["fold"]) == fold]
                total[fold] += own.T @ own
        return total.ravel()

    by_fold = sum_over_partitions(rows, grams).reshape(settings.folds, size, size)
    everything = by_fold.sum(axis=0)
    without = np.stack([_ridge(everything - own, settings) for own in by_fold])
    lowest, highest = -0.5, 1.5

    def bins(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((2, settings.bins))
        for batch in batches:
            z = blank.cosines(_matrix(batch))
            raw = np.einsum("ij,ij->i", z, without[np.asarray(batch["fold"])])
            at = np.clip((raw - lowest) / (highest - lowest) * settings.bins, 0, settings.bins - 1).astype(int)
            total[0] += np.bincount(at, np.asarray(batch["label"]), settings.bins)
            total[1] += np.bincount(at, minlength=settings.bins)
        return total.ravel()

    ones, count = sum_over_partitions(rows, bins).reshape(2, settings.bins)
    full = np.flatnonzero(count)
    centres = lowest + (full + 0.5) * (highest - lowest) / settings.bins
    shares = isotonic(ones[full], count[full])
    # One step for each level, at its mean score: between levels the scores keep rising.
    edges = np.flatnonzero(np.r_[True, np.diff(shares) > 0])
    weight = np.add.reduceat(count[full], edges)
    steps = np.add.reduceat(centres * count[full], edges) / weight
    # Keep the ends off 0 and 1 by what one more row of either kind would change.
    values = (shares[edges] * weight + 0.5) / (weight + 1.0)
    values = np.maximum.accumulate(values)
    steps = np.r_[lowest, steps, highest]
    values = np.r_[values[0] * 0.5, values, (1 + values[-1]) / 2]
    return Model(settings, mean, scale, _ridge(everything, settings), steps, values)


def score_column(model: Model | None, statistics: Column) -> Column:
    """Probability of label 1; without a model every row scores 0.5."""
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def score(rows: pa.Array) -> pa.Array:
        return pa.array(model.score(np.asarray(rows.flatten()).reshape(-1, len(STATISTICS))))

    return score(statistics)


def score_text(model: Model | None, text: Column) -> Column:
    """``score_column`` straight from the text, in one pass of the rows through Python."""
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        rows = [text_statistics(t.as_py()) for t in texts]
        return pa.array(model.score(np.array(rows, dtype=float).reshape(-1, len(STATISTICS))))

    return score.asNondeterministic()(text)


def quality_labels(labels: DataFrame) -> DataFrame:
    """One ``label`` per doc_id: the mean of its labels. Rows with a null in either column are left out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return known.groupBy("doc_id").agg(F.avg("quality").cast("double").alias("label"))


def training_rows(measured: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Stored rows (statistics, label, fold) of the labelled documents."""
    fold = F.pmod(F.xxhash64(F.lit(settings.seed), "doc_id"), F.lit(settings.folds)).cast("int")
    joined = measured.select("doc_id", "statistics").join(quality_labels(labels), "doc_id")
    return materialize(joined.select("statistics", "label", fold.alias("fold")), "quality-training")


def fit_quality(
    docs: DataFrame, labels: DataFrame, use: Column | None = None, settings: Settings = Settings()
) -> tuple[Model | None, DataFrame]:
    """(model, stored table of doc_id and statistics of all rows of ``docs``).

    ``use`` selects the rows (by their doc_id) whose labels may be learned; labels, lang, source and
    doc_id are no inputs of the score. Documents without a label and labels without a document are
    not learned from; a null doc_id matches no label. Without any usable label there is no model (None),
    and every row scores 0.5. Repeated rows are learned from as often as they occur; rows alike score
    alike. Texts of any length are measured whole. Other columns are not read.
    """
    measured = materialize(add_statistics(docs.select("doc_id", "text")).drop("text"), "statistics")
    usable = measured if use is None else measured.where(use)
    return fit(training_rows(usable, labels, settings), settings), measured
