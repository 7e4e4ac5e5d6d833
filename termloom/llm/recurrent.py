"""Language model scores: a gated recurrent network in numpy with a class-factored softmax.

Words are counted over all training texts. The most frequent ones are predicted word by word inside
classes of equal size; every other word falls in a tail class by its spelling, and inside the class
its probability follows from its count. So every text, with any words, has a proper probability.

Training is truncated backpropagation in every partition over its own texts, from common weights;
the weights are then averaged by tokens. Each training text is used in one of the rounds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.hashed_words import Words, find_words, grouped_texts
from termloom.llm.ragged import offsets
from termloom.llm.sums import sum_over_partitions
from termloom.storage import materialize

END = b""  # the token after the last word of a text; no word is empty
SMOOTHING = 0.1


@dataclass(frozen=True)
class Network:
    """``head`` words in classes of ``class_words``; the counts of ``listed`` words are broadcast at most."""

    head: int = 1024
    class_words: int = 64
    hidden: int = 16
    listed: int = 1 << 18
    streams: int = 512
    window: int = 32
    chunk_tokens: int = 1 << 20
    batch: int = 2048
    rate: float = 0.01
    shares: tuple[int, ...] = (1, 3)  # of the texts, for each round of training
    seed: int = 3

    @property
    def head_classes(self) -> int:
        return -(-self.head // self.class_words)

    @property
    def classes(self) -> int:
        return self.head_classes + TAILS + 1

    @property
    def end(self) -> int:
        """Number of the end token, after the head words and the tail classes."""
        return self.head + TAILS


# Tail classes: 3 lengths, and 8 kinds of last non-ASCII letter or none.
TAILS = 3 * 9


def tail_classes(words: Words) -> np.ndarray:
    """Class of each word by its spelling alone."""
    sizes, last = words.ends - words.starts, words.last_non_ascii().astype(np.int64)
    kind = np.where(last > 0, 1 + last % 8, 0)
    return ((sizes > 5).astype(np.int64) + (sizes > 10)) * 9 + kind


_COUNTS = "word binary, c bigint"
# Words, and bytes of texts, that a task counts before it passes its counts on.
HELD_WORDS, HELD_BYTES = 200_000, 1 << 27
# Rows scored side by side by a task.
SCORED_ROWS = 8_192


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c, hash, tail) over all ``docs``; the end token is the empty word. Tasks add up before the shuffle."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        size = 0

        def taken() -> pa.RecordBatch:
            columns = [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "c"])

        for batch in batches:
            for item in batch.column(0).cast(pa.binary()):
                words = (item.as_py() or b"").lower()
                size += len(words)
                seen.update(words.split())
                seen[END] += 1
                if len(seen) > HELD_WORDS or size > HELD_BYTES:
                    yield taken()
                    size = 0
        if seen:
            yield taken()

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in grouped_texts(batch["word"]):
                words = find_words(texts)  # one each, none of the end token
                numbers, tails = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int32)
                numbers[words.text], tails[words.text] = words.hashes.view(np.int64), tail_classes(words)
                own = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(numbers), pa.array(tails)], ["word", "c", "hash", "tail"])

    counted = docs.select(text).mapInArrow(partial, _COUNTS).groupBy("word").agg(F.sum("c").alias("c"))
    return counted.mapInArrow(spelled, _COUNTS + ", hash bigint, tail int")


@dataclass(frozen=True)
class Vocabulary:
    """Totals, the counts of the listed words, and token numbers: head words, tail classes, end."""

    network: Network
    total: int
    distinct: int
    hashes: np.ndarray  # of the listed words, sorted
    order: np.ndarray  # the place of each in the two arrays that follow; the end token is the last
    tokens: np.ndarray
    counts: np.ndarray
    token_counts: np.ndarray  # by token
    tail_words: np.ndarray  # distinct words of each tail class

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word among the listed ones, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, dtype=np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)


def list_vocabulary(counts: DataFrame, network: Network) -> Vocabulary:
    """Collect the hashes of at most ``listed`` words: all down to some count, in steps of an eighth of a power of two."""
    step = F.floor(F.log2("c") * 8).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect()
    total, distinct = sum(r.c for r in sizes), sum(r.n for r in sizes)
    held, lowest = 0, 10_000
    for row in sorted(sizes, key=lambda r: -r.step):
        held += row.n
        if held > network.listed:
            break
        lowest = row.step
    is_end = F.col("word") == F.lit(bytearray(END))
    listed = counts.where((step >= lowest) & ~is_end).select("hash", "tail", "c").collect()
    words = sorted((-r.c, r.hash, r.tail) for r in listed)
    head = network.head
    tokens = [k if k < head else head + tail for k, (_, _, tail) in enumerate(words)]
    hashes = np.array([number for _, number, _ in words], dtype=np.int64).view(np.uint64)
    names = hashes[:head].view(np.int64)

    def tails(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        sums = np.zeros((2, TAILS))
        for batch in batches:
            outside = ~np.isin(np.asarray(batch["hash"]), names)
            kinds = np.asarray(batch["tail"])[outside]
            sums[0] += np.bincount(kinds, np.asarray(batch["c"])[outside], TAILS)
            sums[1] += np.bincount(kinds, minlength=TAILS)
        return sums.ravel()

    sums = sum_over_partitions(counts.where(~is_end).select("hash", "tail", "c"), tails)
    tail_counts, tail_words = (np.zeros((2, TAILS)) if sums is None else sums.reshape(2, TAILS))
    token_counts = np.zeros(network.end + 1)
    token_counts[: min(head, len(words))] = [-c for c, _, _ in words[:head]]
    token_counts[head : network.end] = tail_counts
    ends = counts.where(is_end).agg(F.sum("c")).first()[0]
    token_counts[network.end] = ends or 0
    order = np.argsort(hashes)
    return Vocabulary(
        network,
        total,
        distinct,
        hashes[order],
        order.astype(np.int32),
        np.array([*tokens, network.end], dtype=np.int32),
        np.array([*[-c for c, _, _ in words], ends or 0], dtype=np.int64),
        token_counts,
        tail_words,
    )


class Weights:
    """The parameters, as named views of one flat array."""

    def __init__(self, network: Network, flat: np.ndarray | None = None):
        n, h = network, network.hidden
        shapes = {
            "input": (n.end + 1, 3 * h),
            "state": (h, 3 * h),
            "class_weight": (h, n.classes),
            "class_bias": (n.classes,),
            "word_weight": (n.head_classes, h, n.class_words),
            "word_bias": (n.head_classes, n.class_words),
        }
        size = sum(int(np.prod(s)) for s in shapes.values())
        self.flat = np.zeros(size, dtype=np.float32) if flat is None else flat.astype(np.float32)
        self.names, at = list(shapes), 0
        for name, shape in shapes.items():
            length = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + length].reshape(shape))
            at += length


def token_classes(network: Network) -> np.ndarray:
    """Class of each token."""
    head = np.arange(network.head) // network.class_words
    return np.concatenate([head, network.head_classes + np.arange(TAILS + 1)])


def first_weights(vocabulary: Vocabulary) -> Weights:
    """Biases give the counted frequencies, so that training starts from a unigram model."""
    n = vocabulary.network
    weights, draw = Weights(n), np.random.default_rng(n.seed)
    weights.input[:] = draw.normal(size=weights.input.shape) * 0.3
    weights.state[:] = draw.normal(size=weights.state.shape) / np.sqrt(n.hidden)
    weights.class_weight[:] = draw.normal(size=weights.class_weight.shape) * 0.05
    weights.word_weight[:] = draw.normal(size=weights.word_weight.shape) * 0.05
    counts = vocabulary.token_counts + SMOOTHING
    weights.class_bias[:] = np.log(np.bincount(token_classes(n), counts, n.classes))
    words = np.full(n.head_classes * n.class_words, SMOOTHING)
    words[: n.head] = counts[: n.head]
    weights.word_bias[:] = np.log(words).reshape(weights.word_bias.shape)
    weights.class_bias -= weights.class_bias.max()
    weights.word_bias -= weights.word_bias.max(axis=1, keepdims=True)
    return weights


def _step(weights: Weights, columns: np.ndarray, tokens: np.ndarray, state: np.ndarray):
    """(state after ``tokens``, update gates, reset gates, candidates, what the reset gates scale).

    States and gates have a column per text: work on a group of gates then runs over contiguous memory.
    ``columns`` is the input table turned likewise.
    """
    h = len(state)
    fed, back = columns.take(tokens, axis=1), weights.state.T @ state
    gates = fed[: 2 * h]
    gates += back[: 2 * h]
    gates *= np.float32(0.5)  # the logistic function by way of tanh
    np.tanh(gates, out=gates)
    gates *= np.float32(0.5)
    gates += np.float32(0.5)
    keep, reset, new = fed[:h], fed[h : 2 * h], fed[2 * h :]
    new += reset * back[2 * h :]
    np.tanh(new, out=new)
    after = state - new
    after *= keep
    after += new
    return after, keep, reset, new, back[2 * h :]


# Logits within this need no shift before the exponential: their sums stay far inside 32-bit floats.
_SAFE = 60.0


def _with_bias(weight: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, bool]:
    """Weights with the bias as a last row, and whether all logits that a state may give are within ``_SAFE``.

    States lie between -1 and 1, so the sizes of the weights bound the logits.
    """
    both = np.concatenate([weight, bias[..., None, :]], axis=-2)
    return both, bool(np.abs(both).sum(axis=-2).max() < _SAFE)


def _softmax(logits: np.ndarray, targets: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log probability of each target, exponentials in place of the logits, their sums).

    ``logits`` has a column per target: sums down the rows run over contiguous memory.
    """
    if not safe:
        logits -= logits.max(axis=0)
    picked = logits[targets, np.arange(len(targets))]
    np.exp(logits, out=logits)
    sums = logits.sum(axis=0)
    return picked - np.log(sums), logits, sums


def _slope(exponentials: np.ndarray, sums: np.ndarray, targets: np.ndarray, tokens: int) -> np.ndarray:
    """Gradient of the mean loss over ``tokens`` with regard to the logits."""
    exponentials *= 1 / (sums * np.float32(tokens))
    exponentials[targets, np.arange(len(targets))] -= np.float32(1 / tokens)
    return exponentials


def _short(network: Network) -> type:
    """A kind of integer that holds a token; numpy sorts 16-bit ones in linear time."""
    return np.int16 if network.end < 1 << 15 else np.int32


def token_log_probabilities(
    weights: Weights, network: Network, states: np.ndarray, targets: np.ndarray, gradient: Weights | None = None
):
    """Natural log probability of each target token (of a tail word: of its class).

    ``states`` has a column per target. With ``gradient``, adds the gradients of the mean loss to it and returns also that of the states.
    """
    classes = _CLASSES.setdefault(network, token_classes(network))[targets]
    tokens, h = len(targets), network.hidden
    # A last row of ones lets the products add the biases, and sum up their gradients.
    extended = np.ones((h + 1, tokens), dtype=np.float32)
    extended[:h] = states
    both, safe = _with_bias(weights.class_weight, weights.class_bias)
    result, exponentials, sums = _softmax(both.T @ extended, classes, safe)
    back = None
    if gradient is not None:
        slope = _slope(exponentials, sums, classes, tokens)
        found = extended @ slope.T
        gradient.class_weight += found[:h]
        gradient.class_bias += found[h]
        back = weights.class_weight @ slope
    head = np.flatnonzero(targets < network.head)
    order = head[np.argsort(classes[head].astype(_short(network)), kind="stable")]
    edges = np.searchsorted(classes[order], np.arange(network.head_classes + 1))
    sorted_states, sorted_targets = extended.take(order, axis=1), targets[order]
    logs = np.empty(len(order), dtype=np.float32)
    slopes = np.empty((h, len(order)), dtype=np.float32) if gradient is not None else None
    both, safe = _with_bias(weights.word_weight, weights.word_bias)
    for k in range(network.head_classes):
        own = slice(edges[k], edges[k + 1])
        if edges[k] == edges[k + 1]:
            continue
        inside, place = sorted_states[:, own], sorted_targets[own] - k * network.class_words
        logs[own], exponentials, sums = _softmax(both[k].T @ inside, place, safe)
        if gradient is not None:
            slope = _slope(exponentials, sums, place, tokens)
            found = inside @ slope.T
            gradient.word_weight[k] += found[:h]
            gradient.word_bias[k] += found[h]
            slopes[:, own] = weights.word_weight[k] @ slope
    result[order] += logs
    if gradient is None:
        return result
    back[:, order] += slopes
    return result, back


_CLASSES: dict[Network, np.ndarray] = {}


def window_gradient(weights: Weights, network: Network, inputs, targets, state):
    """(gradient of the mean loss, state after the window, loss sum) for inputs of shape (steps, streams).

    The gradient does not reach back before the window; the state does. It starts anew with a text.
    """
    steps, streams = inputs.shape
    h = network.hidden
    gradient, columns = Weights(network), np.ascontiguousarray(weights.input.T)
    shape = (h, steps, streams)
    kept, states, befores = [], np.empty(shape, dtype=np.float32), np.empty(shape, dtype=np.float32)
    for t in range(steps):
        befores[:, t] = state = state * (inputs[t] != network.end)
        state, *gates = _step(weights, columns, inputs[t], state)
        kept.append(gates)
        states[:, t] = state
    logs, slopes = token_log_probabilities(weights, network, states.reshape(h, -1), targets.reshape(-1), gradient)
    slopes = slopes.reshape(shape)
    through, scaled = np.empty((3 * h, steps, streams), dtype=np.float32), np.empty(shape, dtype=np.float32)
    carried = np.zeros((h, streams), dtype=np.float32)
    to_gates, to_new = np.ascontiguousarray(weights.state[:, : 2 * h]), np.ascontiguousarray(weights.state[:, 2 * h :])
    for t in range(steps - 1, -1, -1):
        keep, reset, new, back = kept[t]
        slope = slopes[:, t] + carried
        kept_slope = slope * keep
        own = slope - kept_slope
        np.multiply(own, befores[:, t] - new, out=through[:h, t])
        through[:h, t] *= keep
        own *= 1 - new * new
        through[2 * h :, t] = own
        own *= reset
        scaled[:, t] = own
        own *= back
        np.multiply(own, 1 - reset, out=through[h : 2 * h, t])
        carried = kept_slope + to_gates @ through[: 2 * h, t] + to_new @ scaled[:, t]
        carried *= inputs[t] != network.end
    flat = inputs.reshape(-1)
    every, before = through.reshape(3 * h, -1), befores.reshape(h, -1)
    gradient.state[:, : 2 * h] += before @ every[: 2 * h].T
    gradient.state[:, 2 * h :] += before @ scaled.reshape(h, -1).T
    order = np.argsort(flat.astype(_short(network)), kind="stable")
    starts = np.flatnonzero(np.r_[True, flat[order][1:] != flat[order][:-1]])
    gradient.input[flat[order][starts]] += np.add.reduceat(every.take(order, axis=1), starts, axis=1).T
    return gradient.flat, state, float(-logs.sum())


class Trainer:
    """Adam over the windows of a partition's texts, laid side by side in streams."""

    def __init__(self, weights: Weights, network: Network):
        self.weights, self.network = Weights(network, weights.flat.copy()), network
        self.first, self.second = np.zeros_like(weights.flat), np.zeros_like(weights.flat)
        self.updates, self.tokens, self.loss = 0, 0, 0.0

    def learn(self, stream: np.ndarray) -> None:
        """``stream``: tokens of whole texts, each ended by the end token."""
        n = self.network
        streams = int(min(n.streams, max(1, len(stream) // (4 * n.window))))
        length = len(stream) // streams
        # What is left over by the cut into equal parts makes one more, shorter part.
        self._learn_block(stream[: streams * length].reshape(streams, length), stream)
        if len(stream) > streams * length:
            self._learn_block(stream[streams * length :][None, :], stream)

    def _learn_block(self, block: np.ndarray, stream: np.ndarray) -> None:
        n = self.network
        before = np.concatenate([np.full((len(block), 1), n.end, block.dtype), block[:, :-1]], axis=1)
        inputs, targets = before.T.copy(), block.T.copy()
        state = np.zeros((n.hidden, len(block)), dtype=np.float32)
        for t in range(0, len(inputs), n.window):
            own = slice(t, t + n.window)
            slope, state, loss = window_gradient(self.weights, n, inputs[own], targets[own], state)
            self.loss += loss
            self.tokens += targets[own].size
            self._update(slope)

    def _update(self, slope: np.ndarray) -> None:
        size = float(np.sqrt((slope * slope).sum()))
        if size > 1:
            slope *= np.float32(1 / size)
        self.updates += 1
        self.first += np.float32(0.1) * (slope - self.first)
        self.second += np.float32(0.01) * (slope * slope - self.second)
        rate = self.network.rate * np.sqrt(1 - 0.99**self.updates) / (1 - 0.9**self.updates)
        self.weights.flat -= np.float32(rate) * self.first / (np.sqrt(self.second) + np.float32(1e-7))


_TOKENS = (
    "row bigint, doc_id bigint, held_out boolean, part int, tokens array<int>, n_known bigint, base double, "
    "below double, words array<binary>, times array<int>"
)


def token_rows(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """The stored rows of ``docs`` (doc_id, held_out, part, text) as tokens: words are looked up this once.

    Beside the tokens stands what the listed words give to both scores (``base``; ``below``: the shares of tail
    words in their classes), and the other words, whose counts must be joined.
    """
    n = vocabulary.network
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = [part.split()[0] for part in _TOKENS.split(", ")]

    def lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets(sizes), pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        logs = np.log10(known.counts + SMOOTHING)
        in_tail = logs * (known.tokens >= n.head)
        in_tail[-1] = 0.0  # the end token is predicted itself
        # Of a tail word the count is added; its class gives the denominator.
        below = -np.log10(known.token_counts[n.head : n.end] + SMOOTHING * (known.tail_words + 1))
        below = np.concatenate([np.zeros(n.head), below, [0.0]])
        ends = int(known.counts[-1] > 0)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for start, texts in grouped_texts(batch[text]):
                size, words = len(texts), find_words(texts)
                places = known.places(words.hashes)
                hit = places >= 0
                tokens = np.where(hit, known.tokens[places], n.head + tail_classes(words)).astype(np.int32)
                found, at = places[hit], words.text[hit]
                per_text = np.bincount(words.text, minlength=size)
                # Each text's words, then the end token.
                flat = np.full(len(tokens) + size, n.end, dtype=np.int32)
                flat[np.arange(len(tokens)) + words.text] = tokens
                base = np.bincount(at, logs[found], size) + logs[-1]
                model = np.bincount(at, in_tail[found], size) + np.bincount(words.text, below[tokens], size)
                # The distinct words of each text that are not listed.
                missed = np.flatnonzero(~hit)
                missed = missed[np.lexsort((words.hashes[missed], words.text[missed]))]
                whose, which = words.text[missed], words.hashes[missed]
                new = np.flatnonzero(np.r_[True, (whose[1:] != whose[:-1]) | (which[1:] != which[:-1])][: len(missed)])
                times = np.diff(np.r_[new, len(missed)]).astype(np.int32)
                unlisted = np.bincount(whose[new], minlength=size)
                kept = [batch[c].slice(start, size) for c in ("doc_id", "held_out", "part")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + size)), *kept, lists(per_text + 1, pa.array(flat)),
                     pa.array(np.bincount(at, minlength=size) + ends), pa.array(base), pa.array(model),
                     lists(unlisted, pa.array(words.of(missed[new]), pa.binary())), lists(unlisted, pa.array(times))],
                    names,
                )
                row += size

    return materialize(docs.mapInArrow(run, _TOKENS), "tokens")


def train(rows: DataFrame, vocabulary: Vocabulary) -> Weights:
    """Train on all ``rows`` (part, tokens): each round takes its share of the parts, in every partition."""
    n = vocabulary.network
    context = rows.sparkSession.sparkContext
    weights = first_weights(vocabulary)
    low = 0
    for share in n.shares:
        start = context.broadcast(weights.flat)

        def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            trainer = Trainer(Weights(n, start.value), n)
            held: list[np.ndarray] = []
            size = 0
            for batch in batches:
                tokens = np.asarray(batch["tokens"].flatten())
                ends = np.cumsum(np.asarray(batch["tokens"].value_lengths()))
                at = 0
                while at < len(tokens):
                    # Whole texts up to a chunk's tokens, or one text.
                    last = np.searchsorted(ends, at + n.chunk_tokens - size, side="left")
                    cut = int(ends[min(last, len(ends) - 1)])
                    held.append(tokens[at:cut])
                    size += cut - at
                    at = cut
                    if size >= n.chunk_tokens:
                        trainer.learn(np.concatenate(held))
                        held, size = [], 0
            if held:
                trainer.learn(np.concatenate(held))
            return np.append(trainer.weights.flat.astype(np.float64) * trainer.tokens, trainer.tokens)

        use = rows.where((F.col("part") >= low) & (F.col("part") < low + share)).select("tokens")
        total = sum_over_partitions(use, partial)
        if total is not None and total[-1]:
            weights = Weights(n, total[:-1] / total[-1])
        low += share
    return weights


def score_texts(weights: Weights, network: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Log10 probability of each token row (of tail words only the class), windows of whole texts.

    Texts run side by side, longest first; the state of each is carried from window to window.
    """
    result, columns = np.zeros(len(texts)), np.ascontiguousarray(weights.input.T)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    for first in range(0, len(order), network.batch):
        rows = order[first : first + network.batch]
        sizes = lengths[rows]
        state = np.zeros((network.hidden, len(rows)), dtype=np.float32)
        for low in range(0, int(sizes[0]) if len(sizes) else 0, network.window):
            live = int((sizes > low).sum())
            width = int(min(network.window, sizes[0] - low))
            grid = np.full((live, width + 1), network.end, dtype=np.int32)
            for k in range(live):
                own = texts[rows[k]]
                piece = own[max(0, low - 1) : low + width]
                skip = 1 if low == 0 else 0
                grid[k, skip : skip + len(piece)] = piece
            active = (sizes[:live, None] > low + np.arange(width)).sum(axis=0)
            ends = np.r_[0, np.cumsum(active)]
            states = np.empty((network.hidden, ends[-1]), dtype=np.float32)
            for t in range(width):
                if active[t] < state.shape[1]:
                    state = state[:, : active[t]]
                state = _step(weights, columns, grid[: active[t], t], state)[0]
                states[:, ends[t] : ends[t + 1]] = state
            targets = np.concatenate([grid[:n, t + 1] for t, n in enumerate(active)])
            owners = np.concatenate([rows[:n] for n in active])
            logs = token_log_probabilities(weights, network, states, targets)
            result += np.bincount(owners, logs, len(texts))
    return result / np.log(10)


def _model_scores(rows: DataFrame, network: Network, weights: Weights) -> DataFrame:
    """(row, doc_id, held_out, n_tokens, n_known, base, model) of stored token rows."""
    shared = rows.sparkSession.sparkContext.broadcast(weights.flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = Weights(network, shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, SCORED_ROWS):
                batch = whole.slice(start, SCORED_ROWS)
                lengths = np.asarray(batch["tokens"].value_lengths()).astype(np.int64)
                texts = np.split(np.asarray(batch["tokens"].flatten()), np.cumsum(lengths)[:-1])
                model = np.asarray(batch["below"]) + score_texts(trained, network, texts)
                kept = [batch[c] for c in ("row", "doc_id", "held_out", "n_known", "base")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(lengths), pa.array(model)],
                    ["row", "doc_id", "held_out", "n_known", "base", "n_tokens", "model"],
                )

    schema = "row bigint, doc_id bigint, held_out boolean, n_known bigint, base double, n_tokens bigint, model double"
    return rows.select("row", "doc_id", "held_out", "tokens", "n_known", "base", "below").mapInArrow(run, schema)


def score_documents(docs: DataFrame, held_out: Column, network: Network = Network(), text: str = "text") -> DataFrame:
    """Scores of all rows of ``docs``, learned from those that are not ``held_out``; other columns are dropped.

    Per row: doc_id, held_out, n_tokens (with the end token), n_known (tokens counted in training), train_tokens,
    base_score (log10 of the smoothed unigram probability) and score (log10 probability by the
    model). A null or empty text is its end token alone. A null ``held_out`` counts as false.
    Repeated rows are scored, and learned from, each. Without training texts all counts are zero.
    """
    part = F.pmod(F.xxhash64(F.lit(network.seed), "doc_id"), F.lit(sum(network.shares))).cast("int")
    marked = docs.select(
        F.col("doc_id").cast("bigint"), F.coalesce(held_out, F.lit(False)).alias("held_out"), part.alias("part"), text
    )
    counts = materialize(count_words(marked.where(~F.col("held_out")), text), "word-counts")
    vocabulary = list_vocabulary(counts, network)
    rows = token_rows(marked, vocabulary, text)
    weights = train(rows.where(~F.col("held_out")), vocabulary)
    partial = _model_scores(rows, network, weights)
    # A word that is not listed is rarer than all that are, so no key of this join is hot.
    looked_up = (
        rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("e"))
        .select("row", F.col("e.words").alias("word"), F.col("e.times").alias("times"))
        .join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTHING))).alias("_logs"),
            F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("_known"),
        )
    )
    logs = F.coalesce("_logs", F.lit(0.0))
    below = log10(vocabulary.total + SMOOTHING * (vocabulary.distinct + 1))
    return partial.join(looked_up, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(vocabulary.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )
