"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its subwords: the whole word, and its runs of 3 to 5 bytes with
marks at its ends, hashed into buckets. So a misspelling never seen keeps most of its vector. A text
is cut into windows of equal length of about WINDOW words; a window is the mean of its distinct words, and a
softmax over it gives the probability of toxicity. The text's score is that of its worst window, so
a long text doesn't dilute what is in one place. Vectors and softmax are trained jointly, in numpy,
on windows of labelled texts under their text's label.

Training takes MAX_TRAIN texts of each label at most, chosen by a hash of their id, and all windows of
each. They are encoded once as blocks of buckets, a table; each step of training sums loss and gradient
over the blocks in FIT_TASKS tasks, and the driver holds vectors and gradients only, whose size is
fixed, whatever the texts' lengths and the number of tasks. Scores cover all texts, whole.

Defined cases: a null or empty text is one window without words and gets the score of the softmax's
bias; a text with several labels is toxic if any is; of rows that repeat a labelled id the least text
trains; ids, languages and sources are no input. Without labels of both kinds every score is the share
of toxic labels. Rows keep their other columns; a ``score`` of the input is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.common import materialize, some_by_hash
from curatrix.llm.words import Words, blocks, mix, span_hashes

WINDOW, BUCKETS, DIMENSIONS = 40, 1 << 17, 4
MAX_TRAIN = 3000
FIT_TASKS, FIT_BYTES, _CHUNK = 8, 4 << 20, 1 << 15
LEAST = 20  # a window of fewer distinct words counts as so many
STEPS, DECAY, SHRINK, GAIN = 25, 2.5e-6, 100.0, 20.0
#: A clean text is clean in each of its windows, and is judged by the worst: they weigh so much more.
CLEAN_WEIGHT = 5.0
_EXAMPLES = "bucket binary, per_word binary, window binary, kind binary, first binary, toxic binary, weight binary"


def windows_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The window of each word, numbered through the batch, and the first window of each text."""
    n = words.counts
    many = np.maximum(1, np.round(n / WINDOW).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(many)])
    docs = words.docs
    return first[docs] + (np.arange(len(docs)) - words.ptr[docs]) * many[docs] // np.maximum(n[docs], 1), first


def subwords(words: Words, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of the words numbered ``one``, and the range of each word."""
    lengths = (words.ends - words.starts)[one]
    stop = np.cumsum(lengths + 2)
    first = stop - lengths - 2
    data = np.empty(stop[-1] if len(stop) else 0, np.uint8)
    data[first], data[stop - 1] = ord("<"), ord(">")
    inside = np.ones(len(data), bool)
    inside[first] = inside[stop - 1] = False
    data[inside] = words.data[np.arange(lengths.sum()) + np.repeat(words.starts[one] - (np.cumsum(lengths) - lengths), lengths)]
    buckets, of = [(span_hashes(data, first, stop) % np.uint64(BUCKETS)).astype(np.int32)], [np.arange(len(one), dtype=np.int32)]
    run = data.astype(np.uint64)  # the bytes from each place on as one number, one byte more at a time
    for n in (2, 3, 4, 5):
        run = run[: max(0, len(data) - n + 1)] << np.uint64(8) | data[n - 1 :]
        if n > 2:
            many = np.maximum(lengths + 2 - n + 1, 0)
            before = np.cumsum(many) - many
            at = np.arange(many.sum()) + np.repeat(first - before, many)
            buckets.append((mix(run[at] | np.uint64(n << 40)) % np.uint64(BUCKETS)).astype(np.int32))
            of.append(np.repeat(np.arange(len(one), dtype=np.int32), many))
    of_all = np.concatenate(of)
    del of, run
    order = np.argsort(of_all, kind="stable")
    return np.concatenate(buckets)[order], np.concatenate([[0], np.cumsum(np.bincount(of_all, minlength=len(one)))])


def bags(words: Words, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One word of each kind, and the distinct pairs of window and kind: a word counts once in each."""
    _, one, kind = np.unique(words.hashes, return_index=True, return_inverse=True)
    pair = np.unique(window * max(1, len(one)) + kind)
    return one, pair // max(1, len(one)), pair % max(1, len(one))


def minimize(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, keep: int = 6) -> np.ndarray:
    """Limited-memory BFGS with backtracking; ``f`` gives value and gradient."""
    value, slope = f(x)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, parts = -slope, []
        for s, y, r in reversed(moves):
            parts.append((s @ d) * r)
            d = d - parts[-1] * y
        d *= 1 / (moves[-1][2] * (moves[-1][1] @ moves[-1][1])) if moves else 0.1 / max(1e-12, np.abs(d).max(initial=0))
        for (s, y, r), part in zip(moves, reversed(parts), strict=True):
            d = d + (part - (y @ d) * r) * s
        fall, length = slope @ d, 1.0
        while True:
            after, slope_after = f(x + length * d)
            if after <= value + 1e-4 * length * fall or length < 1e-3:
                break
            length *= 0.3
        y = slope_after - slope
        if (curve := y @ (length * d)) > 1e-12:
            moves = [*moves, ((length * d).astype(np.float32), y.astype(np.float32), 1 / curve)][-keep:]
        x, value, slope = x + length * d, after, slope_after
    return x


class Block:
    """The windows of some training texts: distinct pairs of window and word, and words as buckets."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        kinds = (np.int32, np.int32, np.int32, np.int32, np.int32, np.int8, np.float64)
        self.bucket, self.per_word, self.window, self.kind, self.first, self.toxic, self.weight = (np.frombuffer(batch.column(k)[row].as_buffer(), t) for k, t in enumerate(kinds))
        self.ptr = np.concatenate([[0], np.cumsum(self.per_word)])[:-1]
        self.gain = GAIN / np.maximum(np.bincount(self.window, minlength=len(self.toxic)), LEAST)

    def of_words(self, values: np.ndarray) -> np.ndarray:
        """The mean over each word's buckets."""
        return np.add.reduceat(values[self.bucket], self.ptr) / self.per_word if len(self.ptr) else np.zeros(0)

    def to_buckets(self, values: np.ndarray) -> np.ndarray:
        """What each window gives its words, as sums over buckets."""
        word = np.bincount(self.kind, values[self.window], len(self.ptr)) / np.maximum(self.per_word, 1)
        return np.bincount(self.bucket, np.repeat(word, self.per_word), BUCKETS)

    def log_softmax(self, vectors: np.ndarray, softmax: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means of the windows, and log probabilities of both labels."""
        mean = np.stack([np.bincount(self.window, self.of_words(v)[self.kind], len(self.toxic)) for v in vectors]) * self.gain
        logits = softmax.T @ mean + bias[:, None]
        logits -= logits.max(0)
        return mean, logits - np.log(np.exp(logits).sum(0))

    def curve(self) -> np.ndarray:
        """How much each bucket moves the windows."""
        word = np.bincount(self.kind, self.gain[self.window] ** 2, len(self.ptr)) / np.maximum(self.per_word, 1).astype(float) ** 2
        return np.bincount(self.bucket, np.repeat(word, self.per_word), BUCKETS)

    def slope(self, vectors: np.ndarray, softmax: np.ndarray, bias: np.ndarray) -> tuple[float, np.ndarray]:
        """Weighted loss, and its gradient by vectors, softmax and bias, one after the other."""
        mean, log_p = self.log_softmax(vectors, softmax, bias)
        truth = np.stack([self.toxic == 0, self.toxic == 1])
        error = (np.exp(log_p) - truth) * self.weight
        back = [self.to_buckets(g) for g in (softmax @ error) * self.gain]
        return -float((self.weight * (log_p * truth).sum(0)).sum()), np.concatenate([*back, (mean @ error.T).reshape(-1), error.sum(1)])

    def reweighted(self, vectors: np.ndarray, softmax: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Weights without the windows of toxic texts that look clean, but for the worst of each text."""
        toxic = self.log_softmax(vectors, softmax, bias)[1][1]
        worst = np.zeros(len(toxic), bool)
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        order = np.lexsort((-toxic, text))
        worst[order[self.first[:-1]]] = True
        return np.where((self.toxic == 1) & ~worst & (toxic < np.log(0.5)), 0.0, self.weight)


def encode_texts(rows: DataFrame, clean_weight: float) -> DataFrame:
    """``rows`` (``label``, ``body``) as blocks of whole texts of about FIT_BYTES, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "body", FIT_BYTES):
            words = Words(block.column(1))
            window, first = windows_of(words)
            one, window, kind = bags(words, window)
            bucket, ptr = subwords(words, one)
            toxic = np.repeat(block.column(0).to_numpy().astype(np.int8), np.diff(first))
            weight = np.where(toxic == 1, 1.0, CLEAN_WEIGHT * clean_weight)
            arrays = (bucket.astype(np.int32), np.diff(ptr).astype(np.int32), window.astype(np.int32), kind.astype(np.int32), first.astype(np.int32), toxic, weight)
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=[f.split()[0] for f in _EXAMPLES.split(", ")])

    return rows.select("label", "body").mapInArrow(run, _EXAMPLES)


def _summed(examples: DataFrame, each: Callable[[Block], tuple[float, np.ndarray]]) -> tuple[float, np.ndarray]:
    """The sums of a value and of an array over all blocks.

    Tasks' arrays are added up in chunks by other tasks, so the driver gets one array, in pieces,
    however many tasks there are. Between tasks 32 bits of a number are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, total = 0.0, None
        for batch in batches:
            for i in range(batch.num_rows):
                more, found = each(Block(batch, i))
                value, total = value + more, found if total is None else total + found
        if total is not None:
            raw = [total[low : low + _CHUNK].astype(np.float32).tobytes() for low in range(0, len(total), _CHUNK)]
            values = [value] + [0.0] * (len(raw) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(raw)), pa.int32()), pa.array(values), pa.array(raw, pa.binary())], names=["chunk", "value", "total"])

    def add(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in parts["total"])
        return pa.table({"chunk": parts["chunk"][:1], "value": [sum(parts["value"].to_pylist())], "total": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    schema = "chunk int, value double, total binary"
    rows = examples.coalesce(FIT_TASKS).mapInArrow(run, schema).groupBy("chunk").applyInArrow(add, schema).collect()
    rows.sort(key=lambda r: r["chunk"])
    return sum(r["value"] for r in rows), np.concatenate([np.zeros(0), *(np.frombuffer(r["total"], np.float32) for r in rows)])


def fit(examples: DataFrame, share: float, seed: int = 7) -> tuple[np.ndarray, float]:
    """Train on blocks (see ``encode_texts``); the log odds that each bucket adds to a word, and the bias.

    ``share`` is that of toxic texts. All windows first have their text's label; then those of toxic
    texts that the model finds clean are left out, but for the worst of each text, and training goes
    on. Vectors and softmax are only ever used through what is returned.
    """
    if not 0 < share < 1:
        return np.zeros(BUCKETS), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    context = examples.sparkSession.sparkContext
    # Steps are taken in vectors scaled by how much a bucket moves the windows, so rare ones move less.
    curve = _summed(examples, lambda b: (0.0, b.curve()))[1]
    used = np.flatnonzero(curve)
    scale = 1 / np.sqrt(curve[used] + SHRINK * np.median(curve[used])) if len(used) else np.ones(0)
    scale /= scale.max(initial=1e-300)
    size = DIMENSIONS * len(used)
    rng = np.random.default_rng(seed)

    def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vectors = np.zeros((DIMENSIONS, BUCKETS))
        vectors[:, used] = x[:size].reshape(DIMENSIONS, -1) * scale
        return vectors, x[size:-2].reshape(DIMENSIONS, 2), x[-2:]

    def with_model(x: np.ndarray, call: Callable):  # noqa: ANN202
        vectors, softmax, bias = parts(x)
        shared = context.broadcast((vectors.astype(np.float32), softmax, bias))
        try:
            return call(shared)
        finally:
            shared.destroy()

    def minimum(blocks_: DataFrame, x: np.ndarray) -> np.ndarray:
        total, _ = _summed(blocks_, lambda b: (float(b.weight.sum()), np.zeros(1)))

        def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
            value, slope = with_model(x, lambda shared: _summed(blocks_, lambda b: b.slope(*shared.value)))
            by_bucket = slope[: DIMENSIONS * BUCKETS].reshape(DIMENSIONS, -1)[:, used] * scale / total
            return value / total + 0.5 * DECAY * (x[:-2] ** 2).sum(), np.concatenate([by_bucket.reshape(-1) + DECAY * x[:size], slope[DIMENSIONS * BUCKETS : -2] / total + DECAY * x[size:-2], slope[-2:] / total])

        return minimize(loss, x, STEPS)

    x = np.concatenate([rng.normal(0, 0.01, size), rng.normal(0, 1, 2 * DIMENSIONS), np.zeros(2)])
    x = minimum(examples, x)

    def weigh(shared) -> DataFrame:  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                weights = [Block(batch, i).reweighted(*shared.value).tobytes() for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(weights, pa.binary())], names=batch.schema.names)

        return materialize(examples.mapInArrow(run, _EXAMPLES), "examples")

    vectors, softmax, bias = parts(minimum(with_model(x, weigh), x))
    return GAIN * ((softmax[:, 1] - softmax[:, 0]) @ vectors), float(bias[1] - bias[0])


def score_block(model: tuple[np.ndarray, float], column: pa.Array) -> np.ndarray:
    """The score of each text."""
    odds, bias = model
    words = Words(column)
    window, first = windows_of(words)
    logit = np.full(first[-1], bias)
    if len(words):
        one, window, kind = bags(words, window)
        bucket, ptr = subwords(words, one)
        each = np.add.reduceat(odds[bucket], ptr[:-1]) / np.diff(ptr)
        sizes = np.bincount(window, minlength=len(logit))
        logit += np.bincount(window, each[kind], len(logit)) / np.maximum(sizes, LEAST)
    return 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(logit, first[:-1]), -50, 50)))


def training_examples(df: DataFrame, text: str, id_column: str, labels: DataFrame, label: str, keep: Column, most: int = MAX_TRAIN) -> tuple[DataFrame, float]:
    """What ``fit`` takes: blocks of the labelled texts that ``keep`` (on the id) lets in, from a table,
    and the share of toxic ones. Clean ones weigh so much more as the sample left out more of them.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).where(keep)
    each = materialize(known.groupBy(F.col(id_column).alias("key")).agg(F.max(label).alias("label")), "labels")
    chosen = some_by_hash(each.where("label = 1"), "key", most).unionAll(some_by_hash(each.where("label = 0"), "key", most))
    # 2 * MAX_TRAIN ids and those that tie with the last; rows that repeat an id are one training text.
    texts = df.select(F.col(id_column).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body")).join(F.broadcast(chosen), "key")
    texts = texts.groupBy("key").agg(F.max("label").alias("label"), F.min("body").alias("body"))
    clean, toxic = (each.where(f"label = {x}").count() for x in (0, 1))
    weight = (clean / max(1, min(clean, most))) / (toxic / max(1, min(toxic, most))) if clean and toxic else 1.0
    dealt = materialize(texts.select("key", "label", "body").repartition(FIT_TASKS), "texts")
    examples = materialize(encode_texts(dealt, weight), "examples")
    found = dealt.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    return examples, float(found[1] / found[0]) if found[0] else 0.0


def score(df: DataFrame, text: str, model: tuple[np.ndarray, float]) -> DataFrame:
    """``df`` with ``score``: 0 to 1, higher where label 1 is likelier."""
    df = df.drop("score")
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])
    known = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(score_block(known.value, block.column(block.schema.get_field_index(text))))], names=[*block.schema.names, "score"])

    return df.mapInArrow(run, schema)
