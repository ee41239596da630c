"""A quality classifier by importance resampling.

Two generative models of hashed n-grams are counted: of target text, the labelled good rows, and of
raw text, all rows. A row's importance is the ratio of its likelihoods under both; a sample of k rows
without replacement, in proportion to importance, is the k largest of log importance plus Gumbel
noise. Rows outside the sample are rejected.

n-grams are taken from two streams: words, lower-cased (1 and 2 of them), and shapes of words (1 to
3), in which runs of capitals, of other letters and of digits become one sign each, other characters
stay, and a word that repeats the one before is marked. Each stream has buckets of its own.

Unless k is given, it is the expected number of rows from the target: the sum over rows of
min(1, share * importance), with the share of good rows among labelled ones. Target counts come from
MAX_LABELLED labelled rows at most, chosen by a hash of their id; everything else covers all rows.

Noise is a function of id and seed, so results don't depend on partitions. The k-th largest key is
found by counting keys in ranges, narrowed step by step: no task or driver sorts them.

Defined cases: null and empty texts have importance 1; rows whose keys tie with the k-th are kept
too, so repeated rows share their fate; a row with several labels is good if all of them are; without
good labels both models are equal, and the noise alone decides; an empty table gives no rows. Rows
keep their other columns; ``log_ratio``, ``key`` and ``selected`` of the input are replaced. N-grams that
share one of the BUCKETS of their stream count as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.common import kth_largest, materialize, some_by_hash
from curatrix.llm.words import Words, blocks, span_hashes

BUCKETS = 1 << 15  # of each stream
MAX_LABELLED = 50_000
#: Keys are compared in steps of 2**-20.
_STEPS = 1 << 20
_SIGN = np.arange(256, dtype=np.uint8)
_SIGN[ord("A") : ord("Z") + 1] = ord("A")
_SIGN[ord("a") : ord("z") + 1] = ord("a")
_SIGN[0x80:] = ord("a")
_SIGN[ord("0") : ord("9") + 1] = ord("0")


def shape_hashes(raw: Words, repeats: np.ndarray) -> np.ndarray:
    """The hash of each word's shape; ``raw`` keeps the case."""
    if not len(raw):
        return np.zeros(0, np.uint64)
    sign = _SIGN[raw.data]
    keep = np.ones(len(sign), bool)
    keep[1:] = (sign[1:] != sign[:-1]) | ~np.isin(sign[1:], [ord("A"), ord("a"), ord("0")])
    keep[raw.starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return span_hashes(sign[keep], at[raw.starts], at[raw.ends]) + repeats.astype(np.uint64)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every n-gram of a batch, and the text of each."""
    raw = Words(column, lower=False)
    words = Words(column)
    h = words.hashes
    docs = words.docs
    repeats = np.zeros(len(h), bool)
    repeats[1:] = (h[1:] == h[:-1]) & (docs[1:] == docs[:-1])
    out, of = [], []
    for stream, (hashes, sizes) in enumerate(((h, (1, 2)), (shape_hashes(raw, repeats), (1, 2, 3)))):
        words._hashes = hashes
        for n in sizes:
            g, at, _ = words.ngrams(n, short=False)
            out.append(((g ^ np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64) + stream * BUCKETS)
            of.append(docs[at])
    return np.concatenate(out), np.concatenate(of)


def labelled_sample(labels: DataFrame, id_column: str, label: str, most: int, keep: Column | None = None) -> DataFrame:
    """``id``, ``good``: ``most`` labelled ids, by a hash of the id; fit to be broadcast."""
    rows = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull())
    rows = rows if keep is None else rows.where(keep)
    each = rows.groupBy(F.col(id_column).alias("id")).agg(F.min(label).alias("good"))
    return some_by_hash(each, "id", most)


def train(df: DataFrame, text: str, id_column: str, sample: DataFrame) -> tuple[np.ndarray, float]:
    """Log ratio of both models for each bucket, and the share of good rows among labelled ones."""
    # MAX_LABELLED ids and those that tie with the last.
    known = F.broadcast(sample.select("id", (F.col("good") == 1).cast("int").alias("good")))
    rows = df.select(F.col(id_column).alias("id"), F.col(text).alias("body")).join(known, "id", "left").select("good", "body")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 2 * BUCKETS + 2), np.int64)  # raw, target; the last two count labelled and good rows
        for block in blocks(batches, "body"):
            good = block.column(0).to_numpy(zero_copy_only=False)
            bucket, of = features(block.column(1))
            n[0, :-2] += np.bincount(bucket, minlength=2 * BUCKETS)
            n[1, :-2] += np.bincount(bucket[(good == 1)[of]], minlength=2 * BUCKETS)
            n[0, -2] += np.isfinite(good.astype(float)).sum()
            n[0, -1] += (good == 1).sum()
        at = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[0, at]), pa.array(n[1, at])], names=["bucket", "raw", "target"])

    n = np.zeros((2, 2 * BUCKETS + 2))
    summed = rows.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    n[0, summed["bucket"]], n[1, summed["bucket"]] = summed["raw"], summed["target"]
    labelled, good = n[0, -2:]
    ratio = np.zeros(2 * BUCKETS)
    for s in (slice(0, BUCKETS), slice(BUCKETS, 2 * BUCKETS)):
        if n[1, s].sum():
            # Target counts are smoothed towards the raw model: an unseen bucket is no proof.
            raw = (n[0, s] + 0.5) / (n[0, s] + 0.5).sum()
            target = (n[1, s] + 0.5 * raw * BUCKETS) / (n[1, s].sum() + 0.5 * BUCKETS)
            ratio[s] = np.log(target) - np.log(raw)
    return ratio, float(good / labelled) if labelled else 1.0


def score(df: DataFrame, text: str, ratio: np.ndarray) -> DataFrame:
    """``df`` with ``log_ratio``, the log of each row's importance."""
    df = df.drop("log_ratio")
    schema = T.StructType([*df.schema.fields, T.StructField("log_ratio", T.DoubleType())])
    known = df.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            bucket, of = features(block.column(block.schema.get_field_index(text)))
            sums = np.bincount(of, known.value[bucket], minlength=block.num_rows).astype(np.float64)  # of nothing it gives integers
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(sums)], names=[*block.schema.names, "log_ratio"])

    return df.mapInArrow(run, schema)


def gumbel(id_column: str, seed: int) -> Column:
    """Standard Gumbel noise that an id and the seed fix."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_column)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def resample(df: DataFrame, text: str, id_column: str, labels: DataFrame, label: str = "quality", k: int | None = None, seed: int = 29, most: int = MAX_LABELLED, carry: list[str] | None = None) -> DataFrame:
    """``df`` with ``log_ratio``, ``key`` (double) and ``selected`` (boolean), read from a table.

    ``carry`` names the columns of ``df`` that the result has: all, unless given.
    """
    df = df.drop("log_ratio", "key", "selected")
    sample = materialize(labelled_sample(labels, id_column, label, most), "labelled")
    ratio, share = train(df, text, id_column, sample)
    scored = score(df, text, ratio)
    return choose(scored if carry is None else scored.select(*carry, "log_ratio"), id_column, share, k, seed)


def choose(scored: DataFrame, id_column: str, share: float, k: int | None, seed: int) -> DataFrame:
    held = materialize(scored.withColumn("key", F.col("log_ratio") + gumbel(id_column, seed)), "scored")
    if k is None:
        k = round(held.agg(F.sum(F.least(F.lit(1.0), share * F.exp(F.least(F.col("log_ratio"), F.lit(50.0)))))).first()[0] or 0)
    step = F.floor(F.col("key") * _STEPS).cast("long")
    at = kth_largest(held.select(step.alias("key")), k)
    return held.withColumn("selected", F.lit(True) if at is None else step >= at)
