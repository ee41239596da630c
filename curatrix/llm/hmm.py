"""Language-model scoring by a hidden Markov model over words.

Words are counted over all training texts. The model's symbols are the SYMBOLS most frequent words, one
class for each of CLASSES hashed word endings, which all other words share, and the end of a text.
Baum-Welch trains states that emit symbols: partitions run forward and backward over all training
texts, expected counts are summed, and the driver holds the model only, whose size is fixed. Texts are
worked on whole, in pieces of SEGMENT tokens side by side: products of each piece's steps give the
exact forward and backward vectors at its ends first, so nothing depends on where a text is cut. A word in a class has its share of it by its count: (c + 0.5) out of the class's
counts, with half a count for a word never seen. A text's score is the exact log10 likelihood of all
its tokens under the model, by the scaled forward recursion over the whole text; ``base_score`` is
that of an unordered model with half a count added to each word.

Words are known by 54 bits of their hash and 10 bits of their ending. Counts of all words stay spread
over buckets, packed in rows, as many as the corpus has times BUCKET_BYTES; only the KNOWN_WORDS most
frequent are broadcast (of words that tie for the last place, none). The others' part of a
score is a sum over words, so occurrences travel to the bucket of their counts, and sums travel back;
both carry at most a row for each pair of block and bucket.

Defined cases: null and empty texts have one token, the end; a null id counts as the empty string in
the split; repeated ids are scored row by row; without training texts counts are 0 and scores finite;
texts of any length are scored whole. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import kth_largest, materialize
from curatrix.llm.words import Words, blocks, mix

STATES, SYMBOLS, CLASSES, KNOWN_WORDS, ROUNDS, SEGMENT = 6, 4096, 1024, 300_000, 5, 512
BLOCK_BYTES, BUCKET_BYTES = 1 << 22, 64 << 20
#: Segments that forward and backward vectors are held for at a time.
_HELD_SEGMENTS = 1024
_HELD_WORDS = 1 << 20
END = SYMBOLS + CLASSES
WIDTH = END + 1


def keys_of(words: Words) -> np.ndarray:
    """A key for each word: hash above, class of the ending below."""
    ending = np.zeros(len(words), np.uint64)
    for k in range(1, 4):  # the last three bytes, or fewer
        at = words.ends - k
        ending = ending << np.uint64(8) | np.where(at >= words.starts, words.data[np.maximum(at, 0)], 0).astype(np.uint64)
    return (words.hashes & ~np.uint64(CLASSES - 1)) | (mix(ending) % np.uint64(CLASSES))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their numbers."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings buckets together, and where each begins in it."""
    bucket = ((keys >> np.uint64(10)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def count_words(train: DataFrame, text: str, buckets: int) -> DataFrame:
    """A row per bucket: its words' keys and counts, its most frequent ones, and sums by class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def give() -> Iterator[pa.RecordBatch]:
            keys, n = summed(np.concatenate([k for k, _ in held]), np.concatenate([m for _, m in held]))
            held.clear()
            order, at = by_bucket(keys, buckets)
            keys, n = keys[order], n[order].astype(np.int32)
            full = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([keys[at[b] : at[b + 1]].tobytes() for b in full], pa.binary()), pa.array([n[at[b] : at[b + 1]].tobytes() for b in full], pa.binary())], names=["bucket", "keys", "counts"])

        size = 0
        for block in blocks(batches, text, BLOCK_BYTES):
            keys, n = np.unique(keys_of(Words(block.column(0))), return_counts=True)
            held.append((keys, n))
            size += len(keys)
            if size > 4 * _HELD_WORDS:
                held[:] = [summed(np.concatenate([k for k, _ in held]), np.concatenate([m for _, m in held]))]
                size = len(held[0][0])
                if size > _HELD_WORDS:
                    yield from give()
                    size = 0
        if held:
            yield from give()

    top = 4 * KNOWN_WORDS // buckets + 16

    def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, n = summed(np.frombuffer(b"".join(rows["keys"]), np.uint64), np.frombuffer(b"".join(rows["counts"]), np.int32).astype(np.int64))
        best = np.argsort(-n, kind="stable")[:top]
        kind = (keys % np.uint64(CLASSES)).astype(np.int64)
        return pd.DataFrame({"bucket": [key[0]], "keys": [keys.tobytes()], "counts": [n.tobytes()], "words": [len(keys)], "total": [int(n.sum())], "top": [list(zip(keys[best].view(np.int64).tolist(), n[best].tolist()))], "class_total": [np.bincount(kind, n, CLASSES).astype(np.int64).tolist()], "class_words": [np.bincount(kind, minlength=CLASSES).tolist()]})

    sent = train.select(text).mapInArrow(count, "bucket int, keys binary, counts binary")
    return materialize(sent.groupBy("bucket").applyInPandas(gather, "bucket int, keys binary, counts binary, words long, total long, top array<struct<key:long,n:long>>, class_total array<long>, class_words array<long>"), "vocabulary")


def describe(vocabulary: DataFrame, texts: int) -> dict:
    """What every task needs of the counts; its size has a fixed bound."""
    total, distinct = vocabulary.agg(F.sum("total"), F.sum("words")).first()
    top = vocabulary.select(F.inline("top"))
    least = kth_largest(top.select(F.col("n").alias("key")), KNOWN_WORDS + 1)
    parts = (top if least is None else top.where(F.col("n") > least)).collect()
    keys, counts = np.array([r[0] for r in parts], np.int64).view(np.uint64), np.array([r[1] for r in parts], np.int64)
    best = np.lexsort((keys, -counts))
    keys, counts = keys[best], counts[best]
    symbol = np.where(np.arange(len(keys)) < SYMBOLS, np.arange(len(keys)), SYMBOLS + (keys % np.uint64(CLASSES)).astype(np.int64))
    sums, words = np.zeros(CLASSES), np.zeros(CLASSES)
    both = vocabulary.select(F.posexplode(F.arrays_zip("class_total", "class_words")).alias("class", "x")).groupBy("class").agg(F.sum("x.class_total").alias("total"), F.sum("x.class_words").alias("words"))
    for r in both.collect():
        sums[r["class"]], words[r["class"]] = r["total"], r["words"]
    own = (keys[:SYMBOLS] % np.uint64(CLASSES)).astype(np.int64)
    sums -= np.bincount(own, counts[:SYMBOLS], CLASSES)
    words -= np.bincount(own, minlength=CLASSES)
    unigram = np.zeros(WIDTH)
    unigram[: min(SYMBOLS, len(keys))] = counts[:SYMBOLS]
    unigram[SYMBOLS:END] = sums + 0.5 * (words + 1)
    unigram[END] = texts
    order = np.argsort(keys)
    tokens = int(total or 0) + texts
    return {
        "keys": keys[order], "counts": counts[order], "symbols": symbol[order].astype(np.uint16), "ends": texts, "tokens": tokens, "unigram": (unigram + 1e-3) / (unigram + 1e-3).sum(),
        "class_log": np.log10(sums + 0.5 * (words + 1)), "base_log": float(np.log10(tokens + 0.5 * ((distinct or 0) + (texts > 0) + 1))),
    }


_ENCODED = "block long, ids array<long>, held array<boolean>, lengths binary, symbols binary, sums binary, rare binary, rare_docs binary"


def encode(df: DataFrame, text: str, known: dict) -> DataFrame:
    """A row per block of texts: symbols of all tokens; per text sums for frequent words; rare words.

    ``sums`` has three numbers a text: log10(c + 0.5) of words whose count is known here, the same of
    those that share a class less the log of all words' classes, and the words with a count.
    """
    shared = df.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, task, made = shared.value, TaskContext.get().partitionId(), 0
        table = k["keys"]
        for block in blocks(batches, text, BLOCK_BYTES):
            words = Words(block.column(2))
            distinct, kind = np.unique(keys_of(words), return_inverse=True)
            at = np.minimum(np.searchsorted(table, distinct), max(len(table) - 1, 0))
            there = table[at] == distinct if len(table) else np.zeros(len(distinct), bool)
            symbol = SYMBOLS + (distinct % np.uint64(CLASSES)).astype(np.int64)
            own = np.zeros(len(distinct))
            if there.any():
                symbol[there] = k["symbols"][at[there]]
                own[there] = np.log10(k["counts"][at[there]] + 0.5)
            in_class = symbol >= SYMBOLS
            share = np.where(in_class, own, 0.0)
            share[in_class] -= k["class_log"][symbol[in_class] - SYMBOLS]
            n, docs = len(words.ptr) - 1, words.docs
            sums = np.stack([np.bincount(docs, x[kind], n) for x in (own, share, there.astype(float))])
            ends = words.ptr[1:] + np.arange(n)
            symbols = np.full(len(words) + n, END, np.uint16)
            inner = np.ones(len(symbols), bool)
            inner[ends] = False
            symbols[inner] = symbol[kind]
            rare = np.flatnonzero(~there[kind])
            yield pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + made]), pa.array([block.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([block.column(1).to_pylist()], pa.list_(pa.bool_()))]
                + [pa.array([a.tobytes()], pa.binary()) for a in (words.counts.astype(np.int64) + 1, symbols, sums, distinct[kind[rare]], docs[rare].astype(np.uint32))],
                names=["block", "ids", "held", "lengths", "symbols", "sums", "rare", "rare_docs"],
            )
            made += 1

    return materialize(df.mapInArrow(run, _ENCODED), "encoded")


class Model:
    """Start, step and emission probabilities."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit

    @classmethod
    def random(cls, unigram: np.ndarray, states: int = STATES, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        emit = unigram * np.exp(rng.normal(0, 1, (states, len(unigram))))
        emit[:, END] = unigram[END]
        return cls(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(1, keepdims=True))

    def edges(self, symbols: np.ndarray, lengths: np.ndarray, back: bool = True) -> tuple[np.ndarray, ...]:
        """The segments of all texts, in order: text, first token, size, whether it begins its text,
        the forward vector before it and the backward vector behind it.
        """
        states = len(self.start)
        parts = -(-lengths // SEGMENT)
        text = np.repeat(np.arange(len(lengths)), parts)
        place = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = (np.cumsum(lengths) - lengths)[text] + place * SEGMENT
        size = np.minimum(lengths[text] - place * SEGMENT, SEGMENT)
        head = place == 0
        enter, leave = np.tile(self.start, (len(text), 1)), np.ones((len(text), states))
        long = np.flatnonzero(parts[text] > 1)
        if len(long):
            # The product of all steps of a segment, as it acts on the vector before it; a text's first
            # one begins with the start's probabilities in place of a step.
            emit = np.ascontiguousarray(self.emit.T)
            order = long[np.argsort(-size[long], kind="stable")]
            product = np.tile(np.eye(states), (len(order), 1, 1))
            first = head[order]
            for t in range(SEGMENT):
                n = int(np.searchsorted(-size[order], -t, "left"))  # segments longer than t
                b = emit[symbols[begin[order[:n]] + t]]
                if t == 0:
                    now = np.where(first[:, None, None], np.eye(states), self.step) * b[:, None, :]
                else:
                    now = (product[:n].reshape(-1, states) @ self.step).reshape(n, states, states) * b[:, None, :]
                if t % 16 == 15 or t == SEGMENT - 1:
                    now /= now.max((1, 2), keepdims=True)
                product[:n] = now
            product /= product.max((1, 2), keepdims=True)
            at = np.zeros(len(text), np.int64)
            at[order] = np.arange(len(order))
            for wave in range(1, int(parts.max())):
                here = long[place[long] == wave]
                v = (enter[here - 1][:, None, :] @ product[at[here - 1]])[:, 0]
                enter[here] = v / v.sum(1, keepdims=True)
            for wave in range(int(parts.max()) - 2, -1, -1) if back else ():
                here = long[(place[long] == wave) & (wave + 1 < parts[text[long]])]
                v = (product[at[here + 1]] @ leave[here + 1][:, :, None])[:, :, 0]
                leave[here] = v / v.sum(1, keepdims=True)
        return text, begin, size, head, enter, leave

    def counts(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Expected counts: of emissions by symbol, then of steps by the state left, then of starts."""
        out = np.zeros((WIDTH + len(self.start) + 1, len(self.start)))
        _, begin, size, head, enter, leave = self.edges(symbols, lengths)
        for low in range(0, len(size), _HELD_SEGMENTS):
            cut = slice(low, low + _HELD_SEGMENTS)
            self._count(out, symbols, begin[cut], size[cut], head[cut], enter[cut], leave[cut])
        return out

    def _count(self, out: np.ndarray, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, head: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> None:
        """Add what ``counts`` returns for some segments; each goes on where the one before ends."""
        states = len(self.start)
        order = np.argsort(-size, kind="stable")
        begin, size, head, enter, leave = begin[order], size[order], head[order], enter[order], leave[order]
        emit = np.ascontiguousarray(self.emit.T)
        longest = int(size[0])
        active = np.searchsorted(-size, -np.arange(longest), "left")  # segments longer than t
        alphas, seen = [], []
        for t in range(longest):
            n = active[t]
            b = emit[symbols[begin[:n] + t]]
            a = (np.where(head[:, None], enter, enter @ self.step) if t == 0 else alphas[-1][:n] @ self.step) * b
            a /= a.sum(1, keepdims=True)
            alphas.append(a)
            seen.append(b)
        beta = leave[: active[-1]]
        steps = np.zeros((states, states))
        gammas = [None] * longest
        for t in range(longest - 1, -1, -1):
            n = active[t]
            if n > len(beta):
                beta = np.concatenate([beta, leave[len(beta) : n]])
            g = alphas[t] * beta
            g /= g.sum(1, keepdims=True)
            gammas[t] = g
            before, back = (alphas[t - 1][:n], seen[t] * beta) if t else (enter[~head], (seen[0] * beta)[~head])
            back /= ((before @ self.step) * back).sum(1, keepdims=True)
            steps += before.T @ back
            if t:
                beta = back @ self.step.T
        where = np.concatenate([symbols[begin[:n] + t] for t, n in enumerate(active)])
        gamma = np.concatenate(gammas)
        for s in range(states):
            out[:WIDTH, s] += np.bincount(where, gamma[:, s], WIDTH)
        out[WIDTH:-1] += self.step * steps
        out[-1] += gammas[0][head].sum(0)

    def updated(self, counts: np.ndarray, unigram: np.ndarray) -> Model:
        """The model that the counts ask for; each state leans on all texts by a few counts."""
        states = len(self.start)
        emit = counts[:WIDTH].T + 5.0 * unigram
        step = counts[WIDTH:-1] + 0.1
        start = counts[-1] + 0.1
        assert emit.shape == (states, WIDTH)
        return Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def log_likelihood(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 of each text's likelihood, by the scaled forward recursion over whole texts."""
        out = np.zeros(len(lengths))
        text, begin, size, head, enter, _ = self.edges(symbols, lengths, back=False)
        order = np.argsort(-size, kind="stable")
        text, begin, size, head, enter = text[order], begin[order], size[order], head[order], enter[order]
        emit = np.ascontiguousarray(self.emit.T)
        active = np.searchsorted(-size, -np.arange(size[0]), "left") if len(size) else []
        logs, a, scale = np.zeros(len(size)), None, np.ones(len(size))
        for t, n in enumerate(active):
            b = emit[symbols[begin[:n] + t]]
            a = (np.where(head[:, None], enter, enter @ self.step) if t == 0 else a[:n] @ self.step) * b
            total = a.sum(1)
            a /= total[:, None]
            scale[:n] *= total
            if t % 16 == 15:  # 16 probabilities are far from the least double
                logs += np.log10(scale)
                scale[:] = 1.0
        np.add.at(out, text, logs + np.log10(scale))
        return out


def baum_welch(encoded: DataFrame, unigram: np.ndarray, rounds: int = ROUNDS, states: int = STATES) -> Model:
    """Train on the blocks' texts that are not held out."""
    model = Model.random(unigram, states)
    names = [f"s{i}" for i in range(states)]
    for _ in range(rounds):
        shared = encoded.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((WIDTH + states + 1, states))
            for batch in batches:
                for i in range(batch.num_rows):
                    held = np.array(batch.column(0)[i].as_py(), bool)
                    lengths = np.frombuffer(batch.column(1)[i].as_buffer(), np.int64)
                    symbols = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint16)
                    total += shared.value.counts(symbols[np.repeat(~held, lengths)], lengths[~held])  # noqa: B023
            at = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(total[at, s]) for s in range(states))], names=["row", *names])

        rows = encoded.select("held", "lengths", "symbols").mapInArrow(run, "row int, " + ", ".join(f"{n} double" for n in names))
        found = rows.groupBy("row").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
        counts = np.zeros((WIDTH + states + 1, states))
        counts[found["row"].to_numpy()] = found[names].to_numpy()
        model = model.updated(counts, unigram)
        shared.unpersist()
    return model


def rare_sums(encoded: DataFrame, vocabulary: DataFrame, buckets: int) -> DataFrame:
    """``block``, ``docs``, ``logs``, ``known``: what rare words add to the texts of a block."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, docs = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint64), np.frombuffer(batch.column(2)[i].as_buffer(), np.uint32)
                order, at = by_bucket(keys, buckets)
                keys, docs = keys[order], docs[order]
                full = np.flatnonzero(np.diff(at))
                cut = lambda a: pa.array([a[at[b] : at[b + 1]].tobytes() for b in full], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), batch.column(0)[i].as_py())), cut(keys), cut(docs)], names=["bucket", "block", "keys", "numbers"])

    asked = encoded.select("block", "rare", "rare_docs").mapInArrow(split, "bucket int, block long, keys binary, numbers binary")
    told = vocabulary.select("bucket", F.lit(None).cast("long").alias("block"), "keys", F.col("counts").alias("numbers"))

    def answer(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        is_count = rows["block"].isna()
        table, counts = (np.frombuffer(b"".join(rows.loc[is_count, c]), t) for c, t in (("keys", np.uint64), ("numbers", np.int64)))
        out: list[tuple] = []
        for block, keys, docs in rows.loc[~is_count, ["block", "keys", "numbers"]].itertuples(index=False):
            keys, docs = np.frombuffer(keys, np.uint64), np.frombuffer(docs, np.uint32)
            at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
            n = np.where(table[at] == keys, counts[at], 0) if len(table) else np.zeros(len(keys), np.int64)
            of, place = np.unique(docs, return_inverse=True)
            out.append((int(block), of.astype(np.uint32).tobytes(), np.bincount(place, np.log10(n + 0.5)).tobytes(), np.bincount(place, (n > 0).astype(float)).tobytes()))
        return pd.DataFrame(out, columns=["block", "docs", "logs", "known"])

    return asked.unionByName(told).groupBy("bucket").applyInPandas(answer, "block long, docs binary, logs binary, known binary")


def score_texts(df: DataFrame, id_column: str, text: str, held_out: Column) -> DataFrame:
    """One row per row of ``df``: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = df.select(F.col(id_column).cast("long").alias("id"), held_out.alias("held"), F.col(text).alias("text"))
    train = rows.where(~F.col("held"))
    texts, size = rows.agg(F.count_if(~F.col("held")), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    vocabulary = count_words(train, "text", buckets)
    known = describe(vocabulary, texts)
    encoded = encode(rows, "text", known)
    model = df.sparkSession.sparkContext.broadcast(baum_welch(encoded, known["unigram"]))
    few = df.sparkSession.sparkContext.broadcast({k: known[k] for k in ("ends", "tokens", "base_log")})

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, symbols = np.frombuffer(batch.column(3)[i].as_buffer(), np.int64), np.frombuffer(batch.column(4)[i].as_buffer(), np.uint16)
                sums = np.frombuffer(batch.column(5)[i].as_buffer(), np.float64).reshape(3, -1)
                scores = model.value.log_likelihood(symbols, lengths)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), batch.column(2).slice(i, 1), pa.array([np.concatenate([lengths.astype(float), sums[0], sums[1] + scores, sums[2]]).tobytes()], pa.binary())], names=["block", "ids", "held", "logs"])

    scored = encoded.select("block", "ids", "held", "lengths", "symbols", "sums").mapInArrow(forward, "block long, ids array<long>, held array<boolean>, logs binary")
    parts = scored.unionByName(rare_sums(encoded, vocabulary, buckets), allowMissingColumns=True)

    def finish(_: tuple, found: pd.DataFrame) -> pd.DataFrame:
        k = few.value
        own = found["docs"].isna()
        ids, held, numbers = found.loc[own, ["ids", "held", "logs"]].iloc[0]
        lengths, base, score, seen = (x.copy() for x in np.frombuffer(numbers, np.float64).reshape(4, -1))
        for docs, logs, n in found.loc[~own, ["docs", "logs", "known"]].itertuples(index=False):
            docs, logs = np.frombuffer(docs, np.uint32), np.frombuffer(logs, np.float64)
            base[docs] += logs
            score[docs] += logs
            seen[docs] += np.frombuffer(n, np.float64)
        base += np.log10(k["ends"] + 0.5) - lengths * k["base_log"]
        return pd.DataFrame({"id": pd.array(list(ids), "Int64"), "held_out": list(held), "n_tokens": lengths.astype(np.int64), "n_known": (seen + (k["ends"] > 0)).astype(np.int64), "train_tokens": k["tokens"], "base_score": base, "score": score})

    out = parts.groupBy("block").applyInPandas(finish, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_column)
