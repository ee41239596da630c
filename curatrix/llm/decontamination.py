"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them.

A first pass counts how often every n-gram of the test items occurs in all texts; each that occurs is a
seed, frequent ones too, for an edited copy may hold no others: an edit breaks just the n-grams that are
rare. So any SEED words in a row that a copy left intact hold a seed, however often the item itself was
copied: there is no cut-off that could drop a passage. A second pass looks the seeds up in all texts;
hits on one item near one diagonal make a window, and the item is aligned with the words of the window:
1 for an equal word, -1 for another, -1 for a gap. The score is the best local alignment's part of the
item's own score; a text is contaminated from MIN_SCORE. Windows that hold too few of the item's words
for that score are not aligned. What is left of a window before and behind a passage, if it has hits,
is aligned again, so an item that a text holds several times is found each time. Hits are taken up about
_HITS at a time, whole texts together.

Both passes are maps over the texts. Test items are broadcast in blocks of about ITEM_BYTES, one pass
over the texts for each block, so a test set of any size works.

Defined cases: words are runs between white space, lower-cased in ASCII; items without words match
nothing, shorter ones than a seed have themselves as a seed; null texts are empty; equal items are
found each; repeated rows are scanned each; passages of one item don't overlap, the better one of two
that would is kept. Rows keep their other columns; ``leaks`` of the input is replaced. Words are compared
by 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.words import Words, blocks

SEED, MIN_SCORE = 3, 0.3
ITEM_BYTES = 8 << 20
_CELLS = 1 << 20
_HITS = 1 << 18
_LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))


class Items:
    """A block of test items: their words, and their n-grams as (n, hash, item, place)."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        self.ids = ids
        words = Words(pa.array(texts, pa.string()))
        self.hashes, self.ptr = words.hashes, words.ptr
        size, found = words.counts, []
        for n in range(1, SEED + 1):
            h, at, ptr = words.ngrams(n, short=False)
            item = np.repeat(np.arange(len(ids)), np.diff(ptr))
            mine = (size[item] == n) if n < SEED else np.ones(len(item), bool)
            found.append((np.full(mine.sum(), n), h[mine], item[mine], (at - words.ptr[item])[mine]))
        self.n, self.hash, self.item, self.place = (np.concatenate(x) for x in zip(*found, strict=True))

    def words(self, item: int) -> np.ndarray:
        return self.hashes[self.ptr[item] : self.ptr[item + 1]]

    def shared(self, which: np.ndarray, h: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """How many words of each item the window ``h[begin:stop]`` holds: no alignment scores more."""
        # Per word, its places in the texts in order: a window holds it if one lies inside.
        known = np.unique(self.hashes)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        here = np.flatnonzero(known[at] == h)
        here = here[np.argsort(at[here], kind="stable")]
        key = at[here] * (len(h) + 1) + here
        word = np.searchsorted(known, self.hashes)
        out, size = np.zeros(len(which), np.int64), (self.ptr[1:] - self.ptr[:-1])[which]
        low = 0
        while low < len(which):
            high = max(low + 1, int(np.searchsorted(np.cumsum(size[low:]), _CELLS, "right")) + low)
            n = size[low:high]
            pair = np.repeat(np.arange(low, high), n)
            base = word[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.ptr[which[low:high]], n)] * (len(h) + 1)
            inside = np.searchsorted(key, base + begin[pair]) < np.searchsorted(key, base + stop[pair])
            out[low:high] = np.bincount(pair[inside] - low, minlength=high - low)
            low = high
        return out

    def keys(self) -> dict[int, np.ndarray]:
        """The distinct n-grams of each n, in order."""
        return {n: np.unique(self.hash[self.n == n]) for n in range(1, SEED + 1) if (self.n == n).any()}

    def seeds(self, often: dict[tuple[int, int], int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each n: seeds in order, with item and place. ``often`` counts n-grams in the texts."""
        seed = np.array([(n, h) in often for n, h in zip(self.n.tolist(), self.hash.tolist(), strict=True)], bool)
        out = {}
        for n in range(1, SEED + 1):
            mine = np.flatnonzero(seed & (self.n == n))
            if len(mine):
                mine = mine[np.argsort(self.hash[mine], kind="stable")]
                out[n] = (self.hash[mine], self.item[mine], self.place[mine])
        return out


def count_ngrams(df: DataFrame, text: str, keys: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """How often the given n-grams occur in all texts."""
    known = df.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {n: np.zeros(len(k), np.int64) for n, k in known.value.items()}
        for block in blocks(batches, text):
            words = Words(block.column(0))
            for n, k in known.value.items():
                h, _, _ = words.ngrams(n, short=False)
                at = np.minimum(np.searchsorted(k, h), len(k) - 1)
                total[n] += np.bincount(at[k[at] == h], minlength=len(k))
        for n, t in total.items():
            full = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), n, np.int32)), pa.array(known.value[n][full].view(np.int64)), pa.array(t[full])], names=["n", "hash", "count"])

    rows = df.select(text).mapInArrow(run, "n int, hash long, count long").groupBy("n", "hash").agg(F.sum("count").alias("count"))
    return {(r["n"], r["hash"] % (1 << 64)): r["count"] for r in rows.collect()}


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The best local alignment's score of each pair, and the place in the window where it ends."""
    best, end = np.zeros(len(items)), np.zeros(len(items), np.int64)
    order = sorted(range(len(items)), key=lambda i: (len(windows[i]), len(items[i])))
    low = 0
    while low < len(order):
        high = low + 1
        while high < len(order) and (high - low + 1) * len(windows[order[high]]) <= _CELLS:
            high += 1
        pairs = order[low:high]
        wide, tall = max(len(windows[i]) for i in pairs), max(len(items[i]) for i in pairs)
        w, q = np.zeros((len(pairs), wide), np.uint64), np.ones((len(pairs), tall), np.uint64)
        for k, i in enumerate(pairs):
            w[k, : len(windows[i])], q[k, : len(items[i])] = windows[i], items[i]
        column = np.arange(wide, dtype=np.float32)
        last = np.zeros((len(pairs), wide + 1), np.float32)
        top, at = np.zeros(len(pairs), np.float32), np.zeros(len(pairs), np.int64)
        for row in range(tall):
            h = last[:, :-1] + np.where(w == q[:, row : row + 1], np.float32(1), np.float32(-1))
            np.maximum(h, last[:, 1:] - 1, out=h)
            np.maximum(h, 0, out=h)
            h = np.maximum.accumulate(h + column, axis=1) - column
            j = h.argmax(1)
            now = h[np.arange(len(pairs)), j]
            more = now > top
            top[more], at[more] = now[more], j[more]
            last[:, 1:] = h
        best[pairs], end[pairs] = top, at
        low = high
    return best, end


def find(items: Items, seeds: dict, words: Words, min_score: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, end) of what is contaminated."""
    hits, load = [], np.zeros(len(words.ptr) - 1, np.int64)
    for n, (keys, item, place) in seeds.items():
        h, at, ptr = words.ngrams(n, short=False)
        low = np.searchsorted(keys, h, "left")
        hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == h)
        low = low[hit]
        many = np.searchsorted(keys, h[hit], "right") - low
        doc = np.searchsorted(ptr, hit, "right") - 1
        np.add.at(load, doc, many)
        hits.append((doc, at[hit] - words.ptr[doc], low, many, item, place))
    out, total, begin = [], np.cumsum(load), 0
    while begin < len(load) and total[-1] > (total[begin - 1] if begin else 0):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + _HITS, "right")))
        out += _find_in(items, hits, begin, end, words, min_score)
        begin = end
    return out


def _find_in(items: Items, hits: list, low_doc: int, high_doc: int, words: Words, min_score: float) -> list[tuple[int, int, float, int, int]]:
    """What ``find`` gives, for the texts from ``low_doc`` to before ``high_doc``."""
    docs, which, shift, place_in = [], [], [], []
    for doc, at, low, many, item, place in hits:
        a, b = np.searchsorted(doc, [low_doc, high_doc])
        doc, at, low, many = doc[a:b], at[a:b], low[a:b], many[a:b]
        entry = np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)
        docs.append(np.repeat(doc, many))
        which.append(item[entry])
        place_in.append(np.repeat(at, many))
        shift.append(place_in[-1] - place[entry])
    # Each hit may be aligned with the words from ``low`` to before ``high`` of its text.
    hit = [np.concatenate(x) for x in (docs, which, shift, place_in)]
    hit += [np.zeros(len(hit[0]), np.int64), np.diff(words.ptr)[hit[0]]]
    found: list[tuple[int, int, float, int, int]] = []
    while len(hit[0]):
        order = np.lexsort((hit[2], hit[4], hit[1], hit[0]))
        hit = [x[order] for x in hit]
        window, passages = _align_hits(items, hit, (low_doc, high_doc), words, min_score)
        good = np.flatnonzero(passages[:, 0] > 0)
        found += [(int(d), int(i), float(x[0]), int(x[1]), int(x[2])) for (d, i), x in zip(np.stack([window[0], window[1]], 1)[good].tolist(), passages[good].tolist(), strict=True)]
        of = passages[window[2]]  # the passage of each hit's window
        at, low, high = hit[3], hit[4], hit[5]
        before, behind = (of[:, 0] > 0) & (at < of[:, 1]), (of[:, 0] > 0) & (at >= of[:, 2])
        low, high = np.where(behind, of[:, 2].astype(np.int64), low), np.where(before, of[:, 1].astype(np.int64), high)
        rest = before | behind
        hit = [x[rest] for x in (*hit[:4], low, high)]
    return _apart(found)


def _align_hits(items: Items, hit: list[np.ndarray], part: tuple[int, int], words: Words, min_score: float) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Windows of sorted hits (text and item of each, window of each hit), and (score, first word, end)
    of each window's passage, all 0 where there is none.
    """
    docs, which, shift, _, low, high = hit
    size = (items.ptr[1:] - items.ptr[:-1])[which]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (which[1:] != which[:-1]) | (low[1:] != low[:-1]) | (shift[1:] - shift[:-1] > size[1:])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(docs)]]) - 1
    docs, which, size = docs[first], which[first], size[first]
    slack, base = size // 2 + 2, words.ptr[docs]
    begin, stop = np.maximum(shift[first] - slack, low[first]) + base, np.minimum(shift[last] + size + slack, high[first]) + base
    out = np.zeros((len(first), 3))
    a, b = words.ptr[list(part)]
    able = np.flatnonzero(items.shared(which, words.hashes[a:b], begin - a, stop - a) >= min_score * size - 1e-6)
    h = words.hashes
    q, w = [items.words(i) for i in which[able].tolist()], [h[x:y] for x, y in zip(begin[able].tolist(), stop[able].tolist(), strict=True)]
    best, end = align(q, w)
    good = np.flatnonzero(best >= min_score * size[able] - 1e-6)
    # The alignment read backwards from its end gives its beginning.
    _, back = align([q[i][::-1] for i in good], [w[i][: end[i] + 1][::-1] for i in good])
    at = able[good]
    stopped = begin[at] + end[good] + 1 - base[at]
    out[at] = np.stack([best[good] / size[at], stopped - 1 - back, stopped], axis=1)
    return (docs, which, np.cumsum(new) - 1), out


def _apart(found: list[tuple[int, int, float, int, int]]) -> list[tuple[int, int, float, int, int]]:
    """Passages without those that overlap a better one of the same text and item."""
    kept: dict[tuple[int, int], list[tuple]] = {}
    for x in sorted(found, key=lambda x: (-x[2], x)):
        mine = kept.setdefault(x[:2], [])
        if all(x[4] <= y[3] or x[3] >= y[4] for y in mine):
            mine.append(x)
    return [x for mine in kept.values() for x in sorted(mine, key=lambda x: x[3])]


def scan(df: DataFrame, text: str, items: DataFrame, item_id: str, item_text: str, min_score: float = MIN_SCORE, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``df`` with ``leaks``: item, score, first word and end (exclusive, in words) of each leak."""
    spark = df.sparkSession
    tests = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where(F.octet_length("text") > 0)
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // item_bytes))
    out = df.drop("leaks").withColumn("leaks", F.array().cast(_LEAKS))
    for part in range(parts):
        rows = tests.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).orderBy("id", "text").collect()
        block = Items([r["id"] for r in rows], [r["text"] for r in rows])
        if not len(block.hash):
            continue
        seeds = block.seeds(count_ngrams(df, text, block.keys()))
        out = _scan_block(out, text, spark.sparkContext.broadcast((block, seeds)), min_score)
    return out


def _scan_block(df: DataFrame, text: str, known, min_score: float) -> DataFrame:
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, seeds = known.value
        for block in blocks(batches, text):
            at = block.schema.get_field_index("leaks")
            leaks = block.column(at).to_pylist()
            for doc, item, score, start, end in find(items, seeds, Words(block.column(block.schema.get_field_index(text))), min_score):
                leaks[doc].append({"item_id": items.ids[item], "score": score, "start": start, "end": end})
            columns = list(block.columns)
            columns[at] = pa.array(leaks, _LEAK)
            yield pa.RecordBatch.from_arrays(columns, names=block.schema.names)

    return df.mapInArrow(run, schema)
