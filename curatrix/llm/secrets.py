"""Secret scans: fixed patterns, and tokens that look drawn at random rather than named.

The patterns find what announces itself. For the rest, character Markov models give the likelihood of
each token: two of ordinary identifiers, and one of random strings for each alphabet they are drawn
from. A token is a secret if the likeliest random model, its choice paid for, gives it a log10
likelihood greater by MIN_RATIO than both ordinary ones do.

Models are trained from labelled samples. Ordinary, for one model: every run of token characters of all
texts, outside what the patterns find, long ones and real secrets among them; for the other, so that
names that a corpus lacks aren't secrets there: WORDS, of which identifiers are made. Random: DRAWN strings of each alphabet,
drawn with a fixed seed, and what the patterns for keys and digests found in the corpus; assigned values
are no sample, as they may be names. Counts of character pairs are summed across partitions; the driver
gets tables of fixed size. An ordinary pair's probability leans by LEAN counts on what a pair's letters,
case aside, and the kinds of both characters say, so a rare string doesn't become ordinary by itself.

A token is a run of MIN_TOKEN token characters or more that overlaps no pattern's span.

Defined cases: a null or empty text has no spans; texts of any length are scanned whole; a corpus
without words leaves the ordinary model to its priors. Rows keep their other columns; ``spans`` of the
input is replaced.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.words import blocks, text_buffers

# fixed values: the kinds of secrets, as given
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")

MIN_TOKEN, MIN_RATIO = 10, 8.0
DRAWN, DRAWN_LENGTH, LEAN = 2000, 32, 200.0
_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
#: Characters of the models: letters, digits and the signs of base64 and names; 0 stands for an edge.
SIGNS = "+/_=-"
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + SIGNS
_CODE = np.zeros(256, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET)) + 1
SIZE = len(ALPHABET) + 1
#: What random strings are drawn from.
DRAWN_FROM = {
    "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "lower": string.ascii_lowercase, "upper": string.ascii_uppercase, "letters": string.ascii_letters,
    "lower36": string.ascii_lowercase + string.digits, "upper36": string.ascii_uppercase + string.digits, "all62": string.ascii_letters + string.digits,
    "base64": string.ascii_letters + string.digits + "+/", "url64": string.ascii_letters + string.digits + "-_",
}
#: Ordinary words of identifiers, a labelled sample.
WORDS = """
abstract access action active admin after amount append array async author available background balance begin between binary border browser buffer
button bytes calendar cancel channel character children class client cloud collection color command comment company compare config connection
container content control convert count country currency current database default delivery description detail device dictionary digest display
document download driver editor element enable encode entity environment event example execute expire extension external feature field folder format
frame function general global handler header height helper hidden image index input instance integer internal invoice iterator journal label language
layout length library limit list listener location logger machine manager margin master memory message minimum mobile module monitor name network
notification number offset operation order output page panel parent parser path pattern permission phone plugin policy prefix primary private process
profile project provider proxy quality query random range reference region release remote report request response result role root schedule schema
screen script second section select sequence service session shape share size source standard start status storage stream string submit summary symbol
system target task test text time title total track transfer translation trigger type update upload
""".split()
_ORDINARY, _SAMPLES = 0, {"access": "upper36", "hex": "hex"}
#: Characters fall into edges, small and capital letters, digits and signs; what each step between two kinds leans on.
_KIND = np.repeat([0, 1, 2, 3, 4], [1, 26, 26, 10, len(SIGNS)])
_STEPS = np.array([[0, 70, 20, 8, 2], [0, 92, 3, 1, 4], [0, 60, 35, 2, 3], [0, 3, 2, 85, 10], [0, 60, 15, 20, 5]], float)


def base_spans(text: str) -> list[tuple[int, str, int, int, int]]:
    """(start, kind, end, start and end of the value) of what the patterns find."""
    found = []
    if "=" in text or ":" in text:  # no assignment is without them
        found += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def pair_counts(raw: bytes) -> np.ndarray:
    """Counts of pairs of characters of the alphabet; any other character is an edge."""
    code = np.concatenate([[0], _CODE[np.frombuffer(raw, np.uint8)], [0]])
    return np.bincount(code[:-1] * SIZE + code[1:], minlength=SIZE * SIZE)


def _spread(own: np.ndarray, prior: np.ndarray, lean: float) -> np.ndarray:
    """Rows of probabilities: counts that lean on a prior distribution; no step leads to an edge."""
    counts = own + lean * prior
    counts[:, 0] = 0
    return counts / np.maximum(counts.sum(1, keepdims=True), 1e-300)


def ordinary(counts: np.ndarray) -> np.ndarray:
    """P(next | character) of ordinary identifiers."""
    inner = counts.copy()
    inner[:, 0] = 0
    steps = _STEPS * LEAN / 20
    np.add.at(steps, (_KIND[:, None], _KIND[None, :]), inner)
    steps /= steps.sum(1, keepdims=True)
    # What follows within its kind: a letter by the letter before, case aside, others by themselves.
    folded = inner[:, 1:27] + inner[:, 27:53]
    pairs = folded[1:27] + folded[27:53] + 0.5
    first = folded[[0, *range(53, SIZE)]].sum(0) + 0.5
    within = np.tile(first / first.sum(), (SIZE, 1))
    within[1:53] = np.tile(pairs / pairs.sum(1, keepdims=True), (2, 1))
    signs = inner[:, 63:].sum(0) + 0.5
    all_ = np.concatenate([np.zeros((SIZE, 1)), within, within, np.full((SIZE, 10), 0.1), np.tile(signs / signs.sum(), (SIZE, 1))], axis=1)
    return _spread(inner, steps[_KIND[:, None], _KIND[None, :]] * all_, LEAN)


def named_sample() -> np.ndarray:
    """Counts of pairs in WORDS, each LEAN / 10 times, so that they outweigh what rows lean on."""
    counts = np.zeros(SIZE * SIZE)
    for word in WORDS:
        counts += pair_counts(word.encode())
    return (counts * LEAN / 10).reshape(SIZE, SIZE)


def drawn_sample(alphabet: str, seed: int) -> np.ndarray:
    """Counts of pairs in DRAWN random strings of an alphabet."""
    letters = np.frombuffer(alphabet.encode(), np.uint8)
    code = np.zeros((DRAWN, DRAWN_LENGTH + 1), np.int64)
    code[:, 1:] = _CODE[np.random.default_rng([41, seed]).choice(letters, (DRAWN, DRAWN_LENGTH))]
    return np.bincount((code[:, :-1] * SIZE + code[:, 1:]).reshape(-1), minlength=SIZE * SIZE).reshape(SIZE, SIZE)


def train(samples: DataFrame) -> np.ndarray:
    """log10 P(next | character) of the ordinary models, two tables, and of each alphabet's.

    ``samples``: label int (0: ordinary, k: the k-th alphabet's), pair int, n long.
    """
    counts = np.zeros((1 + len(DRAWN_FROM), SIZE, SIZE))
    for r in samples.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect():
        counts[r["label"]].reshape(-1)[r["pair"]] += r["n"]
    out = [ordinary(counts[_ORDINARY]), ordinary(named_sample())]
    for k, alphabet in enumerate(DRAWN_FROM.values(), 1):
        member = np.zeros(SIZE)
        member[_CODE[np.frombuffer(alphabet.encode(), np.uint8)]] = 1 / len(alphabet)
        found = counts[k]
        # Samples of the corpus count no more than drawn ones, however many they are.
        found = found * min(1.0, DRAWN * DRAWN_LENGTH / max(1.0, found.sum()))
        out.append(_spread(found + drawn_sample(alphabet, k), np.tile(member, (SIZE, 1)), float(len(alphabet))))
    return np.log10(np.maximum(np.stack(out), 1e-12))


def ratios(model: np.ndarray, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The log10 likelihood ratio of each token, given as spans of character codes."""
    if not len(starts):
        return np.zeros(0)
    size = ends - starts
    first = np.cumsum(size) - size
    now = code[np.arange(size.sum()) + np.repeat(starts - first, size)]
    before = np.concatenate([[0], now[:-1]])
    before[first] = 0
    pair = before * SIZE + now
    each = [np.add.reduceat(table[pair], first) for table in model.reshape(len(model), -1)]
    return np.maximum.reduce(each[2:]) - np.log10(len(each) - 2) - np.maximum(each[0], each[1])


def ratio(model: np.ndarray, token: str) -> float:
    """The log10 likelihood ratio of one token."""
    code = _CODE[np.frombuffer(token.encode("ascii"), np.uint8)]
    return float(ratios(model, code, np.array([0]), np.array([len(code)]))[0])


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, offsets of each, and the code of each byte."""
    data, offsets = text_buffers(column)
    return data, offsets, _CODE[data]


def samples(df: DataFrame, text: str) -> DataFrame:
    """Labelled samples as counts of pairs, a few thousand rows a task, whatever the texts."""
    labels = {KINDS.index(k): 1 + list(DRAWN_FROM).index(v) for k, v in _SAMPLES.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((1 + len(DRAWN_FROM), SIZE * SIZE), np.int64)
        for block in blocks(batches, text):
            _, offsets, code = _codes(block.column(0))
            for d, t in enumerate(block.column(0).to_pylist()):
                for start, kind, end, low, high in base_spans(t) if t else ():
                    if kind in labels:
                        counts[labels[kind]] += pair_counts(t[low:high].encode())
                    a = offsets[d] + (start if t.isascii() else len(t[:start].encode()))
                    code[a : a + len(t[start:end].encode())] = 0
            # A text's last character and the next one's first are no pair.
            pair = np.concatenate([[0], code[:-1]]) * SIZE + code if len(code) else code
            edge = offsets[:-1][offsets[:-1] < len(code)]
            pair[edge] = code[edge]
            counts[_ORDINARY] += np.bincount(pair[code > 0], minlength=SIZE * SIZE)
        label, pair = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(counts[label, pair])], names=["label", "pair", "n"])

    return df.select(text).mapInArrow(run, "label int, pair int, n long")


def find_all(column: pa.Array, model: np.ndarray, min_ratio: float) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of all spans of each text, in order."""
    texts = column.to_pylist()
    out = [base_spans(t) if t else [] for t in texts]
    data, offsets, code = _codes(column)
    inside = code > 0
    if not inside.any():
        return [[s[:3] for s in found] for found in out]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < len(code)]
    first[edge] = inside[edge]
    edge = offsets[1:][offsets[1:] > 0] - 1
    last[edge] = inside[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = ends - starts >= MIN_TOKEN
    starts, ends = starts[long], ends[long]
    random = ratios(model, code, starts, ends) > min_ratio
    for a, b in zip(starts[random].tolist(), ends[random].tolist(), strict=True):
        d = int(np.searchsorted(offsets, a, "right")) - 1
        # Bytes that begin a character, from the text's first on: its place in code points.
        low = int(((data[offsets[d] : a] & 0xC0) != 0x80).sum())
        high = low + b - a
        if all(s[1] == 3 or s[2] <= low or s[0] >= high for s in out[d]):
            out[d].append((low, 3, high, low, high))
    return [sorted(s[:3] for s in found) for found in out]


def find(text: str, model: np.ndarray, min_ratio: float = MIN_RATIO) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans of a text, in order."""
    return find_all(pa.array([text], pa.string()), model, min_ratio)[0]


def scan(df: DataFrame, text: str, model: np.ndarray, min_ratio: float = MIN_RATIO) -> DataFrame:
    """``df`` with ``spans``: kind, start and end in code points, by start and then kind as listed."""
    df = df.drop("spans")
    schema = T.StructType([*df.schema.fields, T.StructField("spans", _SPAN)])
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            found = find_all(block.column(block.schema.get_field_index(text)), model, min_ratio)
            out = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(out, span)], names=[*block.schema.names, "spans"])

    return df.mapInArrow(run, schema)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with ``mark`` for its spans; overlapping ones have one mark."""
    pieces, low = [], 0
    for a, _, b in spans:
        if a >= low:
            pieces += [text[low:a], mark]
        low = max(low, b)
    return "".join([*pieces, text[low:]])


def redact(df: DataFrame, text: str, model: np.ndarray, mark: str = "[SECRET]", min_ratio: float = MIN_RATIO) -> DataFrame:
    """``df`` with ``mark`` in place of all secrets of its texts; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            at = block.schema.get_field_index(text)
            columns = list(block.columns)
            texts, found = columns[at].to_pylist(), find_all(columns[at], model, min_ratio)
            columns[at] = pa.array([redacted(t, spans, mark) if spans else t for t, spans in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=block.schema.names)

    return df.mapInArrow(run, df.schema)


def joined(spans, kinds: tuple[str, ...] = KINDS):
    """``kind:start:end`` of the spans of these kinds, joined with commas."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans, kind: str):
    """The number of spans of one kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
