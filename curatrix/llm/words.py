"""Words and their hashes for whole Arrow batches of texts, as numpy arrays.

A word is a longest run of bytes outside ``0x20, 0x09-0x0D``. Those bytes never occur inside a
multi-byte UTF-8 character, so working on bytes gives what working on characters gives. A word's
hash is made of its polynomials modulo two primes of 31 bits, found for all words at once from running
sums, and then mixed. No texts of a simple law collide, as they do modulo 2**64; two given words do
with a probability of about 2**-62 times their length.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc

#: Bytes that one running sum goes over: 2**9 * 2**31 * 2 * _STEP is below 2**64.
_STEP = 1 << 19
_PRIMES = (2147483647, 2147483629)
_ROOTS = (1103515245, 1597334677)
_GOLDEN = 0x9E3779B97F4A7C15  # an odd number without pattern
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _powers() -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime, powers of its root and of the root's inverse, made once a process."""
    if not _tables:
        for prime, root in zip(_PRIMES, _ROOTS, strict=True):
            both = []
            for r in (root, pow(root, -1, prime)):
                p = np.ones(1, np.uint64)
                while len(p) < 2 * _STEP:
                    p = np.concatenate([p, p * np.uint64(pow(r, len(p), prime)) % np.uint64(prime)])
                both.append(p)
            _tables.append((both[0], both[1]))
    return _tables


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n+1 offsets into them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``most`` bytes of text, or one longer text.

    When a task ends, its worker gives free memory back: workers live on for other stages' tasks.
    """
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, at = text_buffers(batch.column(batch.schema.get_field_index(column)))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
                yield batch.slice(low, high - low)
                low = high
    finally:
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)


class Words:
    """All words of a batch: byte spans, and the range of words of each text in ``ptr``."""

    def __init__(self, column: pa.Array, lower: bool = True):
        data, self.offsets = text_buffers(column)
        self.data = LOWER[data] if lower else data
        n = len(data)
        inside = ~SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edge = self.offsets[:-1][self.offsets[:-1] < n]
        first[edge] = inside[edge]
        edge = self.offsets[1:][self.offsets[1:] > 0] - 1
        last[edge] = inside[edge]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.ptr = np.searchsorted(self.starts, self.offsets)
        self._hashes: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    @property
    def docs(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts)

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = span_hashes(self.data, self.starts, self.ends)
        return self._hashes

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def ngrams(self, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the runs of ``n`` words, the first word of each, and the ranges of each text.

        With ``short``, a text of fewer words than ``n``, but one at least, has its whole run.
        """
        counts = self.counts
        many = np.maximum(counts - n + 1, 0)
        if short:
            many = np.where((counts > 0) & (many == 0), 1, many)
        ptr = np.concatenate([[0], np.cumsum(many)])
        at = np.arange(ptr[-1]) - np.repeat(ptr[:-1], many) + np.repeat(self.ptr[:-1], many)
        stop = np.repeat(self.ptr[1:], many)
        h, out = self.hashes, np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                w = at + k
                there = w < stop
                out = out * np.uint64(_GOLDEN) + (h[w] if there.all() else np.where(there, h[np.minimum(w, max(len(h) - 1, 0))], np.uint64(k + 1)))
        return mix(out), at, ptr


def _long_hash(data: np.ndarray) -> tuple[int, int]:
    """Both polynomials of one span that is longer than a step, piece by piece."""
    out = []
    for prime, root, (up, _) in zip(_PRIMES, _ROOTS, _powers(), strict=True):
        total = 0
        for low in range(0, len(data), _STEP):
            piece = data[low : low + _STEP]
            total += pow(root, low, prime) * int(((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)]).sum() % np.uint64(prime))
        out.append(total % prime)
    return out[0], out[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The mixed hash of each span of bytes; spans are in order of their starts and may overlap."""
    out = np.zeros(len(starts), np.uint64)
    long = ends - starts > _STEP
    for i in np.flatnonzero(long).tolist():
        a, b = _long_hash(data[starts[i] : ends[i]])
        out[i] = a << 32 | b
    ends = np.where(long, starts, ends) if long.any() else ends
    low = 0
    while low < len(starts):
        base = starts[low]
        high = max(low + 1, int(np.searchsorted(starts, base + _STEP)))
        s, e = starts[low:high] - base, ends[low:high] - base
        n = int(e.max())
        plus = data[base : base + n].astype(np.uint64) + np.uint64(1)
        run = np.zeros(n + 1, np.uint64)
        found = np.zeros(high - low, np.uint64)
        for prime, (up, down) in zip(_PRIMES, _powers(), strict=True):
            np.cumsum(plus * up[:n], out=run[1:])
            found = found << np.uint64(32) | (run[e] - run[s]) % np.uint64(prime) * down[s] % np.uint64(prime)
        out[low:high] |= np.where(long[low:high], np.uint64(0), found)
        low = high
    return mix(out)
