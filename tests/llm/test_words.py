import random

import numpy as np
import pyarrow as pa

from curatrix.llm.words import Words, blocks, span_hashes

TEXTS = ["Hello  wörld\tfoo", "", None, "foo", "x hello wörld foo  ", "  ", " a b\x0bc", "end"]


def test_words_are_those_of_bytes_split():
    words = Words(pa.array(TEXTS))
    want = [(t or "").encode().lower().split() for t in TEXTS]
    assert [words.word(i) for i in range(len(words))] == [w for ws in want for w in ws]
    assert words.counts.tolist() == [len(w) for w in want]


def test_equal_words_and_only_they_have_equal_hashes():
    rng = random.Random(0)
    texts = [" ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(50)) for _ in range(100)]
    words = Words(pa.array(texts))
    of = {}
    for i, h in enumerate(words.hashes.tolist()):
        assert of.setdefault(words.word(i), h) == h
    assert len(set(of.values())) == len(of)


def test_ngrams_of_short_texts():
    words = Words(pa.array(["a b c d e f", "a b", "", "b c d e f"]))
    h, at, ptr = words.ngrams(5)
    assert np.diff(ptr).tolist() == [2, 1, 0, 1]
    assert h[1] == h[3]
    assert np.diff(words.ngrams(5, short=False)[2]).tolist() == [2, 0, 0, 1]


def test_long_words_and_offsets():
    big = "z" * 1_200_000
    words = Words(pa.array(["a " + big, big]).slice(1))
    other = Words(pa.array(["a " + big, big]))
    assert words.hashes[0] == other.hashes[1] == other.hashes[2]


def test_blocks_keep_all_rows():
    batch = pa.record_batch([pa.array(["x" * n for n in (0, 5, 100, 3, 0, 7)]), pa.array(range(6))], ["text", "i"])
    got = list(blocks([batch, batch.slice(0, 0)], "text", 10))
    assert [i for b in got for i in b.column(1).to_pylist()] == list(range(6))
    assert all(b.num_rows == 1 or sum(map(len, b.column(0).to_pylist())) <= 10 for b in got)


def test_overlapping_spans():
    data = np.frombuffer(b"abcabc", np.uint8)
    h = span_hashes(data, np.array([0, 1, 3]), np.array([3, 4, 6]))
    assert h[0] == h[2] != h[1]


def thue_morse(n):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_texts_of_a_simple_law_do_not_collide():
    for n in (512, 1024, 2048, 4096):
        a, b = thue_morse(n)
        h = Words(pa.array([a, b])).hashes
        assert h[0] != h[1]


def test_spans_longer_than_a_step():
    rng = np.random.default_rng(0)
    big = rng.integers(97, 123, 1_700_000).astype(np.uint8)
    near = big.copy()
    near[1_500_000] ^= 1
    both = np.concatenate([big, near, big])
    n = len(big)
    h = span_hashes(both, np.array([0, 5, n, 2 * n]), np.array([n, 9, 2 * n, 3 * n]))
    assert h[0] == h[3] != h[2] and h[1] == span_hashes(big, np.array([5]), np.array([9]))[0]
