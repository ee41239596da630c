import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import hmm
from curatrix.llm.queries import in_part


def tiny_model(states=2):
    rng = np.random.default_rng(1)
    emit = rng.random((states, hmm.WIDTH))
    return hmm.Model(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), emit / emit.sum(1, keepdims=True))


@pytest.mark.parametrize("segment", [1, 2, 3, 128])
def test_likelihood_sums_over_all_paths(monkeypatch, segment):
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    m = tiny_model()
    texts = [[5], [1, 2], [3, 3, 9, 1], [7, 0, 7, 2, 5], [8] * 7]
    symbols, lengths = np.concatenate(texts).astype(np.uint16), np.array([len(t) for t in texts])
    for t, got in zip(texts, m.log_likelihood(symbols, lengths), strict=True):
        total = 0.0
        for path in itertools.product(range(2), repeat=len(t)):
            p = m.start[path[0]] * m.emit[path[0], t[0]]
            for k in range(1, len(t)):
                p *= m.step[path[k - 1], path[k]] * m.emit[path[k], t[k]]
            total += p
        assert math.isclose(got, math.log10(total), rel_tol=1e-10)


@pytest.mark.parametrize("segment, held", [(1, 4096), (2, 2), (3, 1), (128, 4096)])
def test_expected_counts_sum_over_all_paths(monkeypatch, segment, held):
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    monkeypatch.setattr(hmm, "_HELD_SEGMENTS", held)
    m = tiny_model()
    texts = [[5, 2], [1, 2, 3], [3], [4, 4, 0, 6, 1, 2, 9]]
    out = m.counts(np.concatenate(texts).astype(np.uint16), np.array([len(t) for t in texts]))
    want = np.zeros_like(out)
    for t in texts:
        weights = {}
        for path in itertools.product(range(2), repeat=len(t)):
            p = m.start[path[0]] * m.emit[path[0], t[0]]
            for k in range(1, len(t)):
                p *= m.step[path[k - 1], path[k]] * m.emit[path[k], t[k]]
            weights[path] = p
        total = sum(weights.values())
        for path, p in weights.items():
            want[-1, path[0]] += p / total
            for k, s in enumerate(path):
                want[t[k], s] += p / total
                if k:
                    want[hmm.WIDTH + path[k - 1], s] += p / total
    assert np.allclose(out, want)


def test_long_texts_are_worked_on_whole():
    m, rng = tiny_model(), np.random.default_rng(6)
    lengths = np.array([1, 700, 128, 129, 5000, 3, 256])
    symbols = rng.integers(0, 60, lengths.sum()).astype(np.uint16)
    got, counts = m.log_likelihood(symbols, lengths), m.counts(symbols, lengths)
    want, at = [], 0
    expected = np.zeros_like(counts)
    for n in lengths:
        s = symbols[at : at + n]
        at += n
        alphas, total = [], 0.0
        for t in range(n):
            a = (m.start if t == 0 else alphas[-1] @ m.step) * m.emit[:, s[t]]
            total += math.log10(a.sum())
            alphas.append(a / a.sum())
        want.append(total)
        beta = np.ones(2)
        for t in range(n - 1, -1, -1):
            g = alphas[t] * beta
            expected[s[t]] += g / g.sum()
            if t:
                back = m.emit[:, s[t]] * beta
                xi = alphas[t - 1][:, None] * m.step * back[None, :]
                expected[hmm.WIDTH : -1] += xi / xi.sum()
                beta = m.step @ back
                beta /= beta.sum()
            else:
                expected[-1] += g / g.sum()
    assert np.allclose(got, want, rtol=1e-10) and np.allclose(counts, expected, atol=1e-8)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 300, 40)
    symbols = np.concatenate([rng.integers(0, 50, n) + 50 * (k % 2) for k, n in enumerate(lengths)]).astype(np.uint16)
    unigram = (np.bincount(symbols, minlength=hmm.WIDTH) + 1e-3) / (len(symbols) + 1e-3 * hmm.WIDTH)
    m = hmm.Model.random(unigram, 3)
    logs = []
    for _ in range(8):
        logs.append(m.log_likelihood(symbols, lengths).sum())
        m = m.updated(m.counts(symbols, lengths), unigram)
    # Counts lean on priors a little, so that a late round may lose what those gain.
    assert all(b > a - 0.5 for a, b in zip(logs, logs[1:], strict=False))
    words = np.log10(unigram[symbols]).sum()
    assert logs[-1] > logs[0] + 100 and logs[-1] > words + 100


def test_classes_are_of_endings():
    words = hmm.Words(hmm.pa.array(["walking talking ng g sing é xé a", "", None]))
    kind = (hmm.keys_of(words) % np.uint64(hmm.CLASSES)).tolist()
    assert kind[0] == kind[1] == kind[4] and len({kind[0], kind[2], kind[3], kind[5], kind[6], kind[7]}) == 6
    assert len(set(hmm.keys_of(words).tolist())) == 8 and len(hmm.keys_of(hmm.Words(hmm.pa.array(["", None])))) == 0


def test_buckets_grow_with_the_corpus(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = []
    count = hmm.count_words
    monkeypatch.setattr(hmm, "count_words", lambda train, text, buckets: made.append(buckets) or count(train, text, buckets))
    base = sorted((r.doc_id, round(r.base_score, 6), r.n_known) for r in hmm.score_texts(docs, "doc_id", "text", in_part("doc_id", 5, 1)).collect())
    monkeypatch.setattr(hmm, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(hmm, "KNOWN_WORDS", 500)
    assert sorted((r.doc_id, round(r.base_score, 6), r.n_known) for r in hmm.score_texts(docs, "doc_id", "text", in_part("doc_id", 5, 1)).collect()) == base
    assert made[0] == 4 and made[1] > 20


def brute(rows, parts, part):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % parts == part
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return sorted(((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows), key=repr)


def test_base_score_by_brute_force(spark, odd_docs, sf_dir, monkeypatch):
    for known in (hmm.KNOWN_WORDS, 50):  # with 50, nearly all words go through their buckets
        monkeypatch.setattr(hmm, "KNOWN_WORDS", known)
        for docs in (odd_docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
            rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
            out = hmm.score_texts(docs, "doc_id", "text", in_part("doc_id", 5, 1)).collect()
            got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=repr)
            assert got == brute(rows, 5, 1)
            assert all(math.isfinite(r.score) and r.score < 0 for r in out)


def test_held_out_texts_are_likelier_than_under_words_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = hmm.score_texts(docs, "doc_id", "text", in_part("doc_id", 5, 1)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_no_rows_or_no_training_rows(odd_docs):
    none = odd_docs.where(F.lit(False))
    assert hmm.score_texts(none, "doc_id", "text", in_part("doc_id", 5, 1)).count() == 0
    rows = hmm.score_texts(odd_docs, "doc_id", "text", F.lit(True)).collect()
    assert len(rows) == odd_docs.count() and all(math.isfinite(r.score) and r.n_known == 0 and r.train_tokens == 0 for r in rows)
