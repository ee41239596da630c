import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curatrix.llm import bpe

ODD = ["", "it's  we're\n\n they'll'd ''s 'S a's've", "  \n x", "x \n", "　 a\xa0b", "<|endoftext|>a<|endoftext|><|endoftext|> b", "aaaaaaaaaaaa", "日本語 テスト 123４５", "🙂🙂 é ½ ²", "a\x00b\x1c c", "don't I'llx 'reb", "\t's 1's --'s '", "<|endoftext", "x" * 5000]


@pytest.fixture(scope="module")
def model(public_bpe):
    m = bpe.read_vocabulary(public_bpe) | {"classes": bpe.character_classes()}
    words = sorted(w.encode() for w in ["the", " the", "a", " a", "'s", "  ", " and", "aaaa", "é", " tests"])
    data = np.frombuffer(b"".join(words), np.uint8)
    ptr = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    ids, n = bpe.merge_words(m, data, ptr[:-1], ptr[1:])
    return m | bpe.compile_lexicon(words) | {"lexicon_ids": ids, "lexicon_ptr": np.concatenate([[0], np.cumsum(n)])}


def check(model, tokenizer, texts):
    ids, ptr = bpe.encode_block(model, pa.array(texts))
    decoded = bpe.decode_block(model, ids, ptr).to_pylist()
    for i, t in enumerate(texts):
        want = tokenizer.encode(t, add_special_tokens=False).ids
        assert ids[ptr[i] : ptr[i + 1]].tolist() == want, t
        assert decoded[i] == tokenizer.decode(want, skip_special_tokens=False)


def test_same_ids_as_the_library(model, public_bpe):
    rng = random.Random(0)
    alphabet = "aest'rvlmd  \n\t.,!12é日🙂  <|>ΩЖ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    check(model, Tokenizer.from_file(public_bpe), ODD + texts)


def test_texts_that_collide_modulo_powers_of_two(model, public_bpe):
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    texts = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    check(model, Tokenizer.from_file(public_bpe), texts + [t[:1024] for t in texts])


@pytest.mark.parametrize("collide", [lambda h: h * 0, lambda h: h % np.uint64(3), lambda h: h % np.uint64(1000)])
def test_words_that_share_a_hash_are_told_apart(model, public_bpe, monkeypatch, collide):
    hashes = bpe.span_hashes
    monkeypatch.setattr(bpe, "span_hashes", lambda *a: collide(hashes(*a)))
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab ", k=rng.randint(0, 300))) for _ in range(40)] + ["x" * 100 + "y" + "z" * 9, "x" * 100 + "w" + "z" * 9, "x" * 109 + "w"]
    check(model, Tokenizer.from_file(public_bpe), texts + ODD)


def test_words_are_held_against_their_bytes():
    data = np.frombuffer(b"abcdefghijabcdefghXjabcdefghij" + b"q" * 80 + b"q" * 79 + b"r", np.uint8)
    starts, size = np.array([0, 10, 20, 30, 110]), np.array([10, 10, 10, 80, 80])
    assert not bpe.differ(data, starts[[0, 2, 3]], size[[0, 2, 3]], starts[[0, 0, 3]])
    assert bpe.differ(data, starts[:2], size[:2], starts[[0, 0]])
    assert bpe.differ(data, starts[3:], size[3:], starts[[3, 3]])


def test_ids_that_are_no_text(model, public_bpe):
    ids = np.array([128, 128, 50256, 94, 127, 64])
    assert bpe.decode_block(model, ids, np.array([0, 3, 6])).to_pylist() == [Tokenizer.from_file(public_bpe).decode(x, skip_special_tokens=False) for x in ([128, 128, 50256], [94, 127, 64])]


def test_automaton_is_minimal_and_counts():
    words = sorted({(a + b).encode() for a in ("", "ta", "to", "be") for b in ("ps", "p", "st")})
    lexicon = bpe.compile_lexicon(words)
    data, ptr = np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])])
    assert bpe.look_up(lexicon, data, ptr[:-1], ptr[1:]).tolist() == list(range(len(words)))
    for other in (b"pst", b"t", b"tas", b"zz"):
        d = np.frombuffer(other, np.uint8)
        assert bpe.look_up(lexicon, d, np.array([0]), np.array([len(d)])).tolist() == [-1]
    # No two states have equal right languages.
    arcs = {}
    for key, to in zip(lexicon["arc"].tolist(), lexicon["to"].tolist(), strict=True):
        arcs.setdefault(key // 256, []).append((key % 256, to))
    states = [(bool(f), tuple(arcs.get(i, []))) for i, f in enumerate(lexicon["final"])]
    assert len(set(states)) == len(states)


def test_operator(odd_docs, public_bpe):
    tokenizer = Tokenizer.from_file(public_bpe)
    out = bpe.encode_decode(odd_docs, "text", public_bpe, words=3)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and out.columns[: len(odd_docs.columns)] == odd_docs.columns
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(r.ids) // 4 and r.decoded == (r.text or "")
    assert bpe.encode_decode(odd_docs.where(F.lit(False)), "text", public_bpe).count() == 0
    again = bpe.encode_decode(out.select("doc_id", "text", "n_tokens", F.lit("x").alias("IDS")), "text", public_bpe, words=0)
    assert again.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    assert sorted((r.n_tokens, bytes(r.ids)) for r in again.collect()) == sorted((r.n_tokens, bytes(r.ids)) for r in rows)
