import random

import numpy as np
from pyspark.sql import functions as F

from curatrix.llm import decontamination as d


def smith_waterman(q, w):
    h = np.zeros((len(q) + 1, len(w) + 1))
    for i in range(len(q)):
        for j in range(len(w)):
            h[i + 1, j + 1] = max(0, h[i, j] + (1 if q[i] == w[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_alignment_by_brute_force():
    rng = np.random.default_rng(0)
    items = [rng.integers(2, 8, rng.integers(1, 20)).astype(np.uint64) for _ in range(60)]
    windows = [rng.integers(2, 8, rng.integers(1, 40)).astype(np.uint64) for _ in range(60)]
    best, end = d.align(items, windows)
    for q, w, b, e in zip(items, windows, best, end, strict=True):
        assert b == smith_waterman(q, w)
        if b:
            assert smith_waterman(q, w[: e + 1]) == b


def corpus():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    common = ["the", "of", "and", "to"]
    make = lambda n: [rng.choice(common) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(n)]
    items = [make(rng.randint(12, 40)) for _ in range(20)] + [["short"], ["two", "words"]]
    docs, leaks = [], set()
    for i in range(150):
        text = make(rng.randint(30, 200))
        if i % 3 == 0:
            k = rng.randrange(20)
            passage = [w if rng.random() > 0.08 else "edited" for w in items[k]]
            at = rng.randrange(len(text))
            text[at:at] = passage
            leaks.add((i, k))
        docs.append((i, " ".join(text).replace("w1", "W1")))
    docs.append((150, "a SHORT text"))
    docs.append((151, "has two words"))
    leaks |= {(150, 20), (151, 21)}
    return items, docs, leaks


def test_planted_leaks_are_found_and_others_are_not(spark):
    items, docs, leaks = corpus()
    tests = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for item_bytes in (d.ITEM_BYTES, 500):
        found = d.scan(df, "text", tests, "item_id", "text", item_bytes=item_bytes).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*").collect()
        assert {(r.doc_id, r.item_id) for r in found} == leaks
        texts = {i: t.lower().split() for i, t in docs}
        for r in found:
            assert r.score * len(items[r.item_id]) == smith_waterman(items[r.item_id], texts[r.doc_id][r.start : r.end])
            assert abs(r.score * len(items[r.item_id]) - smith_waterman(items[r.item_id], texts[r.doc_id])) < 1e-6


def test_a_passage_in_many_documents_is_still_found(spark):
    items, docs, _ = corpus()
    rows = [(i, docs[i % 100][1] + " " + " ".join(items[0])) for i in range(300)]
    tests = spark.createDataFrame([(0, " ".join(items[0]))], "item_id long, text string")
    found = d.scan(spark.createDataFrame(rows, "doc_id long, text string"), "text", tests, "item_id", "text")
    assert found.where("array_max(transform(leaks, x -> x.score)) = 1").count() == 300


def test_odd_rows(spark, odd_docs):
    tests = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (None, "word1 word2 word3 word4"), (3, "one")], "item_id long, text string")
    out = d.scan(odd_docs, "text", tests, "item_id", "text")
    assert out.count() == odd_docs.count() and out.columns == [*odd_docs.columns, "leaks"]
    assert {r.doc_id for r in out.where("size(leaks) > 0").collect()} == {1, 2, 3, 7, None}
    assert len(out.where("doc_id = 7").first().leaks) == 2
    none = odd_docs.where(F.lit(False))
    assert d.scan(none, "text", tests, "item_id", "text").count() == 0
    assert d.scan(odd_docs, "text", tests.where(F.lit(False)), "item_id", "text").where("size(leaks) > 0").count() == 0


def test_items_that_stand_only_as_edited_copies_are_found(spark):
    rng = random.Random(4)
    make = lambda n, of: [f"{of}{rng.randrange(3000)}" for _ in range(n)]
    items, docs, want = [], [], set()
    for k in range(60):
        item = make(rng.randint(24, 48), "w")
        every, part = (4, 5, 6, 0, 0)[k % 5], (0, 0, 0, 0.2, 0.25)[k % 5]
        copy = [f"e{rng.randrange(3000)}" if (every and i % every == every - 1) or rng.random() < part else w for i, w in enumerate(item)]
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(make(50, "x") + copy + make(50, "x"))))
        if any(all(a == b for a, b in zip(item[i : i + d.SEED], copy[i : i + d.SEED])) for i in range(len(item) - d.SEED + 1)) and smith_waterman(item, copy) >= d.MIN_SCORE * len(item):
            want.add((k, k))
    assert len(want) >= 58
    docs += [(100 + i, " ".join(make(150, "x"))) for i in range(20)]
    tests, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    found = d.scan(df, "text", tests, "item_id", "text").select("doc_id", F.explode("leaks.item_id").alias("item")).collect()
    assert {(r.doc_id, r.item) for r in found} == want


def test_no_window_that_reaches_the_score_is_left_out(monkeypatch):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 6, n))
    items = d.Items(list(range(30)), [text(rng.integers(4, 25)) for _ in range(30)])
    seeds = items.seeds({(n, int(h)): 1 for n, k in items.keys().items() for h in k})
    words = d.Words(d.pa.array([text(n) for n in rng.integers(0, 80, 40)]))
    for min_score in (0.3, 0.7, 0.9):
        found = d.find(items, seeds, words, min_score)
        monkeypatch.setattr(d, "_HITS", 50)
        assert sorted(d.find(items, seeds, words, min_score)) == sorted(found) != []
        monkeypatch.setattr(d.Items, "shared", lambda self, which, *_: np.full(len(which), 10**6))
        assert sorted(d.find(items, seeds, words, min_score)) == sorted(found)
        monkeypatch.undo()


def test_an_item_is_found_as_often_as_a_text_holds_it(spark):
    rng = random.Random(8)
    make = lambda n, of: [f"{of}{rng.randrange(5000)}" for _ in range(n)]
    items = [make(30, "w"), make(12, "v")]
    docs, want = [], []
    for i in range(40):
        text, places = make(rng.randint(0, 60), "x"), []
        for _ in range(rng.randint(0, 4)):  # some right behind each other
            k = rng.randrange(2)
            places.append((i, k, len(text), len(text) + len(items[k])))
            text += items[k] + make(rng.choice([0, 0, 3, 40, 200]), "x")
        docs.append((i, " ".join(text)))
        want += places
    tests, df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    found = d.scan(df.withColumn("LEAKS", F.lit(1)), "text", tests, "item_id", "text")
    assert found.columns == ["doc_id", "text", "leaks"]
    got = found.select("doc_id", F.explode("leaks").alias("l")).collect()
    assert sorted((r.doc_id, r.l.item_id, r.l.start, r.l.end) for r in got) == sorted(want) and all(r.l.score == 1 for r in got)


def test_of_passages_that_overlap_the_better_stays():
    rows = [(0, 1, 0.5, 0, 10), (0, 1, 0.9, 8, 20), (0, 1, 0.4, 20, 30), (0, 2, 0.3, 0, 10), (1, 1, 0.3, 0, 10)]
    assert sorted(d._apart(rows)) == sorted(rows[1:])
