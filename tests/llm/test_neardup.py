import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curatrix.llm import neardup
from curatrix.llm.words import Words


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        equal = (rows[i][1] or "") == (rows[j][1] or "")
        if equal or (a and b and len(a & b) >= threshold * len(a | b) - 1e-9):
            links[i] += 1
            links[j] += 1
            parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, least[find(i)], links[i]) for i, (doc, _) in enumerate(rows))


def corpus(seed=1, groups=25):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(2000)]
    rows, line = [], " ".join(rng.choices(vocabulary, k=12))
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(3, 150))
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.01, 0.03]) else w for w in base]
            rows.append(" ".join(copy))
        if rng.random() < 0.5:
            rows.append(line + " " + rows[-1])
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("tile", [256, 2])
def test_links_and_classes_are_those_of_all_pairs(spark, tile):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.id, r.class_id, r.n_links) for r in neardup.join_similar(df, "doc_id", "text", tile=tile).collect())
    assert got == brute(rows)


def test_a_large_group_in_tiles(spark):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(200)] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.id, r.class_id, r.n_links) for r in neardup.join_similar(df, "doc_id", "text", tile=16).collect())
    want = brute(rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    # Pairs just at the threshold are found with the target recall, others with a higher one.
    assert sum(g[2] for g in got) >= 0.999 * sum(w[2] for w in want)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    rows = corpus(3, 8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.id, r.class_id, r.n_links) for r in neardup.join_similar(df, "doc_id", "text").collect()) == brute(rows)


def test_prefixes_are_shortened_until_the_recall():
    none = np.zeros(0)
    at_edge = neardup.shorten(none, 0.8)
    assert neardup.recall_of(at_edge, none, 0.8) >= 0.9995 and set(at_edge) <= {4, 5}
    longer = at_edge.copy()
    longer[longer.argmin()] += 1
    assert neardup.recall_of(longer, none, 0.8) < 0.9995
    # Links that are found easily leave prefixes longer, and dissimilar neighbours say nothing.
    easy = neardup.shorten(np.full(1000, 0.849), 0.8)
    assert easy.sum() > at_edge.sum()
    assert neardup.shorten(np.full(1000, 0.3), 0.8).tolist() == at_edge.tolist()
    assert neardup.shorten(none, 0.8, recall=0.5).min() > 5
    assert neardup.shorten(none, 0.5, trees=1, recall=0.9999).tolist() == [1]


def test_shared_levels():
    hi = np.array([0x0001000200030004, 0x0001000200030004, 0x0001000200030005, 0x0001000300030005, 0x8000000000000000], np.uint64)
    lo = np.array([0x0005000600070008, 0x0005000600090008, 0x0005000600090008, 0x0005000600090008, 0], np.uint64)
    assert neardup.shared_levels(hi, lo).tolist() == [0, 6, 3, 1, 0]
    assert neardup.shared_levels(hi[:1], lo[:1]).tolist() == [0] and len(neardup.shared_levels(hi[:0], lo[:0])) == 0


def test_signatures_agree_as_often_as_sets_do():
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        other = [w if rng.random() > 0.03 else "x" + w for w in base]
        texts += [" ".join(base), " ".join(other)]
    sig, full = neardup.signatures_of(Words(pa.array(texts)), 5, 16)
    assert full.tolist() == list(range(120)) and len(np.unique(sig[::2])) == sig[::2].size
    values = sig.view(np.uint16).reshape(120, -1)
    agree = (values[::2] == values[1::2]).mean(1)
    true = np.array([len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in zip(texts[::2], texts[1::2], strict=True)])
    assert abs((agree - true).mean()) < 0.01 and np.abs(agree - true).max() < 0.2


def test_forest_is_sorted_and_neighbours_are_sampled(spark):
    rows = corpus(7, 40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sig = neardup.signatures(df, "doc_id", "text", 5, 4)
    classes = sig.groupBy("text_key").agg(F.min("id").alias("rep"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    forest = neardup.plant(classes, 4)
    got = [(r.tree, r.hi, r.lo, r.rep) for r in forest.collect()]
    assert got == sorted(got) and len(got) == 4 * classes.where("sig IS NOT NULL").count()
    bodies = df.select(F.col("doc_id").alias("rep"), F.col("text").alias("body"))
    found = neardup.sampled_similarities(forest, bodies, 5)
    assert (found >= 0.8).sum() > 20 and found.max() <= 1
    assert 0 < len(neardup.sampled_similarities(forest, bodies, 5, most=3)) <= 3 * 7


def test_depths_come_from_all_neighbours(spark):
    rng = random.Random(13)
    rows = []
    for _ in range(800):  # more pairs than a bounded choice for each length of prefix would take
        base = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        rows += [" ".join(base), " ".join([*base, "more"]), " ".join(["x", *base[rng.randint(0, 6) :]])]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes = neardup.signatures(df, "doc_id", "text", 5, 4).groupBy("text_key").agg(F.min("id").alias("rep"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    classes = neardup.materialize(classes)
    forest = neardup.materialize(neardup.plant(classes, 4))
    stood = sorted((r.tree, r.hi, r.lo, r.rep) for r in forest.collect())
    pairs = set()
    for x, y in itertools.pairwise(stood):
        hi, lo = (np.array([x[k], y[k]]).view(np.uint64) for k in (1, 2))
        if x[0] == y[0] and neardup.shared_levels(hi, lo)[1] > 1:
            pairs.add((min(x[3], y[3]), max(x[3], y[3])))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")  # neighbours in two batches count too
    try:
        assert {(r.a, r.b) for r in neardup.neighbours(forest).collect()} == pairs
        source = df.select(F.col("doc_id").alias("rep"), F.col("text").alias("body"))
        got = neardup.neighbour_links(forest, classes, source, 5, 0.8, 4)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    sets = [shingles(t) for _, t in rows]
    true = np.array([len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs])
    assert got.tolist() == neardup.tally(neardup.schedule(4), true, 0.8).tolist() and got[:, 0].sum() == (true >= 0.8).sum() > 1000


def test_tallies_of_parts_add_up():
    true = np.random.default_rng(3).uniform(0.7, 1, 500)
    steps = neardup.schedule(16)
    whole = neardup.tally(steps, true, 0.8)
    assert (whole == neardup.tally(steps, true[:123], 0.8) + neardup.tally(steps, true[123:], 0.8)).all()
    links = true[true >= 0.8]
    assert whole[:, 0].sum() == len(links) and np.allclose(whole[:, 1:].sum(0) * neardup.UNIT, [neardup.found_with(d, links).sum() for d in steps], atol=1e-5)
    assert (neardup.first_step(whole, 0.8) == neardup.shorten(true, 0.8)).all()


def test_recall_of_links_near_the_threshold(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(150):  # a changed word breaks five n-grams of 100 to 200
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(100, 200))]
        rows.append(" ".join(base))
        for _ in range(2):
            copy = list(base)
            for _ in range(rng.randint(1, 5)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links = sum(r.n_links for r in neardup.join_similar(df, "doc_id", "text").collect())
    true = sum(r[2] for r in brute(rows))
    assert true > 300 and 0.995 * true <= links <= true
    # With a low target, prefixes stay longer and fewer are found.
    few = sum(r.n_links for r in neardup.join_similar(df, "doc_id", "text", trees=2, recall=0.3).collect())
    assert 0 < few < links


def test_long_texts_make_tiles_of_their_own(spark):
    rows = corpus(9, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.id, r.class_id, r.n_links) for r in neardup.join_similar(df, "doc_id", "text", tile_bytes=200).collect())
    assert got == brute(rows)


def test_chains_are_one_component(spark):
    n = 300
    edges = spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).union(spark.createDataFrame([(1000, 999), (999, 998)], "u long, v long"))
    got = {r.id: r.class_id for r in neardup.components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {998: 998, 999: 998, 1000: 998}
    assert neardup.components(edges.limit(0)).count() == 0


def test_pairs_of_sets():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 30, 20)).astype(np.uint64) for _ in range(30)]
    tile = np.array([0] * 15 + [1] * 15)
    i, j = neardup.similar(sets, tile, True, 0.5)
    want = {(a, b) for a in range(15) for b in range(15, 30) if len(np.intersect1d(sets[a], sets[b])) >= 0.5 * len(np.union1d(sets[a], sets[b]))}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_odd_rows(spark, odd_docs):
    got = sorted(((r.id, r.class_id, r.n_links) for r in neardup.join_similar(odd_docs, "doc_id", "text").collect()), key=repr)
    want = {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 1), 5: (4, 1), 6: (6, 0), 7: (7, 0), 9: (9, 1), 10: (9, 1), 11: (11, 0)}
    assert {r[0]: r[1:] for r in got if r[0] not in (None, 8)} == want
    assert [r for r in got if r[0] == 8] == [(8, 8, 1), (8, 8, 1)]
    assert [r for r in got if r[0] is None] == [(None, None, 0)] * 2
    kept = neardup.keep_one(odd_docs, "doc_id", "text")
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 4, 6, 7, 8, 9, 11, None, None], key=repr)
    assert kept.columns == odd_docs.columns
    none = odd_docs.where(F.lit(False))
    assert neardup.join_similar(none, "doc_id", "text").count() == neardup.keep_one(none, "doc_id", "text").count() == 0
