import math
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from curatrix.llm import common, quality


def corpus(spark, n=400):
    rng = random.Random(5)
    clean = ["river", "stone", "walked", "under", "morning", "light", "quiet", "road", "home", "again"]
    rows, labels = [], []
    for i in range(n):
        good = i % 5 > 0
        words = rng.choices(clean, k=rng.randint(20, 60))
        text = " ".join(words) + "." if good else rng.choice([" ".join(w.upper() + "!!" for w in words), " ".join([words[0]] * 50), " ".join(w + "***" for w in words)])
        rows.append((i, text))
        if i % 3 == 0:
            labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_junk_goes_and_clean_text_stays(spark):
    docs, labels = corpus(spark)
    got = {r.doc_id: r.selected for r in quality.resample(docs, "text", "doc_id", labels).collect()}
    clean, junk = [got[i] for i in got if i % 5], [got[i] for i in got if not i % 5]
    assert sum(clean) >= 0.98 * len(clean) and sum(junk) <= 0.05 * len(junk)


def test_k_rows_are_those_of_largest_keys(spark):
    docs, labels = corpus(spark)
    out = quality.resample(docs, "text", "doc_id", labels, k=37)
    rows = sorted(out.collect(), key=lambda r: -r.key)
    assert [r.selected for r in rows] == [True] * 37 + [False] * (len(rows) - 37)


def test_log_ratio_by_brute_force(spark):
    docs, labels = corpus(spark, 60)
    sample = quality.labelled_sample(labels, "doc_id", "quality", 1000)
    ratio, share = quality.train(docs, "text", "doc_id", sample)
    good = {r.id: r.good for r in sample.collect()}
    assert math.isclose(share, sum(good.values()) / len(good))
    import numpy as np

    counts = np.zeros((2, 2 * quality.BUCKETS))
    texts = {r.doc_id: r.text for r in docs.collect()}
    each = {i: quality.features(pa.array([t]))[0] for i, t in texts.items()}
    assert [len(f) for f in each.values()] == [len(plain_features(t)) for t in texts.values()]
    for i, f in each.items():
        np.add.at(counts[0], f, 1)
        if good.get(i) == 1:
            np.add.at(counts[1], f, 1)
    b = int(counts[1].argmax())
    s = slice(0, quality.BUCKETS) if b < quality.BUCKETS else slice(quality.BUCKETS, None)
    raw = (counts[0, s] + 0.5) / (counts[0, s] + 0.5).sum()
    target = (counts[1, s] + 0.5 * raw * quality.BUCKETS) / (counts[1, s].sum() + 0.5 * quality.BUCKETS)
    assert math.isclose(ratio[b], math.log(target[b % quality.BUCKETS] / raw[b % quality.BUCKETS]), rel_tol=1e-9)
    got = {r.doc_id: r.log_ratio for r in quality.score(docs, "text", ratio).collect()}
    assert all(math.isclose(got[i], ratio[f].sum(), abs_tol=1e-6) for i, f in each.items())


def plain_features(text):
    """(stream, n, n-gram) of a text, by its words as strings."""
    raw = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lower = [re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), w) for w in raw]
    shapes = []
    for i, w in enumerate(raw):
        signs = "".join("A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "a" if "a" <= c <= "z" or ord(c) > 127 else c for c in w)
        shapes.append((re.sub(r"([Aa0])\1+", r"\1", signs), i > 0 and lower[i] == lower[i - 1]))
    out = []
    for stream, (words, sizes) in enumerate(((lower, (1, 2)), (shapes, (1, 2, 3)))):
        for n in sizes:
            out += [(stream, n, tuple(words[i : i + n])) for i in range(len(words) - n + 1)]
    return out


def test_features_are_those_of_plain_strings():
    rng = random.Random(2)
    pieces = ["a", "B", "Ab", "7", "42", "é", "!", "--", "xY9", "word", "Word", "WORD"]
    texts = [" ".join("".join(rng.choices(pieces, k=rng.randint(1, 3))) for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["", None, " \t\n "]
    bucket, of = quality.features(pa.array(texts))
    of_gram, grams_of, clashes = {}, {}, 0
    for d, t in enumerate(texts):
        want = plain_features(t)
        got = bucket[of == d].tolist()
        assert len(got) == len(want)
        for b, g in zip(got, want, strict=True):  # both go by stream, then n, then place
            assert of_gram.setdefault(g, b) == b and (b >= quality.BUCKETS) == (g[0] == 1)
            clashes += grams_of.setdefault(b, g) != g
    assert len(of_gram) > 2000 and len(set(of_gram.values())) > 0.85 * len(of_gram) and clashes


def test_noise_is_gumbel_and_choice_follows_importance(spark):
    ids = spark.range(20_000)
    x = sorted(r[0] for r in ids.select(quality.gumbel("id", 3)).collect())
    for p in (0.05, 0.25, 0.5, 0.75, 0.95):  # quantiles: -log(-log p)
        assert abs(x[int(p * len(x))] + math.log(-math.log(p))) < 0.05
    # Of two rows, the one that is thrice as important is chosen three times of four.
    pairs = ids.select("id", F.when(F.col("id") % 2 == 0, math.log(3.0)).otherwise(0.0).alias("r"), (F.col("id") / 2).cast("long").alias("pair"))
    won = pairs.select("pair", "id", (F.col("r") + quality.gumbel("id", 5)).alias("key")).groupBy("pair").agg(F.max_by("id", "key").alias("best")).where("best % 2 = 0").count()
    assert abs(won / 10_000 - 0.75) < 0.02


def test_the_number_of_rows_chosen(spark):
    ratios = [(i, [-3.0, 0.0, 0.5, 4.0, 60.0][i % 5]) for i in range(200)]
    scored = spark.createDataFrame(ratios, "doc_id long, log_ratio double")
    for share in (0.1, 0.7, 1.0):
        got = quality.choose(scored, "doc_id", share, None, 29).where("selected").count()
        assert got == round(sum(min(1.0, share * math.exp(min(r, 50))) for _, r in ratios))
    assert quality.choose(scored, "doc_id", 0.5, 0, 29).where("selected").count() == 0
    assert quality.choose(scored, "doc_id", 0.5, 500, 29).where("selected").count() == 200


def test_columns_of_the_results_names_are_replaced(spark):
    docs, labels = corpus(spark, 40)
    odd = docs.select("*", F.lit("x").alias("KEY"), F.lit(1).alias("log_ratio"), F.lit(2).alias("selected"), F.lit(3).alias("good"), F.lit(4).alias("id"))
    out = quality.resample(odd, "text", "doc_id", labels)
    assert out.columns == ["doc_id", "text", "good", "id", "log_ratio", "key", "selected"]
    plain = quality.resample(docs, "text", "doc_id", labels)
    assert sorted((r.doc_id, r.key) for r in out.collect()) == sorted((r.doc_id, r.key) for r in plain.collect())


def test_kth_largest(spark):
    keys = spark.createDataFrame([(x,) for x in [5, 5, 5, -7, 10**12, 0, None]], "key long")
    assert [common.kth_largest(keys, k) for k in (1, 2, 4, 5, 6)] == [10**12, 5, 5, 0, -7]
    assert common.kth_largest(keys, 7) is None
    assert common.kth_largest(keys, 0) == 10**12 + 1


def test_some_by_hash(spark):
    df = spark.range(1000)
    assert common.some_by_hash(df, "id", 137).count() == 137
    assert common.some_by_hash(df, "id", 2000).count() == 1000
    assert sorted(common.some_by_hash(df, "id", 9).collect()) == sorted(common.some_by_hash(df.repartition(7), "id", 9).collect())


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (7, None)], "doc_id long, quality int")
    out = quality.resample(odd_docs, "text", "doc_id", labels)
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    assert all(r.log_ratio == 0 for r in rows if not (r.text or "").strip())
    assert len({r.selected for r in rows if r.doc_id == 8}) == 1
    none = odd_docs.where(F.lit(False))
    assert quality.resample(none, "text", "doc_id", labels).count() == 0
    assert quality.resample(odd_docs, "text", "doc_id", labels.where(F.lit(False))).count() == odd_docs.count()
