import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from curatrix.llm import queries, toxicity
from curatrix.llm.queries import in_part

BAD = ["dreadful", "wretched", "horrible", "vile"]


def corpus(spark, n=1500):
    rng = random.Random(8)
    clean = ["".join(rng.choice("bcdfgh") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(clean, k=rng.randint(10, 150))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2 + len(words) // 40):
                w = rng.choice(BAD)
                if i % 12 == 0:  # a misspelling: one letter is another, so most runs of letters stay
                    k = rng.randrange(1, len(w) - 1)
                    w = w[:k] + "x" + w[k + 1 :]
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_misspellings(spark):
    docs, labels = corpus(spark)
    held = in_part("doc_id", 4, 2)
    model = toxicity.fit(*toxicity.training_examples(docs, "text", "doc_id", labels, "toxic", ~held))
    out = toxicity.score(docs.join(labels, "doc_id"), "text", model).where(held).collect()
    assert all(0 <= r.score <= 1 for r in out)
    toxic, clean = [r.score >= 0.3 for r in out if r.toxic], [r.score >= 0.3 for r in out if not r.toxic]
    assert np.mean(toxic) >= 0.8 and np.mean(clean) <= 0.1
    never = ["dreadfull wretchedd " + "bacada " * 3, "vvile horribble bacada"]
    plain = ["bacada " * 5, "facade"]
    scores = toxicity.score_block(model, pa.array(never + plain))
    assert scores[:2].min() > scores[2:].max()


def test_held_out_labels_are_not_read(spark):
    docs, labels = corpus(spark, 120)
    held = in_part("doc_id", 4, 2)
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.training_examples(docs, "text", "doc_id", x, "toxic", ~held) for x in (labels, turned))
    assert sorted(map(tuple, a[0].collect())) == sorted(map(tuple, b[0].collect())) and a[1] == b[1]


def read(examples):
    """Blocks of examples as (words in each window, toxic, texts' first windows)."""
    batch = examples.toArrow().combine_chunks().to_batches()[0]
    return [toxicity.Block(batch, i) for i in range(batch.num_rows)]


def test_windows_cut_whole_texts():
    words = toxicity.Words(pa.array(["a " * 100, "", "b", None, "c " * 1000]))
    window, first = toxicity.windows_of(words)
    assert np.diff(first).tolist() == [2, 1, 1, 1, 25]
    sizes = np.bincount(window, minlength=first[-1])
    assert sizes.sum() == 1101 and sizes[first[4] :].min() == sizes[first[4] :].max() == 40


def test_a_word_counts_once_in_a_window():
    model = (np.full(toxicity.BUCKETS, 1.0), 0.0)
    once, often = toxicity.score_block(model, pa.array(["z", "z " * 30]))
    assert once == often


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (4, 0), (8, 1), (9, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(*toxicity.training_examples(odd_docs, "text", "doc_id", labels, "toxic", F.lit(True)))
    out = toxicity.score(odd_docs, "text", model).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if not (r.text or "").strip()}) == 1
    assert toxicity.score(odd_docs.where(F.lit(False)), "text", model).count() == 0
    for some in (labels.where("toxic = 1"), labels.where(F.lit(False))):
        model = toxicity.fit(*toxicity.training_examples(odd_docs, "text", "doc_id", some, "toxic", F.lit(True)))
        assert np.isfinite(toxicity.score_block(model, pa.array(["x", None]))).all()


def test_all_windows_of_a_long_text_train(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(2000))), (2, "b c"), (3, " ".join(f"v{i}" for i in range(400)))], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    examples, share = toxicity.training_examples(docs, "text", "doc_id", labels, "toxic", F.lit(True))
    found = sorted((int(b.toxic[f]), int(n), int((np.bincount(b.window)[f : f + n]).sum())) for b in read(examples) for f, n in zip(b.first[:-1], np.diff(b.first), strict=True))
    assert found == [(0, 1, 2), (0, 10, 400), (1, 50, 2000)] and abs(share - 1 / 3) < 1e-9


def test_words_train_whole(spark):
    word = "字" * 300 + "end"
    docs, labels = spark.createDataFrame([(1, f"a {word}"), (2, "b")], "doc_id long, text string"), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    size = max(int(b.per_word.max()) for b in read(toxicity.training_examples(docs, "text", "doc_id", labels, "toxic", F.lit(True))[0]))
    n = len(f"<{word}>".encode())
    assert size == 1 + sum(n - k + 1 for k in (3, 4, 5))


def test_repeated_ids_train_once(spark):
    docs = spark.createDataFrame([(1, "b b"), (1, "a"), (1, "b b"), (2, "c"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    found = read(toxicity.training_examples(docs, "text", "doc_id", labels, "toxic", F.lit(True))[0])
    assert sum(len(b.first) - 1 for b in found) == 2 and sum(len(b.per_word) for b in found) == 1


def test_slope_is_that_of_the_loss(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BUCKETS", 64)
    docs, labels = corpus(spark, 12)
    block = read(toxicity.encode_texts(docs.join(labels, "doc_id").select(F.col("toxic").alias("label"), F.col("text").alias("body")).coalesce(1), 1.5))[0]
    rng = np.random.default_rng(0)
    block.bucket = block.bucket % 64
    x = [rng.normal(0, 0.3, (4, 64)), rng.normal(0, 1, (4, 2)), rng.normal(0, 1, 2)]
    value, slope = block.slope(*x)
    for part, at, place in ((0, (1, 5), 64 + 5), (0, (3, 63), 255), (1, (2, 1), 256 + 5), (2, (1,), 256 + 8 + 1)):
        y = [p.copy() for p in x]
        y[part][at] += 1e-6
        assert abs((block.slope(*y)[0] - value) / 1e-6 - slope[place]) < 1e-2 * max(1, abs(slope[place]))


def test_query_has_the_contract_columns(spark, sf_dir):
    rows = queries.op10_toxicity(spark, sf_dir).collect()
    docs = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in rows)
