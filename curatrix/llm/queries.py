"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import decontamination, hmm, neardup, quality, secrets, toxicity, warc
from curatrix.llm.bpe import encode_decode
from curatrix.llm.common import materialize, table, text_or_empty
from curatrix.llm.sharding import shuffle_into_shards
from curatrix.llm.topk import top_k


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written and read again, so that all columns are exchanged, not only those that the digests need.
    out = materialize(shuffle_into_shards(table(spark, sf_dir, "documents"), 16), "sharded")
    text = text_or_empty(out)
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary"))
    return out.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    light = quality.resample(docs, "text", "doc_id", table(spark, sf_dir, "labels"), carry=["doc_id"])
    return light.select("doc_id", "log_ratio", "key", "selected")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5, "vec_id", "embedding")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.scan(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    leak = found.select("doc_id", F.explode("leaks").alias("leak"))
    return leak.select("doc_id", "leak.item_id", "leak.score", F.col("leak.start").alias("first_word"), F.col("leak.end").alias("end_word"))


def in_part(id_column: str, parts: int, part: int) -> Column:
    """Whether crc32 of an id as text leaves this remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % parts == part


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(table(spark, sf_dir, "documents"), "doc_id", "text", in_part("doc_id", 5, 1))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = secrets.scan(docs, "text", secrets.train(secrets.samples(docs, "text")))
    n = {k: secrets.count_of(F.col("spans"), k).alias(f"n_{k}") for k in secrets.KINDS}
    base = F.sha2(secrets.joined(F.col("spans"), secrets.KINDS[:3]).cast("binary"), 256)
    return out.select("doc_id", n["assign"], n["access"], n["hex"], base.alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"), n["model"])


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join_similar(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "class_id", "n_links")


def public_tokenizer(name: str) -> str:
    """The place of a public tokenizer's file, as their package gives it."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_decode(docs, "text", public_tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = in_part("doc_id", 4, 2)
    examples = toxicity.training_examples(docs, "text", "doc_id", table(spark, sf_dir, "labels"), "toxic", ~held_out)
    out = toxicity.score(docs, "text", toxicity.fit(*examples))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


OP9_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p),
r AS (SELECT *, payload_bytes >= 1000 AND last IS NOT NULL AND (page_id IS NULL OR page_id < last) AS revisit FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN last END AS refers_to FROM r
"""

OP3_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT * FROM e WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id,
             list_sum(list_transform(list_zip(q.v, e.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM q JOIN e ON q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_exact_topk": op3_exact_topk,
    "op4_decontamination": op4_decontamination,
    "op5_hmm": op5_hmm,
    "op6_secrets": op6_secrets,
    "op7_neardup": op7_neardup,
    "op8_bpe": op8_bpe,
    "op9_warc": op9_warc,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {
    "op3_exact_topk": OP3_SQL,
    "op9_warc": OP9_SQL,
}
