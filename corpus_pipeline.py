"""Documents made ready for training, in five stages.

Each stage takes what the one before kept, as a table, and returns the columns of documents; the last
returns token ids. Rejected by quality, all but one of each class of near copies, and documents with a
passage of the benchmark go; secrets are replaced in the text; everything else stays.

Defined cases, of each stage unless it says otherwise: an empty table gives an empty one; extra columns
stay; rows that are equal in all columns are documents each; texts of any length are read whole. What
null and empty texts and null ids come to is said with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import bpe, decontamination, neardup, quality, secrets
from curatrix.llm.common import materialize, table
from curatrix.llm.queries import public_tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects.

    Null and empty texts have importance 1, as raw text has on average; a null id has no label, and its
    noise is that of all null ids.
    """
    return quality.resample(docs, "text", "doc_id", table(spark, sf_dir, "labels")).where("selected").select(*docs.columns)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class of near copies.

    Null and empty texts are copies of each other, and so are repeated rows; rows with a null id stay.
    """
    return neardup.keep_one(docs, "doc_id", "text").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts have none."""
    found = decontamination.scan(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.where(F.size("leaks") == 0).select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced; n_chars follows the text, and is null with it."""
    model = secrets.train(secrets.samples(docs, "text"))
    clean = secrets.redact(docs, "text", model)
    return clean.withColumn("n_chars", F.char_length("text").cast("long") if "n_chars" in docs.columns else F.lit(None)).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and whether decoding gives the text again; a null text is an empty one.

    Columns: doc_id, lang, source, n_chars, n_tokens, ids and round_trip; others end here.
    """
    out = bpe.encode_decode(docs, "text", public_tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("quality", quality_stage), ("neardup", neardup_stage), ("decontamination", decontamination_stage), ("secrets", secrets_stage), ("bpe", bpe_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is a table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


#: Fitted models and Smith-Waterman scores are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
