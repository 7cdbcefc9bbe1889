"""Corpus pipeline over ``documents``: five stages, each on all that its predecessor kept.

1. toxicity: documents that the multiple-instance model rejects go;
2. near duplicates: of each SimHash group the smallest doc_id stays;
3. secrets: reported spans are replaced by a mask;
4. mixing: documents are drawn with the raked probabilities;
5. SentencePiece: the piece ids of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalspark.llm import common, mixing, secrets, sentencepiece_codec, simhash, toxicity
from evalspark.llm.queries import MODEL_PATH


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose score is 0.3 or more; the model learns from the labelled training rows."""
    common.prepare(spark)
    labels = toxicity.train_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of fingerprints within 3 bits."""
    common.prepare(spark)
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every reported secret span of a text by a mask; no document goes."""
    common.prepare(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents so that expected tokens meet the flattened marginals."""
    common.prepare(spark)
    return mixing.draw(docs).filter("sampled").select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ...) of every document left."""
    common.prepare(spark)
    return sentencepiece_codec.encode(docs, sentencepiece_codec.read_model(spark, MODEL_PATH))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]
# The model fits, the fingerprints and the piece ids have no SQL form; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage is written to the checkpoint folder and read again."""
    common.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
