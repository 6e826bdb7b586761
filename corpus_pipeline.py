"""A corpus pipeline of five stages: toxicity, line dedup, near-duplicate removal, mixing, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's result as Parquet in the
shared folder and reads it again as the next stage's docs; what a stage no longer needs is removed. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from splitproof.llm import line_dedup, mixing, ngram_join, sentence_pieces, toxicity
from splitproof.shared import last_staged, remove, removing, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't flag. The chain is fitted on the labelled documents of the input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit_chain(docs, labels))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line equals or nearly equals; those of which no line is left go."""
    return line_dedup.dedup_lines(docs, drop_emptied=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, the one with the smallest id."""
    return ngram_join.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, so some twice and some not at all."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.take(docs, mixing.quality_weights(labels))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text they decode to."""
    out = sentence_pieces.round_trips(docs.select("doc_id", "text"), sentence_pieces.default_model(), with_ids=True)
    return out.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Toxicity and tokenisation are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, apply in STAGES:
        keep: list[str] = []
        with removing(spark, keep):  # what the stage itself has staged goes once its result is written
            docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
            keep.append(last_staged())
        if last:
            remove(spark, [last])
        last = keep[0]
    return docs
