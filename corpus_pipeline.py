"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing to target weights, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() writes each stage's result to the shared folder and hands it to the next.

In every stage null texts count as empty, null ids and sources are values of their own, rows that are alike are rows
each, texts are whole at any length, an empty table stays empty, and columns that docs has besides, whatever their
names, pass through all stages but the last. What that comes to is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.line_dedup import dedup_lines
from sluice.llm.mixing import mixed_documents
from sluice.llm.near_dups import one_of_each
from sluice.llm.quality import quality_filter
from sluice.llm.runtime import staged
from sluice.llm.sentencepiece_op import encode_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; null and empty texts have too few words, so they go."""
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document (of smaller id, null first) has; n_chars follows the text,
    which may be empty then. Rows that share an id are one document: none loses a line to another."""
    return with_length(dedup_lines(docs, counts=False), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id; texts without words stay."""
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy that is taken of a document, its text cut to the words taken. Texts without words
    have nothing to take, so they go; rows that are alike are taken each for itself."""
    return with_length(mixed_documents(docs), docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and two distinct sampled segmentations with inclusion scores; fewer, where a text has
    fewer. Rows that share id and text get the same samples; null ids stay null."""
    import public_tokenizers

    got = encode_documents(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return got.select("doc_id", "ids", F.col("decoded").alias("round_trip"), "samples")


def with_length(got: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return got
    return got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("sentencepiece", sentencepiece)]

#: The cascade, the shingle components, the seeded blocks and the tokens have no SQL form; tests/llm holds the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
