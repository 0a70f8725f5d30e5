"""From raw documents to token ids: quality rules, language identification, near duplicates,
benchmark decontamination and piece encoding. Each stage is written before the next one reads it, so a
lost executor costs the work of one stage at most.

All stages but the last return the columns of ``documents`` unchanged and drop the documents they decide
against; the last one adds ``piece_ids`` and ``round_trip`` (whether decoding them gives the text back).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import decontaminate, jaccard_join, language_id, pieces, quality
from topicloom.llm.common import table
from topicloom.llm.registry import QUERIES
from topicloom.session import materialize


# The last stage runs in executors that earlier ones have filled, so its workers remember less; this costs time only.
PIECE_SEGMENTS = 60_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones among them teach."""
    return language_id.keep_identified(docs, docs)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents."""
    return jaccard_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids."""
    coded = pieces.add_ids_and_text(docs, into="__decoded", remember=PIECE_SEGMENTS)
    plain = F.translate(F.coalesce(F.col("text"), F.lit("")), pieces.BLANK, " ")
    return coded.withColumn("round_trip", F.col("__decoded") == plain).drop("__decoded")


STAGES = [
    ("quality rules", quality_stage),
    ("language identification", language_stage),
    ("n-gram Jaccard join", duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece", piece_stage),
]

# Language identification and piece encoding are not expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


QUERIES["pipeline"] = run
