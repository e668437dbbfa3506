"""The corpus pipeline: five stages from ``documents`` to token ids, each an operator of ``gridloom.llm``.

Every stage works on all that the one before kept, is written as Parquet and read
again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe, common, decontaminate, jaccard_join, pii, quality
from gridloom.llm.tokenizers_io import public_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one of the smallest id stays."""
    return jaccard_join.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.drop_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to their kind in brackets; n_chars follows."""
    return pii.mask_pii(docs, length="n_chars")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of the whole text in place of it, with a digest of the text that they decode to."""
    return bpe.encode_decode(docs, public_path("byte_bpe_50k.json"), add=("n_tokens", "ids", "decoded_sha256"), keep_text=False)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

#: SQL can express neither the estimated rules nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table, in the shared checkpoint folder.

    Each stage's files go when the next one's are there, the last one's when the application ends.
    Null, empty and very long texts, repeated rows, empty tables and extra columns are each
    stage's to handle, as its operator says: documents without words go in the first, repeated
    ones in the second; an empty table gives an empty one with the last stage's columns; extra
    columns, whatever their names, are passed on.
    """
    common.checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/gridloom-pipeline-{uuid.uuid4().hex}"
    common.discard(spark, place, at_exit=True)
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}-{name}")
        docs = spark.read.parquet(f"{place}/{k}-{name}")
        if k:
            common.discard(spark, f"{place}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
