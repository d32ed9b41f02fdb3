"""From raw documents to token blocks: five stages, each one of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm.common import keep_small_batches, save, table
from glyphmill.llm.containment import decontaminate
from glyphmill.llm.jaccard import keep_one
from glyphmill.llm.mixing import take
from glyphmill.llm.quality import classify
from glyphmill.llm.rans import read_blocks, tokenizer_path, write_blocks


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    keep_small_batches(spark)
    return classify(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: at least 80 % of their five-word shingles are shared."""
    keep_small_batches(spark)
    return keep_one(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keep_small_batches(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    keep_small_batches(spark)
    return take(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token blocks, and where in them each document is."""
    keep_small_batches(spark)
    return read_blocks(*write_blocks(docs, tokenizer_path(spark)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]

#: A classifier, the cube method and the coder are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
