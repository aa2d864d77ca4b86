"""A corpus from raw documents to training shards, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontaminate, mixing, near_dup, quality, sharding
from corvane.llm.common import shared_path, table

#: Near-duplicate stages of the pipeline go by five words and a similarity of 0.8.
NEAR = near_dup.NearDup(shingle=5, percent=80)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs.

    A null, empty or very short text fails the base rules. Rows are judged one by one, so repeated rows and ids go or stay alike;
    an empty table stays empty, and any other columns stay as they are.
    """
    return quality.passing(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near-duplicates.

    Rows are judged by id and text: of rows that share an id, each stays or goes for its own text. Where rows repeat both, all of them stay
    or go together. Rows without an id and texts without words stay. Other columns stay as they are, whatever their names.
    """
    return near_dup.without_copies(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, exact or edited.

    Null and empty texts contain none and stay; with an empty benchmark all rows do. Repeated rows go or stay alike.
    """
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents to the target weights of their sources, in random order.

    A null source is a source of its own, rows without an id draw one count, and rows that repeat an id draw the same count each.
    """
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, nulls, empty and repeated ones too, with their shard and the version of the manifest."""
    return sharding.shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontamination),
    ("mix", source_mixing),
    ("shard", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Signatures, alignments and file layout are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
