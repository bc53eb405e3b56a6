"""The corpus pipeline: filter, deduplicate, decontaminate and pack `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patchsieve.llm.common import table, written
from patchsieve.llm.decontaminate import without_passages
from patchsieve.llm.near_dups import one_per_group
from patchsieve.llm.packing import packed
from patchsieve.llm.quality import train, with_scores

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


QUALITY_CUT = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality network does not reject."""
    network, prior = train(docs, table(spark, sf_dir, "labels"))
    return with_scores(docs.select(*COLUMNS), network, prior).where(f"score >= {QUALITY_CUT}").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group of near duplicates, that with the least id."""
    return one_per_group(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark."""
    return without_passages(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return packed(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
# no stage can be said in SQL: a fitted model, near duplicates, edit matching and packing
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
