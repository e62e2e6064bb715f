"""The corpus pipeline: quality rules, language ID, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  Every stage works on all rows that its
predecessor kept.

Cases: a row whose ``text`` is null, empty or without a word goes in the first or
second stage.  Rows with a null ``doc_id`` pass every stage and are packed; they
are never duplicates.  Rows that repeat a ``doc_id`` and text all stay and are
packed as often; those with another text are judged by it.  A document that line
dedup empties stays until near-dedup, where all empty texts are one group, and has
no piece.  Ties go to the smallest ``doc_id``.  Null ``lang`` or ``source`` are no
label and no site.  Further columns pass through whatever their names.  An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm import langid, linededup, packing, quality, simhash
from spanforge.llm.common import read
from spanforge.storage import drop_path, fresh_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, read(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.stage(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.stage(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("best_fit_packing", pack),
]

#: a trained random field and a search by thresholds aren't SQL; tests/llm/test_pipeline.py has the stages by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again by the next.

    A stage's folder goes when the next one is written: one copy of the corpus is left, and goes with the session.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        at = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            drop_path(spark, before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
