"""Corpus pipeline: documents to token ids, in five stages that each work on all rows the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkcomments.llm import decontaminate, language_id, near, pii, sentencepiece
from sparkcomments.llm.common import staged, table

STAGES = [
    ("language_id", language_id.stage),
    ("jaccard_join", near.stage),
    ("decontaminate", decontaminate.stage),
    ("pii", pii.stage),
    ("sentencepiece", sentencepiece.stage),
]

#: SQL can express neither the filters, the recursive splits nor the recurrence; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
