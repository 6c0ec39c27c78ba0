"""The corpus pipeline: documents in, cleaned and encoded documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import stages
from skein.llm.common import read_table, stored

#: (name, function); each function takes (spark, docs, sf_dir), and its result is stored before the next one reads it.
STAGES = stages.STAGES

#: SQL cannot express fingerprints, suffix refinement or encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of sf_dir."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
