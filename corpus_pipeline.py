"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import stages
from quern.llm.common import stored, temporaries

STAGES = [
    ("quality_rules", stages.quality_stage),
    ("simhash_near_dedup", stages.near_dedup),
    ("benchmark_decontamination", stages.decontaminate),
    ("personal_data", stages.sanitise),
    ("token_ids", stages.token_ids),
]

#: SimHash, zstandard and BPE have no SQL form; tests hold run() against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each over all that the one before kept, written and read between them. Of the tables written on the way only the result stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with temporaries(spark):
        for name, stage in STAGES:
            with temporaries(spark):
                docs = stored(stage(spark, docs, sf_dir), name)
    return docs
