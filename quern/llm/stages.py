"""Pipeline stages over the operators: functions of (spark, docs, sf_dir). Rows keep their columns but where a stage says otherwise.

Defined cases, for all stages: a null text counts as empty (the quality rules drop it); null doc_ids are documents like any other; texts are read
whole, whatever their length; repeated rows are judged one by one but in near_dedup, where one stays; ties are settled as each operator's module says;
columns besides those named pass through, whatever their names; an empty table gives an empty result. sanitise() needs a column n_chars, token_ids() needs
lang and source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontamination, pii, quality, simhash
from quern.llm.common import quoted
from quern.llm.queries import BYTE_BPE


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject."""
    return quality.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which at least one word in twenty lies in a benchmark window."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that reveal them, in the texts; n_chars follows the text where it changes."""
    done = pii.sanitised(docs.withColumn("__quern_old", F.col("text")))
    n = F.when(F.col("text").eqNullSafe(F.col("__quern_old")), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return done.withColumn("n_chars", n).select(*quoted(docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: doc_id, lang, source, and the ids of the text with their number; decoding them gives the text back."""
    encoded = bpe.encode(docs, BYTE_BPE)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")
