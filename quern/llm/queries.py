"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontamination, html, pii, quality, revisits, simhash, suffix_array, suffix_tree, token_counts
from quern.llm.common import stored

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex16(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def op1_revisit_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolved(revisits.captures(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return found.select("record_id", "url", "response_id", "outcome", lines.alias("headers"), "digest")


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def op2_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(of_kind(pii.BASE, kind)).cast("long").alias(f"n_{kind}") for kind in pii.PATTERNS]
    every = F.concat(pii.BASE, of_kind(pii.TERMS, "generalise"), of_kind(pii.TERMS, "remove"))
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col(pii.BASE)), 256).alias("base_sha256"), pii.written(every).alias("spans"))


def op3_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op4_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op5_bpe_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def lost() -> Column:
    """Units inside the ranges starts[i]:stops[i]."""
    return F.aggregate(F.arrays_zip("starts", "stops"), F.lit(0).cast("long"), lambda acc, x: acc + x["stops"] - x["starts"])


def op8_deep_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, texts, kept = suffix_array.deduplicated(table(spark, sf_dir, "documents"))
    some = kept.select("sha", lost().alias("n_lost"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha")).dropDuplicates(["sha"])
    told = texts.filter("copies > 1").select("sha", F.lit(True).alias("all"), F.lit(0).cast("long").alias("n_lost"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha"))
    told = stored(told.unionByName(some.withColumn("all", F.lit(False))), "told")
    n_removed = F.when(F.col("all"), F.col("n_bytes")).otherwise(F.coalesce("n_lost", F.lit(0)))
    joined = rows.join(told, "sha", "left")
    return joined.select("doc_id", "n_bytes", n_removed.cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))


def op9_prefix_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, texts, kept = suffix_tree.deduplicated(table(spark, sf_dir, "documents"))
    some = kept.select("sha", lost().alias("n_lost"), F.sha2("kept", 256).alias("kept_sha")).dropDuplicates(["sha"])
    told = stored(texts.select("sha", "rep").join(some, "sha", "left"), "told")
    copy, own = F.col("doc_id") > F.col("rep"), F.col("doc_id") == F.col("rep")
    n_removed = F.when(copy, F.col("n_words")).when(own, F.coalesce("n_lost", F.lit(0))).otherwise(0)
    kept_sha = F.when(copy, F.sha2(F.lit(""), 256)).when(own, F.coalesce("kept_sha", "sha")).otherwise(F.col("sha"))
    return rows.join(told, "sha", "left").select("doc_id", "n_words", n_removed.cast("long").alias("n_removed"), kept_sha.alias("kept_sha256"))


def op10_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).drop("ratio", "bad_chunks")


QUERIES = {f.__name__: f for f in (op1_revisit_asof, op2_pii_disclosure, op3_simhash_pigeonring, op4_tag_path_ratios, op5_bpe_prefix_trie, op6_token_counts, op7_decontamination, op8_deep_shallow, op9_prefix_suffix_trees, op10_compression_bands)}
