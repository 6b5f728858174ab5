"""The numbered queries over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactdq.llm import oracles
from contactdq.session import table

URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contactdq.llm.url_filters import UrlRule, judge

    return judge(table(spark, sf_dir, "pages"), [UrlRule(*r) for r in URL_RULES])


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from contactdq.llm.token_files import read_files, write_files

    return read_files(spark, write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contactdq.llm.near_dedup import classes

    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contactdq.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")), 0.7)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contactdq.llm.secrets import report

    return report(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contactdq.llm.quality_rules import POLICIES, apply_policy, ledger, mask

    book = ledger(table(spark, sf_dir, "documents"))
    return apply_policy(book, POLICIES["strict-1"]).withColumn("base_failed", F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES["base-1"])).cast("long")) != 0)


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of op6 costs under the strict policy, from the ledger alone."""
    from contactdq.llm.quality_rules import POLICIES, ablation, ledger

    return ablation(ledger(table(spark, sf_dir, "documents")), POLICIES["strict-1"])


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contactdq.llm.sharding import shard

    placed = shard(table(spark, sf_dir, "documents"), 16, rebalance_to=17)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from contactdq.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contactdq.llm.decontamination import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contactdq.llm.substring_dedup import deduplicated

    return deduplicated(table(spark, sf_dir, "documents"), 50, with_text=False)


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contactdq.llm.byte_net import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")), 0.3)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contactdq.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"), 8)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contactdq.llm.merkle import manifest

    return manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_token_files": op2_token_files,
    "op3_near_dedup": op3_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_secret_scans": op5_secret_scans,
    "op6_quality_rules": op6_quality_rules,
    "op7_sharding": op7_sharding,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_merkle_manifest": op13_merkle_manifest,
    "quality_ablation": quality_ablation,
}

#: The other queries have no SQL here (CRC-32, tokenizers, learned scores, places of matches); tests hold them against plain Python.
ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": oracles.url_filters(URL_RULES),
    "op3_near_dedup": oracles.NEAR_DEDUP,
    "op6_quality_rules": oracles.QUALITY_RULES,
    "op9_benchmark_decontamination": oracles.DECONTAMINATION,
    "op10_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op13_merkle_manifest": oracles.merkle(),
    "quality_ablation": oracles.quality_ablation(("few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length", "shouting")),
}
