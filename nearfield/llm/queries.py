"""The queries of this package and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import language, mixing, pieces, pii, quality_model, quality_rules, secrets_scan, simhash, toxicity, winnowing

#: The vocabulary of op8, as the package public_tokenizers names it.
VOCABULARY = "piece_bpe_32k.model"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language.identify(documents, language.train(documents))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality_model.score(documents, quality_model.train(documents, table(spark, sf_dir, "labels")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*quality_rules.COLUMNS)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_copies(table(spark, sf_dir, "documents"))
    return planned.withColumn("taken", F.col("copies") * F.col("size")).select(*mixing.COLUMNS)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.link_documents(table(spark, sf_dir, "documents"))
    return linked.select("doc_id", simhash.digits(F.col("fp")).alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return secrets_scan.find_secrets(documents, secrets_scan.train(documents))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_documents(table(spark, sf_dir, "documents")).select(*winnowing.COLUMNS)


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize_checked(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_language_id,
    op2_quality_classifier,
    op3_quality_rules,
    op4_source_mix,
    op5_simhash_dedup,
    op6_toxicity,
    op7_secret_scan,
    op8_sentencepiece,
    op9_fingerprints,
    op10_pii_surrogates,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality_rules.ORACLE_SQL, "op4_source_mix": mixing.ORACLE_SQL}
