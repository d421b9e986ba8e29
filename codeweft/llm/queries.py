"""Queries of the operators in this subpackage, and the SQL of those that SQL can say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm import docs, encoding, mixing, provenance, syntax, truncation
from codeweft.session import stage, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    verdicts = syntax.parse_verdicts(table(spark, d, "source_files"), table(spark, d, "parse_results"))
    return verdicts.where("not accepted").select("repo_id", "file_path")


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.parse_rates(syntax.parse_verdicts(table(spark, d, "source_files"), table(spark, d, "parse_results")))


def p1_errors(spark: SparkSession, d: str) -> DataFrame:
    """All errors of each file that doesn't parse, and the first cause."""
    verdicts = syntax.parse_verdicts(table(spark, d, "source_files"), table(spark, d, "parse_results"))
    return verdicts.where("not accepted").select("repo_id", "file_path", "language", "first_cause", "errors")


def _not_handwritten(spark: SparkSession, d: str) -> DataFrame:
    return provenance.not_handwritten(table(spark, d, "files"), table(spark, d, "source_files"), table(spark, d, "repo_meta"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _not_handwritten(spark, d).select("repo_id", "path")


def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Files per repository and kind of evidence."""
    return _not_handwritten(spark, d).groupBy("repo_id", "why").agg(F.count("*").alias("files"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return docs.function_docs(table(spark, d, "ir_nodes"), table(spark, d, "source_files")).where("telling").select("node_id").distinct()


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The code-description pairs themselves."""
    pairs = docs.function_docs(table(spark, d, "ir_nodes"), table(spark, d, "source_files"))
    return pairs.where("telling").select("node_id", "signature", "documentation")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_column(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.mix_shares(stage(mixing.mix(table(spark, d, "documents"), targets), "mix"), targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_evidence(table(spark, d, "documents")).where("truncated").select("doc_id").distinct()


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(truncation.truncation_evidence(table(spark, d, "documents")))


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p1_errors, p4_found, p4_kinds, p7_found, p7_pairs, p8_ids, p9_mix, p9_shares, p10_found, p10_rates)}
SQL: dict[str, str] = {}
