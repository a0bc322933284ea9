"""The queries of the training-data problems, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.common import read_table
from quarry.llm import conversations, credentials, functions, handwritten, leaks, neighbours, packing, pairs, sourcecheck, subjects
from quarry.llm.sql import SQL

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return conversations.conversations(read_table(spark, base, "turns"))


def p1_session_report(spark: SparkSession, base: str) -> DataFrame:
    return conversations.session_report(read_table(spark, base, "turns"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return credentials.found_lines(read_table(spark, base, "chunks"))


def p2_redacted(spark: SparkSession, base: str) -> DataFrame:
    return credentials.redacted(read_table(spark, base, "chunks"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return sourcecheck.broken_files(read_table(spark, base, "source_files"))


def p3_rates(spark: SparkSession, base: str) -> DataFrame:
    return sourcecheck.failure_rates(read_table(spark, base, "source_files"))


def p3_log_agreement(spark: SparkSession, base: str) -> DataFrame:
    return sourcecheck.recorded_against_found(read_table(spark, base, "source_files"), read_table(spark, base, "parsed_files"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return functions.documented_ids(read_table(spark, base, "chunks"))


def p4_pairs(spark: SparkSession, base: str) -> DataFrame:
    return functions.documented_functions(read_table(spark, base, "chunks"))


def p4_file_pairs(spark: SparkSession, base: str) -> DataFrame:
    return functions.documented_in_files(read_table(spark, base, "source_files"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return handwritten.not_handwritten(read_table(spark, base, "source_files"))


def p5_label_counts(spark: SparkSession, base: str) -> DataFrame:
    return handwritten.label_counts(read_table(spark, base, "source_files"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return neighbours.similar_pairs(read_table(spark, base, "chunks"))


def p6_greedy_search(spark: SparkSession, base: str) -> DataFrame:
    return neighbours.search_queries(read_table(spark, base, "chunks"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return pairs.defects(read_table(spark, base, "turns"))


def p8_packing(spark: SparkSession, base: str) -> DataFrame:
    return packing.pack(read_table(spark, base, "documents"), read_table(spark, base, "container_kinds"))


def p8_fill_report(spark: SparkSession, base: str) -> DataFrame:
    return packing.fill_report(read_table(spark, base, "documents"), read_table(spark, base, "container_kinds"))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return leaks.leaks(read_table(spark, base, "documents"), read_table(spark, base, "eval_items")).select("doc_id", "item_id")


def p9_items(spark: SparkSession, base: str) -> DataFrame:
    return leaks.leaked_items(read_table(spark, base, "documents"), read_table(spark, base, "eval_items"))


def p9_kept(spark: SparkSession, base: str) -> DataFrame:
    return leaks.without_leaks(read_table(spark, base, "documents"), read_table(spark, base, "eval_items")).select("doc_id")


def _subject_tables(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return read_table(spark, base, "documents"), read_table(spark, base, "subject_labels"), read_table(spark, base, "subjects")


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return subjects.document_subjects(*_subject_tables(spark, base)).select("doc_id", "subject_id")


def p10_composition(spark: SparkSession, base: str) -> DataFrame:
    return subjects.composition(*_subject_tables(spark, base))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
