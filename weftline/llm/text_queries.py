"""Queries of problems 6 to 8 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.encode import encode
from weftline.llm.leaks import WINDOW, leaks
from weftline.llm.personal import find_personal, redact
from weftline.shared import settled
from weftline.sources.tables import table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "benchmark")).filter(f"n_exact >= {WINDOW}").select("doc_id", "item_id")


def p7_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that share a masked window, with replaced words allowed."""
    return leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_personal(table(spark, d, "documents"), table(spark, d, "name_parts")).select("doc_id", "kind", "pii_text").distinct()


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    # Rows are told apart by a key of this run, so that those with a null or repeated doc_id are searched too.
    docs = settled(table(spark, d, "documents").select("doc_id", "text", F.monotonically_increasing_id().alias("row_key")), "documents")
    return redact(docs, find_personal(docs, table(spark, d, "name_parts"), "row_key"), "row_key", name="doc_id")


QUERIES = {"p6_ids": p6_ids, "p7_found": p7_found, "p7_overlaps": p7_overlaps, "p8_found": p8_found, "p8_redacted": p8_redacted}

#: SQL has no NFKC and no tokenizers: tests compare these queries with brute force.
SQL: dict[str, str] = {}
