"""Queries of problems 1 to 4 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.event_runs import collapse_runs
from weftline.llm.seen_keys import answer_errors, seen_before
from weftline.llm.shared_spans import shared_spans
from weftline.llm.term_counts import RECORDS, TermCounts, count_terms, mark_terms
from weftline.shared import fresh_path
from weftline.sources.tables import table

RARE, COMMON = 3, 0.2


def _kmer_counts(spark: SparkSession, d: str) -> TermCounts:
    kmers = table(spark, d, "kmers").select("seq_id", "kmer_key", "kmer_offset", "is_reverse", "batch_no")
    return count_terms(spark, kmers, "seq_id", ["kmer_offset", "is_reverse"], ["kmer_key", "kmer_offset"], "batch_no", fresh_path(spark, "terms"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    store = _kmer_counts(spark, d)
    return mark_terms(store.counts(), store.records(), RARE, COMMON).filter("mark IS NOT NULL").select("field_name", "field_value", "mark")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return _kmer_counts(spark, d).counts().filter(F.col("field_name") != RECORDS)


def _tag_stretches(spark: SparkSession, d: str) -> DataFrame:
    at = F.when(F.col("graph_position") != 0, F.col("graph_position"))
    return collapse_runs(table(spark, d, "tag_runs"), "file_id", "start_position", F.shiftright(at, 10), at.bitwiseAND(1023), 2)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _tag_stretches(spark, d).select(F.col("entity").alias("file_id"), F.col("first_order").alias("first_start"), F.col("last_order").alias("last_start"))


def p2_stretches(spark: SparkSession, d: str) -> DataFrame:
    return _tag_stretches(spark, d).select(F.col("entity").alias("file_id"), F.col("first_order").alias("first_start"), "n_events", "length")


def _seen(spark: SparkSession, d: str, bits: int = 32) -> DataFrame:
    return seen_before(table(spark, d, "kmers"), "kmer_key", "row_id", table(spark, d, "seen_keys"), bits=bits)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _seen(spark, d)


def p3_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """By fingerprints of 8 bits, and of 32 as in p3_found: rows looked up, wrong answers among them and their share."""
    answers = {bits: _seen(spark, d, bits) for bits in (8, 32)}
    return answer_errors(table(spark, d, "kmers"), "kmer_key", "row_id", answers, table(spark, d, "seen_keys"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(table(spark, d, "reads"), "read_id", "seq", 40)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select(F.col("record").alias("read_id"), F.col("span_start").alias("mem_start"), F.col("span_end").alias("mem_end"))


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Shared letters of each read and their share of its letters; reads that share nothing are there with 0."""
    held = _spans(spark, d).groupBy(F.col("record").alias("read_id")).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n_shared"))
    reads = table(spark, d, "reads").filter("read_id IS NOT NULL").groupBy("read_id").agg(F.coalesce(F.max(F.length("seq")), F.lit(0)).cast("bigint").alias("n_letters"))
    out = reads.join(held, "read_id", "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)).cast("bigint"))
    return out.select("read_id", "n_letters", "n_shared", F.try_divide("n_shared", "n_letters").alias("shared_part"))


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p2_found": p2_found, "p2_stretches": p2_stretches, "p3_found": p3_found, "p3_error_rate": p3_error_rate, "p4_found": p4_found, "p4_coverage": p4_coverage}

_TERMS = """
    WITH o AS (SELECT DISTINCT seq_id, kmer_offset, is_reverse, kmer_key FROM kmers WHERE seq_id IS NOT NULL),
    t AS (SELECT 'kmer_key' AS field_name, kmer_key AS field_value, count(*) AS n_occurrences, count(DISTINCT seq_id) AS n_records
        FROM o WHERE kmer_key IS NOT NULL GROUP BY 2
        UNION ALL
        SELECT 'kmer_offset', CAST(kmer_offset AS BIGINT), count(*), count(DISTINCT seq_id)
        FROM (SELECT DISTINCT seq_id, kmer_offset, is_reverse FROM o WHERE kmer_offset IS NOT NULL) GROUP BY 2)"""
_RUNS = """
    WITH r AS (SELECT DISTINCT file_id, start_position AS s, CASE WHEN graph_position <> 0 THEN graph_position END AS g FROM tag_runs),
    n AS (SELECT *, lag(g) OVER w AS p, lead(s) OVER w AS next_s FROM r WINDOW w AS (PARTITION BY file_id ORDER BY s, g NULLS FIRST)),
    b AS (SELECT *, CASE WHEN (g >> 10) = (p >> 10) AND abs((g & 1023) - (p & 1023)) <= 2 THEN 0 ELSE 1 END AS new FROM n),
    c AS (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY s, g NULLS FIRST) AS run FROM b),
    x AS (SELECT file_id, min(s) AS first_start, max(s) AS last_start, count(*) AS n_events, arg_max(next_s, s) AS next_s, run FROM c GROUP BY file_id, run HAVING count(*) > 1)"""

_SPANS = """
    WITH r AS (SELECT DISTINCT read_id, upper(seq) AS seq FROM reads WHERE read_id IS NOT NULL AND length(seq) >= 40),
    w AS (SELECT read_id, i, substring(seq, i + 1, 40) AS s FROM (SELECT read_id, seq, unnest(range(length(seq) - 39)) AS i FROM r)),
    v AS (SELECT * FROM w WHERE NOT regexp_matches(s, '[^ACGT]')),
    h AS (SELECT s FROM v GROUP BY s HAVING count(DISTINCT read_id) > 1),
    g AS (SELECT read_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY read_id ORDER BY i) <= 40 THEN 0 ELSE 1 END AS new FROM v SEMI JOIN h USING (s)),
    b AS (SELECT *, sum(new) OVER (PARTITION BY read_id ORDER BY i) AS run FROM g),
    x AS (SELECT read_id, CAST(min(i) AS INTEGER) AS mem_start, CAST(max(i) + 40 AS INTEGER) AS mem_end FROM b GROUP BY read_id, run)"""

SQL = {
    "p1_found": _TERMS + """
    SELECT field_name, field_value, 'rare' AS mark FROM t WHERE n_occurrences < 3
    UNION ALL SELECT field_name, field_value, 'common' FROM t WHERE n_records >= 0.2 * (SELECT count(DISTINCT seq_id) FROM kmers)""",
    "p1_counts": _TERMS + " SELECT * FROM t",
    "p2_found": _RUNS + " SELECT file_id, first_start, last_start FROM x",
    "p2_stretches": _RUNS + " SELECT c.file_id, first_start, n_events, c.next_s - first_start AS length FROM x JOIN c ON c.file_id = x.file_id AND c.run = x.run AND c.s = x.last_start",
    "p3_found": """
    WITH f AS (SELECT kmer_key, min(row_id) AS first_id FROM kmers GROUP BY kmer_key)
    SELECT row_id FROM kmers k JOIN f USING (kmer_key)
    WHERE row_id > first_id OR kmer_key IN (SELECT kmer_key FROM seen_keys WHERE kmer_key IS NOT NULL)""",
    "p4_found": _SPANS + " SELECT * FROM x",
    "p4_coverage": _SPANS + """,
    c AS (SELECT read_id, sum(mem_end - mem_start) AS n FROM x GROUP BY read_id),
    a AS (SELECT read_id, CAST(coalesce(max(length(seq)), 0) AS BIGINT) AS n_letters FROM reads WHERE read_id IS NOT NULL GROUP BY read_id)
    SELECT read_id, n_letters, CAST(coalesce(n, 0) AS BIGINT) AS n_shared, CASE WHEN n_letters > 0 THEN coalesce(n, 0) / n_letters END AS shared_part FROM a LEFT JOIN c USING (read_id)""",
}
