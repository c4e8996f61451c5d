"""Problem 5: a few keys hold most of the records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.operators.skew import heavy_keys, key_totals
from weftline.sources.tables import table

SHARE = 0.03


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(table(spark, d, "mems"), ["mem_size"], SHARE).unionByName(heavy_keys(table(spark, d, "hits"), ["node_id"], SHARE)).select("field_name", "field_value")


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    return key_totals(table(spark, d, "mems"), ["mem_size"], "read_id").unionByName(key_totals(table(spark, d, "hits"), ["node_id"], "read_id"))


QUERIES = {"p5_found": p5_found, "p5_totals": p5_totals}

SQL = {
    "p5_found": """
        SELECT 'mem_size' AS field_name, mem_size AS field_value FROM mems WHERE mem_size IS NOT NULL GROUP BY mem_size
        HAVING count(*) >= 0.03 * (SELECT count(mem_size) FROM mems)
        UNION ALL
        SELECT 'node_id', node_id FROM hits WHERE node_id IS NOT NULL GROUP BY node_id
        HAVING count(*) >= 0.03 * (SELECT count(node_id) FROM hits)""",
    "p5_totals": """
        SELECT 'mem_size' AS field_name, mem_size AS field_value, count(*) AS n_rows, count(DISTINCT read_id) AS n_entities
        FROM mems WHERE mem_size IS NOT NULL GROUP BY mem_size
        UNION ALL
        SELECT 'node_id', node_id, count(*), count(DISTINCT read_id) FROM hits WHERE node_id IS NOT NULL GROUP BY node_id""",
}
