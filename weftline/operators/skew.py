"""Per-key results where a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _values(df: DataFrame, fields: list[str], *more: Column) -> DataFrame:
    """(field_name, field_value, ..): a row for each field of each row that has one."""
    if len(fields) == 1:
        out = df.select(F.lit(fields[0]).alias("field_name"), F.col(fields[0]).cast("bigint").alias("field_value"), *more)
    else:
        each = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).cast("bigint").alias("field_value")) for f in fields))
        out = df.select(F.inline(each), *more)
    return out.filter(F.col("field_value").isNotNull())


def key_totals(df: DataFrame, fields: Iterable[str], entity: str) -> DataFrame:
    """Rows and distinct entities of every value of several columns.

    Every row is folded into a per-task hash table before anything is shuffled (Spark's partial aggregation, which
    spills when full), so a shuffle carries one row for each task and key, however many rows the key has. The distinct
    entities are counted through the pairs (value, entity), which are spread by both columns: no task gets all pairs of a
    hot value, and the second step again shuffles one row a task and value.

    Returns (field_name STRING, field_value BIGINT, n_rows BIGINT, n_entities BIGINT).
    Null values are no key. Rows with a null entity count as rows, not as an entity. Repeated rows count as they stand.
    An empty table gives no rows. Other columns are ignored.
    """
    pairs = _values(df, list(fields), F.col(entity).alias("_e"))
    each = pairs.groupBy("field_name", "field_value", "_e").agg(F.count(F.lit(1)).alias("_n"))
    return each.groupBy("field_name", "field_value").agg(F.sum("_n").alias("n_rows"), F.count("_e").alias("n_entities"))


def heavy_keys(df: DataFrame, fields: Iterable[str], share: float) -> DataFrame:
    """The values that hold at least `share` of the rows in which their column is not null.

    Returns (field_name, field_value, n_rows, n_total). Counting is partial in every task; the totals are sums of the
    counts, so the rows are read once. n_total is joined on field_name: one row for each column asked for.
    """
    counts = _values(df, list(fields)).groupBy("field_name", "field_value").agg(F.count(F.lit(1)).alias("n_rows"))
    totals = counts.groupBy("field_name").agg(F.sum("n_rows").alias("n_total"))
    return counts.join(F.broadcast(totals), "field_name").filter(F.col("n_rows") >= F.lit(share) * F.col("n_total"))


def salted_join(big: DataFrame, small: DataFrame, on: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join in which each key of `big` is spread over `salts` tasks and `small`'s rows are repeated for each salt.

    For how = inner, left, left_semi or left_anti (big's rows stay whole). Null keys never match. The salt comes from the
    row itself, so a task that is run again gives the same rows; rows that are equal in every column share it.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("big's rows would be repeated by a join of this kind")
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")
