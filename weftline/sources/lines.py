"""Text files of one sequence a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.ordered import bucket_width, with_sum_before
from weftline.shared import settled


def read_lines(spark: SparkSession, path: str, first_id: int = 1) -> DataFrame:
    """(read_id BIGINT, seq STRING): the non-empty lines, numbered over all files in order of file name and place.

    Lines are numbered inside each input split; the splits' counts, one row each, are added up before. Line ends of
    Windows are cut off. No files or only empty lines: no rows.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("seq"))
    raw = settled(raw.filter("seq <> ''"), "lines")
    # Ids given by Spark grow along a split; splits are ordered by file and place.
    parts = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"))
    # one row for each split
    order = parts.select("file", "block", "n", "low", F.row_number().over(Window.orderBy("file", "block")).alias("k"))
    order = with_sum_before(order, [], "k", "n", "base", bucket_width(order, "k"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    return raw.withColumn("i", inside).join(order.select("file", "block", "base"), ["file", "block"]).select((F.col("base") + F.col("i") - 1 + first_id).cast("bigint").alias("read_id"), "seq")

