"""A text index in a folder of Parquet tables with a header that is checked when it is opened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: What a folder's header must say.
FORMAT, VERSION = "weftline-index", 1
HEADER = "format string, version int, tables array<string>"


def save_index(spark: SparkSession, path: str, tables: dict[str, DataFrame], order: dict[str, str] | None = None) -> None:
    """Write each table, range-partitioned and sorted by its column in `order`, so that scans of a range skip the rest; the header last."""
    for name, df in tables.items():
        key = (order or {}).get(name)
        out = df.repartitionByRange(key).sortWithinPartitions(key) if key else df
        out.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(FORMAT, VERSION, sorted(tables))], HEADER).coalesce(1).write.mode("overwrite").parquet(f"{path}/header")


def open_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an index; ValueError if the folder holds none, or one of another format or version."""
    try:
        header = spark.read.schema(HEADER).parquet(f"{path}/header").first()
    except Exception as e:
        raise ValueError(f"no index in {path}") from e
    if header is None or header["format"] != FORMAT:
        raise ValueError(f"not an index: {path}")
    if header["version"] != VERSION:
        raise ValueError(f"index of version {header['version']}, not {VERSION}: {path}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in header["tables"]}
