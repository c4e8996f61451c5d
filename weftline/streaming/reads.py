"""Matches of reads that arrive in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from weftline.operators.mems import find_mems, text_windows
from weftline.shared import settled


def stream_mems(spark: SparkSession, source: str, schema: StructType, texts: DataFrame, out: str, checkpoint: str, min_len: int, min_occ: int = 1) -> StreamingQuery:
    """Match the reads of new Parquet files in `source` with fixed texts and write (read_id, mem_start, mem_end, size) to `out`.

    Matches of a read depend on no other read, so nothing is kept between batches; each batch has its own folder, which a
    repeated batch writes over. Ends when all files there are have been read. The texts are cut into windows once, before the
    first batch; batches only read them.
    """
    known = tuple(settled(df, "text_windows") for df in text_windows(texts, min_len))

    def batch(reads: DataFrame, number: int) -> None:
        reads = reads.filter("read_id IS NOT NULL AND seq <> ''").selectExpr("read_id", "upper(seq) AS seq").distinct()
        find_mems(settled(reads, "batch"), known, min_len, min_occ)[0].write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
