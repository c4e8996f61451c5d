"""The folder that all executors share, and cutting of lineage through it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session gets a folder of this machine; a cluster, whose executors don't share one, an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(known)
    return known


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame, label: str) -> DataFrame:
    """df, written once to the shared folder as Parquet and read back: later steps neither repeat its work nor need its executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def forget(*settled_: DataFrame) -> None:
    """Delete what settled() wrote for these, once nothing that is still to run reads it."""
    for df in settled_:
        remove(df.sparkSession, df.settled_at)


def still_there(df: DataFrame) -> bool:
    """Whether what settled() wrote for df is still in the shared folder."""
    done = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{df.settled_at}/_SUCCESS")
    return done.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(done)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Number of shuffle partitions so that each holds about rows_each rows, and never fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))
