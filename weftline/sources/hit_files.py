"""Hits as tab-separated files, sorted by sequence and node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.mems import seq_starts

COLUMNS = ("node_id", "node_offset", "is_reverse", "mem_length", "mem_start", "read_id")


def write_hits(hits: DataFrame, sequences: DataFrame, path: str) -> None:
    """path/hits: the hits in order of seq_id, node_id, then read, place in the read, offset and strand, without seq_id; path/starts: the row at which each sequence begins, and the total last."""
    ordered = hits.orderBy("seq_id", "node_id", "read_id", "mem_start", "node_offset", "is_reverse")
    ordered.select(*COLUMNS).write.mode("overwrite").csv(f"{path}/hits", sep="\t", nullValue="")
    starts = seq_starts(hits, sequences)
    starts.orderBy(starts["seq_id"].asc_nulls_last()).select("first_row").write.mode("overwrite").csv(f"{path}/starts")


def write_gaf(paths: DataFrame, reads: DataFrame, path: str) -> None:
    """Paths of matches (hit_paths) as GAF lines: read, its length, the match in it, strand, path, its length, the match in it, matches, block, quality 255."""
    n = F.col("mem_end") - F.col("mem_start")
    rows = paths.join(reads.select("read_id", F.length("seq").alias("_n")), "read_id")
    rows.select("read_id", "_n", "mem_start", "mem_end", F.lit("+"), "path", "path_length", "first_offset", F.col("first_offset") + n, n.alias("matches"), n.alias("block"), F.lit(255)).write.mode("overwrite").csv(path, sep="\t")
