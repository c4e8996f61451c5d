"""Queries that write tables in the formats of `sources` and read them back; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans import sequences
from weftline.shared import fresh_path
from weftline.sources.gfa import read_gfa, write_gfa, write_names
from weftline.sources.hit_files import write_gaf, write_hits
from weftline.sources.index_store import open_index, save_index
from weftline.sources.tables import table


def _graph(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    path = fresh_path(spark, "gfa")
    write_gfa(table(spark, d, "nodes"), table(spark, d, "edges"), path)
    return read_gfa(spark, path)


def gfa_nodes(spark, d):
    return _graph(spark, d)["nodes"]


def gfa_edges(spark, d):
    return _graph(spark, d)["edges"]


def stored_runs(spark, d):
    """The runs of tag files as a table of an index folder, sorted by start, opened again."""
    path = fresh_path(spark, "index")
    save_index(spark, path, {"runs": sequences.tag_lengths(spark, d)}, {"runs": "start_position"})
    return open_index(spark, path)["runs"]


def run_files(spark, d):
    """A folder of files of runs, one or more for each tag file, read as a whole: rows and runs of each by the file's path."""
    path = fresh_path(spark, "run_files")
    table(spark, d, "tag_runs").filter("file_id IS NOT NULL").select("start_position", "graph_position", F.col("file_id").alias("part")).write.partitionBy("part").parquet(path)
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    file_id = F.regexp_extract("_metadata.file_path", "part=(-?[0-9]+)/[^/]*$", 1).cast("bigint")
    return rows.groupBy(file_id.alias("file_id")).agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("graph_position") != 0, 1)).alias("n_runs"))


def hit_lines(spark, d):
    """The hits as lines of tab-separated values, without their sequence."""
    path = fresh_path(spark, "hits")
    write_hits(sequences._hits(spark, d), table(spark, d, "sequences"), path)
    return spark.read.text(f"{path}/hits").select(F.col("value").alias("line"))


def hit_start_lines(spark, d):
    """The file of row starts that goes with the hits."""
    path = fresh_path(spark, "hits")
    write_hits(sequences._hits(spark, d), table(spark, d, "sequences"), path)
    return spark.read.text(f"{path}/starts").select(F.col("value").alias("line"))


def gaf_lines(spark, d):
    """The places of matches as GAF lines."""
    path = fresh_path(spark, "gaf")
    write_gaf(sequences.hit_paths(spark, d), sequences.read_texts(spark, d), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def name_lines(spark, d):
    """The names of the paths, one a line."""
    path = fresh_path(spark, "names")
    write_names(sequences.path_names(spark, d), "seq_id", "name", path)
    return spark.read.text(path).select(F.col("value").alias("name"))


QUERIES = {f.__name__: f for f in (gfa_nodes, gfa_edges, stored_runs, run_files, hit_lines, hit_start_lines, gaf_lines, name_lines)}

_HITS = "SELECT DISTINCT seq_id, node_id, node_offset, is_reverse, mem_length, mem_start, read_id FROM hits"
SQL = {
    "gfa_nodes": "SELECT node_id, nullif(seq, '*') AS seq FROM nodes WHERE node_id IS NOT NULL",
    "gfa_edges": "SELECT from_id, coalesce(from_orient, '*') AS from_orient, to_id, coalesce(to_orient, '*') AS to_orient, nullif(overlap, '*') AS overlap FROM edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL",
    "stored_runs": sequences.SQL["tag_lengths"],
    "run_files": "SELECT file_id, count(*) AS n_rows, count(CASE WHEN graph_position <> 0 THEN 1 END) AS n_runs FROM tag_runs WHERE file_id IS NOT NULL GROUP BY file_id",
    "hit_lines": f"SELECT concat_ws(chr(9), coalesce(CAST(node_id AS VARCHAR), ''), coalesce(CAST(node_offset AS VARCHAR), ''), coalesce(CAST(is_reverse AS VARCHAR), ''), coalesce(CAST(mem_length AS VARCHAR), ''), coalesce(CAST(mem_start AS VARCHAR), ''), coalesce(CAST(read_id AS VARCHAR), '')) AS line FROM ({_HITS})",
    "hit_start_lines": f"SELECT CAST(first_row AS VARCHAR) AS line FROM ({sequences.SQL['seq_id_starts']})",
    "gaf_lines": f"""SELECT concat_ws(chr(9), h.read_id, length(r.seq), mem_start, mem_end, '+', path, path_length, first_offset, first_offset + mem_end - mem_start, mem_end - mem_start, mem_end - mem_start, 255) AS line
    FROM ({sequences.SQL['hit_paths']}) h JOIN (SELECT DISTINCT read_id, upper(seq) AS seq FROM reads WHERE read_id IS NOT NULL AND seq <> '') r USING (read_id)""",
    "name_lines": f"SELECT name FROM ({sequences.SQL['path_names']})",
}
