"""Graphs in GFA text: nodes (S), edges (L), paths (P) and walks (W)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def node_number(name: Column) -> Column:
    """The id of a node: its name if that is a number of up to 18 digits, else a negative number made from a 62-bit hash of the name."""
    hashed = F.when(name.isNotNull(), -1 - F.xxhash64(name).bitwiseAND((1 << 62) - 1))
    return F.coalesce(F.when(name.rlike("^[0-9]{1,18}$"), name.try_cast("bigint")), hashed)


def read_gfa(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes (node_id, seq), edges (from_id, from_orient, to_id, to_orient, overlap), names (node_id, name), paths (name), path_steps (name, step, node_id, is_reverse).

    Fields are separated by tabs or spaces. Other records are ignored; a label or an overlap "*" is null. Walks are paths named
    sample#haplotype#contig#start. Names of nodes that aren't numbers get negative ids; ValueError if two names get one id.
    """
    rec = spark.read.text(path).select(F.split(F.regexp_replace("value", "\r$", ""), "[\t ]+").alias("f"))
    part = lambda i: F.get("f", F.lit(i))
    some = lambda c: F.when(c != "*", c)
    labels = rec.filter(part(0) == "S").select(part(1).alias("name"), some(part(2)).alias("seq"))
    names = labels.select(node_number(F.col("name")).alias("node_id"), "name").distinct()
    odd = names.filter("node_id < 0").groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not odd.isEmpty():
        raise ValueError("two names of nodes have one id")
    nodes = labels.select(node_number(F.col("name")).alias("node_id"), "seq")
    edges = rec.filter(part(0) == "L").select(node_number(part(1)).alias("from_id"), part(2).alias("from_orient"), node_number(part(3)).alias("to_id"), part(4).alias("to_orient"), some(part(5)).alias("overlap"))
    paths = rec.filter(part(0) == "P").select(part(1).alias("name"), F.split(part(2), ",").alias("steps"))
    walks = rec.filter(part(0) == "W").select(F.concat_ws("#", part(1), part(2), part(3), part(4)).alias("name"), F.regexp_extract_all(part(6), F.lit("([<>][^<>]+)")).alias("steps"))
    own = paths.select("name", F.posexplode("steps").alias("step", "s")).filter("s <> ''").select("name", "step", F.expr("substring(s, 1, length(s) - 1)").alias("node"), F.col("s").endswith("-").alias("back"))
    own = own.unionByName(walks.select("name", F.posexplode("steps").alias("step", "s")).select("name", "step", F.expr("substring(s, 2)").alias("node"), F.col("s").startswith("<").alias("back")))
    steps = own.select("name", F.col("step").cast("bigint").alias("step"), node_number(F.col("node")).alias("node_id"), F.when(F.col("back"), 1).otherwise(0).alias("is_reverse"))
    return {"nodes": nodes, "edges": edges, "names": names, "paths": paths.select("name").unionByName(walks.select("name")), "path_steps": steps}


def write_gfa(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """S and L lines of nodes (node_id, seq) and edges; nulls become "*". Rows without an id are left out."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    s = nodes.filter("node_id IS NOT NULL").select(F.concat_ws("\t", F.lit("S"), F.col("node_id").cast("string"), some("seq")).alias("value"))
    own = edges.filter("from_id IS NOT NULL AND to_id IS NOT NULL").select(F.concat_ws("\t", F.lit("L"), *(some(c) for c in ("from_id", "from_orient", "to_id", "to_orient", "overlap"))).alias("value"))
    s.unionByName(own).write.mode("overwrite").text(path)


def write_names(names: DataFrame, order: str, name: str, path: str) -> None:
    """One name a line, in the order of a column."""
    names.select(F.col(order), F.col(name).alias("value")).orderBy(order).select("value").write.mode("overwrite").text(path)
