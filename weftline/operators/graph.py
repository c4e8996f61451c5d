"""Graphs of labelled nodes and the paths through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.dna import reverse_complement
from weftline.operators.ordered import bucket_width, with_sum_before
from weftline.operators.text import as_bytes
from weftline.shared import settled


def chop(texts: DataFrame, width: int = 32) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, seq) and path steps (seq_id, step, node_id, is_reverse) of texts cut into pieces of `width` letters.

    Pieces that read the same on either strand are one node, labelled by the smaller reading; its id is that of its first
    step, seq_id * steps + step, where steps is 2^20 or, if a text has more, the steps of the longest text. Empty texts have
    no steps. Reads the texts once for their length.
    """
    longest = texts.agg(F.max(F.length(as_bytes(F.col("seq"))))).first()[0] or 0
    each = max(1 << 20, -(-longest // width))
    cut = texts.filter(F.length("seq") > 0).select("seq_id", as_bytes(F.col("seq")).alias("_b")).select("seq_id", "_b", F.explode(F.expr(f"sequence(0, (length(_b) - 1) div {width})")).alias("step"))
    piece = cut.select("seq_id", F.col("step").cast("bigint").alias("step"), F.substring("_b", (F.col("step") * width + 1).cast("int"), F.lit(width)).cast("string").alias("p"))
    piece = piece.withColumn("rc", reverse_complement(F.col("p"))).withColumn("label", F.least("p", "rc")).withColumn("is_reverse", (F.col("rc") < F.col("p")).cast("int"))
    nodes = piece.groupBy("label").agg(F.min(F.col("seq_id") * F.lit(each).cast("bigint") + F.col("step")).alias("node_id"))
    steps = piece.join(nodes, "label").select("seq_id", "step", "node_id", "is_reverse")
    return nodes.select("node_id", F.col("label").alias("seq")), steps


def step_edges(steps: DataFrame) -> DataFrame:
    """(from_id, from_orient, to_id, to_orient): distinct neighbouring steps of the paths."""
    behind = steps.select("seq_id", (F.col("step") - 1).alias("step"), F.col("node_id").alias("to_id"), F.col("is_reverse").alias("to_rev"))
    sign = lambda c: F.when(F.col(c) == 1, F.lit("-")).otherwise(F.lit("+"))
    return steps.join(behind, ["seq_id", "step"]).select(F.col("node_id").alias("from_id"), sign("is_reverse").alias("from_orient"), "to_id", sign("to_rev").alias("to_orient")).distinct()


def path_positions(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seq_id, step, path_start, node_id, is_reverse, node_length): where each step begins on its path.

    A running sum of node lengths; long paths are summed in buckets of steps. A step to a node that doesn't exist has length 0.
    """
    sized = steps.join(nodes.select("node_id", F.length("seq").cast("bigint").alias("node_length")), "node_id", "left").withColumn("node_length", F.coalesce("node_length", F.lit(0)).cast("bigint"))
    return with_sum_before(sized, ["seq_id"], "step", "node_length", "path_start", bucket_width(sized, "step")).select("seq_id", "step", "path_start", "node_id", "is_reverse", "node_length")


def letter_positions(positions: DataFrame) -> DataFrame:
    """(seq_id, seq_off, node_id, is_reverse, node_offset): the graph position of every letter of every path, offsets along the path's direction."""
    each = positions.filter("node_length > 0").select("seq_id", "path_start", "node_id", "is_reverse", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("node_length") - 1)).alias("o"))
    return each.select("seq_id", (F.col("path_start") + F.col("o")).alias("seq_off"), "node_id", "is_reverse", F.col("o").cast("int").alias("node_offset"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, comp_id): the smallest node id of each node's weak component; nodes without an edge are components.

    Alternating star contraction: each node's larger, then smaller neighbours are hung on its smallest neighbour, until the
    links no longer change. Each round is written to the shared folder; the number of rounds grows with the logarithm of the
    longest path. Links with a null end are ignored; ends that are no nodes count as nodes.
    """
    a, b = F.col("from_id").cast("bigint"), F.col("to_id").cast("bigint")
    links = settled(edges.select(a.alias("a"), b.alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "links")
    sign = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        big = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = big.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        links = settled(small.filter("a <> b").distinct(), "links")
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == sign:
            break
        sign = now
    every = nodes.select(F.col("node_id").cast("bigint").alias("node_id")).filter("node_id IS NOT NULL").unionByName(edges.select(a.alias("node_id"))).unionByName(edges.select(b.alias("node_id"))).filter("node_id IS NOT NULL").distinct()
    return every.join(links.groupBy(F.col("a").alias("node_id")).agg(F.min("b").alias("m")), "node_id", "left").select("node_id", F.coalesce("m", "node_id").alias("comp_id"))


def path_components(steps: DataFrame, comps: DataFrame) -> DataFrame:
    """(seq_id, comp_id) by the first step of each path."""
    return steps.filter("step = 0").join(comps, "node_id").select("seq_id", "comp_id")


def joint_paths(paths: DataFrame, steps: DataFrame) -> DataFrame:
    """(seq_id, comp_id) of all paths (seq_id), those without steps too: the smallest seq_id of the paths that share nodes, by others or directly.

    A path's nodes are in one component, so only links between paths are followed: as many as there are paths, not steps.
    """
    pairs = steps.select("seq_id", "node_id").distinct()
    least = pairs.groupBy("node_id").agg(F.min("seq_id").alias("to_id"))
    links = pairs.join(least, "node_id").filter("seq_id <> to_id").select(F.col("seq_id").alias("from_id"), "to_id").distinct()
    return components(paths.select(F.col("seq_id").alias("node_id")), links).select(F.col("node_id").alias("seq_id"), "comp_id")


def path_name(sample: Column, haplotype: Column, contig: Column, phase: Column | None = None) -> Column:
    """Names of the form sample#haplotype#contig#phase; parts that are null are left out."""
    return F.concat_ws("#", *(c.cast("string") for c in (sample, haplotype, contig, F.lit(0) if phase is None else phase)))


def graph_counts(nodes: DataFrame, edges: DataFrame, steps: DataFrame) -> DataFrame:
    """One row: n_paths, n_steps, n_nodes, n_edges."""
    counts = [steps.agg(F.count_distinct("seq_id").alias("n_paths"), F.count(F.lit(1)).alias("n_steps")), nodes.agg(F.count_distinct("node_id").alias("n_nodes")), edges.select("from_id", "from_orient", "to_id", "to_orient").distinct().agg(F.count(F.lit(1)).alias("n_edges"))]
    out = counts[0].withColumn("_k", F.lit(1))
    for c in counts[1:]:
        out = out.join(c.withColumn("_k", F.lit(1)), "_k")  # one row each
    return out.drop("_k")
