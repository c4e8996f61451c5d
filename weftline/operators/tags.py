"""Tag arrays: the graph position of every row of the text index, as runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.dna import LONGEST_RUN, decode_run, encode_run, position
from weftline.operators.ordered import bucket_width, overlaps, run_lengths, split_runs, with_interval, with_last, with_neighbour, with_sum_before
from weftline.shared import settled

POSITION = ["node_id", "is_reverse", "node_offset"]


def tag_array(sa: DataFrame, positions: DataFrame, width: int = 64) -> DataFrame:
    """(sa's columns but seq_id, seq_off and ch; node_id, is_reverse, node_offset): text positions met with the paths' steps; end-markers have node 0.

    width: cells by which the steps are found, near the typical length of a node.
    """
    steps = positions.filter("node_length > 0").withColumn("_from", F.col("path_start"))
    at = with_interval(sa, "seq_off", steps, "path_start", "node_length", ["node_id", "is_reverse", "_from"], ["seq_id"], width).withColumn("node_offset", F.col("seq_off") - F.col("_from"))
    zero = {"node_id": "bigint", "is_reverse": "int", "node_offset": "int"}
    return at.select(*(c for c in sa.columns if c not in ("seq_id", "seq_off", "ch")), *(F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in zero.items()))


def tag_runs(tags: DataFrame) -> DataFrame:
    """(bwt_start, node_id, is_reverse, node_offset, length)."""
    return run_lengths(tags.withColumnRenamed("bwt_pos", "bwt_start"), [], "bwt_start", POSITION)


def sharing_rows(places: DataFrame, sa: DataFrame, positions: DataFrame, width: int = 64) -> DataFrame:
    """(bwt_pos, seq_id, seq_off, node_id, is_reverse, node_offset): the rows of the index that have the graph position of one of some text places (seq_id, seq_off), written to the shared folder.

    The places' positions are met with the steps to the same nodes, and these with the index: no other row gets its position. A
    place that no step covers gives no row. width: as in tag_array.
    """
    steps = positions.filter("node_length > 0").withColumn("_from", F.col("path_start"))
    at = with_interval(places.select("seq_id", "seq_off").distinct(), "seq_off", steps, "path_start", "node_length", ["node_id", "is_reverse", "_from"], ["seq_id"], width)
    own = at.filter("node_id IS NOT NULL").select("node_id", "is_reverse", (F.col("seq_off") - F.col("_from")).cast("int").alias("node_offset")).distinct()
    spots = own.join(steps.select("seq_id", "_from", "node_id", "is_reverse"), ["node_id", "is_reverse"]).select("seq_id", (F.col("_from") + F.col("node_offset")).alias("seq_off"), *POSITION)
    return settled(settled(spots, "spots").join(sa.select("bwt_pos", "seq_id", "seq_off"), ["seq_id", "seq_off"]).select("bwt_pos", "seq_id", "seq_off", *POSITION), "sharing")


def sharing_runs(rows: DataFrame) -> DataFrame:
    """The tag runs, as those of tag_runs, whose positions the rows have: rows is from sharing_rows, so a row that is missing has another position and ends a run."""
    return run_lengths(rows.select(F.col("bwt_pos").alias("bwt_start"), *POSITION, F.lit(1).cast("bigint").alias("_one")), [], "bwt_start", POSITION, "_one")


def read_runs(table: DataFrame) -> DataFrame:
    """(file_id, start_position, graph_position, length) of a table of run starts.

    A run ends where the next one of its file begins; the last one, which only marks the end, has none and is left out.
    Repeated rows count once; of several runs with one start the one with the highest position stays. A null position is a
    gap like 0. Rows with a null file or start are left out.
    """
    rows = table.filter("file_id IS NOT NULL AND start_position IS NOT NULL").groupBy("file_id", "start_position").agg(F.coalesce(F.max("graph_position"), F.lit(0)).cast("bigint").alias("graph_position"))
    out = with_neighbour(rows, ["file_id"], "start_position", {"_next": "start_position"}, bucket_width(rows, "start_position"), ahead=True)
    return out.filter("_next IS NOT NULL").select("file_id", "start_position", "graph_position", (F.col("_next") - F.col("start_position")).alias("length"))


def coalesce_runs(runs: DataFrame) -> DataFrame:
    """Neighbouring runs of one file with the same position as one run; gaps are left out."""
    out = run_lengths(runs, ["file_id"], "start_position", ["graph_position"], "length")
    return out.filter("graph_position <> 0").select("file_id", "start_position", "graph_position", "length")


def coverage(runs: DataFrame) -> DataFrame:
    """(file_id, n_runs, n_covered, n_rows, share): rows with a position against all rows of each file."""
    own = F.col("graph_position") != 0
    out = runs.groupBy("file_id").agg(F.count(F.when(own, 1)).alias("n_runs"), F.sum(F.when(own, F.col("length")).otherwise(0)).alias("n_covered"), F.sum("length").alias("n_rows"))
    return out.withColumn("share", F.try_divide("n_covered", "n_rows"))


def whole_layout(runs: DataFrame, end_markers: int = 0) -> DataFrame:
    """(bwt_start, node_id, is_reverse, node_offset, length): the files one behind another in order of file_id, behind a run of end-markers (node 0).

    Gaps keep their room but give no run.
    """
    sizes = runs.groupBy("file_id").agg(F.max(F.col("start_position") + F.col("length")).alias("size"))
    base = with_sum_before(sizes, [], "file_id", "size", "base", bucket_width(sizes, "file_id")).select("file_id", "base")
    pos = position(F.col("graph_position"))
    out = runs.filter("graph_position <> 0").join(base, "file_id").select((F.col("start_position") + F.col("base") + end_markers).alias("bwt_start"), pos["node_id"].alias("node_id"), pos["is_reverse"].alias("is_reverse"), pos["node_offset"].alias("node_offset"), "length")
    if end_markers:
        spark = runs.sparkSession
        out = spark.createDataFrame([(0, 0, 0, 0, end_markers)], "bwt_start bigint, node_id bigint, is_reverse int, node_offset int, length bigint").unionByName(out)
    return out


def encode_runs(runs: DataFrame) -> DataFrame:
    """(bwt_start, word): runs cut to at most 511 rows, each packed into a number."""
    cut = split_runs(runs, "bwt_start", "length", LONGEST_RUN)
    return cut.select("bwt_start", encode_run(*(F.col(c) for c in (*POSITION, "length"))).alias("word"))


def decode_runs(words: DataFrame) -> DataFrame:
    return words.select("bwt_start", decode_run(F.col("word")).alias("_d")).select("bwt_start", "_d.*")


def query_runs(ranges: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs that overlap closed row ranges (range_start, range_end), clipped to them: the ranges' columns, (run_start, position, overlap).

    Runs don't overlap each other. They are numbered in order; the numbers at both ends of a range, found by the last run
    that begins at or before them, say which runs it meets, so no run or range is repeated for what it covers.
    """
    r = runs.filter("length > 0").select(F.col("bwt_start").alias("_rs"), (F.col("bwt_start") + F.col("length") - 1).alias("_re"), *POSITION, F.lit(1).alias("_one"))
    r = settled(with_sum_before(r, [], "_rs", "_one", "_no", bucket_width(r, "_rs")).drop("_one"), "numbered")
    ends = ranges.select(F.explode(F.array("range_start", "range_end")).alias("_at")).distinct()
    known = settled(with_last(ends, "_at", r, "_rs", ["_no", "_re"]), "ends")
    low = known.select(F.col("_at").alias("range_start"), F.when(F.col("_re") >= F.col("_at"), F.col("_no")).otherwise(F.coalesce(F.col("_no") + 1, F.lit(0))).alias("_lo"))
    high = known.filter("_no IS NOT NULL").select(F.col("_at").alias("range_end"), F.col("_no").alias("_hi"))
    met = ranges.join(low, "range_start").join(high, "range_end").filter("_lo <= _hi").withColumn("_no", F.explode(F.expr("sequence(_lo, _hi)"))).join(r, "_no")
    return met.select(*ranges.columns, *POSITION, F.greatest("_rs", "range_start").alias("run_start"), (F.least("_re", "range_end") - F.greatest("_rs", "range_start") + 1).alias("overlap"))


def query_distinct(ranges: DataFrame, runs: DataFrame) -> DataFrame:
    """(range_start, range_end, n_runs, n_positions, n_nodes); ranges without a run have 0."""
    met = query_runs(ranges.select("range_start", "range_end").distinct(), runs)
    each = met.groupBy("range_start", "range_end").agg(F.count(F.lit(1)).alias("n_runs"), F.count_distinct(*POSITION).alias("n_positions"), F.count_distinct("node_id").alias("n_nodes"))
    out = ranges.select("range_start", "range_end").distinct().join(each, ["range_start", "range_end"], "left")
    return out.fillna(0, ["n_runs", "n_positions", "n_nodes"])


def tag_at(points: DataFrame, point: str, runs: DataFrame) -> DataFrame:
    """Each point with the run that holds it, or nulls."""
    return with_interval(points, point, runs.withColumn("run_start", F.col("bwt_start")), "bwt_start", "length", ["run_start", *POSITION])


def _with_component(rows: DataFrame, seq_comp: DataFrame) -> DataFrame:
    """Add comp_id by seq_id; a sequence without steps is a component of its own, numbered below all nodes."""
    return rows.join(seq_comp, "seq_id", "left").withColumn("comp_id", F.coalesce("comp_id", -1 - F.col("seq_id")))


def split_by_component(tags: DataFrame, sa: DataFrame, seq_comp: DataFrame) -> DataFrame:
    """(comp_id, row_no, position): a tag array for each component, rows counted from 0 in the order of the whole."""
    own = _with_component(tags.join(sa.select("bwt_pos", "seq_id"), "bwt_pos"), seq_comp).withColumn("_one", F.lit(1))
    out = with_sum_before(own, ["comp_id"], "bwt_pos", "_one", "row_no", bucket_width(own, "bwt_pos"))
    return out.select("comp_id", "row_no", *POSITION)


def merge_components(parts: DataFrame, sa: DataFrame, seq_comp: DataFrame) -> DataFrame:
    """The whole tag array of component arrays: row r takes the next row of the array of its sequence's component.

    Both sides are numbered inside the component and joined on that number.
    """
    rows = _with_component(sa.select("bwt_pos", "seq_id"), seq_comp).withColumn("_one", F.lit(1))
    rows = with_sum_before(rows, ["comp_id"], "bwt_pos", "_one", "row_no", bucket_width(rows, "bwt_pos"))
    return rows.join(parts, ["comp_id", "row_no"]).select("bwt_pos", *POSITION)


def insert_runs(runs: DataFrame, new: DataFrame) -> DataFrame:
    """(file_id, start_position, graph_position, length, accepted): new runs, accepted where all their rows lie in gaps of their file.

    A run is rejected if it shares a row with one of `runs` or with a new one that comes before it, by start, then length, then
    position; so of repeated new runs one is accepted. Runs without a row are rejected.
    """
    key = ["file_id", "start_position", "length", "graph_position"]
    ask = new.select(*key).filter("file_id IS NOT NULL AND start_position IS NOT NULL").withColumn("_id", F.monotonically_increasing_id())
    ask = settled(ask.withColumns({"_end": F.col("start_position") + F.col("length"), "_file": F.col("file_id")}), "new_runs")
    width = bucket_width(ask, "start_position")
    # The furthest end of the new runs before it: inside its bucket and, one row a bucket, before that.
    ask = ask.withColumn("_b", F.floor(F.col("start_position") / width))
    inside = Window.partitionBy("file_id", "_b").orderBy("start_position", "length", "graph_position", "_id").rowsBetween(Window.unboundedPreceding, -1)
    tops = ask.groupBy("file_id", "_b").agg(F.max("_end").alias("_top"))
    tops = tops.select("file_id", "_b", F.max("_top").over(Window.partitionBy("file_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    reach = F.greatest(F.max("_end").over(inside), F.col("_before"))
    ask = ask.join(tops, ["file_id", "_b"]).withColumn("_reach", reach)
    # Runs that were there: the last one that begins before this one's end.
    old = runs.filter("length > 0").select("file_id", F.col("start_position").alias("_s"), (F.col("start_position") + F.col("length") - 1).alias("_e"))
    met = overlaps(ask.filter("length > 0").withColumn("_last", F.col("_end") - 1), "start_position", "_last", old.withColumnRenamed("file_id", "_f"), "_s", "_e", 1 << 12).filter("_f = file_id").select("_id").distinct()
    out = ask.join(met.withColumn("_hit", F.lit(True)), "_id", "left")
    free = (F.col("length") > 0) & F.col("_hit").isNull() & (F.col("_reach").isNull() | (F.col("_reach") <= F.col("start_position")))
    return out.select("file_id", "start_position", "graph_position", "length", F.coalesce(free, F.lit(False)).alias("accepted"))
