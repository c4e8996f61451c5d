"""Maximal exact matches of reads in a collection of texts, and the graph positions of their hits."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.dna import ALPHABET
from weftline.operators.ordered import bucket_width, with_interval, with_sum_before
from weftline.operators.tags import POSITION
from weftline.operators.text import as_bytes
from weftline.shared import settled

#: Letters of a read that a cell of starts covers.
_CELL = 256


def _window_keys(k: int, chunk: int):
    code = np.zeros(256, np.int64)
    code[np.frombuffer(ALPHABET.encode(), np.uint8)] = range(1, 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text_id, seq in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole = code[np.frombuffer(seq.as_buffer(), np.uint8)]
                for begin in range(0, len(whole) - k + 1, chunk):
                    part = whole[begin : begin + chunk + k - 1]
                    n = len(part) - k + 1
                    bad = np.r_[0, np.cumsum(part == 0)]
                    at = np.flatnonzero(bad[k:] == bad[:-k])
                    keys = []
                    for first in range(0, k, 27):
                        key = np.zeros(n, np.int64)
                        for j in range(first, min(k, first + 27)):
                            key = key * 5 + np.maximum(part[j : j + n] - 1, 0)
                        keys.append(key[at])
                    before = np.r_[whole[begin - 1] if begin else 0, part[: n - 1]]
                    behind = np.r_[part[k:], whole[begin + len(part)] if begin + len(part) < len(whole) else 0]
                    cols = [np.full(len(at), text_id, np.int64), (at + begin).astype(np.int32), *keys, before[at].astype(np.int32), behind[at].astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["id", "at", *(f"k{j}" for j in range(len(keys))), "before", "behind"])

    return run


def keyed_windows(texts: DataFrame, text_id: str, at: str, k: int, chunk: int = 1 << 20) -> DataFrame:
    """(text_id, at, k0, k1, .., before, behind): windows of k letters of ACGNT as numbers of base 5, 27 letters each, and the codes of the letters around them, 0 for none."""
    keys = [f"k{j}" for j in range(-(-k // 27))]
    schema = ", ".join(["id bigint", "at int", *(f"{c} bigint" for c in keys), "before int", "behind int"])
    out = texts.filter(F.length("seq") >= k).select(F.col(text_id).cast("bigint"), as_bytes(F.col("seq"))).mapInArrow(_window_keys(k, chunk), schema)
    return out.withColumnsRenamed({"id": text_id, "at": at})


def text_windows(texts: DataFrame, min_len: int) -> tuple[DataFrame, DataFrame]:
    """Windows of the texts and, of the distinct ones, which letters stand around them: what islands() needs of texts."""
    other = keyed_windows(texts, "seq_id", "o", min_len)
    bit = lambda c: F.expr(f"shiftleft(1, {c})")
    return other, other.groupBy(*(c for c in other.columns if c[1:].isdigit())).agg(F.bit_or(bit("before")).alias("_tb"), F.bit_or(bit("behind")).alias("_ta"))


def islands(reads: DataFrame, texts: DataFrame | tuple[DataFrame, DataFrame], min_len: int) -> DataFrame:
    """(read_id, start, stop, seq_id, diagonal): maximal stretches of a read that stand in a text at start + diagonal.

    A stretch begins where a window of min_len letters stands in both and the letters before it differ, and ends where those
    behind one differ. The distinct windows of the texts tell which letters stand around each; only windows of reads that have
    other ones are joined with the texts, by window and letter, so what lies inside a stretch gives no pair, not even in long
    repeats. Beginnings and ends alternate along a diagonal. Reads and texts: (read_id, seq), (seq_id, seq), in capitals, with
    one row for each id. Letters but ACGNT match nothing. Instead of texts, their text_windows may be given.
    """
    one = keyed_windows(reads, "read_id", "i", min_len)
    other, around = texts if isinstance(texts, tuple) else text_windows(texts, min_len)
    keys = [c for c in one.columns if c[1:].isdigit()]
    bit = lambda c: F.expr(f"shiftleft(1, {c})")
    others = lambda mask, c: F.when(F.col(c) == 0, F.col(mask)).otherwise(F.col(mask).bitwiseAND(F.bitwise_not(bit(c))))
    edges = one.join(around, keys).select("read_id", "i", *keys, others("_tb", "before").alias("_first"), others("_ta", "behind").alias("_last"))
    edges = settled(edges.filter("_first <> 0 OR _last <> 0"), "edges")

    def met(mask: str, side: str, is_last: int) -> DataFrame:
        letters = F.filter(F.sequence(F.lit(0), F.lit(len(ALPHABET))), lambda c: F.call_function("getbit", F.col(mask), c) == 1)
        ask = edges.filter(F.col(mask) != 0).select("read_id", "i", *keys, F.explode(letters).alias(side))
        return ask.join(other.select("seq_id", "o", *keys, side), [*keys, side]).select("read_id", "seq_id", (F.col("o") - F.col("i")).alias("diagonal"), "i", F.lit(is_last).alias("is_last"))

    along = Window.partitionBy("read_id", "seq_id", "diagonal").orderBy("i", "is_last")
    ends = met("_first", "before", 0).unionByName(met("_last", "behind", 1)).withColumn("_next", F.lead("i").over(along))
    return ends.filter("is_last = 0").select("read_id", F.col("i").alias("start"), (F.col("_next") + min_len).alias("stop"), "seq_id", "diagonal")


def _furthest(need: int, min_len: int):
    """Of stretches sorted by read and start: (read_id, mem_start, mem_end) where the need-th furthest stop so far grows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, at, stops, last = None, None, [], 0
        for batch in batches:
            out = []

            def close():
                nonlocal last
                if at is not None and len(stops) == need and stops[0] >= at + min_len and stops[0] > last:
                    last = stops[0]
                    out.append((read, at, last))

            for r, start, stop in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (r, start) != (read, at):
                    close()
                    if r != read:
                        stops, last = [], 0
                    read, at = r, start
                if len(stops) < need:
                    heappush(stops, stop)
                else:
                    heappushpop(stops, stop)
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["read_id", "mem_start", "mem_end"])
        if at is not None and len(stops) == need and stops[0] >= at + min_len and stops[0] > last:
            yield pa.RecordBatch.from_arrays([pa.array([read], pa.int64()), pa.array([at], pa.int32()), pa.array([stops[0]], pa.int32())], names=["read_id", "mem_start", "mem_end"])

    return run


def find_mems(reads: DataFrame, texts: DataFrame | tuple[DataFrame, DataFrame], min_len: int, min_occ: int = 1) -> tuple[DataFrame, DataFrame]:
    """Maximal exact matches (read_id, mem_start, mem_end, size) and their places (.., seq_id, seq_off).

    For each start x let e(x) be the furthest end such that the read's letters [x, e) stand at least min_occ times in the
    texts, overlapping places counted. A match is reported if it has min_len letters and e(x) > e(x - 1). Empty reads, and
    reads shorter than min_len, have none. read_id must tell the reads apart.

    e(x) grows only where a stretch begins: it is the min_occ-th furthest stop of the stretches that have begun, kept while
    the stretches of a read stream by in order of their start. Places are looked up for the matches that are reported.
    """
    if min_len < 1:
        raise ValueError("min_len must be at least 1")
    found = settled(islands(reads, texts, min_len).withColumn("read_id", F.col("read_id").cast("bigint")), "islands")
    mems = found.select("read_id", "start", "stop").repartition("read_id").sortWithinPartitions("read_id", "start").mapInArrow(_furthest(max(1, min_occ), min_len), "read_id bigint, mem_start int, mem_end int")
    cells = found.withColumn("_cell", F.explode(F.expr(f"sequence(start div {_CELL}, (stop - {min_len}) div {_CELL})")))
    places = mems.withColumn("_cell", F.expr(f"mem_start div {_CELL}")).join(cells, ["read_id", "_cell"]).filter("start <= mem_start AND stop >= mem_end")
    places = settled(places.select("read_id", "mem_start", "mem_end", "seq_id", (F.col("mem_start") + F.col("diagonal")).cast("bigint").alias("seq_off")), "places")
    match = ["read_id", "mem_start", "mem_end"]
    sized = places.groupBy(*match).agg(F.count(F.lit(1)).alias("size"))
    return sized, places.join(sized, match).select(*match, "size", "seq_id", "seq_off")


def suffix_matches(reads: DataFrame, texts: DataFrame | tuple[DataFrame, DataFrame], min_len: int) -> DataFrame:
    """(read_id, match_length): the longest end of each read, of at least min_len letters, that stands in a text; reads without one have no row."""
    ends = islands(reads, texts, min_len).join(reads.select("read_id", F.length("seq").alias("_n")), "read_id").filter("stop = _n")
    return ends.groupBy("read_id").agg(F.max(F.col("_n") - F.col("start")).alias("match_length"))


def hits(places: DataFrame, sa: DataFrame, positions: DataFrame, mode: str = "position") -> DataFrame:
    """(seq_id, node_id, node_offset, is_reverse, mem_length, mem_start, read_id) of the places of matches.

    mode "position": a row for each distinct graph position of a match, with the sequence of its first row in the text
    index; "sequence": a row for each sequence, with the position of its first row. positions: of the paths' steps.
    """
    rows = places.join(sa.select("seq_id", "seq_off", "bwt_pos"), ["seq_id", "seq_off"])
    steps = positions.filter("node_length > 0").withColumn("_from", F.col("path_start"))
    rows = with_interval(rows, "seq_off", steps, "path_start", "node_length", ["node_id", "is_reverse", "_from"], ["seq_id"], 64).filter("node_id IS NOT NULL").withColumn("node_offset", (F.col("seq_off") - F.col("_from")).cast("int"))
    match = ["read_id", "mem_start", "mem_end"]
    if mode == "position":
        out = rows.groupBy(*match, *POSITION).agg(F.min_by("seq_id", "bwt_pos").alias("seq_id"))
    elif mode == "sequence":
        out = rows.groupBy(*match, "seq_id").agg(F.min_by(F.struct(*POSITION), "bwt_pos").alias("p")).select(*match, "seq_id", "p.*")
    else:
        raise ValueError("mode must be position or sequence")
    return out.select("seq_id", "node_id", "node_offset", "is_reverse", (F.col("mem_end") - F.col("mem_start")).alias("mem_length"), "mem_start", "read_id")


def longest_run_hits(places: DataFrame, sa: DataFrame, runs: DataFrame) -> DataFrame:
    """(read_id, mem_start, mem_end, seq_id, node_id, is_reverse, node_offset, run_length): for each match and sequence the position in the longest tag run; ties go to the smallest position."""
    rows = places.join(sa, ["seq_id", "seq_off"])
    rows = with_interval(rows, "bwt_pos", runs.withColumn("run_length", F.col("length")), "bwt_start", "length", ["run_length", *POSITION])
    order = F.struct(-F.col("run_length"), *(F.col(c) for c in POSITION))
    out = rows.groupBy("read_id", "mem_start", "mem_end", "seq_id").agg(F.min_by(F.struct("run_length", *POSITION), order).alias("p"))
    return out.select("read_id", "mem_start", "mem_end", "seq_id", "p.*")


def hit_paths(places: DataFrame, positions: DataFrame) -> DataFrame:
    """(read_id, mem_start, mem_end, seq_id, seq_off, path, first_offset, path_length): the oriented nodes that each place of a match walks, as >1<2 strings."""
    p = places.withColumn("_end", F.col("seq_off") + F.col("mem_end") - F.col("mem_start") - 1)
    # Steps are found by cells of path letters, on (seq_id, cell).
    cell = 1 << 10
    a = p.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("seq_off") / cell), F.floor(F.col("_end") / cell))))
    b = positions.filter("node_length > 0").withColumn("_stop", F.col("path_start") + F.col("node_length") - 1)
    b = b.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("path_start") / cell), F.floor(F.col("_stop") / cell))))
    met = a.join(b, ["seq_id", "_cell"]).filter((F.col("path_start") <= F.col("_end")) & (F.col("seq_off") <= F.col("_stop")))
    name = F.concat(F.when(F.col("is_reverse") == 1, "<").otherwise(">"), F.col("node_id").cast("string"))
    out = met.groupBy("read_id", "mem_start", "mem_end", "seq_id", "seq_off").agg(F.array_sort(F.collect_set(F.struct("step", name.alias("name"), "node_length"))).alias("s"), (F.col("seq_off") - F.min("path_start")).cast("int").alias("first_offset"))
    return out.select("read_id", "mem_start", "mem_end", "seq_id", "seq_off", F.array_join(F.transform("s", lambda x: x["name"]), "").alias("path"), "first_offset", F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x["node_length"]).alias("path_length"))


def seq_starts(hits_: DataFrame, sequences: DataFrame) -> DataFrame:
    """(seq_id, first_row): where each sequence's hits begin when sorted by sequence, sequences without hits too; one more row, seq_id null, has the total."""
    counts = hits_.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    every = sequences.select(F.col("seq_id").cast("bigint").alias("seq_id")).filter("seq_id IS NOT NULL").distinct().join(counts, "seq_id", "left").fillna(0, ["n"])
    starts = with_sum_before(every, [], "seq_id", "n", "first_row", bucket_width(every, "seq_id")).select("seq_id", F.col("first_row").cast("bigint").alias("first_row"))
    return starts.unionByName(every.agg(F.lit(None).cast("bigint").alias("seq_id"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("first_row")))
