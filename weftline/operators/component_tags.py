"""Tag arrays of components, each sorted from its own texts alone, and put together in the order of the whole.

A component's array is cut where the whole's buckets begin, so that each bucket of the whole meets the next rows of all
arrays in one task: there, every row takes the next one of its component. No row is joined by its number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import suffix_sort
from weftline.operators.ordered import run_lengths
from weftline.operators.suffix_sort import anchor_ranks, bucket_of, cuts_of, each_suffix, give_up_shuffles, in_blocks, sampled, unpacked
from weftline.operators.tags import POSITION
from weftline.shared import forget, fresh_path, remove, settled

#: Component, key, rank; node, strand, offset.
_SUFFIX, _TAG = (np.int64, np.int64, np.int64), (np.int64, np.uint8, np.int32)


def _tagged(chunk: int, cuts, first: int, last: int):
    """Of texts (seq_id, g, seq, ranks, steps): the suffixes of the components' buckets from first to before last with their graph positions, packed; 0 where no step is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                steps = batch.column(4)
                ends, cols = steps.offsets.to_numpy(), [steps.values.field(k).to_numpy() for k in range(4)]
                for row in range(batch.num_rows):
                    start, length, node, strand = (np.r_[c[ends[row] : ends[row + 1]], 0] for c in cols)  # the last one is for places before all steps
                    for _, g, at, key, rank, _ in each_suffix([batch.slice(row, 1)], chunk):
                        b = bucket_of(g, key, rank, cuts)
                        own = np.flatnonzero((b >= first) & (b < last))
                        if len(own):
                            place = own + at
                            k = np.searchsorted(start[:-1], place, "right") - 1
                            off = place - start[k]
                            there = off < length[k]
                            yield b[own], np.full(len(own), g, np.int64), key[own], rank[own], node[k] * there, (strand[k] * there).astype(np.uint8), (off * there).astype(np.int32)

        yield from in_blocks(rows())

    return run


def _arrays(whole):
    """Of rows (b, n, rows) in order of b: each component's array in order, cut at the buckets of the whole: (b, part, n, rows), part the bucket it comes from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = [], None

        def out():
            g, key, rank, *tag = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((rank, key, g))
            for block in in_blocks([(bucket_of(0, key[order], rank[order], whole), *(c[order] for c in tag))]):
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array([own], pa.int64()), block.column(1), block.column(2)], names=["b", "part", "n", "rows"])

        for batch in batches:
            for b, n, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if b != own and held:
                    yield from out()
                    held.clear()
                own = b
                held.append(unpacked(rows.as_buffer(), n, _SUFFIX + _TAG))
        if held:
            yield from out()

    return run


def _of_whole(chunk: int, cuts, first: int, last: int):
    """The suffixes of the whole's buckets from first to before last with their components, packed: (b, part -1, n, rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for _, g, _, key, rank, _ in each_suffix(batches, chunk):
                b = bucket_of(0, key, rank, cuts)
                own = np.flatnonzero((b >= first) & (b < last))
                if len(own):
                    yield b[own], np.full(len(own), g, np.int64), key[own], rank[own]

        for block in in_blocks(rows()):
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array([-1], pa.int64()), block.column(1), block.column(2)], names=["b", "part", "n", "rows"])

    return run


def _merged(before: np.ndarray):
    """Of rows (b, part, n, rows) in order of b and part: the tag runs of each bucket of the whole; open: those at its ends, which others may lengthen. before: rows in earlier buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes, tags, own = [], [], None

        def out():
            g, key, rank = (np.concatenate(c) for c in zip(*suffixes))
            at = np.argsort(g[np.lexsort((rank, key))], kind="stable")  # where the next rows of the components go, one component behind another
            new = np.zeros(len(at), bool)
            new[:1] = True
            cols = []
            for c in zip(*tags):
                col = np.concatenate(c)
                if len(col) != len(at):
                    raise ValueError(f"bucket {own} has {len(at)} rows, the components' arrays {len(col)}")
                put = np.empty_like(col)
                put[at] = col
                new[1:] |= put[1:] != put[:-1]
                cols.append(put)
            head = np.flatnonzero(new)
            open_ = np.zeros(len(head), bool)
            open_[[0, -1]] = True
            node, strand, off = (c[head] for c in cols)
            yield pa.RecordBatch.from_pydict({"bwt_start": pa.array(before[own] + head), "node_id": pa.array(node), "is_reverse": pa.array(strand.astype(np.int32)), "node_offset": pa.array(off), "length": pa.array(np.diff(np.r_[head, len(at)])), "open": pa.array(open_)})

        for batch in batches:
            for b, part, n, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if b != own and suffixes:
                    yield from out()
                    suffixes.clear()
                    tags.clear()
                own = b
                (suffixes if part < 0 else tags).append(unpacked(rows.as_buffer(), n, _SUFFIX if part < 0 else _TAG))
        if suffixes:
            yield from out()

    return run


def merged_runs(texts: DataFrame, by: str, positions: DataFrame, chunk: int = 1 << 18) -> DataFrame:
    """(bwt_start, node_id, is_reverse, node_offset, length), as tag_runs of the whole: tag arrays of the components of texts (seq_id, seq as bytes, by BIGINT), each in order of its own suffixes, put together in the order of all.

    positions: as from graph.path_positions; end-markers and places without a step have node 0. Anchors are ranked once for both
    orders, as those of one component stand in the same order alone and among all. The arrays are written to the shared
    folder, packed by column; only so many suffixes are shuffled before the files are given up.
    """
    spark, kinds = texts.sparkSession, "bwt_start bigint, node_id bigint, is_reverse int, node_offset int, length bigint"
    size = texts.agg(F.sum(F.length("seq").cast("bigint") + 1)).first()[0] or 0
    if not size:
        return settled(spark.createDataFrame([], kinds), "tag_runs")
    steps = positions.filter("node_length > 0").select("seq_id", F.struct(*(F.col(c).cast("bigint").alias(c) for c in ("path_start", "node_length", "node_id", "is_reverse"))).alias("s")).groupBy("seq_id").agg(F.sort_array(F.collect_list("s")).alias("steps"))
    ranked = anchor_ranks(texts, by, chunk)
    placed = settled(ranked.join(steps, "seq_id", "left").select("seq_id", "g", "seq", "ranks", F.coalesce("steps", F.array().cast(steps.schema["steps"].dataType)).alias("steps")), "placed_texts")
    forget(ranked)
    bare = placed.drop("steps")
    drawn = bare.mapInArrow(sampled(chunk, max(64, size >> 20)), "g bigint, k bigint, r bigint").toArrow()  # a million rows or so
    g, key, rank = (drawn.column(c).to_numpy() for c in ("g", "k", "r"))
    own, whole = cuts_of([g, key, rank], size), cuts_of([np.zeros_like(g), key, rank], size)
    once, least = max(1, suffix_sort._PASS // suffix_sort._SORTED), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def passes(cuts) -> Iterator[tuple[int, int, int]]:
        for first in range(0, len(cuts[0]) + 1, once):
            last = min(first + once, len(cuts[0]) + 1)
            yield first, last, max(least, last - first)

    block = "b bigint, part bigint, n bigint, rows binary"
    path = fresh_path(spark, "component_arrays")
    for first, last, parts in passes(own):
        rows = placed.mapInArrow(_tagged(chunk, own, first, last), "b bigint, n bigint, rows binary")
        rows.repartition(parts, "b").sortWithinPartitions("b").mapInArrow(_arrays(whole), block).write.mode("append").parquet(path)
        give_up_shuffles(placed)
    arrays = spark.read.schema(block).parquet(path)
    n = np.zeros(len(whole[0]) + 1, np.int64)
    for b, k in arrays.groupBy("b").agg(F.sum("n")).collect():  # a row for each bucket
        n[b] = k
    before, out = np.r_[0, np.cumsum(n)], fresh_path(spark, "merged")
    for first, last, parts in passes(whole):
        rows = bare.mapInArrow(_of_whole(chunk, whole, first, last), block).unionByName(arrays.filter(F.col("b").between(first, last - 1)))
        rows.repartition(parts, "b").sortWithinPartitions("b", "part").mapInArrow(_merged(before), f"{kinds}, open boolean").write.mode("append").parquet(out)
        give_up_shuffles(placed)
    forget(placed)
    remove(spark, path)
    runs = spark.read.schema(f"{kinds}, open boolean").parquet(out)
    return runs.filter("not open").drop("open").unionByName(run_lengths(runs.filter("open").drop("open"), [], "bwt_start", POSITION, "length"))
