"""Neighbours, running sums, runs and look-ups along an order, without one task that sees all of it.

An order is cut into buckets of equal width. Windows run inside a bucket; what crosses a border is worked out on one row
for each bucket, of which there are a few for each shuffle partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.shared import settled

SMALLEST = 1 << 16


def bucket_width(df: DataFrame, order: str, each: int = 4) -> int:
    """Width that cuts the range of `order` into about `each` buckets for every shuffle partition."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    if low is None:
        return SMALLEST
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * each
    return max(SMALLEST, -(-(high - low + 1) // parts))


def _bucket(order: str, width: int) -> Column:
    return F.floor(F.col(order) / F.lit(width)).cast("bigint")


def with_neighbour(df: DataFrame, by: list[str], order: str, cols: dict[str, str], width: int, ahead: bool = False) -> DataFrame:
    """Add columns of the row before (or behind) in each group of `by`: cols maps new names to columns. Null at the ends.

    `order` must tell the rows of a group apart.
    """
    step, edge = (F.lead, "first") if ahead else (F.lag, "last")
    inside = Window.partitionBy(*by, "_bucket").orderBy(order)
    df = df.withColumn("_bucket", _bucket(order, width))
    out = df.withColumns({"_here": step(F.lit(True)).over(inside)} | {new: step(old).over(inside) for new, old in cols.items()})
    pick = F.min if ahead else F.max
    edges = df.groupBy(*by, "_bucket").agg(pick(F.struct(order, *(F.col(old).alias(f"_v{k}") for k, old in enumerate(cols.values())))).alias("_e"))
    along = Window.partitionBy(*by).orderBy("_bucket") if by else Window.orderBy("_bucket")
    edges = edges.withColumn("_x", step("_e").over(along)).select(*(F.col(b).alias(f"_by{k}") for k, b in enumerate(by)), F.col("_bucket").alias("_b"), "_x")
    on = F.col("_bucket") == F.col("_b")
    for k, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_by{k}"))
    out = out.join(edges, on, "left")
    return out.withColumns({new: F.when(F.col("_here"), F.col(new)).otherwise(F.col(f"_x._v{k}")) for k, new in enumerate(cols)}).drop("_here", "_bucket", "_b", "_x", *(f"_by{k}" for k in range(len(by))))


def in_order(df: DataFrame, order: str, width: int) -> DataFrame:
    """The same rows, each bucket of `order` in one task and in order there, so that what is met as it is read needs no join."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, _bucket(order, width)).sortWithinPartitions(order)


def _behind(n: int, width: int, edges: bool):
    """Rows (order, columns, behind): each with the columns of the row n further on where the batch has it; edges: only the others, and the first n of each stretch of neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            there = np.zeros(len(at), bool)
            there[: max(0, len(at) - n)] = at[n:] == at[:-n] + n
            if edges:
                head = np.flatnonzero(np.r_[True, np.diff(at) != 1][: len(at)])
                first = np.arange(len(at)) - np.repeat(head, np.diff(np.r_[head, len(at)])) < n
                keep = pa.array(np.flatnonzero(~there | first))
                yield pa.RecordBatch.from_arrays([*(c.take(keep) for c in batch.columns), pa.array(~there).take(keep)], names=[f"c{k}" for k in range(width + 2)])
            else:
                own = np.flatnonzero(there)
                keep = pa.array(own)
                yield pa.RecordBatch.from_arrays([*(c.take(keep) for c in batch.columns), *(c.take(pa.array(own + n)) for c in batch.columns[1:])], names=[f"c{k}" for k in range(2 * width + 1)])

    return run


def with_row_behind(df: DataFrame, order: str, cols: dict[str, str], n: int) -> DataFrame:
    """(order, columns, new names): add columns of the row whose `order` is n more, null where there is none; cols maps new names to columns.

    Rows that come in order are met as they are read; only those at the ends of what is read at once are joined. Rows out of
    order are joined all. df is read twice.
    """
    old = list(dict.fromkeys(cols.values()))
    own = df.select(order, *old)
    kind = lambda *names: [f"{own.schema[c].dataType.simpleString()}" for c in names]
    schema = lambda kinds: ", ".join(f"c{k} {t}" for k, t in enumerate(kinds))
    new = {c: [x for x, y in cols.items() if y == c] for c in old}
    met = own.mapInArrow(_behind(n, len(old), False), schema(kind(order, *old, *old)))
    met = met.select(F.col("c0").alias(order), *(F.col(f"c{k + 1}").alias(c) for k, c in enumerate(old)), *(F.col(f"c{len(old) + 1 + old.index(c)}").alias(x) for x, c in cols.items()))
    ends = settled(own.mapInArrow(_behind(n, len(old), True), schema([*kind(order, *old), "boolean"])), "ends").withColumnsRenamed({"c0": order} | {f"c{k + 1}": c for k, c in enumerate(old)} | {f"c{len(old) + 1}": "_open"})
    behind = ends.select((F.col(order) - n).alias(order), *(F.col(c).alias(x) for c in old for x in new[c]))
    return met.unionByName(ends.filter("_open").select(order, *old).join(behind, order, "left"))


def with_sums_before(df: DataFrame, by: list[str], order: str, sums: dict[str, str], width: int) -> DataFrame:
    """Add the sums of columns over the rows before each row of its group: sums maps new names to columns.

    `order` must tell the rows of a group apart.
    """
    df = df.withColumn("_bucket", _bucket(order, width))
    inside = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    along = (Window.partitionBy(*by).orderBy("_bucket") if by else Window.orderBy("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, "_bucket").agg(*(F.sum(v).alias(f"_t{k}") for k, v in enumerate(sums.values())))
    base = totals.select(*(F.col(b).alias(f"_by{k}") for k, b in enumerate(by)), F.col("_bucket").alias("_b"), *(F.coalesce(F.sum(f"_t{k}").over(along), F.lit(0)).alias(f"_base{k}") for k in range(len(sums))))
    on = F.col("_bucket") == F.col("_b")
    for k, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_by{k}"))
    out = df.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in sums.items()}).join(base, on)
    return out.withColumns({n: F.col(n) + F.col(f"_base{k}") for k, n in enumerate(sums)}).drop("_bucket", "_b", *(f"_base{k}" for k in range(len(sums))), *(f"_by{k}" for k in range(len(by))))


def with_sum_before(df: DataFrame, by: list[str], order: str, value: str, name: str, width: int) -> DataFrame:
    return with_sums_before(df, by, order, {name: value}, width)


def _met_runs(values: int, edges: bool):
    """Of rows (order, values, apart): runs (order, values, length, apart) inside each batch that others can't lengthen; edges: only those that others may."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at, apart = batch.column(0).to_numpy(), batch.column(values + 1).to_numpy(zero_copy_only=False).astype(bool)
            gap = np.r_[True, np.diff(at) != 1]
            new = gap | apart
            new[1:] |= apart[:-1]
            for c in batch.columns[1 : values + 1]:
                there = c.is_valid().to_numpy(zero_copy_only=False)
                new[1:] |= (there[1:] != there[:-1]) | pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
            head = np.flatnonzero(new)
            length = np.diff(np.r_[head, n])
            last = np.r_[gap[head[1:]], True]
            own = (gap[head] | last) & ~apart[head]
            own = own if edges else ~own
            keep = pa.array(head[own])
            yield pa.RecordBatch.from_arrays([*(c.take(keep) for c in batch.columns[: values + 1]), pa.array(length[own].astype(np.int64)), pa.array(apart[head[own]])], names=[f"c{k}" for k in range(values + 3)])

    return run


def run_lengths(df: DataFrame, by: list[str], order: str, values: list[str], length: str | None = None, apart: Column | None = None, width: int | None = None) -> DataFrame:
    """Runs of equal neighbouring values: (by, order of the first row, values, length).

    Without `length` each row has length 1 and `order` counts rows without gaps; with it, rows are intervals
    [order, order + length) and only intervals that touch are joined. Rows for which `apart` holds are runs of their own.
    Nulls equal nulls. Rows that come in order are counted as they are read, and only runs at the ends of what is read at once
    are met with others.
    """
    if not by and not length:
        own = df.select(order, *values, (apart if apart is not None else F.lit(False)).alias("_apart"))
        schema = ", ".join(f"c{k} {t}" for k, t in enumerate([*(own.schema[c].dataType.simpleString() for c in (order, *values)), "bigint", "boolean"]))
        names = {f"c{k}": c for k, c in enumerate([order, *values, "length", "_apart"])}
        inner, ends = (own.mapInArrow(_met_runs(len(values), edges), schema).withColumnsRenamed(names) for edges in (False, True))
        return inner.drop("_apart").unionByName(run_lengths(settled(ends.drop("_apart"), "ends"), by, order, values, "length", width=width))
    if width is None:
        width = bucket_width(df, order)
    df = df.select(*by, order, *values, (F.col(length) if length else F.lit(1).cast("bigint")).alias("_len"), (apart if apart is not None else F.lit(False)).alias("_apart"))
    df = df.withColumn("_end", F.col(order) + F.col("_len"))
    near = with_neighbour(df, by, order, {"_pe": "_end", "_pa": "_apart"} | {f"_p{k}": v for k, v in enumerate(values)}, width)
    joins = F.col("_pe").isNotNull() & (F.col("_pe") == F.col(order)) & ~F.col("_apart") & ~F.coalesce("_pa", F.lit(False))
    for k, v in enumerate(values):
        joins = joins & F.col(v).eqNullSafe(F.col(f"_p{k}"))
    # A run's first row, and the end of the row before the next run: the run ends there.
    heads = near.filter(~joins).select(*by, order, *values, "_pe")
    last = df.groupBy(*by).agg(F.max("_end").alias("_stop"))
    nexts = with_neighbour(heads, by, order, {"_close": "_pe"}, width, ahead=True)
    if by:
        last = last.select(*(F.col(b).alias(f"_by{k}") for k, b in enumerate(by)), "_stop")
        on = F.lit(True)
        for k, b in enumerate(by):
            on = on & F.col(b).eqNullSafe(F.col(f"_by{k}"))
        nexts = nexts.join(last, on, "left").drop(*(f"_by{k}" for k in range(len(by))))
    else:
        stop = last.first()
        nexts = nexts.withColumn("_stop", F.lit(stop[0] if stop else None).cast("bigint"))
    return nexts.select(*by, order, *values, (F.coalesce("_close", "_stop") - F.col(order)).alias("length"))


def split_runs(runs: DataFrame, order: str, length: str, longest: int) -> DataFrame:
    """Runs cut into pieces of at most `longest`: all pieces but the last have that length."""
    cut = runs.withColumn("_k", F.explode(F.expr(f"sequence(0L, cast((`{length}` - 1) div {longest} as bigint))")))
    first = F.col("_k") * longest
    return cut.withColumn(order, F.col(order) + first).withColumn(length, F.least(F.col(length) - first, F.lit(longest))).drop("_k")


def with_interval(points: DataFrame, point: str, runs: DataFrame, start: str, length: str, cols: list[str], by: list[str] = [], width: int = 1 << 12) -> DataFrame:  # noqa: B006
    """Join each point to the run [start, start + length) that holds it, in the same group of `by`; points in no run keep nulls.

    Runs of a group must not overlap. Runs are repeated for each cell of `width` that they touch, and points look in their
    own cell: an equi-join, whatever the lengths.
    """
    cells = runs.select(*by, *cols, F.col(start).alias("_s"), (F.col(start) + F.col(length)).alias("_e"), F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(start) + F.col(length) - 1) / width))).alias("_cell"))
    left = points.withColumn("_cell", F.floor(F.col(point) / width))
    met = left.join(cells.withColumnRenamed("_cell", "_c2").withColumnsRenamed({b: f"_by_{b}" for b in by}), (F.col("_cell") == F.col("_c2")) & (F.col(point) >= F.col("_s")) & (F.col(point) < F.col("_e")) & (F.lit(True) if not by else _all_equal(by)), "left")
    return met.drop("_cell", "_c2", "_s", "_e", *(f"_by_{b}" for b in by))


def with_last(points: DataFrame, point: str, marks: DataFrame, mark: str, cols: list[str]) -> DataFrame:
    """Add columns of the last mark at or before each point; null where none is. Marks must differ.

    Points, each value once, and marks are put in one order; each bucket of it hands on its last mark. No mark is repeated,
    however far it reaches.
    """
    at = F.struct(F.col(mark).alias("_m"), *cols)
    every = marks.select(F.col(mark).alias("_p"), F.lit(0).alias("_tag"), at.alias("_v"))
    every = every.unionByName(points.select(F.col(point).alias("_p")).filter("_p IS NOT NULL").distinct().select("_p", F.lit(1).alias("_tag"), F.lit(None).cast(every.schema["_v"].dataType).alias("_v")))
    every = every.withColumn("_b", _bucket("_p", bucket_width(every, "_p")))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.last("_v", ignorenulls=True).over(upto(Window.partitionBy("_b").orderBy("_p", "_tag")))
    tops = every.groupBy("_b").agg(F.max("_v").alias("_top"))  # one row a bucket
    tops = tops.select("_b", F.last("_top", ignorenulls=True).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    found = every.withColumn("_own", own).filter("_tag = 1").join(tops, "_b").select("_p", F.coalesce("_own", "_before").alias("_v"))
    return points.join(found, F.col(point) == F.col("_p"), "left").select(*points.columns, *(F.col(f"_v.{c}") for c in cols))


def _all_equal(by: list[str]) -> Column:
    on = F.lit(True)
    for b in by:
        on = on & (F.col(b) == F.col(f"_by_{b}"))
    return on


def overlaps(left: DataFrame, l_start: str, l_end: str, right: DataFrame, r_start: str, r_end: str, width: int = 1 << 12) -> DataFrame:
    """Pairs of closed intervals that overlap. Each pair comes once: from the cell in which the overlap begins.

    Both sides are repeated for each cell of `width` they touch; choose it near the typical length of an interval.
    """
    a = left.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(l_start) / width), F.floor(F.col(l_end) / width))))
    b = right.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(r_start) / width), F.floor(F.col(r_end) / width))))
    met = a.join(b, "_cell").filter((F.col(l_start) <= F.col(r_end)) & (F.col(r_start) <= F.col(l_end)))
    return met.filter(F.floor(F.greatest(l_start, r_start) / width) == F.col("_cell")).drop("_cell")
