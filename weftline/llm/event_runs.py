"""Problem 2: runs of consecutive events that are the same or nearly the same.

Events are range-partitioned by (entity, order), so one entity's events may fill many tasks, and each task passes once
over its sorted events, comparing each with the run's anchor, the event directly before it. Runs that end inside a task
are done; the first and the last run of each task, two rows a task, are joined across the borders afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.shared import settled

RUN = "task int, piece bigint, edge int, entity bigint, first_order bigint, last_order bigint, n bigint, next_order bigint, first_label bigint, first_level bigint, last_label bigint, last_level bigint"
_NONE = -(2**63)


def _continues(e0, o0, b0, l0, e1, o1, b1, l1, tolerance, gap):
    """Whether event 1 continues event 0; an event without label (the lowest number) never does."""
    same = (e0 == e1) & (b0 == b1) & (b1 != _NONE) & (np.abs(l1 - l0) <= tolerance)
    return same if gap is None else same & (o1 - o0 <= gap)


def _machine(tolerance: int, gap: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        prev = open_run = None  # the last event; the run it belongs to
        piece = 0

        def rows(cols):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 9))], names=["task", "piece", "edge", "entity", "first_order", "last_order", "n", "next_order", "first_label", "first_level", "last_label", "last_level"])

        for batch in batches:
            e, o, b, v = (np.asarray(batch.column(k).fill_null(_NONE)) for k in range(4))
            if not len(e):
                continue
            # leave out events that repeat the one before them; equal events are neighbours
            p = prev or (e[0], o[0] - 1, b[0], v[0])
            keep = ~((e == np.r_[p[0], e[:-1]]) & (o == np.r_[p[1], o[:-1]]) & (b == np.r_[p[2], b[:-1]]) & (v == np.r_[p[3], v[:-1]]))
            e, o, b, v = e[keep], o[keep], b[keep], v[keep]
            if not len(e):
                continue
            first = prev is None
            p = prev or (e[0], o[0], _NONE, 0)
            joins = _continues(np.r_[p[0], e[:-1]], np.r_[p[1], o[:-1]], np.r_[p[2], b[:-1]], np.r_[p[3], v[:-1]], e, o, b, v, tolerance, gap)
            start = np.flatnonzero(~joins)
            end = np.r_[start[1:], len(e)] - 1
            lead = start[0] if len(start) else len(e)  # events that continue the open run
            if lead and not first:
                open_run = {**open_run, "n": open_run["n"] + int(lead), "last": tuple(int(x[lead - 1]) for x in (o, b, v))}
            if len(start):
                if not first:
                    out = open_run | {"next": int(o[start[0]]) if e[start[0]] == open_run["entity"] else None}
                    if out["n"] > 1 or out["edge"]:
                        yield rows([[task], [piece], [out["edge"]], [out["entity"]], [out["first"][0]], [out["last"][0]], [out["n"]], [out["next"]], [out["first"][1]], [out["first"][2]], [out["last"][1]], [out["last"][2]]])
                        piece += 1
                n = end - start + 1
                s, t = start[:-1], end[:-1]
                after = o[start[1:]]
                whole = (n[:-1] > 1) | (first & (np.arange(len(s)) == 0))
                edge = (first & (np.arange(len(s)) == 0)).astype(np.int32)
                nxt = pa.array(after, mask=e[start[1:]] != e[s])
                w = np.flatnonzero(whole)
                if len(w):
                    s, t = s[w], t[w]
                    yield rows([np.full(len(w), task, np.int32), piece + np.arange(len(w)), edge[w], e[s], o[s], o[t], n[:-1][w], nxt.take(pa.array(w)), b[s], v[s], b[t], v[t]])
                    piece += len(w)
                s, t = start[-1], end[-1]
                open_run = {"edge": int(first and len(start) == 1), "entity": int(e[s]), "first": tuple(int(x[s]) for x in (o, b, v)), "last": tuple(int(x[t]) for x in (o, b, v)), "n": int(n[-1])}
            prev = (e[-1], o[-1], b[-1], v[-1])
        if open_run:
            r = open_run
            yield rows([[task], [piece], [2 + r["edge"]], [r["entity"]], [r["first"][0]], [r["last"][0]], [r["n"]], [None], [r["first"][1]], [r["first"][2]], [r["last"][1]], [r["last"][2]]])

    return run


def collapse_runs(df: DataFrame, entity: str, order: str, label: Column, level: Column, tolerance: int, max_gap: int | None = None, partitions: int | None = None) -> DataFrame:
    """One row for each maximal run of at least two consecutive events of an entity.

    An event continues the one directly before it if both have the same non-null label, their levels differ by at most
    `tolerance` and, with max_gap, their orders by at most that. Returns (entity, first_order, last_order, n_events,
    length): length goes from the first event to the next event after the run, null where none follows in the entity.

    Rows with a null entity or order have no place in a sequence and are ignored. Repeated rows count once. Events of the
    same order are taken by label and level, null labels first. An empty table gives no rows. Levels are null only where
    labels are; a null level counts as no label. All columns are integers.
    """
    ev = df.select(F.col(entity).cast("bigint").alias("_e"), F.col(order).cast("bigint").alias("_o"), F.when(level.isNotNull(), label).cast("bigint").alias("_b"), F.when(label.isNotNull(), level).cast("bigint").alias("_v")).filter("_e IS NOT NULL AND _o IS NOT NULL")
    ev = ev.repartitionByRange(partitions, "_e", "_o") if partitions else ev.repartitionByRange("_e", "_o")
    pieces = settled(ev.sortWithinPartitions("_e", "_o", "_b", "_v").mapInArrow(_machine(tolerance, max_gap), RUN), "runs")
    inner = pieces.filter("edge = 0")
    # The edges: at most two rows a task, whatever the data.
    along = Window.orderBy("task", "piece")
    edges = pieces.filter("edge > 0")
    p = {c: F.lag(c).over(along) for c in ("entity", "last_order", "last_label", "last_level")}
    ok = (p["entity"] == F.col("entity")) & (p["last_label"] == F.col("first_label")) & (F.col("first_label") != _NONE) & (F.abs(p["last_level"] - F.col("first_level")) <= tolerance) & (F.lag("task").over(along) != F.col("task"))
    if max_gap is not None:
        ok = ok & (F.col("first_order") - p["last_order"] <= max_gap)
    edges = edges.withColumn("_new", F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edges.groupBy("_run").agg(F.min("entity").alias("entity"), F.min("first_order").alias("first_order"), F.max("last_order").alias("last_order"), F.sum("n").alias("n"), F.max(F.struct("task", "piece", "next_order"))["next_order"].alias("next_order"))
    follow = Window.orderBy("_run")
    joined = joined.withColumn("next_order", F.coalesce("next_order", F.when(F.lead("entity").over(follow) == F.col("entity"), F.lead("first_order").over(follow))))
    cols = ["entity", "first_order", "last_order", "n", "next_order"]
    out = inner.select(*cols).unionByName(joined.select(*cols)).filter("n > 1")
    return out.select("entity", "first_order", "last_order", F.col("n").alias("n_events"), (F.col("next_order") - F.col("first_order")).alias("length"))
