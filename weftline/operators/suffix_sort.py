"""Order of all suffixes, by anchors: few places of each text whose suffixes are ranked first and tell all others apart.

The anchor of a suffix is the place of the least hash of six letters in its first 24 letters, the leftmost of several, or
its end-marker where that is among them. So suffixes with the same first 24 letters have anchors equally far on, and the
ranks of these order them. About one place in ten is an anchor; in the worst text, of one letter, all are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.shared import forget, fresh_path, settled

#: Letters of a key, of a hash, and keys by which anchors are told apart at first.
KEY, _HASHED, _KEYS = 24, 6, 5
#: Anchors further on that one round of ranking looks at.
_LEAPS = 7
#: Anchors in one batch of rows.
_BLOCK = 1 << 16
#: Suffixes that are sorted at once, and that are shuffled before their files are given up.
_SORTED, _PASS = 1 << 19, 1 << 26

#: Codes of letters; the end-marker has 0.
CODE = np.full(256, 4, np.uint8)
CODE[np.frombuffer(b"ACGT", np.uint8)] = (1, 2, 3, 5)
_HASH = np.random.default_rng(1).permutation(6**_HASHED).astype(np.int64)


def _codes(seq: pa.Scalar) -> np.ndarray:
    """Codes of a text's letters, with end-markers behind it."""
    letters = CODE[np.frombuffer(seq.as_buffer(), np.uint8)]
    return np.r_[letters, np.zeros(KEY * (_KEYS + 1), np.uint8)]


def _numbers(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next 24 and the next 6 letters at each place as numbers of base 6."""
    part = part.astype(np.int64)
    two = part[:-1] * 6 + part[1:]
    four = two[:-2] * 36 + two[2:]
    eight = four[:-4] * 6**4 + four[4:]
    return (eight[:-16] * 6**8 + eight[8:-8]) * 6**8 + eight[16:], four[:-2] * 36 + two[4:]


def _chunks(codes: np.ndarray, chunk: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, keys, anchors) of the suffixes of one text, so many at a time."""
    n = len(codes) - KEY * (_KEYS + 1)
    for at in range(0, n + 1, chunk):
        many = min(chunk, n + 1 - at)
        key, six = _numbers(codes[at : at + many + KEY])
        least = _HASH[six] << 32 | np.arange(len(six))
        for step in (1, 2, 4, 8, 3):
            least = np.minimum(least[:-step], least[step:])
        anchor = (least[:many] & 0xFFFFFFFF) + at
        anchor[max(0, n - KEY + 1 - at) :] = n
        yield at, key[:many], anchor


def _anchors(codes: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of a text, and for each the number of the one that the last 24 of its first 120 letters lead to."""
    n, found = len(codes) - KEY * (_KEYS + 1), []
    for _, _, a in _chunks(codes, chunk):
        found.append(a[np.r_[True, a[1:] != a[:-1]]])
    places = np.unique(np.concatenate(found))
    ask, to = np.minimum(places + KEY * (_KEYS - 1), n), np.empty(len(places), np.int64)
    for at, _, a in _chunks(codes, chunk):
        low, high = np.searchsorted(ask, (at, at + len(a)))
        to[low:high] = np.searchsorted(places, a[ask[low:high] - at])
    return places, to


def _first_keys(chunk: int):
    names = ["seq_id", "i", "tie", *(f"k{j}" for j in range(_KEYS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq_id, seq in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes = _codes(seq)
                n = len(codes) - KEY * (_KEYS + 1)
                places, _ = _anchors(codes, chunk)
                for at in range(0, len(places), _BLOCK):
                    own = places[at : at + _BLOCK]
                    every, _ = _numbers(codes[own[0] : own[-1] + KEY * (_KEYS + 1)])
                    keys = [every[own - own[0] + j * KEY] for j in range(_KEYS)]
                    # What holds an end-marker is told apart by its text.
                    tie = np.where(own + KEY * _KEYS > n, seq_id, 0)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(own), seq_id, np.int64), np.arange(at, at + len(own)), tie.astype(np.int64), *keys)], names=names)

    return run


def _ranked(keys: int, inside: bool):
    """Of rows (seq_id, i, keys) in order of the keys, equal ones in one task: (part, seq_id, i, v), v twice the rank, one more where others share it. Ranks count from 0 in each task or, inside, from the first key on in the rows that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, last, count, head, start = TaskContext.get().partitionId(), None, None, 0, 0, 0

        def out(ends: bool):
            seq_id, i, rank, new = held
            shared = ~(new & np.r_[new[1:], ends])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(new), part, np.int64)), seq_id, i, pa.array(2 * rank + shared)], names=["part", "seq_id", "i", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols, at = [c.to_numpy() for c in batch.columns[2:]], np.arange(count, count + batch.num_rows)
            new = np.zeros(len(at), bool)
            for k, c in enumerate(cols):
                new[1:] |= c[1:] != c[:-1]
                new[0] |= last is None or c[0] != last[k]
                if not k:
                    group = new.copy()
            first = np.maximum.accumulate(np.where(new, at, head))
            rank = first
            if inside:
                begin = np.maximum.accumulate(np.where(group, at, start))
                rank, start = cols[0] + first - begin, begin[-1]
            if held:
                yield out(new[0])
            held, last, count, head = (batch.column(0), batch.column(1), rank, new), [c[-1] for c in cols], count + len(at), first[-1]
        if held:
            yield out(True)

    return run


def _texts_with_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Scalar, np.ndarray]]:
    """Of rows (seq_id, g, i, v, seq) in order of seq_id and i, the text first, with i -1: each text with its anchors' v."""
    own, parts = None, []
    for batch in batches:
        i, v, low = batch.column(2).to_numpy(), batch.column(3).to_numpy(), 0
        for row in np.flatnonzero(i < 0):
            parts.append(v[low:row])
            if own is not None:
                yield *own, np.concatenate(parts)
            own, parts, low = (batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), batch.column(4)[row]), [], row + 1
        parts.append(v[low:])
    if own is not None:
        yield *own, np.concatenate(parts)


def _asks(chunk: int, leap: int):
    """Of the anchors whose rank, halved, is odd (shared by others): the ranks of those `leap` and more anchors further on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq_id, _, seq, ranks in _texts_with_ranks(batches):
            if not (ranks & 1).any():
                continue
            _, to = _anchors(_codes(seq), chunk)
            step, power = leap, np.arange(len(to))
            while step:
                if step & 1:
                    power = to[power]
                to, step = to[to], step >> 1
            at = np.flatnonzero(ranks & 1)
            for low in range(0, len(at), chunk):
                own = at[low : low + chunk]
                cols, there = [np.full(len(own), seq_id, np.int64), own.astype(np.int64), ranks[own] >> 1], own
                for _ in range(_LEAPS):
                    there = power[there]
                    cols.append(ranks[there] >> 1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["seq_id", "i", "r", *(f"r{j}" for j in range(1, _LEAPS + 1))])

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for seq_id, g, seq, ranks in _texts_with_ranks(batches):
        yield pa.RecordBatch.from_arrays([pa.array([seq_id], pa.int64()), pa.array([g], pa.int64()), pa.array([seq.as_py()], pa.binary()), pa.array([(ranks >> 1).tobytes()], pa.binary())], names=["seq_id", "g", "seq", "ranks"])


def each_suffix(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(seq_id, g, place, keys, ranks of the anchors, codes of the letters before) of all suffixes."""
    for batch in batches:
        for seq_id, g, seq, ranks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            codes, ranks = _codes(seq), np.frombuffer(ranks.as_buffer(), np.int64)
            n, no, last = len(codes) - KEY * (_KEYS + 1), -1, -1
            for at, key, anchor in _chunks(codes, chunk):
                number = no + np.cumsum(np.r_[anchor[0] != last, anchor[1:] != anchor[:-1]])
                no, last = number[-1], anchor[-1]
                before = np.r_[codes[at - 1] if at else np.uint8(0), codes[at : at + len(key) - 1]]
                yield seq_id, g, at, key, ranks[number], before


def sampled(chunk: int, each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip = 0
        for _, g, _, key, rank, _ in each_suffix(batches, chunk):
            own = slice(skip, None, each)
            skip = (skip - len(key)) % each
            if len(key[own]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[own]), g, np.int64)), pa.array(key[own]), pa.array(rank[own])], names=["g", "k", "r"])

    return run


def cuts_of(cols: list[np.ndarray], size: int) -> tuple[np.ndarray, ...]:
    """Of drawn suffixes (g, key, rank), those that cut so many into buckets which are sorted at once."""
    order = np.lexsort(cols[::-1])
    many = -(-size // _SORTED)
    cut = order[np.unique(np.arange(1, many) * len(order) // many)]
    return tuple(c[cut] for c in cols)


def bucket_of(g: int, key: np.ndarray, rank: np.ndarray, cuts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """How many of the cuts (g, key, rank), in order, are at or before each suffix of one text."""
    low, high = np.searchsorted(cuts[0], (g, g + 1))
    keys, ranks = cuts[1][low:high], cuts[2][low:high]
    out = np.searchsorted(keys, key, "right")
    if len(keys):
        near = np.flatnonzero((out > 0) & (keys[out - 1] == key))
        for k in np.unique(key[near]):
            first, last = np.searchsorted(keys, k), np.searchsorted(keys, k, "right")
            own = near[key[near] == k]
            out[own] = first + np.searchsorted(ranks[first:last], rank[own], "right")
    return out + low


def _counted(chunk: int, cuts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(cuts[0]) + 1, np.int64)
        for _, g, _, key, rank, _ in each_suffix(batches, chunk):
            n += np.bincount(bucket_of(g, key, rank, cuts), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["b", "n"])

    return run


_PACKED = (np.int64, np.int64, np.int64, np.uint8, np.int64, np.int64)


def _packed(chunk: int, cuts, first: int, last: int, places: bool):
    """(b, n, rows): suffixes of the buckets from first to before last, packed by column: g, key, rank, letter before and, with places, seq_id and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for seq_id, g, at, key, rank, before in each_suffix(batches, chunk):
                b = bucket_of(g, key, rank, cuts)
                own = np.flatnonzero((b >= first) & (b < last))
                if len(own):
                    yield b[own], np.full(len(own), g, np.int64), key[own], rank[own], before[own], *((np.full(len(own), seq_id, np.int64), own + at) if places else ())

        yield from in_blocks(rows())

    return run


def in_blocks(rows: Iterator[tuple[np.ndarray, ...]], many: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(b, n, rows): of columns, the first of which is the bucket, about so many rows at a time, those of each bucket in their order and packed by column."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[0])
        if n >= many:
            yield from _blocks(held)
            held, n = [], 0
    if held:
        yield from _blocks(held)


def _blocks(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    b, *cols = (np.concatenate(c) for c in zip(*held))
    order = np.argsort(b, kind="stable")
    ends = np.r_[np.flatnonzero(np.diff(b[order])) + 1, len(b)]
    low = 0
    for high in ends:
        own = order[low:high]
        data = pa.compress(b"".join(_shuffled(c[own]) for c in cols), codec="zstd", asbytes=True)
        yield pa.RecordBatch.from_arrays([pa.array([b[own[0]]], pa.int64()), pa.array([len(own)], pa.int64()), pa.array([data], pa.binary())], names=["b", "n", "rows"])
        low = high


def _shuffled(col: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones: they are packed better so."""
    return np.ascontiguousarray(col.view(np.uint8).reshape(len(col), -1).T).tobytes()


def unpacked(data: bytes, n: int, kinds: tuple) -> list[np.ndarray]:
    sizes = [np.dtype(t).itemsize for t in kinds]
    raw, at, out = np.frombuffer(pa.decompress(data, n * sum(sizes), codec="zstd"), np.uint8), 0, []
    for t, s in zip(kinds, sizes):
        out.append(np.ascontiguousarray(raw[at : at + n * s].reshape(s, n).T).reshape(-1).view(t))
        at += n * s
    return out


def _in_order(before: np.ndarray, by: str | None, places: bool):
    """Of rows (b, n, rows) in order of b: the suffixes of each bucket in order or, without places, the runs of the letters before them; open: those at the bucket's ends, which others may lengthen. before: rows in earlier buckets."""
    letters = pa.array(list("$ACGNT"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = [], None

        def out():
            g, key, rank, ch, *at = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((rank, key, g)) if g[0] != g[-1] or (g != g[0]).any() else np.lexsort((rank, key))
            if not places:
                ch = ch[order]
                head = np.flatnonzero(np.r_[True, (ch[1:] != ch[:-1]) | (ch[1:] == 0)])
                open_ = np.zeros(len(head), bool)
                open_[[0, -1]] = True
                yield pa.RecordBatch.from_pydict({"bwt_start": pa.array(before[own] + head), "ch": letters.take(pa.array(ch[head])), "length": pa.array(np.diff(np.r_[head, len(ch)])), "open": pa.array(open_ & (ch[head] != 0))})
                return
            seq_id, place = at
            for low in range(0, len(order), 1 << 16):
                o = order[low : low + (1 << 16)]
                at = np.arange(before[own] + low, before[own] + low + len(o))
                cols = {by: pa.array(g[o])} if by else {}
                cols |= {"bwt_pos": pa.array(at), "seq_id": pa.array(seq_id[o]), "seq_off": pa.array(place[o]), "ch": letters.take(pa.array(ch[o]))}
                yield pa.RecordBatch.from_pydict(cols)

        for batch in batches:
            for b, n, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if b != own and held:
                    yield from out()
                    held.clear()
                own = b
                held.append(unpacked(rows.as_buffer(), n, _PACKED if places else _PACKED[:4]))
        if held:
            yield from out()

    return run


def give_up_shuffles(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of what is over; it does so when the driver's garbage is collected."""
    df.sparkSession._jvm.System.gc()


def anchor_ranks(texts: DataFrame, by: str | None, chunk: int) -> DataFrame:
    """(seq_id, g, seq, ranks): texts as bytes, g their column `by` or 0, with the ranks of the suffixes at their anchors among all of these, packed.

    Anchors get the rank of their first 120 letters, then those that share a rank are told apart by the ranks of the seven
    anchors that these letters lead to one by one, then by every eighth of them and so on. Each time they are shuffled once,
    by ranges of the first 24 letters or by the rank, and ranked as they are read in order.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys, further = [*(f"k{j}" for j in range(_KEYS)), "tie"], [f"r{j}" for j in range(1, _LEAPS + 1)]
    schema = "part bigint, seq_id bigint, i bigint, v bigint"
    suf = texts.select("seq_id", "seq").mapInArrow(_first_keys(chunk), ", ".join(["seq_id bigint, i bigint, tie bigint", *(f"k{j} bigint" for j in range(_KEYS))]))
    own = settled(suf.select("seq_id", "i", *keys).repartitionByRange(parts, "k0").sortWithinPartitions(*keys).mapInArrow(_ranked(len(keys), False), schema), "anchor_ranks")
    give_up_shuffles(own)
    below = F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    sizes = own.groupBy("part").agg(F.count(F.lit(1)).alias("m")).select("part", below.alias("below"))
    cur = own.join(F.broadcast(sizes), "part").select("seq_id", "i", (F.col("v") + 2 * F.col("below")).alias("v"))
    done, old, leap = None, [own], 1

    def met(ranked: DataFrame) -> DataFrame:
        blank = lambda kind: F.lit(None).cast(kind)
        rows = texts.select("seq_id", (F.col(by) if by else F.lit(0)).cast("bigint").alias("g"), F.lit(-1).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("v"), "seq")
        rows = rows.unionByName(ranked.select("seq_id", blank("bigint").alias("g"), "i", "v", blank("binary").alias("seq")))
        return rows.repartition(parts, "seq_id").sortWithinPartitions("seq_id", "i")

    while True:
        known = cur if done is None else cur.unionByName(done)
        if cur.filter("v % 2 = 1").isEmpty():
            break
        at = met(known).mapInArrow(_asks(chunk, leap), "seq_id bigint, i bigint, r bigint, " + ", ".join(f"{c} bigint" for c in further))
        fresh = settled(at.repartition(parts, "r").sortWithinPartitions("r", *further).mapInArrow(_ranked(1 + _LEAPS, True), schema), "anchor_ranks")
        over = cur.filter("v % 2 = 0")
        done = over if done is None else done.unionByName(over)
        cur = fresh.select("seq_id", "i", "v")
        old.append(fresh)
        give_up_shuffles(fresh)
        leap *= _LEAPS + 1
    out = settled(met(known).mapInArrow(_joined, "seq_id bigint, g bigint, seq binary, ranks binary"), "ranked_texts")
    forget(*old)
    give_up_shuffles(out)
    return out


def sorted_suffixes(texts: DataFrame, by: str | None = None, chunk: int = 1 << 18, places: bool = True) -> DataFrame:
    """(by, bwt_pos, seq_id, seq_off, ch), written to the shared folder: all suffixes of texts (seq_id, seq as bytes, by BIGINT) in order of `by` and then of their letters; bwt_pos counts all of them.

    Suffixes are cut into buckets between some of them that were drawn, so that none has many more than others whatever the
    texts are, and each bucket is sorted in memory. Only so many are shuffled before the files are given up. Buckets are
    written in order, so neighbours mostly stand in one file.

    Without places, for one order of all: (bwt_start, ch, length, open), the runs of the letters before the suffixes in each bucket,
    every end-marker alone. Neither the suffixes' places nor the suffixes themselves are then shuffled or written.
    """
    spark, schema = texts.sparkSession, f"{f'`{by}` bigint, ' if by else ''}bwt_pos bigint, seq_id bigint, seq_off bigint, ch string" if places else "bwt_start bigint, ch string, length bigint, open boolean"
    size = texts.agg(F.sum(F.length("seq").cast("bigint") + 1)).first()[0] or 0
    if not size:
        return settled(spark.createDataFrame([], schema), "suffixes")
    ranked = anchor_ranks(texts, by, chunk)
    drawn = ranked.mapInArrow(sampled(chunk, max(64, size >> 20)), "g bigint, k bigint, r bigint").toArrow()  # a million rows or so
    cuts = cuts_of([drawn.column(c).to_numpy() for c in ("g", "k", "r")], size)
    counts = ranked.mapInArrow(_counted(chunk, cuts), "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n"))
    n = np.zeros(len(cuts[0]) + 1, np.int64)
    for b, k in counts.collect():  # a row for each bucket
        n[b] = k
    before = np.r_[0, np.cumsum(n)]
    path, first = fresh_path(spark, "suffixes"), 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(before, before[first] + _PASS, "right")) - 1)
        rows = ranked.mapInArrow(_packed(chunk, cuts, first, last, places), "b bigint, n bigint, rows binary")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), last - first)
        rows.repartition(parts, "b").sortWithinPartitions("b").mapInArrow(_in_order(before, by, places), schema).write.mode("append").parquet(path)
        give_up_shuffles(ranked)
        first = last
    forget(ranked)
    out = spark.read.schema(schema).parquet(path)
    out.settled_at = path
    return out
