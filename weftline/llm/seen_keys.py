"""Problem 3: has this key been seen before, without all earlier keys in memory?

Keys are partitioned by hash, and each batch of rows is answered and then sealed: a minimal perfect hash (about three bits a
key) gives each of its new keys its own slot in an array of fingerprints. The sealed parts of each partition are kept in a
folder that all executors share, one row each, and a later batch meets these, never the earlier keys. A task takes its rows in
order of arrival; a key was seen if a sealed part has its fingerprint in its slot, or if the exact set of the current batch
has it. How often the answers for all rows are wrong is measured afterwards, against exact first rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.shared import fresh_path

#: Rows of a partition and batch: (kind 0) sealed parts, (kind 1) keys with their row ids.
ROUTED = "part int, kind int, r bigint, k bigint, sealed binary"
ANSWER = "kind string, row_id bigint, part int, sealed binary"
_LEVELS = 40


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash (the finalizer of splitmix64) of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class Sealed:
    """Distinct keys as a minimal perfect hash with fingerprints.

    Level by level, each key takes a bit; keys that alone have theirs stay, the others go to the next level. A key's slot is
    the number of set bits before its own.
    """

    def __init__(self, keys: np.ndarray, bits: int = 32, gamma: float = 1.6):
        self.levels, self.bits, rest, at = [], bits, keys, 0
        slots, placed = [], []
        for level in range(_LEVELS):
            if not len(rest):
                break
            m = max(64, int(len(rest) * gamma))
            h = (mix(rest, level + 1) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(h, minlength=m) == 1
            words = np.packbits(alone, bitorder="little")
            before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]
            self.levels.append((m, words, before, at))
            ok = alone[h]
            slots.append(self._slot(h[ok], words, before) + at)
            placed.append(rest[ok])
            at += int(ok.sum())
            rest = rest[~ok]
        self.exact = np.sort(rest)  # keys that no level could place: none but in a vanishing share of cases
        self.prints = np.zeros(max(1, at), np.uint32)
        if placed:
            self.prints[np.concatenate(slots)] = self.fingerprint(np.concatenate(placed))

    def fingerprint(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys, 1009) >> np.uint64(64 - self.bits)).astype(np.uint32)

    @staticmethod
    def _slot(h: np.ndarray, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        byte = h >> 3
        below = words[byte] & ((1 << (h & 7)) - 1).astype(np.uint8)
        return before[byte] + np.bitwise_count(below)

    def to_bytes(self) -> bytes:
        """The bits and fingerprints; has() of from_bytes(to_bytes()) answers alike."""
        sizes = [self.bits, len(self.levels), len(self.prints), len(self.exact)] + [x for m, words, _, at in self.levels for x in (m, len(words), at)]
        prints = self.prints.astype(np.uint8 if self.bits <= 8 else np.uint16 if self.bits <= 16 else np.uint32)
        return np.array(sizes, "<i8").tobytes() + self.exact.tobytes() + prints.tobytes() + b"".join(words.tobytes() for _, words, _, _ in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> Sealed:
        out = cls.__new__(cls)
        out.bits, n, prints, exact = np.frombuffer(data, "<i8", 4).tolist()
        sizes = np.frombuffer(data, "<i8", 3 * n, 32).reshape(n, 3).tolist()
        at = 32 + 24 * n
        out.exact = np.frombuffer(data, np.uint64, exact, at)
        at += 8 * exact
        kind = np.uint8 if out.bits <= 8 else np.uint16 if out.bits <= 16 else np.uint32
        out.prints = np.frombuffer(data, kind, prints, at).astype(np.uint32)
        at += prints * np.dtype(kind).itemsize
        out.levels = []
        for m, length, first in sizes:
            words = np.frombuffer(data, np.uint8, length, at)
            at += length
            out.levels.append((m, words, np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]], first))
        return out

    def has(self, keys: np.ndarray) -> np.ndarray:
        found, open_ = np.zeros(len(keys), bool), np.arange(len(keys))
        for level, (m, words, before, at) in enumerate(self.levels):
            if not len(open_):
                return found
            k = keys[open_]
            h = (mix(k, level + 1) % np.uint64(m)).astype(np.int64)
            hit = (words[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1
            kk = k[hit]
            found[open_[hit]] = self.prints[self._slot(h[hit], words, before) + at] == self.fingerprint(kk)
            open_ = open_[~hit]
        if len(open_) and len(self.exact):
            i = np.minimum(np.searchsorted(self.exact, keys[open_]), len(self.exact) - 1)
            found[open_] = self.exact[i] == keys[open_]
        return found


def _within_batch(parts: int):
    """Of a key's rows in one batch only those with the smallest id must meet the other batches; the rest, without a key now, are seen and go anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, r = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            order = np.lexsort((r, k))
            ks, rs = k[order], r[order]
            head = np.r_[True, ks[1:] != ks[:-1]]
            first = rs[np.maximum.accumulate(np.where(head, np.arange(len(ks)), 0))]
            seen = rs > first
            # of equal keys without an id of their own one is enough
            need = (rs >= 0) | head
            part = np.where(seen, mix(rs.view(np.uint64), 5), mix(ks.view(np.uint64), 7)) % np.uint64(parts)
            cols = [pa.array(part.astype(np.int32)), pa.array(np.ones(len(ks), np.int32)), pa.array(rs), pa.array(ks, mask=seen), pa.nulls(len(ks), pa.binary())]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(need)) for c in cols], names=["part", "kind", "r", "k", "sealed"])

    return run


def _stream(batch_rows: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sealed: dict[int, list[Sealed]] = {}

        def emit(ids, part=None, data=None):
            n = len(ids) if data is None else 1
            cols = [pa.array(["seen" if data is None else "sealed"] * n, pa.string()), pa.array(ids, pa.int64()) if data is None else pa.nulls(1, pa.int64()), pa.nulls(n, pa.int32()) if data is None else pa.array([part], pa.int32()), pa.nulls(n, pa.binary()) if data is None else pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["kind", "row_id", "part", "sealed"])

        def answer(part, k, r):
            """Ids of the rows that are seen; then the new keys are sealed."""
            u, at, inv = np.unique(k, return_index=True, return_inverse=True)
            first = r[at]  # rows come in order of id: the first row of a key has the smallest
            known = np.zeros(len(u), bool)
            for s in sealed.get(part, []):
                rest = np.flatnonzero(~known)
                known[rest] = s.has(u[rest])
            yield emit(r[(known[inv] | (r > first[inv])) & (r >= 0)])
            if not known.all():
                sealed.setdefault(part, []).append(Sealed(u[~known], bits))
                yield emit([], part, sealed[part][-1].to_bytes())

        waiting_k, waiting_r, waiting, open_part = [], [], 0, None

        def close():
            nonlocal waiting_k, waiting_r, waiting
            if waiting:
                yield from answer(open_part, np.concatenate(waiting_k), np.concatenate(waiting_r))
            waiting_k, waiting_r, waiting = [], [], 0

        for batch in batches:
            part = np.asarray(batch.column(0))
            for begin, end in zip((bounds := np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)])[:-1], bounds[1:]):
                rows = batch.slice(begin, end - begin)
                if part[begin] != open_part:
                    yield from close()
                    sealed, open_part = {}, int(part[begin])
                kind = np.asarray(rows.column(1))
                for data in rows.column(4).slice(0, int((kind == 0).sum())).to_pylist():
                    sealed.setdefault(open_part, []).append(Sealed.from_bytes(data))
                r, k = np.asarray(rows.column(2)), rows.column(3)
                done = (kind == 1) & np.asarray(k.is_null())
                if done.any():
                    yield emit(r[done])
                own = (kind == 1) & ~done
                k, r = np.asarray(k.fill_null(0)).view(np.uint64)[own], r[own]
                waiting_k.append(k)
                waiting_r.append(r)
                waiting += len(k)
                if waiting >= batch_rows:
                    k, r = np.concatenate(waiting_k), np.concatenate(waiting_r)
                    cut = int(np.searchsorted(r, r[-1])) if r[-1] >= 0 else len(r)  # rows of one id stay together
                    if cut:
                        yield from answer(open_part, k[:cut], r[:cut])
                    waiting_k, waiting_r, waiting = [k[cut:]], [r[cut:]], len(k) - cut
        yield from close()

    return run


class SeenKeys:
    """Sealed keys in a folder that all executors share; another session opens them by the same path.

    Every batch gets a folder of its own with its answers and its sealed parts, written in one job; what an empty or a lost batch has
    left in one is written over. One batch is added at a time. The number of partitions
    follows from the rows of each batch and never falls; a part that was sealed for fewer partitions is read by all of those that
    its own was split into. Fingerprints have `bits` bits (up to 32): a new key is called seen with probability 2^-bits for each
    sealed part it meets. Parts are never merged, as their keys are gone: a partition has one for each batch, or for each
    batch_rows keys of a larger batch.
    """

    def __init__(self, spark: SparkSession, path: str, bits: int = 32, batch_rows: int = 1 << 20, rows_each: int = 4_000_000):
        self.spark, self.path, self.bits, self.batch_rows, self.rows_each = spark, path, bits, batch_rows, rows_each

    def _sealed(self) -> DataFrame | None:
        """(parts, batch, part, sealed) of all earlier batches."""
        try:
            return self.spark.read.schema("row_id bigint, part int, sealed binary, batch int, parts int, kind string").parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def add(self, rows: DataFrame, key: str, row_id: str | None = None) -> DataFrame:
        """Answer and seal a batch. Returns (row_id) of its rows whose key is in an earlier batch or in a row of this one with a smaller id.

        Without row_id the keys are sealed and nothing is answered. Rows with a null key were never seen and seal nothing;
        rows with a null id have no place in the order and are ignored. Rows that repeat an id don't count as earlier than
        each other. Ids must not be negative. An empty batch gives no rows.

        Only the batch's own keys are shuffled. A hot key's rows don't meet in one task: within each batch that Python reads,
        only the row with the key's smallest id goes to the key's task.
        """
        spark, old = self.spark, self._sealed()
        state = None if old is None else old.groupBy("batch").agg(F.max("parts").alias("parts")).agg(F.max("batch"), F.max("parts")).first()
        batch, parts = (0, int(spark.conf.get("spark.sql.shuffle.partitions"))) if state is None or state[0] is None else (state[0] + 1, state[1])
        n = rows.count()  # of all rows, which takes no column
        while parts * self.rows_each < n:
            parts *= 2
        mine = rows.select(F.col(key).cast("bigint").alias("k"), (F.col(row_id).cast("bigint") if row_id else F.lit(-1).cast("bigint")).alias("r")).filter("k IS NOT NULL AND r IS NOT NULL")
        routed = mine.mapInArrow(_within_batch(parts), ROUTED)
        if old is not None:
            split = F.explode(F.expr(f"sequence(0, {parts} div parts - 1)"))
            routed = routed.unionByName(old.filter("kind = 'sealed'").select("part", "parts", "sealed", split.alias("_j")).select((F.col("part") + F.col("_j") * F.col("parts")).cast("int").alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("r"), F.lit(None).cast("bigint").alias("k"), "sealed"))
        routed = routed.repartitionById(parts, "part").sortWithinPartitions("part", "kind", "r")
        out = f"{self.path}/batch={batch}/parts={parts}"
        routed.mapInArrow(_stream(self.batch_rows, self.bits), ANSWER).write.partitionBy("kind").mode("overwrite").parquet(out)
        return spark.read.schema("row_id bigint, part int, sealed binary, kind string").parquet(out).filter("kind = 'seen'").select("row_id")


def seen_before(rows: DataFrame, key: str, row_id: str, earlier: DataFrame | None = None, earlier_key: str | None = None, batch_rows: int = 1 << 20, bits: int = 32, rows_each: int = 4_000_000) -> DataFrame:
    """(row_id) of the rows whose key is among the earlier keys or in a row with a smaller id: a store of two batches, the earlier keys and the rows. See SeenKeys.add."""
    spark = rows.sparkSession
    store = SeenKeys(spark, fresh_path(spark, "seen"), bits, batch_rows, rows_each)
    if earlier is not None:
        store.add(earlier, earlier_key or key)
    return store.add(rows, key, row_id)


def answer_errors(rows: DataFrame, key: str, row_id: str, found: DataFrame | dict[int, DataFrame], earlier: DataFrame | None = None, earlier_key: str | None = None) -> DataFrame:
    """One row: n_answers, n_wrong, wrong_share of the answers `found`, the ids of the rows called seen (row_id), over all rows.

    Of several answers, by a number, one row each, which begins with that number (bits); the truth is worked out once for all.

    The truth is exact: a row is new if its key isn't among the earlier keys and no row with a smaller id has it. An id's wrong
    answers are the difference between its rows called seen and its rows that are; of an id that many rows share, a new row
    called seen and a seen row called new would cancel, but the second never happens. Rows with a null key or id aren't looked
    up and don't count. Without rows the share is null.

    Rows meet by (key, id) and by id only; by key alone, one row a task and key is shuffled.
    """
    answers = found if isinstance(found, dict) else {0: found}
    mine = rows.select(F.col(key).cast("bigint").alias("k"), F.col(row_id).cast("bigint").alias("r")).filter("k IS NOT NULL AND r IS NOT NULL")
    first = mine.groupBy("k", "r").agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(F.min(F.struct("r", "n")).alias("f"))
    if earlier is not None:
        old = earlier.select(F.col(earlier_key or key).cast("bigint").alias("k")).filter("k IS NOT NULL").distinct()
        first = first.join(old, "k", "left_anti")
    # An id's rows called seen, less its rows, and its new rows again: called seen less truly seen.
    zero = F.lit(0).cast("bigint")
    every = mine.select("r", F.lit(-1).cast("bigint").alias("d"), F.lit(1).cast("bigint").alias("n"), *(zero.alias(f"c{b}") for b in answers))
    every = every.unionByName(first.select("f.r", F.col("f.n").alias("d"), zero.alias("n"), *(zero.alias(f"c{b}") for b in answers)))
    for own, called in answers.items():
        every = every.unionByName(called.select(F.col("row_id").cast("bigint").alias("r"), zero.alias("d"), zero.alias("n"), *((F.lit(1).cast("bigint") if b == own else zero).alias(f"c{b}") for b in answers)).filter("r IS NOT NULL"))
    each = every.groupBy("r").agg(F.sum("n").alias("n"), *((F.sum("d") + F.sum(f"c{b}")).alias(f"d{b}") for b in answers))
    total = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_answers"), *(F.coalesce(F.sum(F.abs(f"d{b}")), F.lit(0)).alias(f"w{b}") for b in answers))
    out = total.select("n_answers", F.inline(F.array(*(F.struct(F.lit(b).alias("bits"), F.col(f"w{b}").alias("n_wrong")) for b in answers))))
    return out.select(*(["bits"] if isinstance(found, dict) else []), "n_answers", "n_wrong", F.try_divide("n_wrong", "n_answers").alias("wrong_share"))
