"""Problem 4: spans of at least a given length that appear verbatim in more than one record.

Two records share a span of at least `span` letters exactly where they share windows of `span` letters. All windows with
the same minimizer (their smallest hashed m-mer) go to the same shard, in the longest pieces that hold only such windows;
a minimizer with more letters than a task indexes at once is cut again by a longer one. A first pass finds the minimizers that two
records hold; a second one, which knows them by a filter of bounded size, cuts the pieces of these alone. Equal pieces are one
piece with its lowest and highest record. A shard is indexed in parts of
bounded size: the Burrows-Wheeler transform of the pieces in a wavelet matrix. Every piece is then streamed backward
through it, letter by letter, with its matching statistics: the longest match that begins at the letter and stands in two
records, as an interval and a length. Intervals of at least `span` letters are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.seen_keys import mix
from weftline.shared import partitions_for, settled

#: Letters by their order; every other letter ends a span.
LETTERS = b"ACGT"
PIECE = "route bigint, text bigint, record bigint, start int, n int, letters binary, low bigint, high bigint"
HELD = "route bigint, low bigint, high bigint, n bigint"
#: Bits of the filter for minimizers: 16 for each up to this power of two, 16 MB. A fuller one lets more pieces through that the index stage drops.
SIEVE_POWER = 27
ANSWER = "route bigint, print bigint, a int, b int"
_CODE = np.zeros(256, np.uint8)
for _case in (LETTERS, LETTERS.lower()):
    _CODE[np.frombuffer(_case, np.uint8)] = np.arange(1, 5)
_CAPITAL = np.frombuffer(b"N" + LETTERS, np.uint8)


class WaveletMatrix:
    """Symbols 0 to 7 as three bit vectors with counts for each 64 bits; step() maps positions by a symbol's rank."""

    def __init__(self, symbols: np.ndarray):
        self.levels, cur, n = [], symbols, len(symbols)
        begin = np.zeros(8, np.int64)
        for bit in (2, 1, 0):
            b = (cur >> bit) & 1
            words = np.zeros(n // 64 + 1, np.uint64)
            packed = np.packbits(b, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]
            zeros = n - int(b.sum())
            self.levels.append((bit, words, before, zeros))
            one = (np.arange(8) >> bit) & 1
            r = self._rank(begin, words, before)
            begin = np.where(one == 1, zeros + r, begin - r)
            cur = np.concatenate([cur[b == 0], cur[b == 1]])
        # rows that start with symbol c begin at the number of smaller symbols
        self.offset = np.r_[0, np.cumsum(np.bincount(symbols, minlength=8))[:-1]] - begin

    @staticmethod
    def _rank(i, words, before):
        w = i >> 6
        return before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def step(self, i: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """C[symbol] + number of `symbol` before i: one backward search step of an interval's bound."""
        c = symbol
        for bit, words, before, zeros in self.levels:
            r = self._rank(i, words, before)
            i = np.where((c >> bit) & 1 == 1, zeros + r, i - r)
        return i + self.offset[c]


def _packed(codes: np.ndarray, n: int) -> np.ndarray:
    """At each place the next n letters (at most 21) as a number; behind the end come zeros."""
    have, width, out, taken = codes.astype(np.int64), 1, None, 0

    def shifted(x, by):
        return np.r_[x[by:], np.zeros(min(by, len(x)), np.int64)]

    while True:
        if n & width:
            out = have if out is None else (out << np.int64(3 * width)) | shifted(have, taken)
            taken += width
        if taken == n:
            return out
        have = (have << np.int64(3 * width)) | shifted(have, width)
        width *= 2


def _nearest_smaller(v: np.ndarray, ahead: bool) -> np.ndarray:
    """Of each place but the first and the last, which hold the smallest value, the nearest place with a smaller value before or behind it."""
    at = np.arange(len(v)) + (1 if ahead else -1)
    at[0], at[-1] = 0, len(v) - 1
    open_ = np.arange(1, len(v) - 1)
    while len(open_):
        open_ = open_[v[at[open_]] >= v[open_]]
        at[open_] = at[at[open_]]  # all between are not smaller either
    return at


class SpanIndex:
    """FM-index of pieces for patterns of up to `span` letters: their matches that stand in two records."""

    def __init__(self, codes: np.ndarray, low: np.ndarray, high: np.ndarray, span: int):
        """codes: letters 1 to 4, a 0 behind each piece; low and high: the lowest and highest record of each letter's piece."""
        widths = [min(21, span - at) for at in range(0, span, 21)]
        cols = []
        for k, w in enumerate(widths):
            p = _packed(codes, w)
            cols.append(np.r_[p[21 * k :], np.zeros(min(21 * k, len(p)), np.int64)])
        order = np.lexsort(cols[::-1])
        self.n, self.span = len(order), span
        self.bwt = WaveletMatrix(codes[order - 1])
        # letters that each row has in common with the row before it; below all others at both ends
        same, still = np.zeros(self.n + 1, np.int16), np.ones(self.n - 1, bool)
        for col, w in zip(cols, widths):
            x = col[order]
            x = x[1:] ^ x[:-1]
            high_bit = np.frexp(x.astype(np.float64))[1]  # numbers of 63 bits may be rounded up to the next power of two
            high_bit -= (x > 0) & (high_bit > 0) & ((x >> np.maximum(high_bit - 1, 0)) == 0)
            same[1:-1][still] += (w - (high_bit + 2) // 3)[still].astype(np.int16)
            still &= x == 0
        same[0] = same[-1] = -1
        self.same, self.before, self.behind = same, _nearest_smaller(same, False), _nearest_smaller(same, True)
        # Rows that agree in span - 1 letters: the interval to go on from once a match has span letters.
        new = same[:-1] < span - 1
        self.first, self.group = np.r_[np.flatnonzero(new), self.n], np.cumsum(new) - 1
        # From each row the nearest row, itself too, by which two records are met.
        a, b = low[order], high[order]
        far = np.full(self.n + 1, self.n + 1)
        change = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        ahead = np.r_[change, self.n + 1]
        far[:-1] = np.where(a != b, np.arange(self.n), ahead[np.searchsorted(change, np.arange(self.n), side="right")])
        self.two = far

    def statistics(self, codes: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
        """For pieces that end before `ends`, longest first: at each step backward the lengths of their matches in two records, at most span."""
        lo, hi, has = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64), np.zeros(len(ends), np.int64)
        for j in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -j, side="left"))  # pieces of more than j letters
            lo, hi, has = lo[:live], hi[:live], has[:live]
            full = np.flatnonzero(has == self.span)
            g = self.group[lo[full]]
            lo[full], hi[full], has[full] = self.first[g], self.first[g + 1], self.span - 1
            letter, todo = codes[ends[:live] - 1 - j].astype(np.int64), np.arange(live)
            while len(todo):
                a, b = self.bwt.step(lo[todo], letter[todo]), self.bwt.step(hi[todo], letter[todo])
                good = (a < b) & (self.two[a] < b)
                at = todo[good]
                lo[at], hi[at] = a[good], b[good]
                has[at] += 1
                # The others give up letters at their end, as many as it takes to stand in more rows.
                todo = todo[~good]
                todo = todo[has[todo] > 0]
                l, r = lo[todo], hi[todo]
                left, right = self.same[l], self.same[r]
                has[todo] = np.maximum(left, right)
                lo[todo] = np.where(left >= right, self.before[l], l)
                hi[todo] = np.where(right >= left, self.behind[r], r)
            yield has


def _sieve_places(route: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(route.view(np.uint64), 5)
    mask = np.uint64((1 << power) - 1)
    return (x & mask).astype(np.int64), ((x >> np.uint64(32)) & mask).astype(np.int64)


def _sieve_words(power: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_sieve_places(np.asarray(batch.column(0)), power))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    return run


def _sieve(routes: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """Two bits for each minimizer, in at most 2^(SIEVE_POWER - 6) words of 64 bits, which are all that comes to the driver."""
    power = min(SIEVE_POWER, max(16, (16 * n).bit_length()))
    words = routes.select("route").mapInArrow(_sieve_words(power), "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (power - 6), np.uint64)
    out[np.asarray(words.column("word"))] = np.asarray(words.column("bits")).view(np.uint64)
    return power, out


def _pieces(span: int, m: int, sieve=None):
    """Cut (text, record, start, letters) into pieces of windows with one minimizer that is in the sieve. Of equal pieces in a batch the first one has their lowest and highest record.

    Without a sieve: of each minimizer in a batch the lowest and highest record and the letters of its different pieces.
    """
    w = span - m + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, rec, first = (np.asarray(batch.column(k)) for k in (0, 1, 2))
            seqs = batch.column(3).cast(pa.large_binary())
            raw = np.frombuffer(seqs.buffers()[2] or b"", np.uint8)
            offs = np.frombuffer(seqs.buffers()[1], np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
            code = _CODE[raw[offs[0] : offs[-1]]]
            offs = offs - offs[0]
            n = len(code)
            if n < span:
                continue
            owner = np.repeat(np.arange(len(text)), np.diff(offs))
            # windows that lie in one record and hold letters only
            bad = np.r_[0, np.cumsum(code == 0)]
            ok = (bad[span:] == bad[:-span]) & (owner[: n - span + 1] == owner[span - 1 :])
            # the smallest hash of the m-mers of each window
            v = np.zeros(n - m + 1, np.uint64)
            for j in range(m):
                v = v * np.uint64(0x9E3779B97F4A7C15) + code[j : n - m + 1 + j]
            h = mix(v, 77)
            size, low = 1, h
            while size * 2 <= w:
                low = np.minimum(low[:-size], low[size:])
                size *= 2
            low = np.minimum(low[: n - span + 1], low[w - size : w - size + n - span + 1])
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            route = low[at]
            new = np.r_[True, (np.diff(at) != 1) | (route[1:] != route[:-1]) | (owner[at][1:] != owner[at][:-1])]
            s = at[new]
            e = np.r_[at[np.flatnonzero(new)[1:] - 1], at[-1]] + span
            o, route = owner[s], route[new].view(np.int64)
            if sieve is None:
                by = np.lexsort((mix(v[s], 3) ^ mix(v[e - m], 4) + (e - s).astype(np.uint64), route))
                piece, key = route[by], (mix(v[s], 3) ^ mix(v[e - m], 4) + (e - s).astype(np.uint64))[by]
                head = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
                fresh = np.r_[True, (piece[1:] != piece[:-1]) | (key[1:] != key[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(piece[head]), pa.array(np.minimum.reduceat(rec[o][by], head)), pa.array(np.maximum.reduceat(rec[o][by], head)), pa.array(np.add.reduceat((e - s)[by] * fresh, head))], names=["route", "low", "high", "n"])
                continue
            power, words = sieve.value
            one, two = _sieve_places(route, power)
            keep = np.flatnonzero((words[one >> 6] >> (one & 63).astype(np.uint64)) & (words[two >> 6] >> (two & 63).astype(np.uint64)) & np.uint64(1))
            if not len(keep):
                continue
            s, e, o, route = s[keep], e[keep], o[keep], route[keep]
            data = _CAPITAL[code].tobytes()
            letters = pa.array([data[a:b] for a, b in zip(s.tolist(), e.tolist())], pa.binary())
            known = np.asarray(letters.dictionary_encode().indices)
            by = np.argsort(known, kind="stable")
            head = np.flatnonzero(np.r_[True, known[by][1:] != known[by][:-1]])
            quiet = np.ones(len(s), bool)
            speaker = by[head]
            quiet[speaker] = False
            lowest, highest = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
            lowest[speaker], highest[speaker] = np.minimum.reduceat(rec[o][by], head), np.maximum.reduceat(rec[o][by], head)
            cols = [pa.array(route), pa.array(text[o]), pa.array(rec[o]), pa.array((first[o] + s - offs[o]).astype(np.int32)), pa.array((e - s).astype(np.int32)), letters, pa.array(lowest, mask=quiet), pa.array(highest, mask=quiet)]
            yield pa.RecordBatch.from_arrays(cols, names=["route", "text", "record", "start", "n", "letters", "low", "high"])

    return run


def _search(span: int, part: int):
    names = ["route", "print", "letters", "low", "high"]

    def merged(rows: pa.Table) -> pa.Table:
        """Equal pieces, which are neighbours, as one."""
        route, print_, low, high = (np.asarray(rows.column(k).combine_chunks()) for k in ("route", "print", "low", "high"))
        head = np.flatnonzero(np.r_[True, (route[1:] != route[:-1]) | (print_[1:] != print_[:-1])])
        if len(head) == len(route):
            return rows
        return pa.table([pa.array(route[head]), pa.array(print_[head]), rows.column("letters").take(pa.array(head)), pa.array(np.minimum.reduceat(low, head)), pa.array(np.maximum.reduceat(high, head))], names=names)

    def of_two(rows: pa.Table) -> pa.Table:
        """Pieces whose minimizer two records hold."""
        if not rows.num_rows:
            return rows
        route, low, high = (np.asarray(rows.column(k).combine_chunks()) for k in ("route", "low", "high"))
        new = np.r_[True, route[1:] != route[:-1]]
        head = np.flatnonzero(new)
        return rows.filter(pa.array((np.minimum.reduceat(low, head) != np.maximum.reduceat(high, head))[np.cumsum(new) - 1]))

    def answer(rows: pa.Table) -> pa.RecordBatch:
        route, print_, low, high = (np.asarray(rows.column(k).combine_chunks()) for k in ("route", "print", "low", "high"))
        joined = pa.concat_arrays(rows.column("letters").chunks).cast(pa.large_binary())
        raw = np.frombuffer(joined.buffers()[2], np.uint8)
        offs = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
        length = np.diff(offs)
        ends = np.cumsum(length + 1) - 1  # place of each piece's 0
        codes = np.zeros(int(ends[-1]) + 1, np.uint8)
        inside = np.ones(len(codes), bool)
        inside[ends] = False
        codes[inside] = _CODE[raw[offs[0] : offs[-1]]]
        index = SpanIndex(codes, np.repeat(low, length + 1), np.repeat(high, length + 1), span)
        ask = np.argsort(-length, kind="stable")
        found_p, found_d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for j, has in enumerate(index.statistics(codes, ends[ask], length[ask])):
            who = ask[np.flatnonzero(has == span)]
            found_p.append(who)
            found_d.append(length[who] - 1 - j)
        p, at = np.concatenate(found_p), np.concatenate(found_d)
        order = np.lexsort((at, p))
        p, at = p[order], at[order]
        new = np.r_[True, (p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1)] if len(p) else np.zeros(0, bool)
        i = np.flatnonzero(new)
        last = np.r_[i[1:] - 1, len(p) - 1] if len(i) else i
        return pa.RecordBatch.from_arrays([pa.array(route[p[i]]), pa.array(print_[p[i]]), pa.array(at[i].astype(np.int32)), pa.array((at[last] + span).astype(np.int32))], names=["route", "print", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, letters, rest = [], 0, None
        for batch in batches:
            rows = pa.table(batch.columns, names=names)
            rows = merged(pa.concat_tables([rest, rows]) if rest is not None else rows)
            route = np.asarray(rows.column("route").combine_chunks())
            cut = int(np.searchsorted(route, route[-1]))  # the last minimizer may go on
            done, rest = of_two(rows.slice(0, cut)), rows.slice(cut)
            if done.num_rows:
                kept.append(done)
                letters += done.column("letters").nbytes
                if letters >= part:
                    yield answer(pa.concat_tables(kept))
                    kept, letters = [], 0
        if rest is not None:
            kept.append(of_two(rest))
        if sum(k.num_rows for k in kept):
            yield answer(pa.concat_tables(kept))

    return run


def shared_spans(rows: DataFrame, record: str, text: str, span: int = 40, m: int = 14, part: int = 2_000_000) -> DataFrame:
    """Maximal stretches of letters that lie in a span of at least `span` letters also found in another record.

    Returns (record, span_start, span_end), 0-based, end exclusive. Letters are compared without case; letters other than
    ACGT equal nothing. Null and short texts share nothing. Rows that repeat a record's text give nothing more; a record with
    several texts is one record, and gets the stretches of each of its texts. Rows with a null record are ignored. An empty
    table gives no rows.

    part: letters that a task indexes at once. A minimizer with more of them is cut again by longer ones, in the end by whole
    windows, of which all equal ones are one piece. Copies meet in each batch before they are shuffled, and again as they come
    in sorted; places find their piece's answer by its minimizer and a 64-bit hash of its letters.
    """
    spark = rows.sparkSession
    seq = F.when(F.octet_length(text) == F.length(text), F.col(text)).otherwise(F.regexp_replace(text, r"[^\x00-\x7F]", "?"))
    cut = rows.select(F.monotonically_increasing_id().alias("text"), F.col(record).cast("bigint").alias("record"), F.lit(0).alias("start"), seq.cast("binary").alias("letters"))
    cut = cut.filter(F.col("record").isNotNull() & (F.length("letters") >= span))
    spans = []
    for level in (m, (m + span) // 2, span):
        held = cut.mapInArrow(_pieces(span, level), HELD).groupBy("route").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
        held = settled(held.filter("low <> high").select("route", "n"), "held")
        count, total, most = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        pieces = settled(cut.mapInArrow(_pieces(span, level, spark.sparkContext.broadcast(_sieve(held, count))), PIECE), "pieces")
        last = level == span or most <= part
        heavy = held.filter(F.col("n") > part).select("route")
        own = pieces if last else pieces.join(heavy, "route", "left_anti")
        ask = own.filter("low IS NOT NULL").select("route", F.xxhash64("letters").alias("print"), "letters", "low", "high")
        ask = ask.repartition(partitions_for(spark, total, 4 * part), "route").sortWithinPartitions("route", "print")
        answers = settled(ask.mapInArrow(_search(span, part), ANSWER), "answers")
        places = own.select("route", F.xxhash64("letters").alias("print"), "text", "record", "start")
        # Answers of a known size: broadcast by Spark while they are small, else a sorted join whose hot keys are split as it runs.
        spans.append(places.join(answers, ["route", "print"]).select("text", "record", (F.col("start") + F.col("a")).alias("span_start"), (F.col("start") + F.col("b")).alias("span_end")))
        if last:
            break
        cut = pieces.join(heavy, "route", "left_semi").select("text", "record", "start", "letters")
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    by = Window.partitionBy("text", "record").orderBy("span_start", "span_end")
    reach = F.max("span_end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    every = every.withColumn("_new", F.when(F.col("span_start") <= reach, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(by))
    merged = every.groupBy("text", "record", "_run").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"))
    return merged.select("record", "span_start", "span_end").distinct()
