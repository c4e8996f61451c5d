"""The text index: k-mers, suffix array, Burrows-Wheeler transform and the relations that hang on them.

The text is a collection of strings; each has an end-marker, written "$" here, that sorts below all letters, the markers
among themselves by seq_id. bwt_pos counts the sorted suffixes from 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.dna import reverse_complement
from weftline.operators.ordered import bucket_width, run_lengths, with_interval, with_neighbour, with_row_behind, with_sum_before, with_sums_before
from weftline.operators.suffix_sort import CODE, sorted_suffixes
from weftline.shared import forget, settled

MARK = "$"


def normal(sequences: DataFrame, seq_id: str = "seq_id", seq: str = "seq") -> DataFrame:
    """(seq_id BIGINT, seq STRING) in capitals; rows with a null id or text are left out, repeated rows count once."""
    return sequences.select(F.col(seq_id).cast("bigint").alias("seq_id"), F.upper(seq).alias("seq")).filter("seq_id IS NOT NULL AND seq IS NOT NULL").distinct()


def as_bytes(seq: Column) -> Column:
    """One byte a letter, "?" for letters beyond ASCII: a part of it is cut in no more time than the part is long, that of a string only by counting from its start."""
    return F.regexp_replace(seq, r"[^\x00-\x7F]", "?").cast("binary")


def windows(texts: DataFrame, text_id: str, seq: str, k: int, valid: str | None = "ACGT") -> DataFrame:
    """(text_id, kmer_offset INT, kmer): every window of k letters, of which all are valid ones. Short texts have none."""
    if k < 1:
        raise ValueError("k must be at least 1")
    # Two steps: in one, the bytes would be made anew for every window.
    out = texts.filter(F.length(seq) >= k).select(text_id, as_bytes(F.col(seq)).alias("_b")).select(text_id, "_b", F.explode(F.expr(f"sequence(0, length(_b) - {k})")).alias("kmer_offset"))
    out = out.select(text_id, "kmer_offset", F.substring("_b", F.col("kmer_offset") + 1, F.lit(k)).cast("string").alias("kmer"))
    return out.filter(F.col("kmer").rlike(f"^[{valid}]+$")) if valid else out


def strand_kmers(texts: DataFrame, k: int) -> DataFrame:
    """(seq_id, kmer_offset, is_reverse, kmer): windows of both strands; offsets on the reverse strand count in the reverse complement."""
    ahead = windows(texts, "seq_id", "seq", k).withColumn("is_reverse", F.lit(0))
    back = windows(texts.withColumn("seq", reverse_complement(F.col("seq"))), "seq_id", "seq", k).withColumn("is_reverse", F.lit(1))
    return ahead.unionByName(back).select("seq_id", "kmer_offset", "is_reverse", "kmer")


def suffix_array(texts: DataFrame, by: str | None = None) -> DataFrame:
    """(bwt_pos, seq_id, seq_off, ch) of texts over ACGNT with one row for each seq_id; other letters count as N. ch is the letter before the suffix, the end-marker before a whole text.

    by: a column of texts, a whole number and not null; its values get an array each, with rows from 0, as if each were built alone.
    """
    own = settled(texts.select("seq_id", as_bytes(F.col("seq")).alias("seq"), *([F.col(by).cast("bigint").alias(by)] if by else [])), "texts")
    out = sorted_suffixes(own, by)
    if not by:
        return out
    sizes = own.groupBy(by).agg(F.sum(F.length("seq").cast("bigint") + 1).alias("_n"))
    first = with_sum_before(sizes, [], by, "_n", "_first", bucket_width(sizes, by))
    return out.join(first.select(by, "_first"), by).select(by, (F.col("bwt_pos") - F.col("_first")).cast("bigint").alias("bwt_pos"), "seq_id", "seq_off", "ch")


def symbol_table(symbols: DataFrame, ch: str = "ch", n: str | None = None) -> DataFrame:
    """(ch, symbol_rank, freq, c_before): each symbol's place in the alphabet, its count and the count of smaller symbols."""
    freq = symbols.groupBy(F.col(ch).alias("ch")).agg((F.sum(n) if n else F.count(F.lit(1))).alias("freq"))
    w = Window.orderBy("ch")  # one row for each symbol of the alphabet
    return freq.select("ch", (F.row_number().over(w) - 1).cast("bigint").alias("symbol_rank"), "freq", F.coalesce(F.sum("freq").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint").alias("c_before"))


def text_symbols(texts: DataFrame) -> DataFrame:
    """(ch, n): letters of the texts and their end-markers, counted text by text without a row for each letter."""
    count = F.map_from_arrays(F.array(*(F.lit(c) for c in "ACGNT")), F.array(*(F.length("s") - F.length(F.replace("s", F.lit(c), F.lit(""))) for c in "ACGNT")))
    each = texts.select(F.regexp_replace("seq", "[^ACGT]", "N").alias("s")).select(F.explode(count).alias("ch", "n")).filter("n > 0")
    return each.select("ch", F.col("n").cast("bigint").alias("n")).unionByName(texts.select(F.lit(MARK).alias("ch"), F.lit(1).cast("bigint").alias("n")))


def end_rows(texts: DataFrame) -> DataFrame:
    """(bwt_pos, seq_id, seq_off): the row of each text's end-marker. The markers sort below all letters and among themselves by seq_id, so the texts alone tell them."""
    ends = texts.select("seq_id", F.length("seq").cast("bigint").alias("seq_off"), F.lit(1).alias("_one"))
    return with_sum_before(ends, [], "seq_id", "_one", "bwt_pos", bucket_width(ends, "seq_id")).select(F.col("bwt_pos").cast("bigint").alias("bwt_pos"), "seq_id", "seq_off")


def bwt_runs(b: DataFrame) -> DataFrame:
    """(bwt_start, ch, length); every end-marker is a run of its own."""
    return run_lengths(b.select(F.col("bwt_pos").alias("bwt_start"), "ch"), [], "bwt_start", ["ch"], apart=F.col("ch") == MARK)


def text_runs(texts: DataFrame) -> DataFrame:
    """bwt_runs of the texts' suffix array, which isn't written for it, written to the shared folder: only runs that meet at the ends of sorted buckets are looked at again."""
    runs = sorted_suffixes(settled(texts.select("seq_id", as_bytes(F.col("seq")).alias("seq")), "texts"), places=False)
    out = settled(runs.filter("not open").drop("open").unionByName(run_lengths(runs.filter("open"), [], "bwt_start", ["ch"], "length")), "bwt_runs")
    forget(runs)
    return out


def _word_counts(k: int, chunk: int = 1 << 20):
    """Of texts as bytes: (w, n), how many suffixes begin with each word of k letters and have each letter before them, as one number of base 6."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(6 ** (k + 1), np.int64)
            for seq in batch.column(0):
                codes = np.r_[np.uint8(0), CODE[np.frombuffer(seq.as_buffer(), np.uint8)], np.zeros(k, np.uint8)]
                for at in range(0, len(codes) - k, chunk):
                    part = codes[at : at + chunk + k].astype(np.int64)
                    many = len(part) - k
                    word = np.zeros(many, np.int64)
                    for j in range(1, k + 1):
                        word = word * 6 + part[j : j + many]
                    n += np.bincount(word * 6 + part[:many], minlength=len(n))
            own = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own])], names=["w", "n"])

    return run


def word_runs(texts: DataFrame, k: int) -> DataFrame:
    """(bwt_start, ch, length): letters before the suffixes of texts over ACGNT, counted without sorting these: in order of their first k letters alone and, for the same ones, of the letter before.

    At the first row of each word of up to k letters, and behind its last one, ranks are those of the transform; inside a word they aren't.
    """
    if not 1 <= k <= 6:
        raise ValueError("k must be 1 to 6")
    counts = texts.select(as_bytes(F.col("seq"))).mapInArrow(_word_counts(k), "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("length"))
    w = Window.orderBy("w").rowsBetween(Window.unboundedPreceding, -1)  # a row for each word and letter of the alphabet
    return counts.select(F.coalesce(F.sum("length").over(w), F.lit(0)).cast("bigint").alias("bwt_start"), F.substring(F.lit(MARK + "ACGNT"), (F.col("w") % 6 + 1).cast("int"), F.lit(1)).alias("ch"), "length")


def rank_blocks(runs: DataFrame, each: int = 10, alphabet: str = MARK + "ACGNT") -> DataFrame:
    """(block_id, bwt_start, rank_$, rank_A, ...): every `each` runs, how often each symbol occurs before the block."""
    width = bucket_width(runs, "bwt_start")
    numbered = with_sum_before(runs.withColumn("_one", F.lit(1)), [], "bwt_start", "_one", "run_id", width).withColumn("block_id", F.floor(F.col("run_id") / each))
    sums = numbered.groupBy("block_id").agg(F.min("bwt_start").alias("bwt_start"), *(F.sum(F.when(F.col("ch") == c, F.col("length")).otherwise(0)).alias(f"_{c}") for c in alphabet))
    names = {c: "rank_end" if c == MARK else f"rank_{c}" for c in alphabet}
    sums = settled(sums, "blocks")
    sums = with_sums_before(sums, [], "block_id", {names[c]: f"_{c}" for c in alphabet}, bucket_width(sums, "block_id"))
    return sums.select("block_id", "bwt_start", *names.values())


def lf_mapping(b: DataFrame) -> DataFrame:
    """(bwt_pos, ch, lf_pos): the row of the suffix that is one letter longer; for whole texts the marker's row of that text."""
    width = bucket_width(b, "bwt_pos")
    ranked = with_sum_before(b.select("bwt_pos", "seq_id", "ch", F.lit(1).alias("_one")), ["ch"], "bwt_pos", "_one", "ch_rank", width)
    table = symbol_table(b)
    out = ranked.join(F.broadcast(table.select("ch", "c_before")), "ch")  # a row for each symbol
    letters = out.filter(F.col("ch") != MARK).select("bwt_pos", "ch", (F.col("c_before") + F.col("ch_rank")).cast("bigint").alias("lf_pos"))
    ends = out.filter(F.col("ch") == MARK).select("bwt_pos", "ch", "seq_id")
    mark = with_sum_before(ends.select("seq_id", F.lit(1).alias("_one")), [], "seq_id", "_one", "lf_pos", bucket_width(ends, "seq_id"))
    return letters.unionByName(ends.join(mark.select("seq_id", F.col("lf_pos").cast("bigint").alias("lf_pos")), "seq_id").select("bwt_pos", "ch", "lf_pos"))


def symbol_ranks(points: DataFrame, point: str, runs: DataFrame, symbols: str = "ACGNT") -> DataFrame:
    """Add rank_A, rank_C, ...: how often each letter occurs in the rows before each point, 0 to the number of rows.

    The counts before each run are running sums; a point adds its part of the run that holds the row before it.
    """
    parts = runs.withColumns({f"_n{c}": F.when(F.col("ch") == c, F.col("length")).otherwise(F.lit(0)) for c in symbols})
    parts = with_sums_before(parts, [], "bwt_start", {f"_b{c}": f"_n{c}" for c in symbols}, bucket_width(runs, "bwt_start")).withColumn("_from", F.col("bwt_start"))
    # Point p looks at row p - 1; point 0 is before all rows.
    at = with_interval(points.withColumn("_row", F.col(point) - 1), "_row", parts, "bwt_start", "length", ["_from", "ch", *(f"_b{c}" for c in symbols)])
    here = {f"rank_{c}": (F.coalesce(f"_b{c}", F.lit(0)) + F.when(F.col("ch") == c, F.col(point) - F.col("_from")).otherwise(0)).cast("bigint") for c in symbols}
    return at.withColumns(here).drop("_row", "_from", "ch", *(f"_b{c}" for c in symbols))


def extend_ranges(ranges: DataFrame, runs: DataFrame, symbols: str = "ACGNT") -> DataFrame:
    """(range_start, range_end, ch, new_start, new_end): closed row ranges with each letter put before them; letters that don't stand there give no row.

    A backward search step for all ranges at once: C of the letter plus its ranks at both bounds.
    """
    c_before = symbol_table(runs, "ch", "length").select("ch", "c_before")
    ends = ranges.select("range_start", "range_end").distinct()
    points = ends.select(F.explode(F.array("range_start", F.col("range_end") + 1)).alias("_p")).distinct()
    ranks = symbol_ranks(points, "_p", runs, symbols).select("_p", F.explode(F.array(*(F.struct(F.lit(c).alias("ch"), F.col(f"rank_{c}").alias("k")) for c in symbols))).alias("_s")).select("_p", "_s.ch", "_s.k")
    low = ranks.select(F.col("_p").alias("range_start"), "ch", F.col("k").alias("_lo"))
    high = ranks.select((F.col("_p") - 1).alias("range_end"), "ch", F.col("k").alias("_hi"))
    out = ends.join(low, "range_start").join(high, ["range_end", "ch"]).filter("_hi > _lo").join(F.broadcast(c_before), "ch")  # a row for each letter
    return out.select("range_start", "range_end", "ch", (F.col("c_before") + F.col("_lo")).alias("new_start"), (F.col("c_before") + F.col("_hi") - 1).alias("new_end"))


def first_symbols(points: DataFrame, point: str, symbols: DataFrame) -> DataFrame:
    """Add the first letter of the suffix at each row: the symbol whose rows hold it; points beyond the text keep null."""
    ends = [(r["ch"], r["c_before"], r["c_before"] + r["freq"]) for r in symbols.collect()]  # a row for each symbol of the alphabet
    first = F.lit(None).cast("string")
    for ch, low, high in ends:
        first = F.when((F.col(point) >= low) & (F.col(point) < high), F.lit(ch)).otherwise(first)
    return points.withColumn("first_ch", first)


def bi_extend(intervals: DataFrame, runs: DataFrame, ahead: bool = False) -> DataFrame:
    """Bi-intervals with each letter put before them, or behind them: (forward_start, reverse_start, size, ch, new_forward, new_reverse, new_size), in an index of both strands.

    An interval is the rows that begin with a pattern, from forward_start on, and those that begin with its reverse complement,
    from reverse_start on, `size` of each. Backwards the forward rows are extended as in a search; on the other strand the rows of
    the letters whose complement comes before this one's, and of patterns at a text's beginning, come first. Forwards the strands
    change places and the letter is its complement. Letters that don't stand there give no row. runs: those of the transform, or
    word_runs of the patterns' length.
    """
    a, b = ("reverse_start", "forward_start") if ahead else ("forward_start", "reverse_start")
    own = intervals.select("forward_start", "reverse_start", "size").distinct()
    flip = dict(zip("ACGNT", "TGCNA"))
    points = own.select(F.explode(F.array(a, F.col(a) + F.col("size"))).alias("_p")).distinct()
    ranks = symbol_ranks(points, "_p", runs)
    low = ranks.select(F.col("_p").alias(a), *(F.col(f"rank_{c}").alias(f"_l{c}") for c in "ACGNT"))
    high = ranks.select(F.col("_p").alias("_e"), *(F.col(f"rank_{c}").alias(f"_h{c}") for c in "ACGNT"))
    met = own.withColumn("_e", F.col(a) + F.col("size")).join(low, a).join(high, "_e")
    n = {c: F.col(f"_h{c}") - F.col(f"_l{c}") for c in "ACGNT"}
    begun = F.col("size") - sum(n.values())  # end-markers before the pattern
    each = [F.struct(F.lit(flip[c] if ahead else c).alias("ch"), F.lit(c).alias("_c"), F.col(f"_l{c}").alias("_lo"), n[c].alias("new_size"), (F.col(b) + begun + sum((n[d] for d in "ACGNT" if flip[d] < flip[c]), F.lit(0))).alias("_other")) for c in "ACGNT"]
    c_before = symbol_table(runs, "ch", "length").select(F.col("ch").alias("_c"), "c_before")
    out = met.select("forward_start", "reverse_start", "size", F.explode(F.array(*each)).alias("_s")).select("forward_start", "reverse_start", "size", "_s.*").filter("new_size > 0").join(F.broadcast(c_before), "_c")  # a row for each letter
    start, other = F.col("c_before") + F.col("_lo"), F.col("_other")
    return out.select("forward_start", "reverse_start", "size", "ch", (other if ahead else start).alias("new_forward"), (start if ahead else other).alias("new_reverse"), "new_size")


def bi_intervals(occurrences_: DataFrame, back: DataFrame, sa: DataFrame) -> DataFrame:
    """(pattern, forward_start, reverse_start, size) in an index of both strands: rows that begin with a pattern, and with its reverse complement.

    occurrences_ and back: (pattern, seq_id, seq_off) of the patterns and of their reverse complements, under the pattern's name.
    """
    f = occurrences_.join(sa, ["seq_id", "seq_off"]).groupBy("pattern").agg(F.min("bwt_pos").alias("forward_start"), F.count(F.lit(1)).alias("size"))
    r = back.join(sa, ["seq_id", "seq_off"]).groupBy("pattern").agg(F.min("bwt_pos").alias("reverse_start"))
    return f.join(r, "pattern").select("pattern", "forward_start", "reverse_start", "size")


def run_samples(runs: DataFrame, sa: DataFrame) -> DataFrame:
    """(bwt_start, head_seq, head_off, tail_seq, tail_off): text positions of the first and the last row of each run."""
    ends = runs.select("bwt_start", (F.col("bwt_start") + F.col("length") - 1).alias("_last"))
    head = sa.select(F.col("bwt_pos").alias("bwt_start"), F.col("seq_id").alias("head_seq"), F.col("seq_off").alias("head_off"))
    tail = sa.select(F.col("bwt_pos").alias("_last"), F.col("seq_id").alias("tail_seq"), F.col("seq_off").alias("tail_off"))
    return ends.join(head, "bwt_start").join(tail, "_last").drop("_last")


def next_text_position(sa: DataFrame, n: int = 1) -> DataFrame:
    """(bwt_pos, seq_id, seq_off, next_seq, next_off): the text position n rows behind each row; null behind the last one."""
    if n == 1:
        return with_neighbour(sa.select("bwt_pos", "seq_id", "seq_off"), [], "bwt_pos", {"next_seq": "seq_id", "next_off": "seq_off"}, bucket_width(sa, "bwt_pos"), ahead=True)
    return with_row_behind(sa.select("bwt_pos", "seq_id", "seq_off"), "bwt_pos", {"next_seq": "seq_id", "next_off": "seq_off"}, n)


def _hashes(sizes: list[int], every: bool):
    """Of rows (id, text): a number made of so many letters, for each of the sizes, at each place, or of the whole text, which has one of the sizes."""
    odd = 0x9E3779B97F4A7C15

    def of(letters: np.ndarray, k: int) -> np.ndarray:
        # parts of 1, 2, 4, .. letters, put one behind another for the ones that k is made of
        part, size, out, done = letters.astype(np.uint64) + np.uint64(1), 1, None, 0
        while True:
            if k & size:
                out = part if out is None else out[: len(part) - done] * np.uint64(pow(odd, size, 1 << 64)) + part[done:]
                done += size
            if size * 2 > k:
                out = out[: len(letters) - k + 1] + np.uint64(k)
                return (out ^ out >> np.uint64(32)).view(np.int64)
            part, size = part[:-size] * np.uint64(pow(odd, size, 1 << 64)) + part[size:], size * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not every:
                own = [x.as_py() for x in batch.column(1)]
                n, h = np.array([len(x) for x in own]), np.zeros(len(own), np.int64)
                for k in sizes:
                    if (n == k).any():
                        h[n == k] = of(np.frombuffer(b"".join(x for x in own if len(x) == k), np.uint8), k)[::k]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h)], names=["pattern", "h"])
                continue
            for seq_id, seq in zip(batch.column(0).to_pylist(), batch.column(1)):
                letters = np.frombuffer(seq.as_buffer(), np.uint8)
                for k in sizes:
                    for at in range(0, len(letters) - k + 1, 1 << 20):
                        h = of(letters[at : at + (1 << 20) + k - 1], k)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), seq_id, np.int64)), pa.array(np.arange(at, at + len(h), dtype=np.int64)), pa.array(h)], names=["seq_id", "seq_off", "h"])

    return run


def occurrences(patterns: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(pattern, seq_id, seq_off): where each pattern of at least k letters stands in the texts, overlapping ones too.

    A number made of a pattern's letters is joined with those of the texts' windows of this length, so repeats that many
    patterns begin with give no pairs. Where patterns have more than four lengths, it is made of the first k, 2k, 4k, .. letters, as
    many as the pattern has. The whole pattern is compared in place.
    """
    patterns = settled(patterns.select("pattern").filter(F.length("pattern") >= k), "patterns")
    n = F.length("pattern")
    if patterns.select(n).distinct().limit(5).count() > 4:
        n = k * F.pow(F.lit(2), F.floor(F.log2(n.cast("double") / k + 1e-9))).cast("int")
    sizes = sorted(r[0] for r in patterns.select(n.alias("n")).distinct().collect())  # four, or one for each power of two
    seeds = patterns.select("pattern", F.substring(as_bytes(F.col("pattern")), F.lit(1), n).alias("_b")).mapInArrow(_hashes(sizes, False), "pattern string, h bigint")
    letters = texts.filter(F.length("seq") >= k).select(F.col("seq_id").cast("bigint").alias("seq_id"), as_bytes(F.col("seq")).alias("_b"))
    hits = letters.mapInArrow(_hashes(sizes, True), "seq_id bigint, seq_off bigint, h bigint").join(seeds, "h").select("pattern", "seq_id", "seq_off")
    hits = hits.join(letters, "seq_id")
    return hits.filter(F.expr("cast(substring(_b, cast(seq_off + 1 as int), length(pattern)) as string) = pattern")).select("pattern", "seq_id", "seq_off")
