"""Problem 7: evaluation texts inside training texts.

Fixed masks over up to 12 words ignore some positions, so that a passage still meets its original when words at such
positions were replaced. The masked windows of the test items and of the corpus are joined by hash, and around each hit
the two word sequences are compared along their common diagonal.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.encode import few_rows_a_batch
from weftline.llm.seen_keys import mix
from weftline.operators.skew import salted_join
from weftline.shared import settled

WINDOW = 13
#: Positions that each mask compares, chosen by simulation: of passages of 20 words with 3 or 4 words replaced at random places they meet 0.99 or 0.94.
MASKS = ((0, 1, 2, 3, 5, 6, 9, 10), (0, 1, 2, 3, 6, 7, 8, 9), (0, 1, 2, 4, 6, 7, 9, 10), (0, 1, 4, 6, 8, 9, 10, 11))
SPANS = tuple(m[-1] + 1 for m in MASKS)
PROBES_AT_ONCE = 4_000_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits after NFKC and lower-casing."""
    return _WORD.findall((text if text.isascii() else unicodedata.normalize("NFKC", text)).lower())


def word_hashes(flat: list[str]) -> np.ndarray:
    import xxhash

    coded = pa.array(flat, pa.string()).dictionary_encode()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return each[np.asarray(coded.indices)] if len(flat) else np.zeros(0, np.uint64)


def masked(h: np.ndarray) -> list[np.ndarray]:
    """For each mask the hash of the window that begins at each place."""
    out = []
    for k, (mask, span) in enumerate(zip(MASKS, SPANS)):
        n = max(0, len(h) - span + 1)
        x = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in mask:
                x = x * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        out.append(mix(x, k + 1))
    return out


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = words(text)
            found = masked(word_hashes(w))
            rows.append((item, w, [{"h": int(x), "at": i} for own in found for i, x in enumerate(own.view(np.int64))]))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], HITS)], names=["item_id", "words", "windows"])


HITS = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32())]))
PART = "doc_id bigint, first int, words array<string>, hits array<struct<h:bigint,at:int>>"


def _parts(found: list[tuple[int, list[str], np.ndarray, np.ndarray]], context: int) -> pa.RecordBatch:
    """Parts of documents (id, words, places and hashes of hits in order of place) around their hits, with `context` words on either side; no word is in two parts."""
    out = []
    for doc, w, at, h in found:
        cuts = np.flatnonzero(np.diff(at) > 2 * context + max(SPANS)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(at)]):
            lo, hi = max(0, int(at[a]) - context), min(len(w), int(at[b - 1]) + max(SPANS) + context)
            out.append((doc, lo, w[lo:hi], [{"h": int(x), "at": int(p)} for x, p in zip(h[a:b], at[a:b])]))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.list_(pa.string())), pa.array([r[3] for r in out], HITS)], names=["doc_id", "first", "words", "hits"])


def _split_words(texts: list[str]) -> tuple[list[str], np.ndarray]:
    flat, sizes = [], []
    for text in texts:
        w = words(text)
        flat += w
        sizes.append(len(w))
    return flat, np.array(sizes, np.int64)


def _documents(probes, context: int):
    """Parts of documents whose masked windows are among the probes; without probes (doc_id, at, h) of all masked windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if probes is None else probes.value
        if known is not None:
            coarse = np.zeros(1 << 22, bool)
            coarse[(known.view(np.uint64) >> np.uint64(42)).astype(np.int64)] = True
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch = big.slice(at, 256)
                ids = batch.column(0)
                flat, sizes = _split_words(batch.column(1).to_pylist())
                ends = np.cumsum(sizes)
                begins, owner = ends - sizes, np.repeat(np.arange(len(sizes)), sizes)
                places, hashes = [], []
                for row, span in zip(masked(word_hashes(flat)), SPANS):
                    n = len(row)
                    inside = owner[:n] == owner[span - 1 : span - 1 + n]
                    if known is None:
                        own = np.flatnonzero(inside)
                    else:
                        own = np.flatnonzero(coarse[(row >> np.uint64(42)).astype(np.int64)] & inside)
                        v = row[own].view(np.int64)
                        own = own[known[np.minimum(np.searchsorted(known, v), len(known) - 1)] == v]
                    places.append(own)
                    hashes.append(row[own].view(np.int64))
                places, hashes = np.concatenate(places), np.concatenate(hashes)
                doc = owner[places]
                if known is None:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array((places - begins[doc]).astype(np.int32)), pa.array(hashes)], names=["doc_id", "at", "h"])
                    continue
                order = np.argsort(places, kind="stable")
                places, hashes, doc = places[order], hashes[order], doc[order]
                new = np.flatnonzero(np.r_[True, np.diff(doc) != 0]) if len(doc) else []
                found = [(ids[int(doc[a])].as_py(), flat[begins[doc[a]] : ends[doc[a]]], places[a:b] - begins[doc[a]], hashes[a:b]) for a, b in zip(new, [*new[1:], len(doc)])]
                yield _parts(found, context)

    return run


def _parts_of_hits(context: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                marks = batch.column(2)[row].values
                at, h = (np.asarray(marks.field(c)) for c in ("at", "h"))
                order = np.argsort(at, kind="stable")
                yield _parts([(batch.column(0)[row].as_py(), words(batch.column(1)[row].as_py()), at[order], h[order])], context)

    return run


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", probes_at_once: int = PROBES_AT_ONCE, gap: int = 2) -> DataFrame:
    """Overlaps of test items with documents.

    Returns (doc_id, item_id, n_exact, n_matched, n_span), one row for each pair that shares a masked window: the longest
    run of equal consecutive words, and, of the longest overlap in which at most `gap` words in a row differ, the equal words
    and all of its words.

    Null, empty and short texts have no window and give nothing. Repeated rows give nothing more. Rows with a null id are
    ignored. The items' window hashes are sent to all tasks only while they are at most probes_at_once (8 bytes each);
    beyond that the windows' hashes and places alone are joined by a shuffle, and only texts with a hit are read again. Hits are
    spread over tasks by their place, however many documents hold a passage.
    """
    spark = documents.sparkSession
    tests = items.filter(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text"))
    tests = settled(tests.mapInArrow(_items, "item_id bigint, words array<string>, windows array<struct<h:bigint,at:int>>").distinct(), "items")
    grams = tests.select("item_id", F.inline("windows")).select("item_id", F.col("at").alias("item_at"), "h").distinct()
    distinct = grams.select("h").distinct()
    probes = None
    if distinct.count() <= probes_at_once:
        probes = spark.sparkContext.broadcast(np.sort(np.array([r.h for r in distinct.toLocalIterator()], np.int64)))
        if not len(probes.value):
            return spark.createDataFrame([], "doc_id bigint, item_id bigint, n_exact int, n_matched int, n_span int")
    # With as many words on either side of a hit as the longest item has, the item lies in the segment wherever the hit is in it.
    context = tests.agg(F.max(F.size("words"))).first()[0] or 0
    docs = documents.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    with few_rows_a_batch(spark):
        if probes is not None:
            parts = settled(docs.mapInArrow(_documents(probes, context), PART), "parts")
        else:
            every = settled(docs.mapInArrow(_documents(None, context), "doc_id bigint, at int, h bigint"), "windows")
            own = every.join(distinct, "h", "left_semi").groupBy("doc_id").agg(F.collect_set(F.struct("h", "at")).alias("hits"))
            parts = settled(docs.join(own, "doc_id").mapInArrow(_parts_of_hits(context), PART), "parts")
    # Hits go into the join without their words; these are met again once for each diagonal.
    hits = parts.select("doc_id", "first", F.inline("hits")).select("doc_id", "first", "h", "at")
    met = salted_join(hits, grams, ["h"]).select("doc_id", "first", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    met = met.join(parts.select("doc_id", "first", "words"), ["doc_id", "first"])
    met = salted_join(met, tests.select("item_id", F.col("words").alias("item_words")), ["item_id"])
    # Along the diagonal: the words of the item against those of the document's part, outside of it null.
    here = F.transform("item_words", lambda w, j: F.coalesce(F.get("words", j + F.col("shift") - F.col("first")) == w, F.lit(False)))
    zero = F.struct(*(F.lit(0).alias(n) for n in ("run", "exact", "miss", "m", "s", "matched", "span")))

    def step(a, same):
        run = F.when(same, a["run"] + 1).otherwise(0)
        miss = F.when(same, 0).otherwise(a["miss"] + 1)
        broken = miss > gap
        m = F.when(broken, 0).otherwise(a["m"] + same.cast("int"))
        s = F.when(broken, 0).when(same, a["s"] + F.when(a["m"] > 0, a["miss"]).otherwise(0) + 1).otherwise(a["s"])
        better = m > a["matched"]
        return F.struct(run.alias("run"), F.greatest(a["exact"], run).alias("exact"), miss.alias("miss"), m.alias("m"), s.alias("s"), F.when(better, m).otherwise(a["matched"]).alias("matched"), F.when(better, s).otherwise(a["span"]).alias("span"))

    found = met.select("doc_id", "item_id", F.aggregate(here, zero, step).alias("a"))
    best = F.max(F.struct("a.matched", "a.span"))
    return found.groupBy("doc_id", "item_id").agg(F.max("a.exact").alias("n_exact"), best.alias("b")).select("doc_id", "item_id", "n_exact", F.col("b.matched").alias("n_matched"), F.col("b.span").alias("n_span"))
