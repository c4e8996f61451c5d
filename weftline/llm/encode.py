"""Problem 6: the whole corpus as token ids of a public tokenizer.

Texts are split into words in Spark. Documents are taken in blocks of bounded size: a block keeps its distinct words once
and its documents as positions in that list. The blocks' words meet by word, where each distinct word is encoded once (a word that
is in more than BLOCKS_A_WORD blocks once for so many of them); its ids go back to the block and the place they came from.
"""

from __future__ import annotations

import base64
import json
import threading
import unicodedata
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.shared import partitions_for, settled

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how byte-level BPE vocabularies split texts, with Java's name for Unicode white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: pieces of a sentence-piece vocabulary hold white space at their beginning only.
PIECE_SPLIT = " *[^ ]+| +"
BLOCK_CHARS = 4_000_000
BLOCKS_EACH = 1
BLOCKS_A_WORD = 10_000
WORDS_EACH = 250_000
#: The vocabulary goes to the tasks as a broadcast; a larger file is none.
LARGEST_VOCABULARY = 64 << 20
_small_batches = threading.Lock()
_inside: dict[int, list] = {}


def java_pattern(pattern: str) -> str:
    """A split pattern with Java's name for Unicode white space."""
    return pattern.replace(r"[^\s", r"[^\p{IsWhite_Space}").replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")


@contextmanager
def few_rows_a_batch(spark: SparkSession, rows: int = 1000):
    """Smaller batches to Python for a job that is run inside: long texts must fit into memory by the batch.

    The setting is the session's. Of jobs in several threads the first sets it and the last puts it back; others that run meanwhile get small batches too.
    """
    name, key = "spark.sql.execution.arrow.maxRecordsPerBatch", id(spark)
    with _small_batches:
        if key not in _inside:
            _inside[key] = [spark.conf.get(name), 0]
            spark.conf.set(name, str(rows))
        _inside[key][1] += 1
    try:
        yield
    finally:
        with _small_batches:
            _inside[key][1] -= 1
            if not _inside[key][1]:
                spark.conf.set(name, _inside.pop(key)[0])


def _blocks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        pack, task, made = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId(), 0

        def block(ids: pa.Array, texts: pa.ListArray) -> pa.RecordBatch:
            nonlocal made
            coded = texts.flatten().dictionary_encode()
            sizes = np.diff(np.asarray(texts.offsets))
            codes = np.asarray(coded.indices).astype(np.uint16 if len(coded.dictionary) < 1 << 16 else np.uint32)
            made += 1
            whole = [pa.array([task << 32 | made], pa.int64()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([sizes.tolist()], pa.list_(pa.int32())), pa.array([codes.itemsize], pa.int32()), pa.array([len(coded.dictionary)], pa.int32()), pa.array([pack.compress(codes.tobytes())], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)]
            return pa.RecordBatch.from_arrays(whole, names=["block", "ids", "sizes", "width", "n_words", "codes", "words"])

        waiting, held = [], 0
        for batch in batches:
            chars = np.cumsum(np.asarray(batch.column(2)))
            a = 0
            while a < len(chars):
                room = max(0, most - held)
                b = int(np.searchsorted(chars, (chars[a - 1] if a else 0) + room, side="right"))
                if b == a and not waiting:
                    b += 1  # a text longer than a block is a block
                waiting.append(batch.slice(a, b - a))
                held += int(chars[b - 1] - (chars[a - 1] if a else 0)) if b > a else 0
                if b < len(chars) or held >= most:
                    whole = pa.Table.from_batches(waiting).combine_chunks()
                    yield block(whole.column(0).chunk(0), whole.column(1).chunk(0))
                    waiting, held = [], 0
                a = b
        whole = pa.Table.from_batches(waiting).combine_chunks() if waiting else None
        if whole is not None and whole.num_rows:
            yield block(whole.column(0).chunk(0), whole.column(1).chunk(0))

    return run


@lru_cache(1)
def encoder(name: str, data: bytes) -> Callable[[str], list[int]]:
    """Ids of one word by a vocabulary, read once in each Python worker: ranks (.tiktoken), pieces (.model) or a tokenizer's settings (.json)."""
    if name.endswith(".tiktoken"):
        import tiktoken

        pieces_ = {base64.b64decode(piece): int(i) for piece, i in map(bytes.split, data.splitlines())}
        return tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=pieces_, special_tokens={}).encode_ordinary
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        lead = len(model.encode("\n"))  # behind a line end a word stands without the white space that is put before a text
        return lambda w: model.encode("\n" + w)[lead:]
    from tokenizers import Tokenizer, normalizers

    model = Tokenizer.from_buffer(data)
    model.encode_special_tokens = True
    model.normalizer = normalizers.Sequence([])
    return lambda w: model.encode(w, add_special_tokens=False).ids


def _lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in NFC and, letter by letter, lower case."""
    for batch in batches:
        out = [t.lower() if t.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])


def _words(docs: DataFrame, name: str, data: bytes) -> DataFrame:
    """(doc_id, words, n): the texts (doc_id, text) as the words that a vocabulary encodes on their own, and their number of characters."""
    whole = F.col("text")
    if name.endswith(".model"):
        whole, pattern = F.concat(F.lit(" "), F.translate("text", "\u2581", " ")), PIECE_SPLIT
    elif name.endswith(".json") and (rules := json.loads(data)["normalizer"]):
        kinds = {r["type"] for r in rules.get("normalizers", [rules])}
        if kinds != {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"no rules for the normalizers {sorted(kinds)}")
        pattern = json.loads(data)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        docs = docs.mapInArrow(_lowered, "doc_id bigint, text string")
    else:
        pattern = SPLIT
    return docs.select("doc_id", F.regexp_extract_all(whole, F.lit("(?s)" + java_pattern(pattern)), F.lit(0)).alias("words"), F.length("text").alias("n"))


def _encode(name: str, vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(name, vocabulary.value)
        last, last_ids = None, []  # rows come sorted by word
        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            table = []
            for w in coded.dictionary.to_pylist():
                if w != last:
                    last, last_ids = w, ids_of(w)
                table.append(last_ids)
            ids = pa.array(table, pa.list_(pa.int32())).take(coded.indices)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], names=["block", "at", "word_ids"])

    return run


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for row in range(batch.num_rows):
            ids, sizes, width, codes, words = (batch.column(k)[row] for k in range(5))
            entries = words.values
            at = np.asarray(entries.field("at"))
            lists = entries.field("word_ids").take(pa.array(np.argsort(at)))
            flat, starts = np.asarray(lists.flatten()), np.asarray(lists.offsets).astype(np.int64)
            starts = starts - starts[0]
            length = np.diff(starts)
            code = np.frombuffer(unpack.decompress(codes.as_py()), np.uint16 if width.as_py() == 2 else np.uint32).astype(np.int64)
            each = length[code]
            ends = np.cumsum(each)
            # place in `flat` of every token: where its word's ids begin, and how far it is in them
            take = np.repeat(starts[code] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)
            bounds = np.r_[0, np.cumsum(np.asarray(sizes.values))]
            offsets = np.r_[0, ends][bounds].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids.values), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[take].astype(np.int32)))], names=["doc_id", "ids"])


def encode(documents: DataFrame, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", doc_id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS, blocks_a_word: int = BLOCKS_A_WORD) -> DataFrame:
    """(doc_id BIGINT, ids ARRAY<INT>): every document by a public vocabulary, without special tokens.

    vocabulary: a file of the driver, sent to the tasks: byte-level BPE as ranks (.tiktoken) or settings (.json), BPE with word
    ends (.json, lower case, white space dropped) or sentence pieces (.model).
    Null, empty texts: an empty list. Strings of special tokens are ordinary text. Every row gives a row, also those that
    repeat an id or have a null one. An empty table gives no rows.

    A word that many blocks hold is spread: blocks are dealt into groups of about blocks_a_word, and a word's rows of one group
    meet, so that no task gets more rows of a word than that.
    """
    spark = documents.sparkSession
    with open(vocabulary, "rb") as f:
        data = f.read(LARGEST_VOCABULARY + 1)
    if len(data) > LARGEST_VOCABULARY:
        raise ValueError(f"{vocabulary} has more than {LARGEST_VOCABULARY} bytes")
    some = F.col(text).isNotNull() & (F.col(text) != "")
    with few_rows_a_batch(spark):
        docs = _words(documents.filter(some).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), vocabulary, data)
        blocks = settled(docs.mapInArrow(_blocks(block_chars), "block bigint, ids array<bigint>, sizes array<int>, width int, n_words int, codes binary, words array<string>"), "blocks")
    n_blocks, n_words = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    words = blocks.select("block", F.posexplode("words").alias("at", "word"))
    group = F.pmod(F.xxhash64("block"), F.lit(max(1, -(-n_blocks // blocks_a_word))))
    coded = words.repartition(partitions_for(spark, n_words, WORDS_EACH), "word", group).sortWithinPartitions("word").mapInArrow(_encode(vocabulary, spark.sparkContext.broadcast(data)), "block bigint, at int, word_ids array<int>")
    # About a block a task, however many there are: a task's batch to Python holds all of its blocks.
    n = partitions_for(spark, n_blocks, BLOCKS_EACH)
    lists = coded.repartition(n, "block").groupBy("block").agg(F.collect_list(F.struct("at", "word_ids")).alias("entries"))
    whole = blocks.drop("words", "n_words").repartition(n, "block").join(lists, "block", "left").select("ids", "sizes", "width", "codes", F.coalesce("entries", F.array().cast("array<struct<at:int,word_ids:array<int>>>")).alias("entries")).mapInArrow(_restore, "doc_id bigint, ids array<int>")
    empty = documents.filter(~F.coalesce(some, F.lit(False))).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.array().cast("array<int>").alias("ids"))
    return whole.unionByName(empty)


def pieces(spark: SparkSession, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(id INT, piece BINARY) of a file of ranks."""
    lines = F.split(F.col("value"), " ")
    return spark.read.text(f"file://{vocabulary}").select(lines[1].cast("int").alias("id"), F.unbase64(lines[0]).alias("piece"))


def decode(encoded: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, text) of (doc_id, ids) through a join with the ids' pieces; a list without ids gives an empty text.

    The table of pieces is as large as a vocabulary. doc_id must tell the rows apart.
    """
    tokens = encoded.select("doc_id", F.posexplode("ids").alias("at", "id")).join(F.broadcast(table), "id")
    bytes_ = F.array_sort(F.collect_list(F.struct("at", F.hex("piece").alias("p"))))
    texts = tokens.groupBy("doc_id").agg(F.decode(F.unhex(F.concat_ws("", F.transform(bytes_, lambda x: x["p"]))), "UTF-8").alias("text"))
    return encoded.select("doc_id").join(texts, "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
