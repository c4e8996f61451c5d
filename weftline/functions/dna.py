"""Letters, words and packed positions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The alphabet in its order behind the end-marker, and the complements; other letters stand for themselves.
ALPHABET = "ACGNT"
PAIRS = ("ACGTacgt", "TGCAtgca")
#: Bits of a packed run, from the lowest: offset, strand, length, node.
OFFSET_BITS, LENGTH_BITS = 10, 9
LONGEST_RUN = (1 << LENGTH_BITS) - 1


def complement(seq: Column) -> Column:
    return F.translate(seq, *PAIRS)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def kmer_key(kmer: Column) -> Column:
    """Two bits a letter, A 0 to T 3, first letter highest; null if another letter is in it. For up to 31 letters."""
    digits = F.translate(F.upper(kmer), "ACGT", "0123")
    return F.when(F.upper(kmer).rlike("^[ACGT]{1,31}$"), F.conv(digits, 4, 10).cast("bigint"))


def kmer_text(key: Column, k: int) -> Column:
    """The letters of a key of k letters."""
    letters = F.array(*(F.lit(c) for c in "ACGT"))
    at = F.transform(F.sequence(F.lit(k - 1), F.lit(0)), lambda j: F.get(letters, F.call_function("shiftright", key, 2 * j).bitwiseAND(3).cast("int")))
    return F.array_join(at, "")


def pack_sa(seq_id: Column, seq_off: Column, max_length: Column | int) -> Column:
    """Position in a text as one number; max_length is the longest text with its end-marker."""
    return seq_id * max_length + seq_off


def unpack_sa(packed: Column, max_length: Column | int) -> Column:
    m = max_length if isinstance(max_length, Column) else F.lit(max_length)
    return F.struct(F.floor(packed / m).cast("bigint").alias("seq_id"), (packed % m).alias("seq_off"))


def encode_run(node_id: Column, is_reverse: Column, offset: Column, length: Column) -> Column:
    """A run of at most 511 rows as one number; null where a part is out of range."""
    fits = (offset >= 0) & (offset < (1 << OFFSET_BITS)) & (length >= 1) & (length <= LONGEST_RUN) & (node_id >= 0) & (node_id < (1 << (64 - OFFSET_BITS - 1 - LENGTH_BITS)))
    word = F.shiftleft(node_id.cast("bigint"), OFFSET_BITS + 1 + LENGTH_BITS).bitwiseOR(F.shiftleft(length.cast("bigint"), OFFSET_BITS + 1)).bitwiseOR(F.shiftleft(is_reverse.cast("bigint"), OFFSET_BITS)).bitwiseOR(offset.cast("bigint"))
    return F.when(fits, word)


def decode_run(word: Column) -> Column:
    return F.struct(
        F.shiftrightunsigned(word, OFFSET_BITS + 1 + LENGTH_BITS).alias("node_id"), F.shiftrightunsigned(word, OFFSET_BITS).bitwiseAND(1).cast("int").alias("is_reverse"),
        word.bitwiseAND((1 << OFFSET_BITS) - 1).cast("int").alias("node_offset"), F.shiftrightunsigned(word, OFFSET_BITS + 1).bitwiseAND(LONGEST_RUN).cast("bigint").alias("length"),
    )


def position(graph_position: Column) -> Column:
    """node_id, is_reverse and node_offset of a packed graph position; nulls for a gap."""
    p = F.when(graph_position != 0, graph_position)
    return F.struct(F.shiftright(p, OFFSET_BITS + 1).alias("node_id"), F.shiftright(p, OFFSET_BITS).bitwiseAND(1).cast("int").alias("is_reverse"), p.bitwiseAND((1 << OFFSET_BITS) - 1).cast("int").alias("node_offset"))


def pack_position(node_id: Column, is_reverse: Column, offset: Column) -> Column:
    return node_id * (2 << OFFSET_BITS) + is_reverse * (1 << OFFSET_BITS) + offset


def format_number(n: Column) -> Column:
    """1234 as 1.2K, and so on with M and B, cut off after one digit; smaller numbers as they are."""

    def cut(unit: int, letter: str) -> Column:
        tenths = F.floor(n / F.lit(unit // 10)).cast("bigint")
        return F.concat(F.floor(tenths / 10).cast("bigint").cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(letter))

    return F.when(n >= 10**9, cut(10**9, "B")).when(n >= 10**6, cut(10**6, "M")).when(n >= 1000, cut(1000, "K")).otherwise(n.cast("string"))
