"""Base codes, reverse complements and k-mers as column expressions.

Bases are digits: C 0, A 1, T 2, G 3 (fixed values); the complement of d is 3 - d, so
sequences order as C < A < T < G. A sequence is a string of digits; k-mers are cut
from its bytes, which takes a step for each base of the k-mer and not of the sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS, DIGITS = "CATG", "0123"


def encode(seq: Column) -> Column:
    """Letters to digits; the sequence should hold no other letters."""
    return F.translate(seq, LETTERS, DIGITS)


def decode(digits: Column) -> Column:
    return F.translate(digits, DIGITS, LETTERS)


def cut_at_unknown(seq: Column) -> Column:
    """The part of a read before its first N."""
    return F.substring_index(seq, "N", 1)


def complement(digits: Column) -> Column:
    return F.translate(digits, "0123", "3210")


def reverse_complement(digits: Column) -> Column:
    return F.reverse(complement(digits))


def canonical(digits: Column) -> Column:
    """The smaller of a sequence and its reverse complement."""
    return F.least(digits, reverse_complement(digits))


def is_forward(digits: Column) -> Column:
    return digits <= reverse_complement(digits)


def piece(digits: Column, start: Column | int, length: int) -> Column:
    """length bases from the 0-based start."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.substring(digits.cast("binary"), start + 1, F.lit(length)).cast("string")


def drop_first(digits: Column) -> Column:
    return F.substring(digits, F.lit(2), F.length(digits))


def drop_last(digits: Column) -> Column:
    return F.substring(digits, F.lit(1), F.length(digits) - 1)


def next_kmer(kmer: Column, base: Column) -> Column:
    return F.concat(drop_first(kmer), base)


def previous_kmer(kmer: Column, base: Column) -> Column:
    return F.concat(base, drop_last(kmer))


def kmers(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Replaces seq by pos (0-based), kmer (canonical) and forward, a row for each k-mer of each sequence.

    The reverse complement is made once a sequence; both strands are then cut in place."""
    keep = [c for c in reads.columns if c != seq]
    both = reads.where(F.length(seq) >= k).select(*keep, F.col(seq).cast("binary").alias("_s"), reverse_complement(F.col(seq)).cast("binary").alias("_r"))
    at = both.select("*", F.explode(F.sequence(F.lit(0), F.octet_length("_s") - k)).alias("pos"))
    cut = lambda c, start: F.substring(F.col(c), start + 1, F.lit(k)).cast("string")
    at = at.select(*keep, "pos", cut("_s", F.col("pos")).alias("_f"), cut("_r", F.octet_length("_s") - k - F.col("pos")).alias("_b"))
    return at.select(*keep, "pos", F.least("_f", "_b").alias("kmer"), (F.col("_f") <= F.col("_b")).alias("forward"))


def join_unitigs(first: Column, second: Column, k: int) -> Column:
    """Two sequences that overlap in k - 1 bases."""
    return F.concat(first, F.substring(second, F.lit(k), F.length(second)))


def overlaps(first: Column, second: Column, k: int) -> Column:
    return F.right(first, F.lit(k - 1)) == F.left(second, F.lit(k - 1))


def add_qualities(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


# Paths are arrays of edge ids.


def path_key(ids: Column) -> Column:
    """The same for a path and its reverse."""
    return F.least(ids, F.reverse(ids))


def has_cycle(ids: Column) -> Column:
    return F.size(F.array_distinct(ids)) < F.size(ids)


def contains_path(ids: Column, part: Column) -> Column:
    """Whether part occurs in ids, read either way."""
    text = lambda a: F.concat(F.lit(","), F.array_join(a, ","), F.lit(","))
    return F.contains(text(ids), text(part)) | F.contains(text(ids), text(F.reverse(part)))


def common(ids: Column, other: Column) -> Column:
    return F.array_intersect(ids, other)


def union(ids: Column, other: Column) -> Column:
    """The ids of both, each once, in the order of their first places."""
    return F.array_union(ids, other)


def holds_all(ids: Column, part: Column) -> Column:
    return F.size(F.array_except(part, ids)) == 0


def place_of(ids: Column, part: Column) -> Column:
    """The 1-based place where part first occurs in ids as it stands, 0 if nowhere."""
    last = F.size(ids) - F.size(part) + 1
    places = F.when(last > 0, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.get(F.filter(places, lambda i: F.slice(ids, i, F.size(part)) == part), F.lit(0)), F.lit(0))
