"""Canonical k-mer counting: exact counts. K-mers are shuffled as stretches that share a minimizer, about a byte each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import kmers
from . import codes

#: A k-mer is solid from this count on; counts are shown up to it.
SOLID = 3
#: Stretches are dealt into so many parts, 2 to this power, and a part is counted at once.
PART_BITS = 12
#: Stretches that a task holds before it sends or counts them, bases of sequences that are cut at once, and rows of a batch.
HELD, BASES, ROWS = 3_000_000, 1 << 20, 100_000


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.Array]:
    """The sequences of a batch, about BASES bases at a time, at least one."""
    seqs = batch.column("seq")
    ends = np.cumsum([len(x) if x is not None else 0 for x in seqs.cast(pa.large_binary()).to_pylist()])
    start = 0
    while start < len(seqs):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BASES, side="right")))
        yield seqs.slice(start, stop - start)
        start = stop


def _dealt(k: int):
    """Rows (part, stretches, counts): each a part's distinct stretches among those that the task held; no counts where all are 1."""

    def send(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        x, h = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(x)
        x, part = x[order], (h[order] >> np.uint64(64 - PART_BITS)).astype(np.uint16)
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        n = np.diff(np.append(first, len(x))).astype(np.uint32)
        x, part = x[first], part[first] * np.uint16(2) + (n > 1)
        order = np.argsort(part, kind="stable")
        x, n, part = x[order], n[order], part[order]
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        blobs = [x[a:b].tobytes() for a, b in zip(at, [*at[1:], len(x)], strict=True)]
        counts = [n[a:b].tobytes() if part[a] & 1 else None for a, b in zip(at, [*at[1:], len(x)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array((part[at] >> 1).astype(np.int32)), pa.array(blobs, pa.binary()), pa.array(counts, pa.binary())], ["part", "stretches", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for seqs in _sliced(batch):
                held.append(codes.stretches(seqs, k))
                size += len(held[-1][0])
                if size >= HELD:
                    yield send(held)
                    held, size = [], 0
        if size:
            yield send(held)

    return run


def _added(k: int, least: int):
    """Rows (kmer, n) of the k-mers that occur at least `least` times. Rows come by part; a part is folded whenever much of it is held."""

    def fold(done: list[np.ndarray], held: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        x, n = (np.concatenate(c) for c in zip(*held, strict=True))
        mers, of = codes.kmers_of(x, k)
        return list(codes.counted(np.concatenate([done[0], mers]), np.concatenate([done[1], n[of]])))

    def shown(done: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keep = done[1] >= least
        x, n = done[0][keep], done[1][keep]
        for a in range(0, len(x), ROWS):
            yield pa.RecordBatch.from_arrays([codes.text_of(x[a : a + ROWS], k), pa.array(n[a : a + ROWS])], ["kmer", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        part, done, held, size = None, none, [], 0
        for batch in batches:
            for now, blob, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "stretches", "counts")), strict=True):
                if held and (now != part or size >= HELD):
                    done, held, size = fold(done, held), [], 0
                if now != part:
                    yield from shown(done)
                    part, done = now, none
                x = np.frombuffer(blob, np.uint64)
                held.append((x, np.ones(len(x), np.int64) if counts is None else np.frombuffer(counts, np.uint32).astype(np.int64)))
                size += len(x)
        if held:
            yield from shown(fold(done, held))

    return run


def count_kmers(reads: DataFrame, k: int, least: int = 1) -> DataFrame:
    """(kmer, n) over the sequences of reads (seq, in digits), of the k-mers that occur at least `least` times. K-mers that are
    no numbers (over 32 bases) are counted as text."""
    if k > codes.LONGEST:
        return solid(kmers(reads.select("seq"), k).groupBy("kmer").agg(F.count("*").alias("n")), least)
    dealt = reads.select("seq").mapInArrow(_dealt(k), "part int, stretches binary, counts binary")
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(_added(k, least), "kmer string, n long")


def solid(counts: DataFrame, least: int = SOLID) -> DataFrame:
    return counts.where(F.col("n") >= least)


def histogram(counts: DataFrame, most: int = SOLID) -> DataFrame:
    """(n, kmers): how many k-mers have each count, counts from `most` on together."""
    return counts.groupBy(F.least("n", F.lit(most)).alias("n")).agg(F.count("*").alias("kmers"))


def long_enough(reads: DataFrame, k: int, extra: int = 10) -> DataFrame:
    """Reads of at least k + extra bases."""
    return reads.where(F.length("seq") >= k + extra)
