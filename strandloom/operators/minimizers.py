"""Minimizers and seed matches.

A minimizer is the smallest canonical k-mer of a window, the leftmost on ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bases import kmers


def fixed(seqs: DataFrame, k: int, step: int, windows: int | None = None) -> DataFrame:
    """(..., window, pos, kmer, forward): one minimizer for each run of `step` k-mers; windows limits to the first ones."""
    keep = [c for c in seqs.columns if c != "seq"]
    at = kmers(seqs, k).withColumn("win", F.floor(F.col("pos") / step).cast("int"))
    if windows is not None:
        at = at.where(F.col("win") < windows)
    best = at.groupBy(*keep, "win").agg(F.min(F.struct("kmer", "pos", "forward")).alias("x"))
    return best.select(*keep, "win", "x.pos", "x.kmer", "x.forward")


def sliding(seqs: DataFrame, k: int, width: int, key: str) -> DataFrame:
    """Distinct (key, pos, kmer, forward) over all runs of `width` k-mers of each sequence."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(1 - width, 0)
    at = kmers(seqs.select(key, "seq"), k).select(key, "pos", F.min(F.struct("kmer", "pos", "forward")).over(w).alias("x"))
    return at.where(F.col("pos") >= width - 1).select(key, "x.pos", "x.kmer", "x.forward").distinct()


def match(reads: DataFrame, refs: DataFrame) -> DataFrame:
    """(read_id, ref_id, read_pos, ref_pos, same): pairs of equal minimizers; same when on one strand."""
    r = refs.select("ref_id", F.col("pos").alias("ref_pos"), "kmer", F.col("forward").alias("_rf"))
    q = reads.select("read_id", F.col("pos").alias("read_pos"), "kmer", F.col("forward").alias("_qf"))
    return q.join(r, "kmer").select("read_id", "ref_id", "read_pos", "ref_pos", (F.col("_qf") == F.col("_rf")).alias("same"))


def unique_hits(reads: DataFrame, index: DataFrame) -> DataFrame:
    """Each read's first window whose minimizer occurs exactly once in the index."""
    once = index.groupBy("kmer").agg(F.count("*").alias("_n"), F.first("ref_id").alias("ref_id"), F.first("pos").alias("ref_pos"), F.first("forward").alias("_rf")).where("_n = 1")
    hit = reads.join(once, "kmer")
    first = hit.groupBy("read_id").agg(F.min(F.struct("win", "pos", "ref_id", "ref_pos", (F.col("forward") == F.col("_rf")).alias("same"))).alias("x"))
    return first.select("read_id", "x.win", F.col("x.pos").alias("read_pos"), "x.ref_id", "x.ref_pos", "x.same")


#: Mapping error rate and least mapped bases.
ERROR_RATE, LEAST_BASES, LEAST_MATCHES = 0.15, 60, 3


def chain_statistics(matches: DataFrame, seed: int, least_span: float) -> DataFrame:
    """Matches of each read and reference that keep to one diagonal.

    The majority strand counts (none on a tie). Along the read a match goes on from the
    one before if the distances differ by less than ERROR_RATE of the read's plus 5; then
    its new bases are mapped. Kept with more than LEAST_BASES mapped and a span over
    least_span. Rows: read_id, ref_id, same, n_matches, mapped, start, stop."""
    pair = Window.partitionBy("read_id", "ref_id")
    votes = matches.select("*", F.sum(F.when(F.col("same"), 1).otherwise(-1)).over(pair).alias("vote"), F.count("*").over(pair).alias("n"))
    major = votes.where((F.col("n") >= LEAST_MATCHES) & (F.col("vote") != 0) & (F.col("same") == (F.col("vote") > 0)))
    line = pair.orderBy("read_pos", "ref_pos")
    step = F.col("read_pos") - F.lag("read_pos").over(line)
    ref = (F.col("ref_pos") - F.lag("ref_pos").over(line)) * F.when(F.col("same"), 1).otherwise(-1)
    along = major.select("read_id", "ref_id", "same", "read_pos", step.alias("step"), ref.alias("ref"))
    good = along.where(F.abs(F.col("step") - F.col("ref")) < ERROR_RATE * F.col("step") + 5)
    got = good.groupBy("read_id", "ref_id", "same").agg(
        F.count("*").alias("n_matches"),
        (F.sum(F.least("step", F.lit(seed))) + seed).cast("long").alias("mapped"),
        F.min(F.col("read_pos") - F.col("step")).cast("long").alias("start"),
        (F.max("read_pos") + seed).cast("long").alias("stop"),
    )
    return got.where((F.col("mapped") > LEAST_BASES) & (F.col("stop") - F.col("start") > least_span))
