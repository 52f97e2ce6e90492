"""Incremental k-mer counts over a stream of reads: an addition, kept apart from the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import kmers


def streaming_solid(reads: DataFrame, k: int, least: int = 3) -> DataFrame:
    """Counts of the k-mers of a streaming table (seq in digits), for complete output mode; solid ones only."""
    return kmers(reads.select("seq"), k).groupBy("kmer").agg(F.count("*").alias("n")).where(F.col("n") >= least)
