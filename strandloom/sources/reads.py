"""FASTA and FASTQ readers: records of exactly two or four lines, the first word of the header a numeric id.

Lines are numbered by file and block without leaving the executors: a row's number is
its rank in its block plus the lines of the blocks before it, which are a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .config import read_format


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, line, value), line from 0 in each file."""
    raw = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    blocks = raw.groupBy("file", "block").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return raw.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("i") - F.col("first")).alias("line"), "value")


def read_records(spark: SparkSession, paths: list[str], form: str | None = None) -> DataFrame:
    """(file, ordinal, read_id, seq, qual, annotation); seq is cut before its first N, qual is null in FASTA."""
    form = form or read_format(paths[0])
    size = 2 if form == "fa" else 4
    parts = numbered_lines(spark, paths).groupBy("file", F.floor(F.col("line") / size).alias("ordinal")).agg(*(F.max(F.when(F.col("line") % size == k, F.col("value"))).alias(f"l{k}") for k in range(size)))
    head = F.regexp_replace("l0", "^[>@]", "")
    return parts.select(
        "file", "ordinal",
        F.regexp_extract(head, r"^\S+", 0).cast("long").alias("read_id"),
        F.substring_index("l1", "N", 1).alias("seq"),
        (F.col("l3") if size == 4 else F.lit(None).cast("string")).alias("qual"),
        F.regexp_extract(head, r"^\S+\s+(.*)$", 1).alias("annotation"),
    )


def scan_reads(spark: SparkSession, paths: list[str], k: int, extra: int = 10) -> DataFrame:
    """Records of at least k + extra bases."""
    return read_records(spark, paths).where(F.length("seq") >= k + extra)


def scan_pairs(spark: SparkSession, first: list[str], second: list[str], k: int) -> DataFrame:
    """(read_id, seq1, seq2) of mates, each at least k + 20 bases; ids must agree in file order."""
    a, b = (read_records(spark, p).select(F.col("ordinal"), F.col("read_id").alias(f"id{n}"), F.col("seq").alias(f"seq{n}"), F.col("file").alias(f"f{n}")) for n, p in ((1, first), (2, second)))
    joined = a.join(b, (F.col("id1") == F.col("id2")) & (a["ordinal"] == b["ordinal"]))
    return joined.where((F.length("seq1") >= k + 20) & (F.length("seq2") >= k + 20)).select(F.col("id1").alias("read_id"), "seq1", "seq2")


def unmatched_pairs(spark: SparkSession, first: list[str], second: list[str]) -> DataFrame:
    """Records without a mate of the same id at the same place; should be empty."""
    a, b = (read_records(spark, p).select("ordinal", "read_id") for p in (first, second))
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def read_edges(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Edge files: four-line records `@id<tab>start<tab>end[<tab>path:..<tab>len:..]`; seq in letters."""
    parts = numbered_lines(spark, paths).groupBy("file", F.floor(F.col("line") / 4).alias("g")).agg(*(F.max(F.when(F.col("line") % 4 == k, F.col("value"))).alias(f"l{k}") for k in (0, 1, 3)))
    words = F.split(F.regexp_replace("l0", "^@", ""), r"\s+")
    number = lambda i: words[i].cast("long")
    return parts.select(number(0).alias("edge_id"), number(1).alias("start_nid"), number(2).alias("end_nid"), F.col("l1").alias("seq"), F.col("l3").alias("qual"), F.regexp_extract("l0", r"path:(\S*)", 1).alias("path"))
