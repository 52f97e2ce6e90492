"""Readers of alignment tables: PAF, pair and single mappings, local alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .reads import numbered_lines

_PAF = ("qname string", "qlen long", "qstart long", "qend long", "strand string", "tname long", "tlen long", "tstart long", "tend long", "nmatch long", "alnlen long", "mapq int")


def read_paf(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.csv(paths, sep="\t", schema=", ".join(_PAF)).drop("mapq")


def with_reads(paf: DataFrame, long_reads: DataFrame) -> DataFrame:
    """Alignments with the sequence of their read; long_reads has read_id and seq."""
    return paf.join(long_reads.select(F.col("read_id").cast("string").alias("qname"), F.col("seq").alias("read_seq")), "qname")


def read_blocks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Pair and single mappings: (file, block, score, ref_id, ref_start, aln_len, read_name, qstart, qaln, qstrand, qlen, mate).

    A line that starts with # ends a block; the mate is the last character of the read's name."""
    lines = numbered_lines(spark, paths)
    # Blocks are numbered within a file, whose lines are in order.
    ends = F.sum(F.when(F.col("value").startswith("#"), 1).otherwise(0)).over(Window.partitionBy("file").orderBy("line"))
    rows = lines.select("file", ends.alias("block"), F.split("value", r"\s+").alias("w"), "value").where("NOT startswith(value, '#') AND value <> ''")
    n = lambda i: F.col("w")[i].cast("long")
    return rows.select("file", "block", n(0).alias("score"), n(1).alias("ref_id"), n(2).alias("ref_start"), n(3).alias("aln_len"), F.col("w")[6].alias("read_name"), n(7).alias("qstart"), n(8).alias("qaln"), F.col("w")[9].alias("qstrand"), n(10).alias("qlen"), F.right(F.col("w")[6], F.lit(1)).alias("mate"))


def pair_mappings(blocks: DataFrame, k: int) -> DataFrame:
    """Hits of at least k bases whose score reaches the aligned length, of blocks with both mates and more than two hits
    or two references; a minus strand swaps start and end."""
    minus = F.col("qstrand") == "-"
    kept = blocks.where((F.col("aln_len") >= k) & (F.col("score") >= F.col("aln_len")))
    stop = F.col("ref_start") + F.col("aln_len")
    kept = kept.select("*", F.when(minus, stop).otherwise(F.col("ref_start")).alias("start"), F.when(minus, F.col("ref_start")).otherwise(stop).alias("stop"))
    w = Window.partitionBy("file", "block")
    found = kept.select("*", F.size(F.collect_set("mate").over(w)).alias("_m"), F.count("*").over(w).alias("_n"), F.size(F.collect_set("ref_id").over(w)).alias("_r"))
    return found.where("_m = 2 AND (_n > 2 OR _r > 1)").drop("_m", "_n", "_r")


def single_mappings(blocks: DataFrame, k: int) -> DataFrame:
    return blocks.where((F.col("aln_len") >= k) & (F.col("score") >= F.col("qlen")))


def read_fastmap(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(read_name, read_len, qstart, qend, n_hits, hits) from SQ and EM lines; // ends a record."""
    lines = numbered_lines(spark, paths)
    record = F.sum(F.when(F.col("value").startswith("SQ"), 1).otherwise(0)).over(Window.partitionBy("file").orderBy("line"))
    rows = lines.select("file", record.alias("r"), F.split("value", r"\t").alias("w"))
    head = rows.where("w[0] = 'SQ'").select("file", "r", F.col("w")[1].alias("read_name"), F.col("w")[2].cast("long").alias("read_len"))
    hits = rows.where("w[0] = 'EM'").select("file", "r", F.col("w")[1].cast("long").alias("qstart"), F.col("w")[2].cast("long").alias("qend"), F.col("w")[3].cast("long").alias("n_hits"), F.expr("slice(w, 5, greatest(0, size(w) - 4))").alias("hits"))
    return hits.join(head, ["file", "r"]).drop("file", "r")


def read_local(spark: SparkSession, paths: list[str], k: int) -> DataFrame:
    """Local alignments of at least two thirds of k: ids, ranges, diff = round((qlen + rlen) * (1 - identity) / 2), identity = 1 - diff / len."""
    w = F.split(F.trim("value"), r"\s+")
    n = lambda i: w[i].cast("long")
    rows = spark.read.text(paths).where("trim(value) <> ''").select(
        n(0).alias("ref_id"), n(1).alias("query_id"), n(2).alias("aln_len"), (w[3].cast("double") / 100).alias("idty"),
        n(5).alias("ref_b"), n(6).alias("ref_e"), n(7).alias("ref_len"), (w[8] == "1").alias("minus"), n(9).alias("qry_b"), n(10).alias("qry_e"), n(11).alias("qry_len"),
    )
    rows = rows.where(F.col("aln_len") >= k * 2 // 3)
    diff = F.round((F.col("qry_e") - F.col("qry_b") + F.col("ref_e") - F.col("ref_b")) * (1 - F.col("idty")) / 2).cast("long")
    return rows.withColumn("diff", diff).withColumn("identity", 1 - F.col("diff") / F.col("aln_len")).drop("idty")


def read_alignment_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(read_id, step, id, start, stop): the steps of lines `read<tab>id:start:stop..`, numbered from 0."""
    w = F.split("value", r"\t")
    at = spark.read.text(paths).where("value <> ''").select(w[0].cast("long").alias("read_id"), F.posexplode(F.slice(w, F.lit(2), F.size(w))).alias("step", "x"))
    part = lambda i: F.split("x", ":")[i].cast("long")
    return at.where("x <> ''").select("read_id", "step", part(0).alias("id"), part(1).alias("start"), part(2).alias("stop"))
