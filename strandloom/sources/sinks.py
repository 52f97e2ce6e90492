"""Writers: edge files, reads, contigs, graph drawings, gap lists. Tables themselves go to Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import decode


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def edge_lines(edges: DataFrame) -> DataFrame:
    """Four lines an edge as one text; seq in digits, a missing qual is written as one letter a base."""
    has = set(edges.columns)
    path = F.concat(F.lit("\tpath:"), F.coalesce("path", F.lit("")), F.lit("\tlen:"), F.length("seq")) if "path" in has else F.lit("")
    qual = F.col("qual") if "qual" in has else F.repeat(F.lit("I"), F.length("seq"))
    return edges.select(F.concat(F.lit("@"), "edge_id", F.lit("\t"), "start_nid", F.lit("\t"), "end_nid", path, F.lit("\n"), decode(F.col("seq")), F.lit("\n+\n"), qual).alias("value"))


def corrected_lines(reads: DataFrame) -> DataFrame:
    """>id, path and error count; then the bases. reads: read_id, seq (digits), path (ids), errors."""
    head = F.concat(F.lit(">"), "read_id", F.lit("\tpath:"), F.array_join("path", "-"), F.lit("-;errorNum:"), "errors")
    return reads.select(F.concat(head, F.lit("\n"), decode(F.col("seq"))).alias("value"))


def contig_lines(contigs: DataFrame, width: int = 80) -> DataFrame:
    """>number, path and frequency; the bases in lines of `width`. contigs: contig_id, seq, path, freq."""
    head = F.concat(F.lit(">"), "contig_id", F.lit("\tpath: "), F.array_join("path", "-"), F.lit(" Freq: "), "freq")
    lines = F.regexp_replace(decode(F.col("seq")), f"(.{{{width}}})(?=.)", "$1\n")
    return contigs.select(F.concat(head, F.lit("\n"), lines).alias("value"))


def split_edges(edges: DataFrame, length: int) -> DataFrame:
    """(name, seq): edges for an outside mapper; those longer than twice `length` give their two ends, /1 and /2."""
    two = F.array(F.struct(F.concat("edge_id", F.lit("/1")).alias("name"), F.expr(f"left(seq, {length})").alias("seq")), F.struct(F.concat("edge_id", F.lit("/2")).alias("name"), F.right("seq", F.lit(length)).alias("seq")))
    one = F.array(F.struct(F.col("edge_id").cast("string").alias("name"), F.col("seq")))
    return edges.select(F.explode(F.when(F.length("seq") > 2 * length, two).otherwise(one)).alias("x")).select("x.name", decode(F.col("x.seq")).alias("seq"))


def write_text(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def dot_text(edges: DataFrame, most: int = 10_000) -> str:
    """A drawing of a small graph; more than `most` edges are refused."""
    rows = edges.select("edge_id", "start_nid", "end_nid", F.length("seq").alias("len")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges")
    return "\n".join(["digraph G {", *(f'  {r.start_nid} -> {r.end_nid} [label="{r.edge_id} len:{r.len}"];' for r in sorted(rows)), "}"])


def debug_lines(table: DataFrame) -> DataFrame:
    """Each row as name:value pairs, for reading by eye."""
    return table.select(F.concat_ws("\t", *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in table.columns)).alias("value"))


def gap_lines(gaps: DataFrame) -> DataFrame:
    return gaps.select((F.col("stop") - F.col("begin")).cast("string").alias("value"))


def alignment_lines(alignments: DataFrame) -> DataFrame:
    """read id, then a:b:c of its steps. alignments: read_id, steps (array of id, start, stop)."""
    return alignments.select(F.concat("read_id", F.lit("\t"), F.array_join(F.transform("steps", lambda s: F.concat_ws(":", *(s[i].cast("string") for i in ("id", "start", "stop")))), "\t")).alias("value"))
