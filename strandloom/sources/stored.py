"""Stages' tables in Parquet: solid k-mers, nodes and edges; and how many rows they have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KMERS = "kmer string, n long"
NODES = "node string, n_in long, n_out long, node_id long"
EDGES = "edge_id long, start_nid long, end_nid long, seq string"


def read_kmers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(KMERS).parquet(path)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODES).parquet(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EDGES).parquet(path)


def sizes(**tables: DataFrame) -> DataFrame:
    """(name, n): the rows of each table."""
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in sorted(tables.items())]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
