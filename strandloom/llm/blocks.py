"""Pairs dealt into blocks, so that what is compared is sent once for many pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: About so many members meet in one block.
TOGETHER = 512


def blocked(pairs: DataFrame) -> DataFrame:
    """(block, m, hub) of distinct pairs (hub, m, weight), stored.

    A member follows the lowest of the hubs that it has most in common with, by powers of four of the weight, and all of its
    pairs go to that hub's block; so members of one group meet with all their pairs there. A hub with many followers has
    several blocks."""
    near = F.floor(F.log2("weight") / 2)
    leader = pairs.groupBy("m").agg(F.min(F.struct((-near).alias("far"), "hub")).alias("x")).select("m", F.col("x.hub").alias("of"))
    shares = leader.groupBy("of").agg((1 + F.floor(F.count("*") / TOGETHER)).cast("int").alias("shares"))
    block = F.struct("of", F.pmod(F.xxhash64("m"), "shares").cast("int").alias("salt"))
    return durable(pairs.join(leader.join(shares, "of"), "m").select(block.alias("block"), "m", "hub"))


def sent(cut: DataFrame, held: DataFrame, column: str) -> DataFrame:
    """(block, m, hub, column) in blocks: the members of each first, with their column of held (m, column) and no hub, then the pairs."""
    members = cut.select("block", F.explode(F.array("m", "hub")).alias("m")).distinct().join(held.select("m", column), "m")
    first = members.select("block", "m", F.lit(None).cast("long").alias("hub"), column)
    both = first.unionByName(cut.withColumn(column, F.lit(None).cast(held.schema[column].dataType)))
    return both.repartition("block").sortWithinPartitions("block", F.asc_nulls_first("hub"))
