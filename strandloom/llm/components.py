"""Connected components of a graph of any size, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable
from .shingles import roots


#: Edges that a task contracts at once.
HELD = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges, HELD at a time, become one edge from each node to the smallest of its component there."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in "uv")
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        low = roots(len(nodes), at[: len(u)], at[len(u) :])
        far = low != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[low[far]])], ["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= HELD:
            yield stars(held)
            held, n = [], 0
    if n:
        yield stars(held)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (u, v) of longs, component the smallest node that can be reached; nodes without edges are not listed.

    A round links every node to the smallest node around it, first among its larger and
    then among its smaller neighbours; it ends when the edges are stars. Each task's edges
    are contracted before a round, which only shortens paths."""
    e = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        # Tasks of about HELD edges each: few edges are done in one task and one round.
        less = e.coalesce(max(1, e.count() // HELD)).mapInArrow(_contract, "u long, v long").distinct()
        both = durable(less.union(less.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = durable(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        stars = durable(small.select("x.*").where("u <> v").distinct())
        discard(e, both, large)
        e = stars
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
        before = now
