"""Edges between nodes: neighbours, classes, bubbles, checks and neighbourhoods.

edges has edge_id, start_nid, end_nid; ends has a row for each end of an edge:
(node_id, side, edge_id, end_of), side the node's in or out slot, end_of start or end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import reverse_complement
from ..plans.tables import durable


def edge_ends(edges: DataFrame) -> DataFrame:
    """Ends of directed edges: an edge leaves its start node and enters its end node; node 0 is none."""
    both = F.array(F.struct(F.col("start_nid").alias("node_id"), F.lit("out").alias("side"), F.lit("start").alias("end_of")), F.struct(F.col("end_nid").alias("node_id"), F.lit("in").alias("side"), F.lit("end").alias("end_of")))
    return edges.select("edge_id", F.explode(both).alias("x")).select("x.node_id", "x.side", "edge_id", "x.end_of").where("node_id > 0")


def node_sides(ends: DataFrame) -> DataFrame:
    """(node_id, side, ids): the edges on each side of each node."""
    return ends.groupBy("node_id", "side").agg(F.sort_array(F.collect_set("edge_id")).alias("ids"))


def classify(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """(edge_id, class): self_cycle, two_cycle, unique, semi_unique or repeat, from the edges beyond either end."""
    sides = node_sides(ends).withColumn("side", F.when(F.col("side") == "in", "out").otherwise("in"))
    beyond = ends.join(sides, ["node_id", "side"], "left").groupBy("edge_id").agg(*(F.max(F.when(F.col("end_of") == at, F.col("ids"))).alias(at) for at in ("start", "end")))
    none = F.expr("CAST(array() AS array<bigint>)")
    e = edges.join(beyond, "edge_id", "left").select("edge_id", (F.col("start_nid") == F.col("end_nid")).alias("self"), F.coalesce("start", none).alias("a"), F.coalesce("end", none).alias("b"))
    na, nb = F.size("a"), F.size("b")
    two = ((na == 1) & (nb == 1) & (F.col("a") == F.col("b"))) | ((na > 1) & (nb > 1) & F.arrays_overlap("a", "b"))
    kind = F.when(F.col("self"), "self_cycle").when(two, "two_cycle").when((na <= 1) & (nb <= 1), "unique").when(((na == 1) & (nb > 1)) | ((na > 1) & (nb == 1)), "semi_unique").otherwise("repeat")
    return e.select("edge_id", kind.alias("class"))


def direction_unique(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """(edge_id, start_unique, end_unique, is_unique): whether the other side of each end's node has exactly one edge."""
    counts = ends.groupBy("node_id", "side").agg(F.countDistinct("edge_id").alias("n")).withColumn("side", F.when(F.col("side") == "in", "out").otherwise("in"))
    flags = ends.join(counts, ["node_id", "side"], "left").groupBy("edge_id").agg(*(F.max(F.when(F.col("end_of") == at, F.coalesce("n", F.lit(0)) == 1)).alias(at) for at in ("start", "end")))
    out = edges.join(flags, "edge_id", "left").select("edge_id", *(F.coalesce(at, F.lit(False)).alias(f"{at}_unique") for at in ("start", "end")))
    return out.withColumn("is_unique", F.col("start_unique") & F.col("end_unique"))


def bubbles(edges: DataFrame) -> DataFrame:
    """(edge_id, n_parallel): edges that share both end nodes, in either direction, with another one."""
    e = edges.where("start_nid >= 2 AND end_nid >= 2 AND start_nid <> end_nid")
    e = e.withColumn("a", F.least("start_nid", "end_nid")).withColumn("b", F.greatest("start_nid", "end_nid"))
    n = e.groupBy("a", "b").agg(F.count("*").alias("n"))
    return e.join(n.where("n > 1"), ["a", "b"]).select("edge_id", (F.col("n") - 1).alias("n_parallel"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of edges whose node is missing; empty for a sound graph."""
    return edge_ends(edges).join(nodes.select("node_id"), "node_id", "left_anti")


def neighbourhood(edges: DataFrame, start: DataFrame, budget: int, length: str = "len") -> DataFrame:
    """(source, node_id, used): nodes within a length budget of each source, with the least length used.

    edges are (start_nid, end_nid, length), walked in their direction; start has source.
    Each round goes one edge on from the nodes that it improved, so it ends once all
    paths have used up the budget or found nothing shorter."""
    found = durable(start.select("source", F.col("source").alias("node_id"), F.lit(0).cast("long").alias("used")).distinct())
    front = found
    while True:
        step = front.join(edges, F.col("node_id") == F.col("start_nid")).select("source", F.col("end_nid").alias("node_id"), (F.col("used") + F.col(length)).cast("long").alias("used"))
        step = step.where(F.col("used") <= budget).groupBy("source", "node_id").agg(F.min("used").alias("used"))
        both = found.withColumnRenamed("used", "old").join(step, ["source", "node_id"], "full")
        both = durable(both.select("source", "node_id", F.least("old", "used").alias("used"), (F.col("used") < F.coalesce("old", F.lit(budget + 1))).alias("better")))
        front = both.where("better").drop("better")
        found = both.drop("better")
        if not front.head(1):
            return found


def shared_node(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds node_id to pairs (a, b) of edges: a's start if b has it at either end, else a's end, else 0."""
    of = lambda n: edges.select(F.col("edge_id").alias(n), F.col("start_nid").alias(f"{n}_s"), F.col("end_nid").alias(f"{n}_e"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    at = lambda c: (F.col(c) > 0) & ((F.col(c) == F.col("b_s")) | (F.col(c) == F.col("b_e")))
    node = F.when(at("a_s"), F.col("a_s")).when(at("a_e"), F.col("a_e")).otherwise(F.lit(0))
    return both.select("a", "b", node.cast("long").alias("node_id"))


def other_side(ends: DataFrame) -> DataFrame:
    """(edge_id, end_of, next_id): the edges on the other side of the node at each end of an edge."""
    near = ends.select("node_id", F.when(F.col("side") == "in", "out").otherwise("in").alias("side"), F.col("edge_id").alias("next_id"))
    return ends.join(near, ["node_id", "side"]).select("edge_id", "end_of", "next_id").distinct()


def turn_self_cycles(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """edges (edge_id, start_nid, end_nid, seq), those from a node to itself read so that they begin with the node's sequence.

    nodes has node_id and node, the canonical (k-1)-mer."""
    at = edges.join(nodes.select(F.col("node_id").alias("start_nid"), "node"), "start_nid", "left")
    off = (F.col("start_nid") == F.col("end_nid")) & (F.left("seq", F.lit(k - 1)) != F.col("node"))
    return at.select("edge_id", "start_nid", "end_nid", F.when(F.coalesce(off, F.lit(False)), reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))


def edge_totals(edges: DataFrame) -> DataFrame:
    """(n_edges, bases, shortest, longest) of edges with seq."""
    n = F.length("seq").cast("long")
    return edges.agg(F.count("*").alias("n_edges"), F.sum(n).alias("bases"), F.min(n).alias("shortest"), F.max(n).alias("longest"))
