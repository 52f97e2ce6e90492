"""Aggregation of edge paths. paths has path_id and ids (array of edge ids, 2 and up)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bases import path_key


def multiset(paths: DataFrame) -> DataFrame:
    """(ids, freq): equal and reversed paths counted together."""
    freq = F.col("freq") if "freq" in paths.columns else F.lit(1)
    return paths.select(path_key(F.col("ids")).alias("ids"), freq.alias("f")).groupBy("ids").agg(F.sum("f").alias("freq"))


def inverted_index(paths: DataFrame) -> DataFrame:
    """(edge_id, path_id) of each edge of each path."""
    return paths.select(F.explode(F.array_distinct("ids")).alias("edge_id"), "path_id")


def columns(paths: DataFrame, anchor: int) -> DataFrame:
    """(path_id, col, edge_id): the paths through an anchor edge on one axis, the anchor's first place at 0."""
    at = paths.where(F.array_contains("ids", anchor)).select("path_id", F.array_position("ids", anchor).alias("a"), F.posexplode("ids").alias("p", "edge_id"))
    return at.select("path_id", (F.col("p") + 1 - F.col("a")).cast("long").alias("col"), "edge_id")


def column_frequency(cols: DataFrame) -> DataFrame:
    """(col, edge_id, freq)."""
    return cols.groupBy("col", "edge_id").agg(F.count("*").alias("freq"))


def dominant(freq: DataFrame, least: int) -> DataFrame:
    """(col, edge_id, top, second, state) of each column's most frequent edge: kept when it reaches `least` and no other
    edge exceeds `least` or half of it; conflict when it reaches `least` all the same; else stop."""
    line = Window.partitionBy("col").orderBy(F.desc("freq"), "edge_id")
    ranked = freq.select("*", F.row_number().over(line).alias("k"), F.coalesce(F.lead("freq").over(line), F.lit(0)).alias("second"))
    kept = (F.col("freq") >= least) & ((F.col("second") == 0) | ((F.col("second") <= least) & (F.col("freq") >= 2 * F.col("second"))))
    state = F.when(kept, "kept").when(F.col("freq") >= least, "conflict").otherwise("stop")
    return ranked.where("k = 1").select("col", "edge_id", F.col("freq").alias("top"), "second", state.alias("state"))


def greedy_consensus(freq: DataFrame, least: int) -> DataFrame:
    """(col, edge_id, top): from column 0 on while columns are kept; nothing at all if a conflict ends it."""
    d = dominant(freq.where("col >= 0"), least)
    # One row: where the first column that isn't kept, or is missing, lies.
    ordered = Window.orderBy("col")
    edge = d.select("col", "state", (F.row_number().over(ordered) - 1).alias("i")).where("state <> 'kept' OR col <> i")
    first = edge.agg(F.min(F.struct("col", "i", "state")).alias("x")).select("x.*")
    joined = d.crossJoin(F.broadcast(first.select(F.col("col").alias("x_col"), F.col("i").alias("x_i"), F.col("state").alias("x_state"))))
    bad = F.coalesce((F.col("x_state") == "conflict") & (F.col("x_col") == F.col("x_i")), F.lit(False))
    return joined.where((F.col("state") == "kept") & (F.col("x_col").isNull() | (F.col("col") < F.col("x_i"))) & ~bad).select("col", "edge_id", "top")


def edge_coverage(paths: DataFrame) -> DataFrame:
    """(edge_id, coverage): each path adds 1 at its ends and 2 between, halved."""
    at = paths.select(F.posexplode("ids").alias("p", "edge_id"), F.size("ids").alias("n"))
    weight = F.when((F.col("p") == 0) | (F.col("p") == F.col("n") - 1), 1).otherwise(2)
    return at.groupBy("edge_id").agg((F.sum(weight) / 2).alias("coverage"))


def statistics(paths: DataFrame, most: int = 256) -> DataFrame:
    """(edge_id, freq): occurrences over all paths, up to `most`."""
    return paths.select(F.explode("ids").alias("edge_id")).groupBy("edge_id").agg(F.least(F.count("*"), F.lit(most)).alias("freq"))


def pair_paths(hits: DataFrame) -> DataFrame:
    """(pair_id, ids): each hit of one mate, then the other mate's hits from the last to the first, both ways round.

    hits has pair_id, mate (1 or 2), start, edge_id; a repeated join edge is dropped."""
    lists = hits.groupBy("pair_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("mate") == m, F.struct("start", "edge_id")))).alias(f"m{m}") for m in (1, 2)))
    ids = lists.select("pair_id", *(F.transform(f"m{m}", lambda x: x["edge_id"]).alias(f"m{m}") for m in (1, 2)))
    tail = lambda e, other: F.when(F.element_at(F.reverse(other), 1) == e, F.slice(F.reverse(other), 2, F.size(other))).otherwise(F.reverse(other))
    way = lambda a, b: F.transform(a, lambda e: F.concat(F.array(e), tail(e, F.col(b))))
    both = ids.where((F.size("m1") > 0) & (F.size("m2") > 0)).select("pair_id", F.explode(F.concat(way("m1", "m2"), way("m2", "m1"))).alias("ids"))
    return both


def without_repeats(paths: DataFrame) -> DataFrame:
    return paths.where(F.size(F.array_distinct("ids")) == F.size("ids"))


def chained(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """(pair_id, mate, connected): whether a mate's hits, in the order of start, then edge, go along joined edges.

    hits has pair_id, mate, start, edge_id. The first two must share a node; from it each further edge leads to its other end."""
    ends = hits.join(edges.select("edge_id", "start_nid", "end_nid"), "edge_id")
    x = F.sort_array(F.collect_list(F.struct("start", "edge_id", F.col("start_nid").alias("s"), F.col("end_nid").alias("e"))))
    lists = ends.groupBy("pair_id", "mate").agg(x.alias("x"))
    a, b = F.col("x")[0], F.col("x")[1]
    joint = F.when((a["s"] == b["s"]) | (a["e"] == b["s"]), b["s"]).when((a["s"] == b["e"]) | (a["e"] == b["e"]), b["e"])
    step = lambda n, y: F.when(y["s"] == n, y["e"]).when(y["e"] == n, y["s"])
    last = F.aggregate(F.slice("x", F.lit(3), F.greatest(F.lit(0), F.size("x") - 2)), F.col("n"), step)
    return lists.withColumn("n", F.when(F.size("x") > 1, joint)).select("pair_id", "mate", ((F.size("x") < 2) | last.isNotNull()).alias("connected"))


def collected(paths: DataFrame) -> DataFrame:
    """(path_id, ids) of paths that are longer than 3 without the zero at either end, reversed."""
    ids = F.col("ids")
    head = F.when(ids[0] == 0, F.slice("ids", F.lit(2), F.size("ids"))).otherwise(ids)
    tail = F.when(F.element_at("t", -1) == 0, F.slice("t", F.lit(1), F.size("t") - 1)).otherwise(F.col("t"))
    cut = paths.where(F.size("ids") > 3).select("path_id", head.alias("t")).select("path_id", tail.alias("ids"))
    return cut.where(F.size("ids") > 3).select("path_id", F.reverse("ids").alias("ids"))


def path_bases(paths: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(path_id, bases) of each path's sequence, whose edges (edge_id, len) overlap in k - 1 bases."""
    at = paths.select("path_id", F.explode("ids").alias("edge_id")).join(edges.select("edge_id", "len"), "edge_id")
    return at.groupBy("path_id").agg((F.sum(F.col("len") - (k - 1)) + (k - 1)).cast("long").alias("bases"))


def totals(bases: DataFrame) -> DataFrame:
    """(n_paths, bases, mean) over all paths; the mean without its fraction, null without paths."""
    out = bases.agg(F.count("*").alias("n_paths"), F.coalesce(F.sum("bases"), F.lit(0)).alias("bases"))
    return out.select("n_paths", "bases", F.expr("bases div nullif(n_paths, 0)").alias("mean"))
