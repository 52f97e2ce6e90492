"""Interval operators: gaps, depth, containment, nearest. Intervals are half-open [begin, stop) under a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gaps(intervals: DataFrame) -> DataFrame:
    """(key, gap_begin, gap_stop): stretches between a key's first begin and last stop that no interval covers."""
    before = Window.partitionBy("key").orderBy("begin", "stop").rowsBetween(Window.unboundedPreceding, -1)
    out = intervals.select("key", F.max("stop").over(before).alias("gap_begin"), F.col("begin").alias("gap_stop"))
    return out.where("gap_begin < gap_stop")


def depth(intervals: DataFrame) -> DataFrame:
    """(key, begin, stop, depth): stretches of equal depth from a running sum of begins and stops."""
    events = intervals.select("key", F.explode(F.array(F.struct(F.col("begin").alias("at"), F.lit(1).alias("d")), F.struct(F.col("stop").alias("at"), F.lit(-1).alias("d")))).alias("x"))
    steps = events.groupBy("key", "x.at").agg(F.sum("x.d").alias("d")).where("d <> 0")
    line = Window.partitionBy("key").orderBy("at")
    out = steps.select("key", F.col("at").alias("begin"), F.lead("at").over(line).alias("stop"), F.sum("d").over(line).cast("long").alias("depth"))
    return out.where("stop IS NOT NULL AND depth > 0")


def thin_runs(intervals: DataFrame, low: int = 2, longest: int = 1000) -> DataFrame:
    """(key, begin, stop): runs of depth under `low`, shorter than `longest`, within a key's covered range (gaps and islands)."""
    d = depth(intervals).where(F.col("depth") < low).select("key", "begin", "stop").unionByName(gaps(intervals).toDF("key", "begin", "stop"))
    line = Window.partitionBy("key").orderBy("begin")
    new = (F.coalesce(F.lag("stop").over(line), F.lit(None)) != F.col("begin")) | F.lag("stop").over(line).isNull()
    islands = d.withColumn("_new", new.cast("int")).withColumn("_i", F.sum("_new").over(line))
    runs = islands.groupBy("key", "_i").agg(F.min("begin").alias("begin"), F.max("stop").alias("stop"))
    return runs.where(F.col("stop") - F.col("begin") < longest).select("key", "begin", "stop")


def contained(intervals: DataFrame) -> DataFrame:
    """Distinct (key, begin, stop) that lie in another, longer interval of their key.

    In the order of begin, longest first, that is when an earlier one reaches as far."""
    before = Window.partitionBy("key").orderBy("begin", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    d = intervals.select("key", "begin", "stop").distinct()
    return d.withColumn("_reach", F.max("stop").over(before)).where(F.col("_reach") >= F.col("stop")).drop("_reach")


def nearest(intervals: DataFrame) -> DataFrame:
    """(key, begin, distance): for each distinct begin, the distance to the nearest other begin of its key."""
    line = Window.partitionBy("key").orderBy("begin")
    d = intervals.select("key", "begin").distinct()
    both = F.least(F.col("begin") - F.lag("begin").over(line), F.lead("begin").over(line) - F.col("begin"))
    return d.select("key", "begin", both.alias("distance")).where("distance IS NOT NULL")


def bins(intervals: DataFrame, width: int) -> DataFrame:
    """(key, bin, depth): intervals over each whole bin of `width`, a bin away from either end."""
    inner = F.sequence(F.floor(F.col("begin") / width) + 1, F.greatest(F.floor(F.col("begin") / width) + 1, F.ceil(F.col("stop") / width) - 2))
    at = intervals.where(F.col("stop") - F.col("begin") > 2 * width).select("key", F.explode(inner).alias("bin"))
    return at.groupBy("key", "bin").agg(F.count("*").alias("depth"))


def longest_single_run(binned: DataFrame) -> DataFrame:
    """(key, first_bin, n_bins): each key's longest run of bins of depth 1, the first on ties (gaps and islands)."""
    ones = binned.where("depth = 1")
    run = F.col("bin") - F.row_number().over(Window.partitionBy("key").orderBy("bin"))
    runs = ones.withColumn("_run", run).groupBy("key", "_run").agg(F.min("bin").alias("first_bin"), F.count("*").alias("n_bins"))
    best = runs.groupBy("key").agg(F.max(F.struct("n_bins", (-F.col("first_bin")).alias("f"))).alias("x"))
    return best.select("key", (-F.col("x.f")).alias("first_bin"), "x.n_bins")


def overlap_join(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Pairs of overlapping intervals of one key: both sides are dealt into bins of `width`, and a pair is kept in its first common bin."""
    deal = lambda d, s: d.select(*(F.col(c).alias(f"{s}_{c}") for c in d.columns)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(f"{s}_begin") / width), F.floor((F.greatest(F.col(f"{s}_stop") - 1, F.col(f"{s}_begin"))) / width))))
    a, b = deal(left, "l"), deal(right, "r")
    on = [a["l_key"] == b["r_key"], a["_bin"] == b["_bin"], a["l_begin"] < b["r_stop"], b["r_begin"] < a["l_stop"], F.floor(F.greatest(a["l_begin"], b["r_begin"]) / width) == a["_bin"]]
    return a.join(b, on).drop("_bin")
