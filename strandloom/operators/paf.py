"""Long-read alignments to edges: cleaning and seed edges.

Rows: qname, qlen, qstart, qend, strand (+ or -), tname, tlen, tstart, tend, nmatch, alnlen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def drop_single(paf: DataFrame) -> DataFrame:
    """Reads with one alignment tell nothing about how edges follow one another."""
    return paf.withColumn("_n", F.count("*").over(Window.partitionBy("qname"))).where("_n > 1").drop("_n")


def clean(paf: DataFrame, flank: int) -> DataFrame:
    """Keeps the alignments that end where the read or the edge ends, give or take flank.

    Inside the read the edge must be covered by three quarters, with matches over two
    fifths of the alignment; an alignment of the whole read must cover three quarters of
    it; at one end of the read it must reach the end of the edge that the strand implies."""
    c = {n: F.col(n) for n in ("qlen", "qstart", "qend", "tlen", "tstart", "tend", "nmatch", "alnlen")}
    plus, far = F.col("strand") == "+", c["qlen"] - flank
    at_end, at_start = c["tend"] > c["tlen"] - flank, c["tstart"] < flank
    inside = (c["qstart"] > flank) & (c["qend"] < far)
    whole = (c["qstart"] < flank) & (c["qend"] > far)
    three = lambda a, b: a > F.floor(b * 3 / 4)
    keep = (
        F.when(inside, three(c["tend"] - c["tstart"], c["tlen"]) & (c["nmatch"] > F.floor(c["alnlen"] * 2 / 5)))
        .when(whole, three(c["qend"] - c["qstart"], c["qlen"]))
        .when(c["qstart"] <= flank, F.when(plus, at_end).otherwise(at_start))
        .otherwise(F.when(plus, at_start).otherwise(at_end))
    )
    return paf.where(keep)


def seed_edges(paf: DataFrame, flank: int, unique: DataFrame) -> DataFrame:
    """Each read's unique edge with most matches that reaches a read end within flank, unless the read spans the edge.

    unique has tname; the alignment with the lowest start, then edge, wins ties."""
    c = {n: F.col(n) for n in ("qlen", "qstart", "qend", "tlen", "tstart", "tend")}
    plus = F.col("strand") == "+"
    left = F.when(plus, c["tlen"] - c["tend"] <= flank).otherwise(c["tstart"] <= flank)
    right = F.when(plus, c["tstart"] <= flank).otherwise(c["tlen"] - c["tend"] <= flank)
    ok = F.when(c["qstart"] < flank, left).when(c["qlen"] - c["qend"] < flank, right).otherwise(False)
    line = Window.partitionBy("qname").orderBy(F.desc("nmatch"), "qstart", "tname")
    best = paf.join(unique.select("tname").distinct(), "tname").where(ok).withColumn("_k", F.row_number().over(line)).where("_k = 1").drop("_k")
    return best.where(~((c["tstart"] < flank) & (c["tlen"] - c["tend"] < flank)))
