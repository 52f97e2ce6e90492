"""Consensus of the paths through an edge, and contigs.

The paths through an anchor are set on one axis with the anchor at 0, all read so that
the anchor goes forwards. The consensus goes out from the anchor, first left and then
right: in each column edges with `least` or more rows survive, rows of others are cut
from there on, several survivors fork the set, none ends the branch.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .walks import Graph


#: A path by column, with the number of reads that take it.
Row = tuple[dict[int, int], int]


def forks(rows: list[Row], least: int, step: int, at: int = 0) -> list[tuple[list[int], list[Row]]]:
    """(edges outwards, rows that agree) of each branch beyond column `at`."""
    done, open_ = [], [([], rows, at + step)]
    while open_:
        path, now, col = open_.pop()
        counts = Counter()
        for r, n in now:
            if col in r:
                counts[r[col]] += n
        best = sorted(e for e, n in counts.items() if n >= least)
        if not best:
            done.append((path, now))
        for e in best:
            open_.append(([*path, e], [(r, n) for r, n in now if col not in r or r[col] == e], col + step))
    return sorted(done, key=lambda x: x[0])


def consensus(anchor: int, paths: list[list[int]], least: int, weights: list[int] | None = None) -> list[tuple[list[int], int]]:
    """(path, reads that support it) for each branch; paths are oriented edge ids and contain the anchor either way, each
    taken by as many reads as weights says (one, without)."""
    rows = []
    for p, n in zip(paths, weights or [1] * len(paths), strict=True):
        if anchor not in p:
            p = [-o for o in reversed(p)]
        if anchor in p:
            i = p.index(anchor)
            rows.append(({j - i: o for j, o in enumerate(p)}, n))
    out = {}
    for left, kept in forks(rows, least, -1):
        for right, rest in forks(kept, least, 1):
            out[(*left[::-1], anchor, *right)] = sum(n for _, n in rest)
    return [(list(p), n) for p, n in sorted(out.items())]


def merge_halves(found: list[tuple[list[int], int]], anchor: int) -> list[tuple[list[int], int]]:
    """Exactly two paths, one that only goes left and one that only goes right of the anchor, become one."""
    if len(found) == 2:
        a, b = sorted(found, key=lambda x: -x[0].index(anchor))
        if a[0][-1] == anchor and b[0][0] == anchor:
            return [(a[0] + b[0][1:], min(a[1], b[1]))]
    return found


def consensus_paths(paths: DataFrame, least: int) -> DataFrame:
    """(anchor, path, freq): the consensus around each edge that starts a path group.

    paths: read_id, path. Rows are gathered by anchor; equal paths are counted before, so a
    group holds distinct paths only, weighted by their counts."""
    flat = F.transform("path", lambda o: F.abs(o))
    distinct = paths.groupBy("path").agg(F.count("*").alias("n")).withColumn("flat", flat)
    by = distinct.select(F.explode(F.array_distinct("flat")).alias("anchor"), "path", "n")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        anchor = int(key[0])
        each = [list(map(int, p)) for p in rows["path"]]
        got = merge_halves(consensus(anchor, each, least, [int(n) for n in rows["n"]]), anchor)
        return pd.DataFrame([(anchor, p, n) for p, n in got], columns=["anchor", "path", "freq"])

    return by.groupBy("anchor").applyInPandas(run, "anchor long, path array<long>, freq long")


def contigs(consensus_: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(path, freq, seq, len): each distinct consensus path, of equal and reversed ones and of parts of longer ones around
    the same edge the longest, as a sequence."""
    turned = F.transform(F.reverse("path"), lambda o: -o)
    one = consensus_.select(F.greatest("path", turned).alias("path"), "freq").groupBy("path").agg(F.max("freq").alias("freq"))
    # An edge belongs to the longest path that holds it; a path that is longest for none of its edges is a part.
    owners = one.select("path", "freq", F.size("path").alias("n"), F.explode(F.transform("path", lambda o: F.abs(o))).alias("e"))
    best = owners.groupBy("e").agg(F.max(F.struct("n", "path", "freq")).alias("x")).select("x.path", "x.freq").distinct()
    graph = best.sparkSession.sparkContext.broadcast(Graph.collect(edges, k))

    def spell(batches):
        for b in batches:
            b["seq"] = [graph.value.path_seq([int(o) for o in p]) for p in b["path"]]
            yield b

    out = best.mapInPandas(spell, "path array<long>, freq long, seq string")
    return out.withColumn("len", F.length("seq").cast("long"))


def extend(found: dict[int, list[int]], unique: set[int], lengths: dict[int, int], least_added: int) -> dict[int, list[int]]:
    """Consensus paths of unique edges, longest first, made longer by one overlapping path of another unique edge.

    A path takes the only other path that holds one of its ends' unique edges, agrees with
    it over the overlap and adds more than least_added bases; a path is used once. Longest
    first, then by anchor, is the order that decides."""
    size = lambda p: sum(lengths[abs(o)] for o in p)
    out, used = {}, set()
    for anchor in sorted(found, key=lambda a: (-size(found[a]), a)):
        if anchor in used:
            continue
        used.add(anchor)
        path, grown = found[anchor], True
        while grown:
            grown = False
            for turn in (False, True):  # to the right, then to the left
                now = [-o for o in reversed(path)] if turn else path
                end = next((o for o in reversed(now) if abs(o) in unique), None)
                ways = []
                for other, p in found.items():
                    if other in used or end is None:
                        continue
                    q = p if end in p else [-o for o in reversed(p)]
                    if end in q:
                        i, j = now.index(end), q.index(end)
                        tail, more = now[i:], q[j:]
                        back = min(i, j)
                        if more[: len(tail)] == tail and now[i - back : i] == q[j - back : j] and size(more[len(tail) :]) > least_added:
                            ways.append((other, more[len(tail) :]))
                if len(ways) == 1:
                    used.add(ways[0][0])
                    now = now + ways[0][1]
                    path, grown = ([-o for o in reversed(now)] if turn else now), True
        out[anchor] = path
    return out
