"""N-gram Jaccard join: size-aware, with a light and a heavy side.

A document's set holds its distinct K-word shingles; two sets link when their Jaccard
similarity is at least NUM / DEN. Equal sets are one node, so copies cost nothing.

Light sets (at most X shingles): two sets of a and b shingles link exactly when they
share a subset of o(a, b) shingles, the least overlap. Both enumerate their subsets of
that fixed size and meet at an equal one.

Heavy sets: each set's shingles are dealt into parts by hash, the number of parts
fixed by the size class of the smaller set. Linked sets differ in at most D shingles,
so with D + 1 parts (and some for empty ones) one part is equal. Each part's content is
a key of an inverted list that is scanned for its members. Parts hold several
shingles, so a passage that many documents share makes no long list.

X is chosen by cost: all sets of up to MEASURED shingles are keyed both ways, and X is
the size with the fewest rows and candidate pairs, as counted in the lists.

Members of a list are candidates. Short lists give pairs, which are verified by the
intersection of the sets. In a long list every member is first compared with one of
them, the hub. Members that link with the hub of each of their lists are connected;
the others are verified against all members of their lists' clusters, block against
block by matrix product, a task for each two blocks of near sizes.

Defined results: a null or wordless text has the empty set, which links with nothing;
fewer than K words are one shingle; a null doc_id never names a component unless it is
alone (then null); rows that share a doc_id are documents of their own, and link by text;
other columns are ignored. Sets and texts are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocked, sent
from .common import discard, durable, met, raw_texts, release, slices
from .components import components
from .shingles import mix, roots, sets, shingles, sums, words

#: Lists up to this length give pairs; of longer ones, blocks of about BLOCK members are compared.
SHORT, BLOCK = 24, 1024
#: Rows that verifying one candidate costs, next to emitting one row.
VERIFY = 2
#: Sets up to this size are keyed both ways to find the boundary; none enumerates more than SUBSETS subsets.
MEASURED, SUBSETS = 40, 1000
NO_ID = (1 << 63) - 1

class Plan:
    """What a size implies at a threshold of num / den."""

    def __init__(self, num: int, den: int, light: int = 0):
        self.num, self.den, self.light = num, den, light
        self.starts = [1]

    def overlap(self, a: int, b: int) -> int:
        """The least intersection of linked sets of a and b."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def partners(self, a: int) -> range:
        """Sizes from a on that can link with a."""
        return range(a, a * self.den // self.num + 1)

    def subset_sizes(self, s: int) -> list[tuple[int, int, int]]:
        """(smaller, larger, subset size) for each size that a light set of s may link with."""
        found = [(s, b, self.overlap(s, b)) for b in self.partners(s) if b <= self.light]
        found += [(a, s, self.overlap(a, s)) for a in range(1, s) if s in self.partners(a)]
        return [x for x in found if x[2] <= x[0]]

    def class_of(self, size: np.ndarray) -> np.ndarray:
        top = int(size.max(initial=1))
        while self.starts[-1] <= top:
            self.starts.append(max(self.starts[-1] + 1, (self.starts[-1] - 1) * self.den // self.num + 1))
        return np.searchsorted(self.starts, size, side="right") - 1

    def differing(self, c: np.ndarray) -> np.ndarray:
        """Most shingles in which linked sets differ, the smaller in class c."""
        last = np.array([*self.starts, 0])[np.asarray(c) + 1] - 1
        return last * (self.den - self.num) // self.num

    def spare(self, c: np.ndarray) -> np.ndarray:
        return 3 + self.differing(c) // 25

    def parts(self, c: np.ndarray) -> np.ndarray:
        return self.differing(c) + 1 + self.spare(c)

    def listable(self, s: int) -> bool:
        return sum(math.comb(s, o) for _, _, o in self.subset_sizes(s)) <= SUBSETS


def boundary(cost: dict[tuple[bool, int], float], num: int, den: int) -> int:
    """The light size with the least cost. cost: (light, size) to rows and verification; a light key counts at the larger size of its two."""
    top = 0
    while top < MEASURED and Plan(num, den, top + 1).listable(top + 1):
        top += 1

    def total(x: int) -> float:
        light = sum(c for (side, z), c in cost.items() if side and z <= x)
        # Smaller sets can only link with light ones.
        return light + sum(c for (side, z), c in cost.items() if not side and z * den >= x * num)

    return min(range(top + 1), key=total)


def _sets_of(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, ends, digest) of each text's set."""
    s, ends = sets(*shingles(*words(raw_texts(batch)), k))
    size = np.diff(ends).astype(np.uint64)
    return s, ends, mix(sums(mix(s), ends) + size).view(np.int64)


def _arrays(s: np.ndarray, ends: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(s.view(np.int64)), mask=None if mask is None else pa.array(mask))


def classes(docs: DataFrame, k: int) -> DataFrame:
    """(id, t, size, m, s): each row's set size and digest, and its set if it has at most MEASURED shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s, ends, m = _sets_of(batch, k)
            size = np.diff(ends)
            few = size <= MEASURED
            held = np.concatenate([[0], np.cumsum(np.where(few, size, 0))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t"), pa.array(size), pa.array(m), _arrays(s[np.repeat(few, size)], held, ~few)], ["id", "t", "size", "m", "s"])

    return docs.select("id", "t", "text").mapInArrow(run, "id long, t long, size long, m long, s array<long>")


def light_keys(s: np.ndarray, ends: np.ndarray, plan: Plan) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, larger size of the two, keys) of the subsets of each light set."""
    size = np.diff(ends)
    for i in np.flatnonzero((size > 0) & (size <= plan.light)):
        own = s[ends[i] : ends[i + 1]]
        for a, b, o in plan.subset_sizes(int(size[i])):
            at = np.array(list(combinations(range(len(own)), o)))
            yield int(i), b, mix(mix(own)[at].sum(axis=1, dtype=np.uint64) ^ mix(np.array([a << 32 | b << 8 | 1], dtype=np.uint64)))


def heavy_keys(s: np.ndarray, ends: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the parts of each heavy set."""
    size = np.diff(ends)
    texts, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    # Smaller sets can only link with light ones.
    heavy = np.flatnonzero((size > 0) & (size * plan.den >= plan.light * plan.num))
    if len(heavy):
        base = plan.class_of(size)
        mixed = mix(s)
        for down in (0, 1):
            live = np.zeros(len(size), dtype=bool)
            live[heavy] = base[heavy] >= down
            c = np.maximum(0, base - down)
            p = plan.parts(c)
            owner = np.repeat(np.arange(len(size)), size)
            on = live[owner]
            o, h = owner[on], s[on]
            part = ((h >> np.uint64(32)) * p[o].astype(np.uint64)) >> np.uint64(32)
            if not len(o):
                continue
            new = np.ones(len(o), dtype=bool)
            new[1:] = (o[1:] != o[:-1]) | (part[1:] != part[:-1])
            at = np.flatnonzero(new)
            label = mix((c[o[at]].astype(np.uint64) << np.uint64(40)) + (part[at] << np.uint64(2)) + np.uint64(2))
            texts.append(o[at])
            keys.append(mix(np.add.reduceat(mixed[on], at) + label))
            empty = p - np.bincount(o[at], minlength=len(size))
            # So many empty parts that all equal ones may be empty: they are keys too. A partner has as many.
            for i in np.flatnonzero(live & (empty > plan.spare(c))):
                free = np.setdiff1d(np.arange(p[i], dtype=np.uint64), part[at][o[at] == i])
                keys.append(mix(mix((np.uint64(c[i]) << np.uint64(40)) + (free << np.uint64(2)) + np.uint64(3))))
                texts.append(np.full(len(free), i))
    return np.concatenate(texts), np.concatenate(keys)


def keys_of(s: np.ndarray, ends: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of each list that a text's set is in."""
    texts, keys = heavy_keys(s, ends, plan)
    light = list(light_keys(s, ends, plan))
    return np.concatenate([texts, *(np.full(len(x), i) for i, _, x in light)]), np.concatenate([keys, *(x for _, _, x in light)])


def measured(own: DataFrame, num: int, den: int) -> dict[tuple[bool, int], float]:
    """The cost of keying the small sets either way, from the lists that this gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, both = Plan(num, den, 0), Plan(num, den, 0)
        while both.light < MEASURED and Plan(num, den, both.light + 1).listable(both.light + 1):
            both.light += 1
        for batch in batches:
            lists = batch.column("s")
            s, ends = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(batch.column("size").to_numpy())])
            at, key = heavy_keys(s, ends, plan)
            light = list(light_keys(s, ends, both))
            sides = np.concatenate([np.zeros(len(at), bool), np.ones(sum(len(x) for _, _, x in light), bool)])
            size = np.concatenate([np.diff(ends)[at], *(np.full(len(x), b) for _, b, x in light)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sides), pa.array(size), pa.array(np.concatenate([key, *(x for _, _, x in light)]).view(np.int64))], ["light", "size", "key"])

    small = own.where(f"size BETWEEN 1 AND {MEASURED}").select("m", "size", "s").dropDuplicates(["m"])
    lists = small.mapInArrow(run, "light boolean, size long, key long").groupBy("light", "size", "key").agg(F.count("*").alias("n"))
    cost = F.sum(F.col("n") + F.lit(float(VERIFY)) * F.col("n") * (F.col("n") - 1) / 2)
    return {(r.light, r.size): r.c for r in lists.groupBy("light", "size").agg(cost.alias("c")).collect()}  # two rows a size at most


def lists(docs: DataFrame, k: int, num: int, den: int, light: int) -> DataFrame:
    """(key, m): the inverted lists. A task emits a set once, however many copies it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, seen = Plan(num, den, light), set()
        for batch in slices(batches):
            s, ends, m = _sets_of(batch, k)
            if len(seen) > 500_000:
                seen.clear()
            keep = np.zeros(len(m), dtype=bool)
            for i, x in enumerate(m.tolist()):
                if x not in seen:
                    seen.add(x)
                    keep[i] = True
            size = np.diff(ends)
            s = s[np.repeat(keep, size)]
            ends = np.concatenate([[0], np.cumsum(size[keep])])
            at, key = keys_of(s, ends, plan)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(m[keep][at])], ["key", "m"])

    return docs.select("text").mapInArrow(run, "key long, m long")


def held_sets(docs: DataFrame, own: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(m, size, s): the sets of nodes, each from one of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s, ends, m = _sets_of(batch, k)
            yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(np.diff(ends)), _arrays(s, ends)], ["m", "size", "s"])

    row = F.struct(F.coalesce("id", F.lit(NO_ID)).alias("i"), F.col("t"))
    first = own.join(nodes, "m", "left_semi").groupBy("m").agg(F.min(row).alias("x")).select("x.i", "x.t")
    texts = docs.select(F.coalesce("id", F.lit(NO_ID)).alias("i"), "t", "text").join(first, ["i", "t"], "left_semi")
    return texts.mapInArrow(run, "m long, size long, s array<long>").dropDuplicates(["m"])


def verified(pairs: DataFrame, held: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, linked) of distinct pairs (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come by block, its sets first, then its pairs.
        block, own = None, {}
        for batch in batches:
            lists, hubs = batch.column("s"), batch.column("hub").to_pylist()
            s = lists.flatten().to_numpy().view(np.uint64)
            ends = np.concatenate([[0], np.cumsum(np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))]).astype(np.int64)
            out = []
            for i, (of, m, hub) in enumerate(zip(batch.column("block").to_pylist(), batch.column("m").to_pylist(), hubs, strict=True)):
                if of != block:
                    block, own = of, {}
                if hub is None:
                    own[m] = s[ends[i] : ends[i + 1]].copy()
                    continue
                a, b = own[hub], own[m]
                both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
                out.append((hub, m, den * both >= num * (len(a) + len(b) - both)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["a", "b", "linked"])
        del own
        release()

    dealt = blocked(pairs.select(F.col("a").alias("hub"), F.col("b").alias("m"), F.lit(1).alias("weight")))
    return sent(dealt, held, "s").mapInArrow(run, "a long, b long, linked boolean")


def _link_blocks(num: int, den: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """At most two blocks: exact intersections by matrix product, then a spanning forest of the links."""
        rows = rows.sort_values("m").reset_index(drop=True)
        size = rows["size"].to_numpy()
        flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in rows["s"]])
        _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
        shared = n > 1
        number = np.cumsum(shared) - 1
        owner = np.repeat(np.arange(len(rows)), size)
        on = shared[at]
        owner, at = owner[on], number[at[on]]
        inter = np.zeros((len(rows), len(rows)), dtype=np.float32)
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        width = 8192
        for lo in range(0, int(shared.sum()), width):
            a, b = np.searchsorted(at, [lo, lo + width])
            x = np.zeros((len(rows), width), dtype=np.float32)
            x[owner[a:b], at[a:b] - lo] = 1
            inter += x @ x.T
        union = size[:, None] + size[None, :] - inter
        u, v = np.nonzero(np.triu(den * inter >= num * union, 1))
        low = roots(len(rows), u, v)
        far = np.flatnonzero(low != np.arange(len(rows)))
        m = rows["m"].to_numpy()
        del inter, union
        release()
        return pd.DataFrame({"u": m[far], "v": m[low[far]]})

    return run


def links(docs: DataFrame, own: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(u, v): enough of the links between sets to connect what all links connect."""
    light = boundary(measured(own, num, den), num, den)
    shared = durable(met(lambda: lists(docs, k, num, den, light)).distinct())
    held = durable(held_sets(docs, own, shared.select("m").distinct(), k))
    lengths = shared.groupBy("key").agg(F.count("*").alias("n"), F.min("m").alias("hub"))
    members = durable(shared.join(lengths, "key").select("key", "m", "n", "hub"))
    discard(shared)
    short = members.where(F.col("n") <= SHORT).select("key", "m")
    a, b = (short.select("key", F.col("m").alias(x)) for x in "ab")
    pairs = a.join(b, "key").where("a < b").select("a", "b")
    hubs = members.where((F.col("n") > SHORT) & (F.col("m") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("m").alias("b"), F.lit(True).alias("hub"))
    pairs = pairs.withColumn("hub", F.lit(False)).unionByName(hubs).groupBy("a", "b").agg(F.max("hub").alias("hub"))
    sizes = held.select("m", "size")
    for x in "ab":
        pairs = pairs.join(sizes.select(F.col("m").alias(x), F.col("size").alias(f"z{x}")), x)
    pairs = durable(pairs.select("a", "b", "hub", (den * F.least("za", "zb") >= num * F.greatest("za", "zb")).alias("near")))
    checked = durable(verified(pairs.where("near").select("a", "b"), held, num, den))
    linked = checked.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))

    # What a long list's hub doesn't link with is compared with all of its cluster.
    around = pairs.where("hub").select("a", "b")
    apart = durable(around.join(checked.where("linked"), ["a", "b"], "left_anti").select(F.col("b").alias("m")).distinct())
    if not apart.head(1):
        return linked
    cluster = components(around.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "m")
    cluster = cluster.join(cluster.join(apart, "m", "left_semi").select("component").distinct(), "component", "left_semi")
    cluster = cluster.join(apart.withColumn("apart", F.lit(True)), "m", "left").withColumn("apart", F.coalesce("apart", F.lit(False)))
    # A small cluster is one block. In others, linked sets are of one size class or of neighbouring ones.
    whole = cluster.groupBy("component").agg((F.count("*") <= BLOCK).alias("whole"))
    cluster = cluster.join(whole, "component").withColumn("apart", F.col("apart") | F.col("whole")).join(held, "m")
    cluster = cluster.withColumn("class", F.when(F.col("whole"), 0).otherwise(F.floor(F.log("size") / math.log(den / num)).cast("int")))
    cell = ["component", "apart", "class"]
    cells = cluster.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = durable(cluster.join(cells, cell).withColumn("block", F.struct(F.col("apart"), F.col("class"), F.pmod(F.xxhash64("m"), "blocks").cast("int").alias("no"))))
    blocks = placed.select("component", "block").distinct()
    i, j = (blocks.select("component", F.col("block").alias(x)) for x in "ij")
    couples = i.where("i.apart").join(j, "component").where("abs(i.class - j.class) <= 1 AND (NOT j.apart OR i <= j)")
    ends = couples.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    both = placed.join(ends, ["component", "block"]).select("component", "i", "j", "m", "size", "s")
    return linked.unionByName(both.groupBy("component", "i", "j").applyInPandas(_link_blocks(num, den), "u long, v long"))


def grouped(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(id, t, size, root) of every row of docs (id, t, text): root is the same for the rows of a component, null for an empty set."""
    own = durable(classes(docs, k))
    filled = own.where("size > 0")
    found = components(links(docs, filled, k, num, den)).withColumnRenamed("node", "m")
    root = F.when(F.col("size") > 0, F.coalesce("component", "m"))
    return own.join(found, "m", "left").select("id", "t", "size", root.alias("root"))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")


def join(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    rows = durable(grouped(_named(docs), k, num, den))
    low = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("low"))
    out = rows.join(low, "root", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("low")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The rows of docs without those that link, by way of others too, with a row of a lower id (null is the highest), or of
    an equal id and another text. Rows equal in id and text are one; rows without a word stay."""
    rows = durable(grouped(_named(docs), k, num, den))
    first = F.min(F.struct(F.coalesce("id", F.lit(NO_ID)).alias("_id"), F.col("t").alias("_t")))
    stay = rows.where("root IS NOT NULL").groupBy("root").agg(first.alias("x")).select("x.*")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.withColumns({"_id": F.coalesce("doc_id", F.lit(NO_ID)), "_t": F.xxhash64(F.coalesce("text", F.lit("")))})
    kept = keyed.where(worded).join(stay, ["_id", "_t"], "left_semi").dropDuplicates(["_id", "_t"])
    return kept.unionByName(keyed.where(~worded)).select(docs.columns)
