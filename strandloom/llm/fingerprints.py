"""Document fingerprints by Order MinHash.

A text's k-mers are runs of K words (very long words are cut into pieces first). Each
k-mer is numbered by its occurrence, so repeats count. The hash range is cut into BINS;
each bin is one of the sketch's permutations: its PICK smallest occurrence-numbered
k-mers are kept, put back into text order and hashed together. A bin with one of them
borrows the next smallest hash of the bins after it (around the end), so a short text's
tuples carry order too; only a text of one k-mer has none. Likeness is the share
of bins that agree among those that either text fills, so it drops both when words
change and when they change places.

All of it is DataFrame expressions on arrays within a row; no k-mer leaves its row.

Defined results: a null text counts as empty; two empty texts have likeness 1, an empty
and a filled one 0; a text of fewer than K words is one k-mer; rows equal in doc_id and
text are one document, a doc_id's different texts follow one another by hash, null ids
come first; a single document is its own next one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

K, PICK, BINS = 3, 2, 32
#: Up to so many distinct repeated k-mers are looked for one by one.
MANY = 16
_SHIFT = 64 - (BINS.bit_length() - 1)


def sketch(df: DataFrame, text: str, out: str = "sketch") -> DataFrame:
    """Replaces the text column by out: an array of BINS integers, null where a bin is empty."""
    keep = [f"`{c}`" for c in df.columns if c != text]
    d = df.selectExpr(*keep, rf"filter(split(`{text}`, '[ \\t\\n\\x0B\\f\\r]+'), x -> x <> '') AS w")
    d = d.selectExpr(*keep, "IF(exists(w, x -> octet_length(x) > 48), flatten(transform(w, x -> IF(octet_length(x) > 48, regexp_extract_all(x, '.{1,12}', 0), array(x)))), w) AS w")
    d = d.selectExpr(*keep, "transform(w, x -> xxhash64(x)) AS h")
    run = ", ".join(f"get(h, i + {k})" for k in range(1, K))
    d = d.selectExpr(*keep, f"CASE WHEN size(h) = 0 THEN array() WHEN size(h) < {K} THEN array(xxhash64(h)) ELSE transform(slice(h, 1, greatest(0, size(h) - {K - 1})), (x, i) -> xxhash64(x, {run})) END AS g")
    # Occurrence numbers: only k-mers that repeat are sorted with their places; where many repeat, all are.
    d = d.selectExpr(*keep, "g", "sort_array(g) AS s")
    d = d.selectExpr(*keep, "g", "array_distinct(filter(s, (x, i) -> x <=> get(s, i - 1))) AS d")
    every = "transform(g, (x, i) -> struct(x AS h, i AS p))"
    d = d.selectExpr(*keep, "g", "d", f"CASE WHEN size(d) = 0 THEN array() WHEN size(d) > {MANY} THEN sort_array({every}) ELSE sort_array(filter({every}, e -> array_contains(d, e.h))) END AS s")
    d = d.selectExpr(*keep, "g", "d", "s", "filter(transform(s, (e, i) -> IF(e.h <=> get(s, i - 1).h, -1, i)), i -> i >= 0) AS b")
    numbered = "flatten(transform(b, (a, j) -> transform(slice(s, a + 1, coalesce(get(b, j + 1), size(s)) - a), (e, o) -> struct(xxhash64(e.h, o) AS h, e.p AS p))))"
    single = "transform(g, (x, i) -> struct(xxhash64(x, 0) AS h, i AS p))"
    some = "filter(transform(g, (x, i) -> struct(IF(array_contains(d, x), NULL, xxhash64(x, 0)) AS h, i AS p)), e -> e.h IS NOT NULL)"
    d = d.selectExpr(*keep, f"CASE WHEN size(d) = 0 THEN {single} WHEN size(d) > {MANY} THEN {numbered} ELSE concat({some}, {numbered}) END AS e")
    # The PICK smallest of each bin: from the sorted hashes alone, then the entries up to each bin's limit.
    at = lambda x: f"shiftright({x}, {_SHIFT})"
    d = d.selectExpr(*keep, "e", "sort_array(transform(e, x -> x.h)) AS s")
    d = d.selectExpr(*keep, "e", f"filter(s, (x, i) -> NOT {at(f'get(s, i - {PICK})')} <=> {at('x')}) AS s")
    # A column that is used once is put in place of its name, so one that a lambda reads is bound as an argument first.
    most = f"map_from_entries(filter(transform(s, (x, i) -> IF({at('get(s, i + 1)')} <=> {at('x')}, NULL, struct({at('x')} AS bin, x AS most))), x -> x IS NOT NULL))"
    d = d.selectExpr(*keep, "e", f"transform(array({most}), m -> transform(sequence({-BINS // 2}L, {BINS // 2 - 1}L), i -> try_element_at(m, i)))[0] AS m")
    d = d.selectExpr(*keep, f"sort_array(transform(array(m), m -> filter(e, x -> x.h <= get(m, CAST({at('x.h')} + {BINS // 2} AS int))))[0]) AS s")
    bin_of = lambda e: at(f"{e}.h")
    # Now each bin has at most PICK = 2 entries, side by side; the entry after the first one is in its bin or is borrowed.
    other = "get(s, (i + 1) % size(s))"
    mark = f"CASE WHEN size(s) = 1 THEN xxhash64(e.h) WHEN e.p <= {other}.p THEN xxhash64(e.h, {other}.h) ELSE xxhash64({other}.h, e.h) END"
    entries = f"filter(transform(s, (e, i) -> IF({bin_of('get(s, i - 1)')} <=> {bin_of('e')}, NULL, struct(CAST({bin_of('e')} AS int) AS bin, CAST({mark} & 2147483647 AS int) AS mark))), x -> x IS NOT NULL)"
    return d.selectExpr(*keep, f"transform(array(map_from_entries({entries})), m -> transform(sequence({-BINS // 2}, {BINS // 2 - 1}), i -> try_element_at(m, i)))[0] AS `{out}`")


def likeness(a: str, b: str) -> Column:
    same = f"size(filter(zip_with({a}, {b}, (x, y) -> x = y), z -> z))"
    some = f"size(filter(zip_with({a}, {b}, (x, y) -> x IS NOT NULL OR y IS NOT NULL), z -> z))"
    return F.expr(f"CAST(IF({some} = 0, 1.0D, {same} / {some}) AS double)")


def as_text(a: str) -> Column:
    return F.expr(f"array_join(transform({a}, x -> coalesce(lower(hex(x)), '-')), '.')")


def with_neighbours(keys: DataFrame, order: list[str], partitions: int) -> DataFrame:
    """Adds prev (a struct of all columns of the row before, in order, cyclic) to keys.

    Rows are dealt by range; within a range a window looks back, and the first row of a
    range looks at the last row of the range before it."""
    cols = keys.columns
    dealt = durable(keys.repartitionByRange(partitions, *order).withColumn("part", F.spark_partition_id()))
    w = Window.partitionBy("part").orderBy(*order)
    inside = dealt.withColumn("prev", F.lag(F.struct(*cols)).over(w))
    ends = dealt.groupBy("part").agg(F.max(F.struct(*order, *(c for c in cols if c not in order))).alias("end"))  # one row a range
    ends = ends.select("part", F.struct(*(F.col(f"end.{c}").alias(c) for c in cols)).alias("end"))
    line = Window.orderBy("part")
    ends = ends.select("part", F.coalesce(F.lag("end").over(line), F.last("end").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    return inside.join(F.broadcast(ends), "part").select(*cols, F.coalesce("prev", "before").alias("prev"))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text has its last quarter replaced by the head of the next document. Each
    document sends its head to the one before it, so a text is shuffled once."""
    spark = docs.sparkSession
    t = F.coalesce(F.col("text"), F.lit(""))
    # id and salt name a document; a null id is told apart by the salt.
    rows = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64(F.col("doc_id").isNull(), t).alias("salt"), t.alias("t"))
    sizes = rows.select("id", "salt", F.length("t").cast("long").alias("n")).distinct()
    rows = rows.dropDuplicates(["id", "salt"])
    keys = with_neighbours(sizes, ["id", "salt"], int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = rows.join(keys.hint("merge"), ["id", "salt"])
    heads = whole.select(F.col("prev.id").alias("id"), F.col("prev.salt").alias("salt"), F.expr("substring(t, 1, CAST(prev.n div 4 AS int))").alias("head"))
    edit = F.expr("concat(substring(t, 1, CAST(n - n div 4 AS int)), head)")
    both = whole.select("id", "salt", "t", "n", "prev").join(heads.hint("merge"), ["id", "salt"])
    both = both.select("id", "salt", "n", "prev", F.explode(F.array(F.struct(F.lit(0).alias("kind"), "t"), F.struct(F.lit(1).alias("kind"), edit.alias("t")))).alias("x"))
    both = both.select("id", "salt", "n", "prev", "x.kind", F.when(F.col("x.kind") == 1, F.sha2(F.col("x.t"), 256)).alias("sha"), F.col("x.t").alias("t"))
    marked = sketch(both, "t")
    own = F.struct("id", "salt", "kind", "n", "sha")
    back = F.struct(F.col("prev.id").alias("id"), F.col("prev.salt").alias("salt"), F.lit(2).alias("kind"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("sha"))
    sent = marked.select("sketch", F.explode(F.when(F.col("kind") == 0, F.array(own, back)).otherwise(F.array(own))).alias("x")).select("x.*", "sketch")
    pick = lambda c, k: F.max(F.when(F.col("kind") == k, F.col(c)))
    got = sent.groupBy("id", "salt").agg(pick("n", 0).alias("n_chars"), pick("sha", 1).alias("edited_sha256"), *(pick("sketch", k).alias(c) for k, c in enumerate("abc")))
    null_id = (F.col("id") == F.lit(-(1 << 63)))
    return got.select(
        F.when(~null_id, F.col("id")).alias("doc_id"), "n_chars", "edited_sha256",
        as_text("a").alias("fingerprint"), as_text("b").alias("edited_fingerprint"),
        likeness("a", "b").alias("near_edited"), likeness("a", "c").alias("near_next"),
    )
