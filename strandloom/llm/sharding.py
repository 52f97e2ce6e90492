"""Sharding by extendible hashing.

A document's 60 hash bits are 32 of its key and 28 of its content, so that rows that
share a key can still be told apart. The directory is indexed by the leading bits;
a bucket that exceeds the byte limit splits on the next bit, all others stay. The
splits are found STEP bits at a time from the bucket's cells, so each round groups
only the rows of buckets that are still too large.

Defined results: a null text has 0 bytes; a null key is hashed as empty text; rows
equal in key and text can't be told apart and stay together; such a group, or one
text, may exceed the limit alone and then has fits = false; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

BITS, KEY_BITS, STEP = 60, 32, 10


def key_hash(key: Column, content: Column) -> Column:
    """60 bits as a long: 32 leading ones of md5(key), then 28 of the content's hash."""
    head = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, KEY_BITS // 4), 16, 10).cast("long")
    return F.shiftleft(head, BITS - KEY_BITS) + F.pmod(F.xxhash64(content), F.lit(1 << (BITS - KEY_BITS)))


def prefix(h: Column, depth: Column | int) -> Column:
    """The leading `depth` of the 60 bits."""
    return F.floor(h / F.pow(F.lit(2.0), F.lit(BITS) - depth)).cast("long") if isinstance(depth, Column) else F.shiftright(h, BITS - depth)


def split_buckets(rows: DataFrame, limit: int) -> DataFrame:
    """Adds depth, shard_bytes, shard_docs and fits to rows (h, bytes, ...)."""
    spark = rows.sparkSession
    done, left, base = [], rows, 0
    while True:
        deep = min(BITS, base + STEP)
        cells = left.groupBy(prefix(F.col("h"), deep).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"))
        # A cell counts in its bucket at each depth; a bucket has at most 2^STEP cells.
        depths = F.sequence(F.lit(0 if base == 0 else base + 1), F.lit(deep))
        at = cells.withColumn("depth", F.explode(depths)).withColumn("bucket", F.expr(f"shiftright(cell, {deep} - depth)"))
        w = Window.partitionBy("depth", "bucket")
        at = at.select("cell", "depth", F.sum("bytes").over(w).alias("shard_bytes"), F.sum("docs").over(w).alias("shard_docs"))
        last = F.lit(deep == BITS)
        leaf = F.struct("depth", "shard_bytes", "shard_docs")
        found = durable(at.groupBy("cell").agg(F.min(F.when((F.col("shard_bytes") <= limit) | (last & (F.col("depth") == BITS)), leaf)).alias("leaf")))
        more = bool(found.where(F.col("leaf").isNull()).head(1))
        joined = left.withColumn("cell", prefix(F.col("h"), deep)).join(found, "cell")
        done.append(joined.where(F.col("leaf").isNotNull()).select(*rows.columns, "leaf.*"))
        if not more:
            break
        left, base = joined.where(F.col("leaf").isNull()).select(*rows.columns), deep
        # A round's rows are read twice by the next one.
        left = durable(left)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumn("fits", F.col("shard_bytes") <= limit)


def shard(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, bytes, shard (its bits), depth, shard_bytes, shard_docs, fits; the shard of every row."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = durable(docs.select(F.col(key), F.octet_length(t).cast("long").alias("bytes"), key_hash(F.col(key), t).alias("h")))
    out = split_buckets(rows, limit)
    bits = F.substring(F.lpad(F.bin("h"), BITS, "0"), F.lit(1), F.col("depth"))
    return out.select(key, "bytes", bits.alias("shard"), "depth", "shard_bytes", "shard_docs", "fits")


def directory(shards: DataFrame) -> DataFrame:
    """One row a shard with the range of directory entries that point to it, [first, after), at the global depth."""
    leaves = shards.groupBy("shard", "depth").agg(F.max("shard_bytes").alias("shard_bytes"), F.max("shard_docs").alias("shard_docs"))
    top = leaves.agg(F.max("depth").alias("global_depth"))
    first = F.conv(F.concat(F.lit("0"), "shard"), 2, 10).cast("decimal(38,0)") * F.pow(F.lit(2), F.col("global_depth") - F.col("depth")).cast("decimal(38,0)")
    room = F.pow(F.lit(2), F.col("global_depth") - F.col("depth")).cast("decimal(38,0)")
    return leaves.crossJoin(F.broadcast(top)).select("shard", "depth", "global_depth", first.alias("first"), (first + room).alias("after"), "shard_bytes", "shard_docs")


def oracle(limit: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM documents),
b AS (SELECT doc_id, bytes, depth, h >> (32 - depth) AS p FROM d, (SELECT CAST(unnest(range(0, 33)) AS INTEGER) AS depth)),
s AS (SELECT *, CAST(sum(bytes) OVER (PARTITION BY depth, p) AS BIGINT) AS shard_bytes,
             count(*) OVER (PARTITION BY depth, p) AS shard_docs FROM b),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k FROM s WHERE shard_bytes <= {limit} OR shard_docs = 1)
SELECT doc_id, bytes, right(lpad(bin(p), 32, '0'), depth) AS shard, depth, shard_bytes, shard_docs, shard_bytes <= {limit} AS fits
FROM l WHERE k = 1"""
