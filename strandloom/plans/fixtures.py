"""Stand-in tables for sequence and graph queries, derived from the general test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bases import encode, reverse_complement

#: Every letter becomes a base; other characters go.
ALPHABET, BASES = "abcdefghijklmnopqrstuvwxyz", "CATGCATGCATGCATGCATGCATGCA"
EVENT_IDS = {"view": 2, "click": 3, "purchase": 4, "signup": 5, "error": 6}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bases(text) -> F.Column:
    return F.regexp_replace(F.translate(F.lower(text), ALPHABET, BASES), "[^ACGT]", "")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, seq in digits); id 0 is not allowed."""
    return table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("read_id"), encode(as_bases(F.col("text"))).alias("seq"))


def reads_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, seq in letters, N kept)."""
    return table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("read_id"), F.regexp_replace(F.upper("text"), "[^ACGTN]", "").alias("seq"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref_id"), encode(as_bases(F.col("text"))).alias("seq"))


def pairs(spark: SparkSession, sf_dir: str, length: int) -> DataFrame:
    """(read_id, seq1, seq2): the first bases of each read, and the reverse complement of its last."""
    r = reads(spark, sf_dir)
    return r.select("read_id", F.left("seq", F.lit(length)).alias("seq1"), reverse_complement(F.right("seq", F.lit(length))).alias("seq2"))


def day(c) -> F.Column:
    return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, begin, stop): from order to shipment in days, by customer."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    joined = o.join(line, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(F.col("o_custkey").alias("key"), day(F.col("o_orderdate")).alias("begin"), day(F.col("l_shipdate")).alias("stop")).where("begin < stop")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path_id, ids): a user's events of a day in order."""
    e = table(spark, sf_dir, "events")
    code = F.lit(7)
    for name, i in EVENT_IDS.items():
        code = F.when(F.col("event_type") == name, i).otherwise(code)
    steps = F.sort_array(F.collect_list(F.struct("ts", "event_id", code.alias("id"))))
    per = e.groupBy("user_id", day(F.col("ts")).alias("day")).agg(steps.alias("s"))
    return per.select((F.col("user_id") * 100_000 + F.col("day")).alias("path_id"), F.transform("s", lambda x: x["id"]).alias("ids"))


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_id, start_nid, end_nid): part to supplier to nation to region, and customer to nation."""
    t = lambda n: table(spark, sf_dir, n)
    region, nation = lambda c: F.col(c).cast("long") + 2, lambda c: F.col(c).cast("long") + 100
    supplier, part, customer = (lambda c, b=b: F.col(c) + b for b in (1_000_000, 1_000_000_000, 2_000_000_000))
    both = lambda df, a, b: df.select(a.alias("start_nid"), b.alias("end_nid"))
    edges = both(t("lineitem"), part("l_partkey"), supplier("l_suppkey")).unionByName(both(t("supplier"), supplier("s_suppkey"), nation("s_nationkey")))
    edges = edges.unionByName(both(t("nation"), nation("n_nationkey"), region("n_regionkey"))).unionByName(both(t("customer"), customer("c_custkey"), nation("c_nationkey")))
    return edges.distinct().select((F.col("start_nid") * 2_000_000_000 + F.col("end_nid")).alias("edge_id"), "start_nid", "end_nid")


# The same in SQL.
SEQ = f"translate(regexp_replace(translate(lower({{}}), '{ALPHABET}', '{BASES}'), '[^ACGT]', '', 'g'), 'CATG', '0123')"
READS = f"reads AS (SELECT doc_id + 1 AS read_id, {SEQ.format('text')} AS seq FROM documents)"
REFS = f"refs AS (SELECT item_id AS ref_id, {SEQ.format('text')} AS seq FROM benchmark)"


def rc(s: str) -> str:
    return f"reverse(translate({s}, '0123', '3210'))"


def kmers_sql(source: str, key: str, k: int) -> str:
    """(key, pos, f, kmer, forward) of a table's sequences."""
    return f"""(SELECT {key}, pos, least(f, {rc('f')}) AS kmer, f <= {rc('f')} AS forward FROM (
  SELECT {key}, pos, substr(seq, CAST(pos AS BIGINT) + 1, {k}) AS f FROM (
    SELECT {key}, seq, CAST(unnest(range(0, length(seq) - {k - 1})) AS INTEGER) AS pos FROM {source} WHERE length(seq) >= {k})))"""


INTERVALS = """iv AS (SELECT o_custkey AS key, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS b,
  date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
intervals AS (SELECT key, CAST(b AS INTEGER) AS begin, CAST(e AS INTEGER) AS stop FROM iv WHERE b < e)"""
PATHS = """paths AS (SELECT user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS path_id,
  list(CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 5 WHEN 'error' THEN 6 ELSE 7 END ORDER BY ts, event_id) AS ids
  FROM events GROUP BY user_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)))"""
GRAPH = """g AS (SELECT l_partkey + 1000000000 AS start_nid, l_suppkey + 1000000 AS end_nid FROM lineitem
  UNION SELECT s_suppkey + 1000000, CAST(s_nationkey AS BIGINT) + 100 FROM supplier
  UNION SELECT CAST(n_nationkey AS BIGINT) + 100, CAST(n_regionkey AS BIGINT) + 2 FROM nation
  UNION SELECT c_custkey + 2000000000, CAST(c_nationkey AS BIGINT) + 100 FROM customer),
edges AS (SELECT DISTINCT start_nid * 2000000000 + end_nid AS edge_id, start_nid, end_nid FROM g),
ends AS (SELECT start_nid AS node_id, 'out' AS side, edge_id, 'start' AS end_of FROM edges UNION ALL SELECT end_nid, 'in', edge_id, 'end' FROM edges)"""
