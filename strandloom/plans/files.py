"""Registered queries of readers, writers and small path operators: tables are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bases
from ..operators import edges as E
from ..operators import intervals as I
from ..operators import kmers as KM
from ..operators import nodes as N
from ..operators import paf as A
from ..operators import paths as P
from ..sources import alignments, config, reads, stored
from ..sources import sinks as S
from . import fixtures as X
from .registry import _COUNTS, _NODES, FLANK, K, _counts, _edge_rows, _slots, query
from .tables import shared_folder

MATE, LEN = 100, 200


def _new(spark: SparkSession, suffix: str = "") -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}{suffix}"


def _written(spark: SparkSession, lines: DataFrame, suffix: str = "") -> list[str]:
    path = _new(spark, suffix)
    S.write_text(lines, path)
    return [path]


def _lines(df: DataFrame, *parts) -> DataFrame:
    """One text a row; parts that name a column are its values."""
    return df.select(F.concat(*((F.col(p) if p in df.columns else F.lit(p)) if isinstance(p, str) else p for p in parts)).alias("value"))


# Libraries and reads.
@query("""SELECT CAST(250 AS INTEGER) AS max_rd_len, CAST(50 AS INTEGER) AS min_rd_len, r_name AS name, CAST(300 + r_regionkey AS INTEGER) AS avg_insert_len,
  CAST(50 AS INTEGER) AS "insert_SD", CAST(r_regionkey % 3 AS INTEGER) AS seq_profile, r_regionkey || '_1.fq.gz,' || r_regionkey || '_2.fq.gz' AS files FROM region""")
def source_config(spark, sf_dir):
    """A library for each region."""
    return _libraries(spark, sf_dir).select("max_rd_len", "min_rd_len", "name", "avg_insert_len", "insert_SD", "seq_profile", F.array_join("files", ",").alias("files"))


def _libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("r_regionkey")
    one = F.concat(F.lit("[LIB]\nname = "), "r_name", F.lit("\navg_insert_len = "), 300 + i, F.lit("\ninsert_SD = 50 ; the same for all\nseq_profile = "), i % 3, F.lit("\nf1 = "), i, F.lit("_1.fq.gz\nf2 = "), i, F.lit("_2.fq.gz"))
    text = X.table(spark, sf_dir, "region").agg(F.array_join(F.sort_array(F.collect_list(one)), "\n").alias("libs"))
    whole = text.select(F.concat(F.lit("[global_setting]\nmax_rd_len = 250 # longest\nmin_rd_len = 50\n"), "libs").alias("value"))
    return config.read_config(spark, _written(spark, whole)[0])


@query("SELECT r_name AS name, r_regionkey || '_' || i || '.fq.gz' AS file FROM region, (VALUES (1), (2)) t(i) WHERE r_regionkey % 3 = 2")
def source_long_read_files(spark, sf_dir):
    return config.long_read_files(_libraries(spark, sf_dir))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'fa' WHEN 1 THEN 'fa' WHEN 2 THEN 'fq' WHEN 3 THEN 'fq' END AS form FROM documents""")
def source_format(spark, sf_dir):
    """The format of a file name for each document; the last two have none."""
    suffix = F.element_at(F.array(*map(F.lit, (".fa", ".fasta.gz", ".fq", ".fastq.zst", ".txt", ".fa.x.gz"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return X.table(spark, sf_dir, "documents").select("doc_id", config.format_of(F.concat(F.lit("reads/d"), "doc_id", suffix)).alias("form"))


def _fastq(spark: SparkSession, sf_dir: str) -> list[str]:
    r = X.reads_n(spark, sf_dir).where("seq IS NOT NULL")
    return _written(spark, _lines(r, "@", "read_id", " doc ", "read_id", "\n", "seq", "\n+\n", F.expr("repeat('I', length(seq))")), ".fq")


_LETTERS = "l AS (SELECT doc_id + 1 AS read_id, regexp_replace(upper(text), '[^ACGTN]', '', 'g') AS s FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {_LETTERS} SELECT read_id, split_part(s, 'N', 1) AS seq, length(s) AS n_qual, 'doc ' || read_id AS annotation FROM l")
def source_reads(spark, sf_dir):
    return reads.read_records(spark, _fastq(spark, sf_dir)).select("read_id", "seq", F.length("qual").cast("long").alias("n_qual"), "annotation")


@query(f"WITH {_LETTERS} SELECT read_id, split_part(s, 'N', 1) AS seq FROM l WHERE length(split_part(s, 'N', 1)) >= {K + 10}")
def source_reads_long_enough(spark, sf_dir):
    return reads.scan_reads(spark, _fastq(spark, sf_dir), K).select("read_id", "seq")


_MATES = f"m AS (SELECT read_id, translate(left(seq, {MATE}), '0123', 'CATG') AS seq1, translate({X.rc(f'right(seq, {MATE})')}, '0123', 'CATG') AS seq2 FROM reads WHERE seq IS NOT NULL)"


def _mates(spark: SparkSession, sf_dir: str, last: int | None = None) -> tuple[list[str], list[str]]:
    """Two files in the order of the ids; the second ends after the id `last`."""
    p = X.pairs(spark, sf_dir, MATE).where("seq1 IS NOT NULL").coalesce(1).sortWithinPartitions("read_id")
    fasta = lambda c, rows: _written(spark, _lines(rows, ">", "read_id", "\n", bases.decode(F.col(c))), ".fa")
    return fasta("seq1", p), fasta("seq2", p if last is None else p.where(F.col("read_id") <= last))


@query(f"WITH {X.READS}, {_MATES} SELECT * FROM m WHERE length(seq1) >= {K + 20}")
def source_pairs(spark, sf_dir):
    return reads.scan_pairs(spark, *_mates(spark, sf_dir), K)


@query(f"WITH {X.READS}, {_MATES} SELECT count(*) AS n FROM m WHERE read_id > 150")
def source_pairs_unmatched(spark, sf_dir):
    return reads.unmatched_pairs(spark, *_mates(spark, sf_dir, 150)).agg(F.count("*").alias("n"))


# Edges.
_EDGES = f"WITH {X.REFS}, e AS (SELECT ref_id AS edge_id, ref_id * 2 AS start_nid, ref_id * 2 + 1 AS end_nid, translate(seq, '0123', 'CATG') AS seq FROM refs WHERE seq IS NOT NULL)"


@query(f"{_EDGES} SELECT *, length(seq) AS n_qual FROM e")
def source_edges(spark, sf_dir):
    got = reads.read_edges(spark, _written(spark, S.edge_lines(_edge_rows(spark, sf_dir))))
    return got.select("edge_id", "start_nid", "end_nid", "seq", F.length("qual").cast("long").alias("n_qual"))


@query(f"{_EDGES} SELECT *, edge_id || '-' || (edge_id + 1) AS path FROM e")
def source_edges_simplified(spark, sf_dir):
    e = _edge_rows(spark, sf_dir).withColumn("path", F.concat("edge_id", F.lit("-"), F.col("edge_id") + 1))
    return reads.read_edges(spark, _written(spark, S.edge_lines(e))).select("edge_id", "start_nid", "end_nid", "seq", "path")


@query(f"{_EDGES} SELECT 'edge_id:' || edge_id || chr(9) || 'start_nid:' || start_nid || chr(9) || 'end_nid:' || end_nid AS value FROM e")
def sink_debug(spark, sf_dir):
    return S.debug_lines(_edge_rows(spark, sf_dir).select("edge_id", "start_nid", "end_nid"))


@query(f"{_EDGES} SELECT count(*) AS n_edges, CAST(sum(length(seq)) AS BIGINT) AS bases, min(length(seq)) AS shortest, max(length(seq)) AS longest FROM e")
def edge_totals(spark, sf_dir):
    return E.edge_totals(_edge_rows(spark, sf_dir))


@query("""SELECT '  ' || (n_nationkey + 100) || ' -> ' || (n_regionkey + 2) || ' [label="' || n_nationkey || ' len:' || (n_nationkey + 1) || '"];' AS value FROM nation
  UNION ALL SELECT 'digraph G {' UNION ALL SELECT '}'""")
def sink_dot(spark, sf_dir):
    e = X.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("edge_id"), (F.col("n_nationkey") + 100).alias("start_nid"), (F.col("n_regionkey") + 2).alias("end_nid"), F.expr("repeat('0', n_nationkey + 1)").alias("seq"))
    return spark.createDataFrame([(x,) for x in S.dot_text(e).split("\n")], "value string")


# Reads and contigs out.
@query(f"WITH {X.READS} SELECT '>' || read_id || chr(9) || 'path:' || read_id * 2 || '-' || (read_id * 2 + 1) || '-;errorNum:' || read_id % 3 || chr(10) || translate(seq, '0123', 'CATG') AS value FROM reads")
def sink_corrected(spark, sf_dir):
    i = F.col("read_id")
    return S.corrected_lines(X.reads(spark, sf_dir).select(i, "seq", F.array(i * 2, i * 2 + 1).alias("path"), (i % 3).alias("errors")))


@query(f"""WITH {X.REFS} SELECT '>' || ref_id || chr(9) || 'path: ' || ref_id * 2 || '-' || (ref_id * 2 + 1) || ' Freq: ' || ref_id % 7 || chr(10)
  || rtrim(regexp_replace(translate(seq, '0123', 'CATG'), '(.{{80}})', '\\1' || chr(10), 'g'), chr(10)) AS value FROM refs""")
def sink_contigs(spark, sf_dir):
    i = F.col("ref_id")
    return S.contig_lines(X.refs(spark, sf_dir).select(i.alias("contig_id"), "seq", F.array(i * 2, i * 2 + 1).alias("path"), (i % 7).alias("freq")))


@query(f"""WITH {X.INTERVALS}, x AS (SELECT max(stop) OVER (PARTITION BY key ORDER BY begin, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, begin AS b FROM intervals)
SELECT CAST(b - a AS VARCHAR) AS value FROM x WHERE a < b""")
def sink_gaps(spark, sf_dir):
    lines = S.gap_lines(I.gaps(X.intervals(spark, sf_dir)).select(F.col("gap_begin").alias("begin"), F.col("gap_stop").alias("stop")))
    return spark.read.text(_written(spark, lines))


# Tables between stages.
@query(f"{_COUNTS} SELECT kmer, n FROM c WHERE n >= 3")
def store_kmers(spark, sf_dir):
    path = _new(spark)
    S.write_parquet(KM.solid(_counts(spark, sf_dir)), path)
    return stored.read_kmers(spark, path)


_NUMBERED = "SELECT node, n_in, n_out, row_number() OVER (ORDER BY node) + 1 AS node_id FROM d WHERE n_in > 1 OR n_out > 1"


@query(f"{_NODES} {_NUMBERED}")
def store_nodes(spark, sf_dir):
    path = _new(spark)
    S.write_parquet(N.number_nodes(N.branching(N.node_degrees(_slots(spark, sf_dir)))), path)
    return stored.read_nodes(spark, path)


@query(f"WITH {X.GRAPH} SELECT 'edges' AS name, count(*) AS n FROM edges UNION ALL SELECT 'nodes', count(DISTINCT node_id) FROM ends")
def store_sizes(spark, sf_dir):
    g = X.graph(spark, sf_dir)
    return stored.sizes(edges=g, nodes=E.edge_ends(g).select("node_id").distinct())


# Alignments; the lines of an order are the hits of a read.
_HITS = """h AS (SELECT CAST(l_orderkey AS VARCHAR) AS qname, 1000 AS qlen, l_partkey % 5 * 20 AS qstart, 1000 - l_suppkey % 4 * 25 AS qend,
  CASE WHEN l_linenumber % 2 = 1 THEN '+' ELSE '-' END AS strand, l_partkey AS tname, 600 AS tlen, l_partkey % 3 * 30 AS tstart, 600 - l_linenumber % 3 * 30 AS tend,
  100 + CAST(l_quantity AS BIGINT) AS nmatch, 300 + l_suppkey % 7 AS alnlen FROM lineitem)"""
_HIT_TYPES = "qname, CAST(qlen AS BIGINT) AS qlen, qstart, qend, strand, tname, CAST(tlen AS BIGINT) AS tlen, tstart, CAST(tend AS BIGINT) AS tend, nmatch, alnlen"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    strand = F.when(n % 2 == 1, "+").otherwise("-")
    cells = ("l_orderkey", F.lit(1000), F.col("l_partkey") % 5 * 20, 1000 - F.col("l_suppkey") % 4 * 25, strand, "l_partkey", F.lit(600), F.col("l_partkey") % 3 * 30, 600 - n % 3 * 30, 100 + F.col("l_quantity").cast("long"), 300 + F.col("l_suppkey") % 7, F.lit(60))
    rows = X.table(spark, sf_dir, "lineitem").select(F.concat_ws("\t", *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cells)).alias("value"))
    return alignments.read_paf(spark, _written(spark, rows))


@query(f"WITH {_HITS} SELECT {_HIT_TYPES} FROM h")
def source_paf(spark, sf_dir):
    return _hits(spark, sf_dir)


@query(f"WITH {_HITS} SELECT {_HIT_TYPES}, o_orderpriority AS read_seq FROM h JOIN orders ON qname = CAST(o_orderkey AS VARCHAR) WHERE o_orderkey % 2 = 0")
def source_paf_reads(spark, sf_dir):
    """Hits with a text of their read; half of the reads are there."""
    r = X.table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("read_id"), F.col("o_orderpriority").alias("seq"))
    return alignments.with_reads(_hits(spark, sf_dir), r)


@query(f"WITH {_HITS} SELECT {_HIT_TYPES} FROM h WHERE qname IN (SELECT qname FROM h GROUP BY qname HAVING count(*) > 1)")
def paf_multi_lines(spark, sf_dir):
    return A.drop_single(_hits(spark, sf_dir))


@query(f"""WITH {_HITS} SELECT {_HIT_TYPES} FROM h WHERE CASE
  WHEN qstart > {FLANK} AND qend < qlen - {FLANK} THEN tend - tstart > tlen * 3 // 4 AND nmatch > alnlen * 2 // 5
  WHEN qstart < {FLANK} AND qend > qlen - {FLANK} THEN qend - qstart > qlen * 3 // 4
  WHEN qstart <= {FLANK} THEN CASE WHEN strand = '+' THEN tend > tlen - {FLANK} ELSE tstart < {FLANK} END
  ELSE CASE WHEN strand = '+' THEN tstart < {FLANK} ELSE tend > tlen - {FLANK} END END""")
def paf_clean_lines(spark, sf_dir):
    return A.clean(_hits(spark, sf_dir), FLANK)


@query(f"""WITH {_HITS}, k AS (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY nmatch DESC, qstart, tname, strand, qend) AS k FROM h WHERE tname % 2 = 0 AND CASE
  WHEN qstart < {FLANK} THEN CASE WHEN strand = '+' THEN tlen - tend <= {FLANK} ELSE tstart <= {FLANK} END
  WHEN qlen - qend < {FLANK} THEN CASE WHEN strand = '+' THEN tstart <= {FLANK} ELSE tlen - tend <= {FLANK} END ELSE false END)
SELECT qname, tname, nmatch, qstart FROM k WHERE k = 1 AND NOT (tstart < {FLANK} AND tlen - tend < {FLANK})""")
def paf_seed_edge_lines(spark, sf_dir):
    unique = X.table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("tname"))
    return A.seed_edges(_hits(spark, sf_dir), FLANK, unique).select("qname", "tname", "nmatch", "qstart")


_MAPS = f"""b AS (SELECT l_orderkey, l_linenumber, 200 + l_partkey * 7 % 60 AS score, l_suppkey AS ref_id, l_partkey AS ref_start, {LEN} + l_partkey % 50 AS aln_len,
  CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, l_orderkey || '/' || (l_linenumber % 2 + 1) AS read_name, l_linenumber % 2 + 1 AS mate FROM lineitem),
kept AS (SELECT * FROM b WHERE aln_len >= {LEN + 3} AND score >= aln_len),
ok AS (SELECT l_orderkey FROM kept GROUP BY l_orderkey HAVING count(DISTINCT mate) = 2 AND (count(*) > 2 OR count(DISTINCT ref_id) > 1))"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings of an order's lines; the order's block ends with a # line."""
    i = X.table(spark, sf_dir, "lineitem")
    strand = F.when(F.col("l_partkey") % 2 == 0, "+").otherwise("-")
    length = LEN + F.col("l_partkey") % 50
    name = F.concat("l_orderkey", F.lit("/"), F.col("l_linenumber") % 2 + 1)
    row = F.concat_ws(" ", *(c.cast("string") for c in (200 + F.col("l_partkey") * 7 % 60, F.col("l_suppkey"), F.col("l_partkey"), length, F.lit("+"), F.lit(9), name, F.lit(0), length, strand, F.lit(210))))
    per = i.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", row.alias("row")))).alias("x"))
    return alignments.read_blocks(spark, _written(spark, _lines(per, F.array_join("x.row", "\n"), "\n# end")))


@query(f"""WITH {_MAPS} SELECT read_name, ref_id, CASE WHEN strand = '-' THEN ref_start + aln_len ELSE ref_start END AS start,
  CASE WHEN strand = '-' THEN ref_start ELSE ref_start + aln_len END AS stop, CAST(mate AS VARCHAR) AS mate FROM kept WHERE l_orderkey IN (SELECT l_orderkey FROM ok)""")
def source_pair_mappings(spark, sf_dir):
    return alignments.pair_mappings(_blocks(spark, sf_dir), LEN + 3).select("read_name", "ref_id", "start", "stop", "mate")


@query(f"WITH {_MAPS} SELECT read_name, ref_id, ref_start, aln_len, score FROM b WHERE aln_len >= {LEN + 3} AND score >= 210")
def source_single_mappings(spark, sf_dir):
    return alignments.single_mappings(_blocks(spark, sf_dir), LEN + 3).select("read_name", "ref_id", "ref_start", "aln_len", "score")


@query("""SELECT 'o' || l_orderkey AS read_name, CAST(500 AS BIGINT) AS read_len, CAST(l_linenumber * 10 AS BIGINT) AS qstart, CAST(l_linenumber * 10 + 60 AS BIGINT) AS qend, CAST(2 AS BIGINT) AS n_hits,
  l_partkey || ':+' || l_suppkey || ',' || l_suppkey || ':-' || l_partkey AS hits FROM lineitem""")
def source_fastmap(spark, sf_dir):
    n = F.col("l_linenumber")
    row = F.concat_ws("\t", F.lit("EM"), n * 10, n * 10 + 60, F.lit(2), F.concat("l_partkey", F.lit(":+"), "l_suppkey"), F.concat("l_suppkey", F.lit(":-"), "l_partkey"))
    per = X.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", row.alias("row")))).alias("x"))
    lines = _lines(per, "SQ\to", "l_orderkey", "\t500\n", F.array_join("x.row", "\n"), "\n//")
    return alignments.read_fastmap(spark, _written(spark, lines)).select("read_name", "read_len", "qstart", "qend", "n_hits", F.array_join("hits", ",").alias("hits"))


@query(f"""WITH a AS (SELECT l_partkey AS ref_id, l_orderkey AS query_id, 100 + l_partkey % 200 AS aln_len, 5 AS ref_b, 105 + l_partkey % 200 AS ref_e, l_linenumber % 2 = 1 AS minus, l_linenumber AS qry_b, l_linenumber + 100 + l_partkey % 200 AS qry_e FROM lineitem),
d AS (SELECT *, CAST(round((qry_e - qry_b + ref_e - ref_b) * (1 - CAST('97.3' AS DOUBLE) / 100) / 2) AS BIGINT) AS diff FROM a WHERE aln_len >= {LEN * 2 // 3})
SELECT ref_id, query_id, aln_len, minus, diff, 1 - CAST(diff AS DOUBLE) / aln_len AS identity FROM d""")
def source_local(spark, sf_dir):
    n, s = F.col("l_linenumber"), F.col("l_partkey") % 200
    cells = (F.col("l_partkey"), F.col("l_orderkey"), 100 + s, F.lit("97.3"), F.lit(0), F.lit(5), 105 + s, F.lit(1000), n % 2, n, n + 100 + s, F.lit(900))
    lines = X.table(spark, sf_dir, "lineitem").select(F.concat_ws(" ", *(c.cast("string") for c in cells)).alias("value"))
    return alignments.read_local(spark, _written(spark, lines), LEN).select("ref_id", "query_id", "aln_len", "minus", "diff", "identity")


@query(f"WITH {X.PATHS}, s AS (SELECT path_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM paths) SELECT path_id AS read_id, CAST(i - 1 AS INTEGER) AS step, CAST(id AS BIGINT) AS id, CAST((i - 1) * 10 AS BIGINT) AS start, CAST((i - 1) * 10 + id AS BIGINT) AS stop FROM s")
def sink_alignments(spark, sf_dir):
    """A step for each edge of a path, written and read back."""
    steps = F.transform("ids", lambda e, i: F.struct(e.alias("id"), (i * 10).alias("start"), (i * 10 + e).alias("stop")))
    lines = S.alignment_lines(X.paths(spark, sf_dir).select(F.col("path_id").alias("read_id"), steps.alias("steps")))
    return alignments.read_alignment_lines(spark, _written(spark, lines))


# Paths and edges.
_PARTS = f"""WITH RECURSIVE {X.PATHS}, e AS (SELECT s_suppkey AS edge_id, 2 + s_suppkey % 4 AS s, 2 + s_suppkey % 7 AS e FROM supplier),
h AS (SELECT l_orderkey AS pair_id, CAST(1 + l_linenumber % 2 AS INTEGER) AS mate, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, edge_id) AS i, s, e FROM lineitem JOIN e ON l_suppkey = edge_id),
w AS (SELECT a.pair_id, a.mate, CAST(2 AS BIGINT) AS i, CASE WHEN b.s IN (a.s, a.e) THEN b.s WHEN b.e IN (a.s, a.e) THEN b.e END AS n FROM h a JOIN h b USING (pair_id, mate) WHERE a.i = 1 AND b.i = 2
  UNION ALL SELECT w.pair_id, w.mate, h.i, CASE WHEN h.s = w.n THEN h.e WHEN h.e = w.n THEN h.s END FROM w JOIN h ON w.pair_id = h.pair_id AND w.mate = h.mate AND h.i = w.i + 1),
z AS (SELECT pair_id, mate, max(i) AS i FROM h GROUP BY pair_id, mate)"""


@query(f"{_PARTS} SELECT z.pair_id, z.mate, z.i = 1 OR w.n IS NOT NULL AS connected FROM z LEFT JOIN w ON z.pair_id = w.pair_id AND z.mate = w.mate AND z.i = w.i")
def path_chained(spark, sf_dir):
    """Lines of an order as hits of two mates; suppliers as edges."""
    k = F.col("s_suppkey")
    e = X.table(spark, sf_dir, "supplier").select(k.alias("edge_id"), (2 + k % 4).alias("start_nid"), (2 + k % 7).alias("end_nid"))
    h = X.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair_id"), (1 + F.col("l_linenumber") % 2).cast("int").alias("mate"), F.col("l_linenumber").alias("start"), F.col("l_suppkey").alias("edge_id"))
    return P.chained(h, e)


@query(f"""WITH {X.PATHS}, z AS (SELECT path_id, list_transform(ids, lambda x: CASE WHEN x = 6 THEN 0 ELSE x END) AS ids FROM paths WHERE len(ids) > 3),
a AS (SELECT path_id, CASE WHEN ids[1] = 0 THEN ids[2:] ELSE ids END AS ids FROM z), b AS (SELECT path_id, CASE WHEN ids[len(ids)] = 0 THEN ids[:len(ids) - 1] ELSE ids END AS ids FROM a)
SELECT path_id, array_to_string(list_reverse(ids), '-') AS path FROM b WHERE len(ids) > 3""")
def path_collected(spark, sf_dir):
    p = X.paths(spark, sf_dir).select("path_id", F.transform("ids", lambda x: F.when(x == 6, 0).otherwise(x)).alias("ids"))
    return P.collected(p).select("path_id", F.array_join("ids", "-").alias("path"))


_BASES = f"WITH {X.PATHS}, b AS (SELECT path_id, CAST({K - 1} + sum(30 + id * 10 - {K - 1}) AS BIGINT) AS bases FROM (SELECT path_id, unnest(ids) AS id FROM paths) GROUP BY path_id)"


def _path_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = spark.range(8).select(F.col("id").alias("edge_id"), (30 + F.col("id") * 10).alias("len"))
    return P.path_bases(X.paths(spark, sf_dir), lengths, K)


@query(f"{_BASES} SELECT path_id, bases FROM b")
def path_bases(spark, sf_dir):
    return _path_bases(spark, sf_dir)


@query(f"{_BASES} SELECT count(*) AS n_paths, CAST(sum(bases) AS BIGINT) AS bases, CAST(sum(bases) // count(*) AS BIGINT) AS mean FROM b")
def path_totals(spark, sf_dir):
    return P.totals(_path_bases(spark, sf_dir))


@query(f"""WITH {X.PATHS}, t AS (SELECT *, '-' || array_to_string(ids, '-') || '-' AS s FROM paths)
SELECT path_id, array_to_string(list_sort(list_intersect(ids, [2, 3, 9])), '-') AS common, array_to_string(list_sort(list_distinct(list_concat(ids, [2, 3, 9]))), '-') AS joined, list_has_all(ids, [2, 3]) AS holds,
  CAST(CASE WHEN contains(s, '-2-3-') THEN strpos(s, '-2-3-') // 2 + 1 ELSE 0 END AS INTEGER) AS place FROM t""")
def path_sets(spark, sf_dir):
    """Ids have one digit, so SQL finds places in their text."""
    some, part = F.array(F.lit(2), F.lit(3), F.lit(9)), F.array(F.lit(2), F.lit(3))
    text = lambda a: F.array_join(F.sort_array(a), "-")
    ids = F.col("ids")
    return X.paths(spark, sf_dir).select("path_id", text(bases.common(ids, some)).alias("common"), text(bases.union(ids, some)).alias("joined"), bases.holds_all(ids, part).alias("holds"), bases.place_of(ids, part).alias("place"))


@query(f"""WITH {X.GRAPH}, p AS (SELECT DISTINCT a.edge_id AS a, b.edge_id AS b, a.start_nid AS s, a.end_nid AS e, b.start_nid AS s2, b.end_nid AS e2 FROM edges a JOIN edges b ON a.end_nid = b.start_nid)
SELECT a, b, CASE WHEN s > 0 AND s IN (s2, e2) THEN s WHEN e > 0 AND e IN (s2, e2) THEN e ELSE 0 END AS node_id FROM p UNION ALL SELECT a, a, s FROM (SELECT DISTINCT a, s FROM p)""")
def edge_shared_node(spark, sf_dir):
    """Pairs of edges that follow each other, and each first one with itself."""
    g = X.graph(spark, sf_dir)
    p = g.alias("x").join(g.alias("y"), F.col("x.end_nid") == F.col("y.start_nid")).select(F.col("x.edge_id").alias("a"), F.col("y.edge_id").alias("b"))
    return E.shared_node(p.distinct().unionByName(p.select("a", F.col("a").alias("b")).distinct()), g)


@query(f"WITH {X.GRAPH} SELECT DISTINCT x.edge_id, x.end_of, y.edge_id AS next_id FROM ends x JOIN ends y ON x.node_id = y.node_id AND x.side <> y.side")
def edge_other_side(spark, sf_dir):
    return E.other_side(E.edge_ends(X.graph(spark, sf_dir)))


@query(f"""WITH {X.REFS}, e AS (SELECT ref_id AS edge_id, ref_id % 5 + 2 AS s, CASE WHEN ref_id % 2 = 0 THEN ref_id % 5 + 2 ELSE 1 END AS e, seq, CASE WHEN ref_id % 3 = 0 THEN left(seq, {K - 1}) ELSE left({X.rc('seq')}, {K - 1}) END AS node FROM refs)
SELECT edge_id, s AS start_nid, e AS end_nid, CASE WHEN s = e AND left(seq, {K - 1}) <> n.node THEN {X.rc('seq')} ELSE seq END AS seq FROM e LEFT JOIN (SELECT s AS id, min(node) AS node FROM e GROUP BY s) n ON n.id = e.s""")
def edge_self_cycles(spark, sf_dir):
    """Every second edge begins and ends at one of five nodes."""
    i, s = F.col("ref_id"), F.col("seq")
    e = X.refs(spark, sf_dir).select(i.alias("edge_id"), (i % 5 + 2).alias("start_nid"), F.when(i % 2 == 0, i % 5 + 2).otherwise(1).alias("end_nid"), s)
    at = F.when(i % 3 == 0, F.left(s, F.lit(K - 1))).otherwise(F.left(bases.reverse_complement(s), F.lit(K - 1)))
    nodes = X.refs(spark, sf_dir).groupBy((i % 5 + 2).alias("node_id")).agg(F.min(at).alias("node"))
    return E.turn_self_cycles(e, nodes, K)
