"""All registered queries of the sequence and graph operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bases
from ..operators import consensus as C
from ..operators import edges as E
from ..operators import intervals as I
from ..operators import kmers as KM
from ..operators import minimizers as M
from ..operators import nodes as N
from ..operators import paf as A
from ..operators import paths as P
from ..operators import unitigs as U
from ..operators import walks as W
from ..sources import sinks as S
from . import fixtures as X

K, SEED, WIDTH, STEP, ANCHOR, FLANK, LEAST = 21, 15, 5, 10, 4, 40, 5

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_COUNTS = f"WITH {X.READS}, c AS (SELECT kmer, count(*) AS n FROM {X.kmers_sql('reads', 'read_id', K)} GROUP BY kmer)"
_NODES = f"""{_COUNTS}, o AS (SELECT kmer FROM c WHERE n >= 3 UNION SELECT {X.rc('kmer')} FROM c WHERE n >= 3),
s AS (SELECT left(kmer, {K - 1}) AS node, 'out' AS side, right(kmer, 1) AS base FROM o
      UNION SELECT right(kmer, {K - 1}), 'in', left(kmer, 1) FROM o),
slots AS (SELECT DISTINCT node, side, base FROM s WHERE node <= {X.rc('node')}),
d AS (SELECT node, CAST(sum(CAST(side = 'in' AS INTEGER)) AS BIGINT) AS n_in, CAST(sum(CAST(side = 'out' AS INTEGER)) AS BIGINT) AS n_out FROM slots GROUP BY node)"""


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KM.count_kmers(X.reads(spark, sf_dir), K)


def _solid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KM.count_kmers(X.reads(spark, sf_dir), K, KM.SOLID)


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.node_slots(_solid(spark, sf_dir), K)


@query(f"{_COUNTS} SELECT kmer, n FROM c")
def kmer_count(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(f"{_COUNTS} SELECT kmer, n FROM c WHERE n >= 3")
def kmer_solid(spark, sf_dir):
    return _solid(spark, sf_dir)


@query(f"{_COUNTS} SELECT least(n, 3) AS n, count(*) AS kmers FROM c GROUP BY 1")
def kmer_histogram(spark, sf_dir):
    return KM.histogram(_counts(spark, sf_dir))


@query(f"WITH {X.READS} SELECT read_id, {X.rc('seq')} AS rc, least(seq, {X.rc('seq')}) AS canonical, translate(seq, '0123', 'CATG') AS letters FROM reads")
def revcomp_canonical(spark, sf_dir):
    s = F.col("seq")
    return X.reads(spark, sf_dir).select("read_id", bases.reverse_complement(s).alias("rc"), bases.canonical(s).alias("canonical"), bases.decode(s).alias("letters"))


@query(f"WITH {X.READS} SELECT read_id, seq FROM reads WHERE length(seq) >= {K + 10}")
def read_filter_len(spark, sf_dir):
    return KM.long_enough(X.reads(spark, sf_dir), K)


@query("SELECT doc_id + 1 AS read_id, split_part(regexp_replace(upper(text), '[^ACGTN]', '', 'g'), 'N', 1) AS seq FROM documents")
def read_cut_n(spark, sf_dir):
    return X.reads_n(spark, sf_dir).select("read_id", bases.cut_at_unknown(F.col("seq")).alias("seq"))


@query(f"""WITH {X.READS}, p AS (SELECT read_id, left(seq, 100) AS seq1, {X.rc('right(seq, 100)')} AS seq2 FROM reads)
SELECT read_id, seq1, seq2 FROM p WHERE length(seq1) >= {K + 20} AND length(seq2) >= {K + 20}""")
def paired_reads(spark, sf_dir):
    p = X.pairs(spark, sf_dir, 100)
    return p.select("read_id", "seq1").join(p.select("read_id", "seq2"), "read_id").where((F.length("seq1") >= K + 20) & (F.length("seq2") >= K + 20))


@query(f"{_NODES} SELECT node, side, base FROM slots")
def node_slots(spark, sf_dir):
    return _slots(spark, sf_dir)


@query(f"{_NODES} SELECT node, n_in, n_out FROM d")
def node_degree(spark, sf_dir):
    return N.node_degrees(_slots(spark, sf_dir))


@query(f"{_NODES} SELECT node, n_in, n_out, row_number() OVER (ORDER BY node) + 1 AS node_id FROM d WHERE n_in > 1 OR n_out > 1")
def node_branching(spark, sf_dir):
    return N.number_nodes(N.branching(N.node_degrees(_slots(spark, sf_dir))))


_CLASS = f"""WITH {X.GRAPH}, sides AS (SELECT node_id, side, list_sort(list(DISTINCT edge_id)) AS ids FROM ends GROUP BY node_id, side),
near AS (SELECT edge_id, max(CASE WHEN end_of = 'start' THEN ids END) AS a, max(CASE WHEN end_of = 'end' THEN ids END) AS b
  FROM ends LEFT JOIN sides ON ends.node_id = sides.node_id AND ends.side <> sides.side GROUP BY edge_id),
x AS (SELECT edges.edge_id, start_nid = end_nid AS self, coalesce(a, []) AS a, coalesce(b, []) AS b FROM edges LEFT JOIN near ON edges.edge_id = near.edge_id)"""


@query(f"""{_CLASS} SELECT edge_id, CASE WHEN self THEN 'self_cycle'
  WHEN (len(a) = 1 AND len(b) = 1 AND a = b) OR (len(a) > 1 AND len(b) > 1 AND list_has_any(a, b)) THEN 'two_cycle'
  WHEN len(a) <= 1 AND len(b) <= 1 THEN 'unique' WHEN (len(a) = 1 AND len(b) > 1) OR (len(a) > 1 AND len(b) = 1) THEN 'semi_unique' ELSE 'repeat' END AS class FROM x""")
def edge_class(spark, sf_dir):
    e = X.graph(spark, sf_dir)
    return E.classify(e, E.edge_ends(e))


@query(f"""{_CLASS} SELECT edge_id, len(a) = 1 AS start_unique, len(b) = 1 AS end_unique, len(a) = 1 AND len(b) = 1 AS is_unique FROM x""")
def edge_direction_unique(spark, sf_dir):
    e = X.graph(spark, sf_dir)
    return E.direction_unique(e, E.edge_ends(e))


def _parallel(spark, sf_dir) -> DataFrame:
    """Lines as edges from part to supplier: parallel ones where a pair occurs again."""
    line = X.table(spark, sf_dir, "lineitem")
    return line.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("edge_id"), (F.col("l_partkey") + 1_000_000_000).alias("start_nid"), (F.col("l_suppkey") + 1_000_000).alias("end_nid"))


@query("""WITH e AS (SELECT l_orderkey * 100 + l_linenumber AS edge_id, l_partkey AS p, l_suppkey AS s FROM lineitem),
n AS (SELECT edge_id, count(*) OVER (PARTITION BY p, s) - 1 AS n_parallel FROM e) SELECT edge_id, n_parallel FROM n WHERE n_parallel > 0""")
def edge_bubble(spark, sf_dir):
    return E.bubbles(_parallel(spark, sf_dir))


@query(f"WITH {X.GRAPH} SELECT node_id, edge_id, side, end_of FROM ends WHERE node_id NOT IN (SELECT c_custkey + 2000000000 FROM customer UNION SELECT l_partkey + 1000000000 FROM lineitem UNION SELECT s_suppkey + 1000000 FROM supplier UNION SELECT CAST(n_nationkey AS BIGINT) + 100 FROM nation)")
def edge_dangling(spark, sf_dir):
    """With the regions left out of the nodes, the edges that enter them dangle."""
    e = X.graph(spark, sf_dir)
    return E.dangling(e, e.select(F.col("start_nid").alias("node_id")).distinct()).select("node_id", "edge_id", "side", "end_of")


@query(f"""WITH RECURSIVE {X.GRAPH}, w AS (SELECT DISTINCT start_nid AS source, start_nid AS node_id, CAST(0 AS BIGINT) AS used FROM edges
  UNION SELECT source, end_nid, used + 1 FROM w JOIN edges ON node_id = start_nid WHERE used + 1 <= 3)
SELECT source, node_id, min(used) AS used FROM w GROUP BY source, node_id""")
def neighbourhood(spark, sf_dir):
    e = X.graph(spark, sf_dir).withColumn("len", F.lit(1))
    return E.neighbourhood(e, e.select(F.col("start_nid").alias("source")).distinct(), 3)


def _fixed_sql(source: str, key: str) -> str:
    return f"(SELECT {key}, win, pos, kmer, forward FROM (SELECT *, row_number() OVER (PARTITION BY {key}, win ORDER BY kmer, pos) AS k FROM (SELECT *, pos // {STEP} AS win FROM {X.kmers_sql(source, key, SEED)})) WHERE k = 1)"


@query(f"WITH {X.REFS} SELECT ref_id, CAST(win AS INTEGER) AS win, pos, kmer, forward FROM {_fixed_sql('refs', 'ref_id')}")
def minimizer_fixed(spark, sf_dir):
    return M.fixed(X.refs(spark, sf_dir), SEED, STEP)


def _sliding_sql(source: str, key: str) -> str:
    """Each run's smallest (k-mer, position) as text, then distinct."""
    return f"""(SELECT DISTINCT {key}, CAST(substr(m, {SEED + 1}, 10) AS INTEGER) AS pos, left(m, {SEED}) AS kmer, right(m, 1) = '1' AS forward FROM (
  SELECT {key}, pos, min(kmer || lpad(CAST(pos AS VARCHAR), 10, '0') || CAST(CAST(forward AS INTEGER) AS VARCHAR)) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN {WIDTH - 1} PRECEDING AND CURRENT ROW) AS m
  FROM {X.kmers_sql(source, key, SEED)}) WHERE pos >= {WIDTH - 1})"""


@query(f"WITH {X.REFS} SELECT ref_id, pos, kmer, forward FROM {_sliding_sql('refs', 'ref_id')}")
def minimizer_sliding(spark, sf_dir):
    return M.sliding(X.refs(spark, sf_dir), SEED, WIDTH, "ref_id")


_MATCH = f"""WITH {X.READS}, {X.REFS}, q AS (SELECT * FROM {_sliding_sql('reads', 'read_id')}), r AS (SELECT * FROM {_sliding_sql('refs', 'ref_id')}),
m AS (SELECT read_id, ref_id, q.pos AS read_pos, r.pos AS ref_pos, q.forward = r.forward AS same FROM q JOIN r ON q.kmer = r.kmer)"""


def _matches(spark, sf_dir) -> DataFrame:
    return M.match(M.sliding(X.reads(spark, sf_dir), SEED, WIDTH, "read_id"), M.sliding(X.refs(spark, sf_dir), SEED, WIDTH, "ref_id"))


@query(f"{_MATCH} SELECT * FROM m")
def seed_match(spark, sf_dir):
    return _matches(spark, sf_dir)


@query(f"""WITH {X.READS}, {X.REFS}, q AS (SELECT * FROM {_fixed_sql('reads', 'read_id')} WHERE win < 10), r AS (SELECT * FROM {_sliding_sql('refs', 'ref_id')}),
o AS (SELECT kmer, any_value(ref_id) AS ref_id, any_value(pos) AS ref_pos, any_value(forward) AS rf FROM r GROUP BY kmer HAVING count(*) = 1),
h AS (SELECT read_id, win, q.pos AS read_pos, ref_id, ref_pos, q.forward = rf AS same, row_number() OVER (PARTITION BY read_id ORDER BY win) AS k FROM q JOIN o ON q.kmer = o.kmer)
SELECT read_id, CAST(win AS INTEGER) AS win, read_pos, ref_id, ref_pos, same FROM h WHERE k = 1""")
def seed_unique_hit(spark, sf_dir):
    return M.unique_hits(M.fixed(X.reads(spark, sf_dir), SEED, STEP, 10), M.sliding(X.refs(spark, sf_dir), SEED, WIDTH, "ref_id"))


_CHAIN = f"""{_MATCH}, v AS (SELECT *, sum(CASE WHEN same THEN 1 ELSE -1 END) OVER p AS vote, count(*) OVER p AS n FROM m WINDOW p AS (PARTITION BY read_id, ref_id)),
j AS (SELECT * FROM v WHERE n >= 3 AND vote <> 0 AND same = (vote > 0)),
a AS (SELECT *, read_pos - lag(read_pos) OVER l AS step, (ref_pos - lag(ref_pos) OVER l) * CASE WHEN same THEN 1 ELSE -1 END AS rstep FROM j WINDOW l AS (PARTITION BY read_id, ref_id ORDER BY read_pos, ref_pos)),
c AS (SELECT read_id, ref_id, same, count(*) AS n_matches, CAST(sum(least(step, {SEED})) + {SEED} AS BIGINT) AS mapped, CAST(min(read_pos - step) AS BIGINT) AS start, CAST(max(read_pos) + {SEED} AS BIGINT) AS stop
      FROM a WHERE abs(step - rstep) < 0.15 * step + 5 GROUP BY read_id, ref_id, same),
chains AS (SELECT * FROM c WHERE mapped > 60 AND stop - start > {K} * 2 / 3)"""


def _chains(spark, sf_dir) -> DataFrame:
    return M.chain_statistics(_matches(spark, sf_dir), SEED, K * 2 / 3)


@query(f"{_CHAIN} SELECT * FROM chains")
def seed_chain_stats(spark, sf_dir):
    return _chains(spark, sf_dir)


def _paf(spark, sf_dir) -> DataFrame:
    """Chains as alignments; the edge's range is the whole edge."""
    lens = lambda df, k, n: df.select(k, F.length("seq").cast("long").alias(n))
    c = _chains(spark, sf_dir).join(lens(X.reads(spark, sf_dir), "read_id", "qlen"), "read_id").join(lens(X.refs(spark, sf_dir), "ref_id", "tlen"), "ref_id")
    return c.select(F.col("read_id").alias("qname"), "qlen", F.col("start").alias("qstart"), F.col("stop").alias("qend"), F.when(F.col("same"), "+").otherwise("-").alias("strand"), F.col("ref_id").alias("tname"), "tlen", F.lit(0).cast("long").alias("tstart"), F.least("tlen", F.col("stop") - F.col("start")).alias("tend"), F.col("mapped").alias("nmatch"), (F.col("stop") - F.col("start")).alias("alnlen"))


_PAF = f"""{_CHAIN}, paf AS (SELECT chains.read_id AS qname, CAST(length(reads.seq) AS BIGINT) AS qlen, start AS qstart, stop AS qend, CASE WHEN same THEN '+' ELSE '-' END AS strand, chains.ref_id AS tname,
  CAST(length(refs.seq) AS BIGINT) AS tlen, CAST(0 AS BIGINT) AS tstart, least(CAST(length(refs.seq) AS BIGINT), stop - start) AS tend, mapped AS nmatch, stop - start AS alnlen
  FROM chains JOIN reads ON chains.read_id = reads.read_id JOIN refs ON chains.ref_id = refs.ref_id)"""


@query(f"""{_PAF} SELECT * FROM paf WHERE CASE
  WHEN qstart > {FLANK} AND qend < qlen - {FLANK} THEN tend - tstart > tlen * 3 // 4 AND nmatch > alnlen * 2 // 5
  WHEN qstart < {FLANK} AND qend > qlen - {FLANK} THEN qend - qstart > qlen * 3 // 4
  WHEN qstart <= {FLANK} THEN CASE WHEN strand = '+' THEN tend > tlen - {FLANK} ELSE tstart < {FLANK} END
  ELSE CASE WHEN strand = '+' THEN tstart < {FLANK} ELSE tend > tlen - {FLANK} END END""")
def paf_clean(spark, sf_dir):
    return A.clean(_paf(spark, sf_dir), FLANK)


@query(f"""{_PAF}, k AS (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY nmatch DESC, qstart, tname) AS k FROM paf WHERE CASE
  WHEN qstart < {FLANK} THEN CASE WHEN strand = '+' THEN tlen - tend <= {FLANK} ELSE tstart <= {FLANK} END
  WHEN qlen - qend < {FLANK} THEN CASE WHEN strand = '+' THEN tstart <= {FLANK} ELSE tlen - tend <= {FLANK} END ELSE false END)
SELECT tname, qname, qlen, qstart, qend, strand, tlen, tstart, tend, nmatch, alnlen FROM k WHERE k = 1 AND NOT (tstart < {FLANK} AND tlen - tend < {FLANK})""")
def paf_seed_edge(spark, sf_dir):
    return A.seed_edges(_paf(spark, sf_dir), FLANK, X.refs(spark, sf_dir).select(F.col("ref_id").alias("tname")))


@query(f"{_PAF} SELECT * FROM paf WHERE qname IN (SELECT qname FROM paf GROUP BY qname HAVING count(*) > 1)")
def paf_multi(spark, sf_dir):
    return A.drop_single(_paf(spark, sf_dir))


@query(f"""WITH {X.INTERVALS}, x AS (SELECT key, max(stop) OVER (PARTITION BY key ORDER BY begin, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_begin, begin AS gap_stop FROM intervals)
SELECT key, gap_begin, gap_stop FROM x WHERE gap_begin < gap_stop""")
def interval_gaps(spark, sf_dir):
    return I.gaps(X.intervals(spark, sf_dir))


_DEPTH = f"""WITH {X.INTERVALS}, ev AS (SELECT key, begin AS pt, 1 AS d FROM intervals UNION ALL SELECT key, stop, -1 FROM intervals),
st AS (SELECT key, pt, sum(d) AS d FROM ev GROUP BY key, pt HAVING sum(d) <> 0),
dp AS (SELECT key, pt AS begin, lead(pt) OVER (PARTITION BY key ORDER BY pt) AS stop, CAST(sum(d) OVER (PARTITION BY key ORDER BY pt) AS BIGINT) AS depth FROM st)"""


@query(f"{_DEPTH} SELECT * FROM dp WHERE stop IS NOT NULL AND depth > 0")
def interval_depth(spark, sf_dir):
    return I.depth(X.intervals(spark, sf_dir))


@query(f"""{_DEPTH}, thin AS (SELECT key, begin, stop, lag(stop) OVER (PARTITION BY key ORDER BY begin) AS p FROM dp WHERE stop IS NOT NULL AND depth < 2),
isl AS (SELECT *, sum(CASE WHEN p = begin THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY begin) AS i FROM thin)
SELECT key, min(begin) AS begin, max(stop) AS stop FROM isl GROUP BY key, i HAVING max(stop) - min(begin) < 1000""")
def interval_thin_runs(spark, sf_dir):
    return I.thin_runs(X.intervals(spark, sf_dir))


@query(f"""WITH {X.INTERVALS}, d AS (SELECT DISTINCT key, begin, stop FROM intervals)
SELECT key, begin, stop FROM d a WHERE EXISTS (SELECT 1 FROM d b WHERE a.key = b.key AND b.begin <= a.begin AND b.stop >= a.stop AND b.stop - b.begin > a.stop - a.begin)""")
def interval_contained(spark, sf_dir):
    return I.contained(X.intervals(spark, sf_dir))


@query(f"""WITH {X.INTERVALS}, d AS (SELECT DISTINCT key, begin FROM intervals)
SELECT a.key, a.begin, min(abs(a.begin - b.begin)) AS distance FROM d a JOIN d b ON a.key = b.key AND a.begin <> b.begin GROUP BY a.key, a.begin""")
def interval_nearest(spark, sf_dir):
    return I.nearest(X.intervals(spark, sf_dir))


_BINS = f"""WITH {X.INTERVALS}, bb AS (SELECT key, unnest(range(CAST(floor(begin / 10.0) AS BIGINT) + 1, greatest(CAST(floor(begin / 10.0) AS BIGINT) + 1, CAST(ceil(stop / 10.0) AS BIGINT) - 2) + 1)) AS bin FROM intervals WHERE stop - begin > 20),
bins AS (SELECT key, bin, count(*) AS depth FROM bb GROUP BY key, bin)"""


@query(f"{_BINS} SELECT * FROM bins")
def interval_bins(spark, sf_dir):
    return I.bins(X.intervals(spark, sf_dir), 10)


@query(f"""{_BINS}, o AS (SELECT key, bin, bin - row_number() OVER (PARTITION BY key ORDER BY bin) AS r FROM bins WHERE depth = 1),
l AS (SELECT key, min(bin) AS first_bin, count(*) AS n_bins FROM o GROUP BY key, r),
k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n_bins DESC, first_bin) AS k FROM l) SELECT key, first_bin, n_bins FROM k WHERE k = 1""")
def interval_longest_run(spark, sf_dir):
    return I.longest_single_run(I.bins(X.intervals(spark, sf_dir), 10))


_OVER = f"""WITH {X.INTERVALS}, gg AS (SELECT key, max(stop) OVER (PARTITION BY key ORDER BY begin, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS begin, begin AS stop FROM intervals)"""


@query(f"""WITH {X.INTERVALS}, d AS (SELECT DISTINCT key, begin, stop FROM intervals), e AS (SELECT DISTINCT user_id AS key, 10227 + CAST(floor(value * 10) AS INTEGER) AS begin, 10227 + CAST(floor(value * 10) AS INTEGER) + 30 AS stop FROM events)
SELECT d.key AS l_key, d.begin AS l_begin, d.stop AS l_stop, e.key AS r_key, e.begin AS r_begin, e.stop AS r_stop FROM d JOIN e ON d.key = e.key AND d.begin < e.stop AND e.begin < d.stop""")
def interval_overlap(spark, sf_dir):
    d = X.intervals(spark, sf_dir).distinct()
    b = (F.lit(10227) + F.floor(F.col("value") * 10).cast("int")).alias("begin")
    e = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), b).withColumn("stop", F.col("begin") + 30).distinct()
    return I.overlap_join(d, e, 64)


def _text(ids: str = "ids") -> F.Column:
    return F.array_join(ids, "-").alias("path")


@query(f"""WITH {X.PATHS}, k AS (SELECT CASE WHEN ids <= list_reverse(ids) THEN ids ELSE list_reverse(ids) END AS ids FROM paths)
SELECT array_to_string(ids, '-') AS path, count(*) AS freq FROM k GROUP BY ids""")
def path_multiset(spark, sf_dir):
    return P.multiset(X.paths(spark, sf_dir)).select(_text(), F.col("freq").cast("long").alias("freq"))


@query(f"WITH {X.PATHS} SELECT DISTINCT unnest(ids) AS edge_id, path_id FROM paths")
def path_inverted_index(spark, sf_dir):
    return P.inverted_index(X.paths(spark, sf_dir))


_COLS = f"""WITH {X.PATHS}, c AS (SELECT path_id, unnest(ids) AS edge_id, generate_subscripts(ids, 1) - list_position(ids, {ANCHOR}) AS col FROM paths WHERE list_contains(ids, {ANCHOR})),
f AS (SELECT CAST(col AS BIGINT) AS col, edge_id, count(*) AS freq FROM c GROUP BY col, edge_id)"""


@query(f"{_COLS} SELECT * FROM f")
def path_column_freq(spark, sf_dir):
    return P.column_frequency(P.columns(X.paths(spark, sf_dir), ANCHOR))


_DOM = f"""{_COLS}, r AS (SELECT *, row_number() OVER l AS k, coalesce(lead(freq) OVER l, 0) AS second FROM f WINDOW l AS (PARTITION BY col ORDER BY freq DESC, edge_id)),
dom AS (SELECT col, edge_id, freq AS top, second, CASE WHEN freq >= {LEAST} AND (second = 0 OR (second <= {LEAST} AND freq >= 2 * second)) THEN 'kept' WHEN freq >= {LEAST} THEN 'conflict' ELSE 'stop' END AS state FROM r WHERE k = 1)"""


@query(f"{_DOM} SELECT * FROM dom")
def path_dominance(spark, sf_dir):
    return P.dominant(P.column_frequency(P.columns(X.paths(spark, sf_dir), ANCHOR)), LEAST)


@query(f"""{_DOM.replace(' FROM f WINDOW', ' FROM f WHERE col >= 0 WINDOW')}, o AS (SELECT *, row_number() OVER (ORDER BY col) - 1 AS i FROM dom),
b AS (SELECT min(i) AS i FROM o WHERE state <> 'kept' OR col <> i),
x AS (SELECT count(*) AS bad FROM o, b WHERE o.i = b.i AND o.col = o.i AND o.state = 'conflict')
SELECT col, edge_id, top FROM o, b, x WHERE state = 'kept' AND (b.i IS NULL OR o.i < b.i) AND bad = 0""")
def path_consensus_greedy(spark, sf_dir):
    return P.greedy_consensus(P.column_frequency(P.columns(X.paths(spark, sf_dir), ANCHOR)), LEAST)


@query(f"""WITH {X.PATHS}, p AS (SELECT unnest(ids) AS edge_id, generate_subscripts(ids, 1) AS i, len(ids) AS n FROM paths)
SELECT edge_id, CAST(sum(CASE WHEN i = 1 OR i = n THEN 1 ELSE 2 END) AS DOUBLE) / 2 AS coverage FROM p GROUP BY edge_id""")
def path_edge_coverage(spark, sf_dir):
    return P.edge_coverage(X.paths(spark, sf_dir))


@query(f"WITH {X.PATHS} SELECT edge_id, least(count(*), 256) AS freq FROM (SELECT unnest(ids) AS edge_id FROM paths) GROUP BY edge_id")
def path_statistics(spark, sf_dir):
    return P.statistics(X.paths(spark, sf_dir))


@query(f"WITH {X.PATHS} SELECT path_id, array_to_string(ids, '-') AS path FROM paths WHERE len(list_distinct(ids)) = len(ids)")
def path_without_repeats(spark, sf_dir):
    return P.without_repeats(X.paths(spark, sf_dir)).select("path_id", _text())


# Iterative and sequential operators: SQL can't express these; tests/ holds them against brute force.
def _graph(spark, sf_dir, keep_tips: bool = True) -> tuple[DataFrame, DataFrame]:
    return U.unitigs(_solid(spark, sf_dir), K, keep_tips)


def _simple(spark, sf_dir) -> DataFrame:
    return U.simplify(_graph(spark, sf_dir)[0], K, 2 * K)


@query()
def unitigs(spark, sf_dir):
    return _graph(spark, sf_dir, False)[0]


@query()
def graph_simplify(spark, sf_dir):
    return _simple(spark, sf_dir)


@query()
def read_correct(spark, sf_dir):
    return W.correct(KM.long_enough(X.reads(spark, sf_dir), K), _simple(spark, sf_dir), K).select("read_id", "seq", F.array_join("path", ",").alias("path"), "errors")


@query()
def pair_merge(spark, sf_dir):
    return W.merge_pairs(X.pairs(spark, sf_dir, 100), _simple(spark, sf_dir), K, 400).select("read_id", "mate", "seq", F.array_join("path", ",").alias("path"))


@query()
def long_path(spark, sf_dir):
    return W.long_paths(X.refs(spark, sf_dir).withColumnRenamed("ref_id", "read_id"), _simple(spark, sf_dir), K).select("read_id", F.array_join("path", ",").alias("path"))


@query()
def contigs(spark, sf_dir):
    edges = _simple(spark, sf_dir)
    paths = W.correct(KM.long_enough(X.reads(spark, sf_dir), K), edges, K).select("read_id", "path")
    return C.contigs(C.consensus_paths(paths, 2), edges, K).select(F.array_join("path", ",").alias("path"), "freq", "seq", "len")


# Scalar functions, sinks and path predicates.
@query(f"""WITH {X.READS}, c AS (SELECT DISTINCT kmer FROM {X.kmers_sql('reads', 'read_id', K)})
SELECT kmer, substr(kmer, 2) || '0' AS after, '3' || left(kmer, {K - 1}) AS before, translate(kmer, '0123', '3210') AS complement FROM c""")
def kmer_extend(spark, sf_dir):
    k = F.col("kmer")
    return _counts(spark, sf_dir).select("kmer", bases.next_kmer(k, F.lit("0")).alias("after"), bases.previous_kmer(k, F.lit("3")).alias("before"), bases.complement(k).alias("complement"))


@query(f"""WITH {X.READS} SELECT read_id, left(seq, 60) || substr(substr(seq, {60 - K + 2}, 60), {K}) AS joined, right(left(seq, 60), {K - 1}) = left(substr(seq, {60 - K + 2}, 60), {K - 1}) AS overlap
FROM reads WHERE length(seq) >= 120""")
def unitig_join(spark, sf_dir):
    """Two overlapping pieces of each read, put together again."""
    r = X.reads(spark, sf_dir).where(F.length("seq") >= 120)
    a, b = bases.piece(F.col("seq"), 0, 60), bases.piece(F.col("seq"), 60 - K + 1, 60)
    return r.select("read_id", bases.join_unitigs(a, b, K).alias("joined"), bases.overlaps(a, b, K).alias("overlap"))


@query(f"""WITH {X.PATHS}, t AS (SELECT path_id, ids, ',' || array_to_string(ids, ',') || ',' AS s FROM paths)
SELECT path_id, len(list_distinct(ids)) < len(ids) AS cyclic, contains(s, ',2,3,') OR contains(s, ',3,2,') AS holds, list_position(ids, 4) AS first_4 FROM t""")
def path_predicates(spark, sf_dir):
    ids = F.col("ids")
    part = F.array(F.lit(2), F.lit(3))
    first = F.array_position(ids, 4)
    return X.paths(spark, sf_dir).select("path_id", bases.has_cycle(ids).alias("cyclic"), bases.contains_path(ids, part).alias("holds"), F.when(first > 0, first).cast("int").alias("first_4"))


def _edge_rows(spark, sf_dir) -> DataFrame:
    return X.refs(spark, sf_dir).select(F.col("ref_id").alias("edge_id"), (F.col("ref_id") * 2).alias("start_nid"), (F.col("ref_id") * 2 + 1).alias("end_nid"), "seq")


@query(f"""WITH {X.REFS} SELECT '@' || ref_id || chr(9) || ref_id * 2 || chr(9) || (ref_id * 2 + 1) || chr(10) || translate(seq, '0123', 'CATG') || chr(10) || '+' || chr(10) || repeat('I', length(seq)) AS value FROM refs""")
def sink_edges(spark, sf_dir):
    return S.edge_lines(_edge_rows(spark, sf_dir))


@query(f"""WITH {X.REFS}, r AS (SELECT *, translate(seq, '0123', 'CATG') AS l FROM refs)
SELECT ref_id || '/1' AS name, left(l, 80) AS seq FROM r WHERE length(l) > 160 UNION ALL SELECT ref_id || '/2', right(l, 80) FROM r WHERE length(l) > 160
UNION ALL SELECT CAST(ref_id AS VARCHAR), l FROM r WHERE length(l) <= 160""")
def sink_split_edges(spark, sf_dir):
    return S.split_edges(_edge_rows(spark, sf_dir), 80)


@query(f"{_MATCH}, p AS (SELECT read_id, ref_id, min(read_pos) AS pos FROM m GROUP BY read_id, ref_id) SELECT read_id, ref_id AS best_ref FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY pos, ref_id) AS k FROM p) WHERE k = 1")
def seed_first_ref(spark, sf_dir):
    """Each read's reference with the leftmost match."""
    m = _matches(spark, sf_dir).groupBy("read_id").agg(F.min(F.struct("read_pos", "ref_id")).alias("x"))
    return m.select("read_id", F.col("x.ref_id").alias("best_ref"))
