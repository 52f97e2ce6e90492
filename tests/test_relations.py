import random

from strandloom.operators import consensus as C
from strandloom.operators import edges as E
from strandloom.operators import intervals as I
from strandloom.operators import minimizers as M
from strandloom.operators import paf as A
from strandloom.operators import paths as P
from strandloom.operators.walks import Graph


def intervals(spark, rows):
    return spark.createDataFrame(rows, "key long, begin int, stop int")


def test_intervals(spark):
    r = random.Random(2)
    rows = [(k, b, b + r.randint(1, 9)) for k in (1, 2) for b in (r.randint(0, 60) for _ in range(12))]
    df = intervals(spark, rows)
    cover = {k: {x for kk, b, e in rows if kk == k for x in range(b, e)} for k in (1, 2)}
    free = {(k, x) for k, c in cover.items() for x in range(min(c), max(c)) if x not in c}
    assert {(g.key, x) for g in I.gaps(df).collect() for x in range(g.gap_begin, g.gap_stop)} == free
    depth = {(d.key, x): d.depth for d in I.depth(df).collect() for x in range(d.begin, d.stop)}
    assert depth == {(k, x): sum(kk == k and b <= x < e for kk, b, e in rows) for k, c in cover.items() for x in c}
    inside = {a for a in rows if any(b[0] == a[0] and b[1] <= a[1] and b[2] >= a[2] and b != a for b in rows)}
    assert {tuple(x) for x in I.contained(df).collect()} == inside
    pairs = {(a, b) for a in rows for b in rows if a[0] == b[0] and a[1] < b[2] and b[1] < a[2]}
    got = [((x.l_key, x.l_begin, x.l_stop), (x.r_key, x.r_begin, x.r_stop)) for x in I.overlap_join(df.distinct(), df.distinct(), 4).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs


def test_edge_classes_and_bubbles(spark):
    rows = [(2, 2, 3), (3, 3, 4), (4, 3, 5), (5, 4, 6), (6, 4, 6), (7, 6, 6)]
    e = spark.createDataFrame(rows, "edge_id long, start_nid long, end_nid long")
    kinds = {r.edge_id: r["class"] for r in E.classify(e, E.edge_ends(e)).collect()}
    assert kinds[7] == "self_cycle" and kinds[3] == "semi_unique" and kinds[4] == "unique"
    assert {r.edge_id for r in E.bubbles(e).collect()} == {5, 6}
    near = {(r.source, r.node_id): r.used for r in E.neighbourhood(e.selectExpr("start_nid", "end_nid", "1 AS len"), e.selectExpr("start_nid AS source").distinct(), 2).collect()}
    assert near[(2, 4)] == 2 and (2, 6) not in near and near[(6, 6)] == 0


def test_paths(spark):
    df = spark.createDataFrame([(1, [2, 3, 4]), (2, [4, 3, 2]), (3, [5, 3, 4]), (4, [2, 3, 2])], "path_id long, ids array<long>")
    assert {tuple(r.ids): r.freq for r in P.multiset(df).collect()} == {(2, 3, 4): 2, (4, 3, 5): 1, (2, 3, 2): 1}
    assert {(r.col, r.edge_id): r.freq for r in P.column_frequency(P.columns(df, 3)).collect()}[(0, 3)] == 4
    assert P.without_repeats(df).count() == 3
    freq = spark.createDataFrame([(0, 3, 9), (1, 4, 8), (1, 5, 2), (2, 6, 7), (2, 7, 6)], "col long, edge_id long, freq long")
    assert P.greedy_consensus(freq.where("col < 2"), 5).count() == 2
    assert P.greedy_consensus(freq, 5).count() == 0  # the conflict in column 2 discards all
    hits = spark.createDataFrame([(1, 1, 0, 2), (1, 1, 5, 3), (1, 2, 0, 4), (1, 2, 6, 3)], "pair_id long, mate int, start int, edge_id long")
    assert sorted(r.ids for r in P.pair_paths(hits).collect()) == [[2, 3, 4], [3, 2], [3, 4], [4, 3, 2]]


def test_seeds(spark):
    r = random.Random(5)
    ref = "".join(r.choice("0123") for _ in range(300))
    refs = spark.createDataFrame([(1, ref)], "ref_id long, seq string")
    reads = spark.createDataFrame([(7, ref[50:220])], "read_id long, seq string")
    m = M.match(M.sliding(reads, 15, 5, "read_id"), M.sliding(refs, 15, 5, "ref_id"))
    assert all(x.ref_pos - x.read_pos == 50 and x.same for x in m.collect())
    c = M.chain_statistics(m, 15, 14).collect()
    assert len(c) == 1 and c[0].stop - c[0].start > 140
    hit = M.unique_hits(M.fixed(reads, 15, 10, 10), M.sliding(refs, 15, 5, "ref_id")).collect()
    assert len(hit) == 1 and hit[0].ref_pos - hit[0].read_pos == 50


def test_alignment_cleaning(spark):
    cols = "qname string, qlen long, qstart long, qend long, strand string, tname long, tlen long, tstart long, tend long, nmatch long, alnlen long"
    rows = [
        ("inside", 1000, 300, 600, "+", 2, 310, 0, 300, 200, 300),
        ("inside-thin", 1000, 300, 600, "+", 2, 310, 0, 300, 100, 300),
        ("start", 1000, 10, 600, "+", 2, 900, 310, 890, 500, 590),
        ("start-off", 1000, 10, 600, "+", 2, 900, 100, 690, 500, 590),
        ("end-minus", 1000, 500, 990, "-", 2, 900, 420, 895, 400, 490),
    ]
    df = spark.createDataFrame(rows, cols)
    assert {r.qname for r in A.clean(df, 40).collect()} == {"inside", "start", "end-minus"}
    unique = spark.createDataFrame([(2,)], "tname long")
    assert {r.qname for r in A.seed_edges(df, 40, unique).collect()} == {"start", "end-minus"}


def test_graph_walks():
    k = 4
    rows = [(2, "001230", 2, "out", 3, "in"), (3, "230112", 3, "out", 4, "in"), (4, "230332", 3, "out", 5, "in")]
    g = Graph(rows, k)
    assert g.next(2) == [3, 4] and g.path_seq([2, 4]) == "001230332"
    assert g.along("01230332", 2, 1) == ([2, 4], 8, 0)
    assert g.map_read("1230332", g.index())[0] == [2, 4]
    assert g.links(2, 4, 10) == [[2, 4]]
    assert g.best_path("001230112", 2, 0) == [2, 3]


def test_consensus():
    rows = [[2, 3, 4], [2, 3, 4], [-4, -3, -2], [5, 3, 6], [5, 3, 6], [7, 3]]
    assert C.consensus(3, rows, 2) == [([2, 3, 4], 3), ([5, 3, 6], 2)]
    assert C.merge_halves([([2, 3], 4), ([3, 5], 2)], 3) == [([2, 3, 5], 2)]


def test_extension_takes_the_only_overlapping_path():
    lengths = dict.fromkeys(range(2, 12), 1500)
    assert C.extend({2: [2, 3, 4, 7], 7: [4, 7, 5, 6]}, {2, 7}, lengths, 2000)[2] == [2, 3, 4, 7, 5, 6]
    assert C.extend({2: [2, 3, 4, 7], 7: [4, 7, 5]}, {2, 7}, lengths, 2000)[2] == [2, 3, 4, 7]


def test_consensus_counts_every_read_of_a_path(spark):
    rows = [(i, [2, 3, 4]) for i in range(5)] + [(9, [-4, -3]), (10, [3, 7])]
    paths = spark.createDataFrame(rows, "read_id long, path array<long>")
    got = {r.anchor: (list(r.path), r.freq) for r in C.consensus_paths(paths, 2).collect()}
    assert got[2] == ([2, 3, 4], 5) and got[3] == ([2, 3, 4], 6)
