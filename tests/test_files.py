import pytest
from pyspark.sql import functions as F

from strandloom.operators import edges, paths
from strandloom.operators.walks import Graph
from strandloom.sources import config
from strandloom.sources.options import Options


def test_options():
    ok = Options("out", "lib.cfg", 81, longest_read=250)
    for stage in ("preprocess", "count", "construct", "simplify", "consensus"):
        assert ok.check(stage) is ok
    assert ok.longest_tip == 250
    wrong = {"filter_size": ("count", 1000), "window": ("preprocess", 21), "tip": ("preprocess", 100), "longest_read": ("simplify", 130), "least_map": ("simplify", 20), "least_cover": ("consensus", 11), "extend": ("consensus", 999), "prefix": ("construct", "")}
    for name, (stage, value) in wrong.items():
        with pytest.raises(ValueError, match=name):
            Options(**({"prefix": "out", "config": "lib.cfg", "k": 81} | {name: value})).check(stage)


def test_formats_agree(spark):
    names = ["a.fa", "b.fasta.gz", "c.fq", "x/d.fastq.zst"]
    got = spark.createDataFrame([(n,) for n in names], "p string").select(config.format_of(F.col("p"))).collect()
    assert [r[0] for r in got] == [config.read_format(n) for n in names]


def test_a_thicket_is_looked_at_less_far():
    """Ten layers of bubbles have 1,024 ways; the reader still gets ways, and each is a walk."""
    rows, k = [], 3
    for layer in range(10):
        for side in range(2):
            i = 2 + 2 * layer + side
            rows.append((i, "01" + "0123"[side] * 3 + "01", 2 + layer, "out", 3 + layer, "in"))
    rows.append((100, "2201", 0, "out", 2, "in"))
    graph = Graph(rows, k)
    assert graph.extensions(100, 50) is None and len(graph.extensions(100, 20)) == 16
    ways = graph.ways(100, 50)
    assert ways and len(ways) <= 64 and all(graph.next(a) and b in graph.next(a) for w in ways for a, b in zip([100, *w], w, strict=False))
    assert len(graph.extensions(100, 1)) == 2


def test_chains_and_shared_nodes(spark):
    e = spark.createDataFrame([(2, 10, 11), (3, 11, 12), (4, 11, 13), (5, 20, 21)], "edge_id long, start_nid long, end_nid long")
    hits = [(1, 1, 0, 2), (1, 1, 5, 3), (1, 1, 9, 4), (2, 1, 0, 2), (2, 1, 5, 5), (3, 2, 0, 5)]
    got = {(r.pair_id, r.mate): r.connected for r in paths.chained(spark.createDataFrame(hits, "pair_id long, mate int, start long, edge_id long"), e).collect()}
    assert got == {(1, 1): True, (2, 1): False, (3, 2): True}
    pairs = spark.createDataFrame([(2, 3), (2, 5), (3, 4)], "a long, b long")
    assert {(r.a, r.b): r.node_id for r in edges.shared_node(pairs, e).collect()} == {(2, 3): 11, (2, 5): 0, (3, 4): 11}


def test_small_paths(spark):
    p = spark.createDataFrame([(1, [0, 2, 3, 4, 5, 0]), (2, [0, 2, 3, 4]), (3, [2, 3])], "path_id long, ids array<long>")
    assert {r.path_id: r.ids for r in paths.collected(p).collect()} == {1: [5, 4, 3, 2]}
    lengths = spark.createDataFrame([(2, 30), (3, 40)], "edge_id long, len long")
    total = paths.path_bases(p.where("path_id = 3"), lengths, 21)
    assert total.first().bases == 50 and tuple(paths.totals(total).first()) == (1, 50, 50)
    assert tuple(paths.totals(total.limit(0)).first())[:2] == (0, 0)
