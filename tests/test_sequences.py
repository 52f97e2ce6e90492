import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from strandloom.functions import bases
from strandloom.operators import chains, codes, walks
from strandloom.operators import kmers as KM
from strandloom.operators import nodes as N
from strandloom.operators import unitigs as U
from strandloom.operators.align import align, band_matches, edit_counts


def rc(s):
    return s[::-1].translate(str.maketrans("0123", "3210"))


def brute_unitigs(reads, k):
    solid = {min(r[i : i + k], rc(r[i : i + k])) for r in reads for i in range(len(r) - k + 1)}
    both = solid | {rc(x) for x in solid}
    after, before = {}, {}
    for x in both:
        after.setdefault(x[:-1], set()).add(x[-1])
        before.setdefault(x[1:], set()).add(x[0])
    linear = lambda v: len(after.get(v, ())) == 1 and len(before.get(v, ())) == 1
    forked = lambda v: len(after.get(v, ())) > 1 or len(before.get(v, ())) > 1
    found = set()
    for x in both:
        if not linear(x[:-1]):
            s = x
            while linear(s[-k + 1 :]):
                s += next(iter(after[s[-k + 1 :]]))
            found.add(min(s, rc(s)))
    return solid, found, {s for s in found if forked(s[: k - 1]) and forked(s[-k + 1 :])}


def sample_reads():
    r = random.Random(3)
    g = "".join(r.choice("0123") for _ in range(300))
    return [g, g[:100] + "012" + g[103:200], rc(g[50:250]), g[20:60] + g[200:240]]


def test_reverse_complement_and_canonical(spark):
    df = spark.createDataFrame([("0123",), ("",), ("3321",), (None,)], "s string")
    rows = df.select("s", bases.reverse_complement(bases.reverse_complement(F.col("s"))).alias("again"), bases.canonical(F.col("s")).alias("c")).collect()
    assert all(r.s == r.again for r in rows)
    assert [r.c for r in rows] == ["0123", "", min("3321", rc("3321")), None]


def test_kmers_and_counts_do_not_depend_on_the_strand(spark):
    reads = sample_reads()
    a = spark.createDataFrame([(x,) for x in reads], "seq string")
    b = spark.createDataFrame([(rc(x),) for x in reads], "seq string")
    ca, cb = ({r.kmer: r.n for r in KM.count_kmers(d, 7).collect()} for d in (a, b))
    assert ca == cb and sum(ca.values()) == sum(len(x) - 6 for x in reads)
    assert {r.n: r.kmers for r in KM.histogram(KM.count_kmers(a, 7)).collect()}.keys() <= {1, 2, 3}


def test_cut_at_unknown_and_next_kmer(spark):
    df = spark.createDataFrame([("ACNGT",), ("NACG",), ("ACG",)], "s string")
    assert [r[0] for r in df.select(bases.cut_at_unknown(F.col("s"))).collect()] == ["AC", "", "ACG"]
    row = spark.range(1).select(bases.next_kmer(F.lit("0123"), F.lit("0")), bases.previous_kmer(F.lit("0123"), F.lit("3")), bases.join_unitigs(F.lit("0123"), F.lit("2300"), 3)).first()
    assert list(row) == ["1230", "3012", "012300"]


def test_unitigs_match_brute_force(spark):
    for k in (5, 7):
        solid, every, inner = brute_unitigs(sample_reads(), k)
        df = spark.createDataFrame([(x,) for x in solid], "kmer string")
        edges, nodes = U.unitigs(df, k)
        assert {r.seq for r in edges.collect()} == inner
        assert U.unpaired(edges, nodes).count() == 0
        whole, _ = U.unitigs(df, k, keep_tips=True)
        assert {r.seq for r in whole.collect()} == every
        assert {r.kmer for r in U.kmers_of(whole, k).collect()} == solid


def edges_of(spark, rows):
    return spark.createDataFrame([(i, s, len(s), a, sa, b, sb) for i, s, a, sa, b, sb in rows], "edge_id long, seq string, len int, start_nid long, start_side string, end_nid long, end_side string")


def test_simplify_merges_a_chain_and_drops_a_tip(spark):
    rows = [
        (2, "00112", 2, "out", 3, "in"),
        (3, "12330", 3, "out", 4, "in"),  # joins edge 2 at node 3
        (4, "30211", 4, "out", 5, "in"),
        (5, "30100", 4, "out", 6, "in"),
        (6, "30", 4, "out", 7, "in"),  # a tip
        (7, "11222", 5, "out", 2, "in"),
        (8, "00311", 6, "out", 2, "in"),
    ]
    out = U.simplify(edges_of(spark, rows), 3, 4).collect()
    seqs = {min(r.seq, rc(r.seq)) for r in out}
    assert min("00112330", rc("00112330")) in seqs
    assert all(r.edge_id != 6 for r in out)


def test_nodes_are_numbered_in_order(spark):
    df = spark.createDataFrame([("3",), ("0",), ("012301230",), ("012301231",)], "node string")
    got = {r.node: r.node_id for r in N.number_nodes(df).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(got) and min(got.values()) == 2


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_alignment_against_plain_dynamic_programming():
    r = random.Random(1)
    for _ in range(200):
        a = "".join(r.choice("0123") for _ in range(r.randint(0, 12)))
        b = "".join(r.choice("0123") for _ in range(r.randint(0, 12)))
        ins, dele, mis, same = edit_counts(a, b)
        assert ins + dele + mis == distance(a, b)
        assert dele + mis + same == len(a) and ins + mis + same == len(b)
    a = "".join(r.choice("0123") for _ in range(400))
    b = a[:100] + "3" + a[100:200] + a[203:]
    ins, dele, mis, same = align(a, b)
    assert dele + mis + same == len(a) and ins + mis + same == len(b) and same >= 394
    assert band_matches("0123", "0123", 2) == 4 and band_matches("", "01", 2) == 0


def test_counts_match_brute_force_at_every_length(spark):
    r = random.Random(5)
    reads = ["".join(r.choice("0123") for _ in range(r.randint(0, 120))) for _ in range(40)] + ["0" * 200, "01" * 90, "", None]
    reads += reads[:7]
    df = spark.createDataFrame([(x,) for x in reads], "seq string").repartition(3)
    for k in (1, 2, 5, 20, 21, 31, 32, 33):
        want = Counter(min(x[i : i + k], rc(x[i : i + k])) for x in reads if x for i in range(len(x) - k + 1))
        assert {r.kmer: r.n for r in KM.count_kmers(df, k).collect()} == want
        assert {r.kmer for r in KM.count_kmers(df, k, 3).collect()} == {x for x, n in want.items() if n >= 3}


def test_kmers_are_shuffled_in_stretches():
    r = random.Random(6)
    stretch, low = codes.stretches(pa.array(["".join(r.choices("0123", k=20_000)), "0" * 500]), 21)
    mers, of = codes.kmers_of(stretch, 21)
    assert len(mers) == 19_980 + 480 and 4 * len(stretch) < len(mers)
    part = {}
    assert all(part.setdefault(x, h) == h for x, h in zip(mers.tolist(), low[of].tolist()))


def brute_positions(items):
    before, out = dict(items), {}
    for i in before:
        at, n = i, 0
        while before[at] is not None and n <= len(before):
            at, n = before[at], n + 1
        if before[at] is None:
            out[i] = (at, n)
    return out


def test_positions_by_contraction_match_steps(spark, monkeypatch):
    r = random.Random(8)
    ids = r.sample(range(-(10**12), 10**12), 700)
    items = [(a, b, r.randint(0, 5)) for a, b in zip(ids, [None, *ids])]
    items = [(a, None if r.random() < 0.02 else b, p) for a, b, p in items]
    ring = r.sample(range(2 * 10**12, 3 * 10**12), 40)
    items += [(a, b, a % 3) for a, b in zip(ring, [ring[-1], *ring])]
    want = brute_positions([(a, b) for a, b, _ in items])
    assert len(want) == 700
    df = spark.createDataFrame(items, "id long, prev long, part int").repartition(3)
    for held in (chains.HELD, 100):
        monkeypatch.setattr(chains, "HELD", held)
        assert {x.id: (x.head, x.dist) for x in chains.positions(df).collect()} == want


def test_items_of_a_chain_meet_in_one_task(spark):
    r = random.Random(9)
    read = "".join(r.choices("0123", k=2_000))
    at = U.oriented(spark.createDataFrame([(min(read[i : i + 21], rc(read[i : i + 21])),) for i in range(1_980)], "kmer string"), 21).collect()
    part = {x.id: x.part for x in at}
    same = [part[x.id] == part[y.id] for x in at for y in ([z for z in at if z.a == x.b] if x.id % 50 == 0 else [])]
    assert len(part) == 3_960 and sum(same) > len(same) // 2


def plain_links(g, a, b, budget):
    """The same without looking ahead."""
    found, stack = [], [([a], 0)]
    while stack and len(found) < 2:
        path, used = stack.pop()
        for n in g.next(path[-1]):
            if n == b:
                found.append([*path, b])
            elif n not in path and used + len(g.seq(n)) - g.k + 1 <= budget:
                stack.append(([*path, n], used + len(g.seq(n)) - g.k + 1))
    return found


def test_links_match_a_plain_search():
    r = random.Random(4)
    some = 0
    for _ in range(40):
        rows = [(i, "".join(r.choices("0123", k=r.randint(3, 8))), r.randint(2, 7), r.choice(["in", "out"]), r.randint(2, 7), r.choice(["in", "out"])) for i in range(2, 12)]
        g = walks.Graph(rows, 3)
        for _ in range(60):
            a, b = (r.choice([-1, 1]) * r.randint(2, 11) for _ in "ab")
            want = plain_links(g, a, b, 12)
            assert g.links(a, b, 12) == want
            some += bool(want)
    assert some > 100


def test_links_leave_a_thicket_that_does_not_lead_there():
    # Layers of two parallel edges: 2^60 ways, none to the edge asked for.
    rows = [(2 + 2 * i + j, "01" + "0123"[j] + "2", 2 + i, "out", 3 + i, "in") for i in range(60) for j in (0, 1)]
    rows.append((500, "0123", 900, "out", 901, "in"))
    assert walks.Graph(rows, 3).links(2, 500, 1_000) == []


def test_links_leave_a_thicket_whose_way_out_is_taken():
    # From 2 through edge 3 into layers of two parallel edges, which lead back to where 3 begins: no way goes past 3 twice.
    rows = [(2, "0120", 1, "out", 2, "in"), (3, "0121", 2, "out", 3, "in"), (4, "0122", 3, "out", 10, "in")]
    rows += [(10 + 2 * i + j, "01" + "0123"[j] + "2", 10 + i, "out", 11 + i, "in") for i in range(40) for j in (0, 1)]
    rows += [(200, "0103", 50, "out", 2, "in"), (201, "0133", 3, "out", 51, "in"), (300, "0123", 51, "out", 301, "in")]
    g = walks.Graph(rows, 3)
    assert g.links(2, 300, 1_000) == [[2, 3, 201, 300]]
    assert g.links(2, 300, 1_000, {2, 300}) == [[2, 3, 201, 300]]


def test_barred_links_match_a_plain_search():
    def plain(g, path, used, b, budget, barred):
        for n in g.next(path[-1]):
            if n == b:
                yield [*path, b]
            elif abs(n) not in barred | {abs(o) for o in path} and used + g.added(n) <= budget:
                yield from plain(g, [*path, n], used + g.added(n), b, budget, barred)

    r = random.Random(5)
    some = 0
    for _ in range(40):
        rows = [(i, "".join(r.choices("0123", k=r.randint(3, 8))), r.randint(2, 7), r.choice(["in", "out"]), r.randint(2, 7), r.choice(["in", "out"])) for i in range(2, 12)]
        g = walks.Graph(rows, 3)
        for _ in range(60):
            a, b, c = r.sample(range(2, 12), 3)
            a, b = a * r.choice([-1, 1]), b * r.choice([-1, 1])
            barred = {abs(a), abs(b), c}
            want = list(plain(g, [a], 0, b, 12, barred))
            got = g.links(a, b, 12, barred)
            assert len(got) == min(2, len(want)) and all(x in want for x in got)
            some += len(want) == 1
    assert some > 100


def test_seeds_as_numbers_match_those_as_text():
    r = random.Random(8)
    for k in (1, 2, 5, 21, 31, 32):
        seqs = {i: "".join(r.choices("0123", k=r.randint(k, k + 60))) for i in range(1, 12)}
        seqs[12] = seqs[1][: k + 3]  # k-mers that occur twice
        g = walks.Graph([(i, s, 0, "out", 0, "in") for i, s in seqs.items()], k)
        index = g.index()
        assert isinstance(index, walks.Mers) and g.index() is index
        for _ in range(60):
            s = r.choice(list(seqs.values()))
            read = "".join(r.choices("0123", k=r.randint(0, 700))) + r.choice(("", "N", "4")) + r.choice((s, walks.rc(s), s[: k - 1]))
            assert g.seed(read, index) == g.seed(read, g.texts())
        for _ in range(40):  # substitutions are counted as base by base
            o = r.choice([1, -3])
            s = g.seq(o)
            read = "".join(c if r.random() < 0.9 else r.choice("0123") for c in s) + "0"
            assert g.along(read, o, 0) == ([o], len(s), sum(a != b for a, b in zip(s, read)))
            assert g.enters(o) == s[k - 1]
    assert isinstance(walks.Graph([(1, "0" * 40, 0, "out", 0, "in")], 33).index(), dict)


def test_the_index_of_seeds_holds_and_takes_little_memory(monkeypatch):
    import tracemalloc

    digits = random.Random(6).choices("0123", k=1_000_000)
    seqs = {i: "".join(digits[i * 200 : i * 200 + 200]) for i in range(1, 5_000)}
    seqs[0] = seqs[7]  # occurs twice
    monkeypatch.setattr(walks.Mers, "HELD", 1 << 17)
    monkeypatch.setattr(walks.Mers, "STEP", 1 << 15)
    tracemalloc.start()
    m = walks.Mers(seqs, 21)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    bases = 200 * len(seqs)
    fixed = (1 << m.BITS) + 16 * (1 << m.RANGES)  # the tables, whatever the graph's size
    assert held < fixed + 6 * bases and peak < fixed + (16 << m.RANGES) + 30 * bases
    for i in (1, 2, 77, 4_999):
        assert m.first(seqs[i][5:]) == (0, 1, i, 5) and m.first(walks.rc(seqs[i])) == (0, -1, i, 179)
    assert m.first(seqs[7]) is None and m.first(seqs[7][:50] + seqs[9][:30]) == (50, 1, 9, 0)


def test_solid_kmers_are_counted_once_for_the_graph(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    text = "".join(random.Random(3).choices("0123", k=60))
    mers = sorted({min(m, walks.rc(m)) for i in range(40) for m in [text[i : i + 21]]})
    solid = spark.createDataFrame([(m,) for m in mers], "kmer string").mapInArrow(run, "kmer string")
    U.unitigs(solid, 21, True)
    assert seen.value == len(mers)
