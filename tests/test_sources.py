from strandloom.sources import alignments, config, reads, sinks

CONFIG = """
[global_setting]
max_rd_len = 250  # longest
[LIB]
name = a
avg_insert_len = 500
asm_flag = 1
f1 = x_1.fq.gz
f2 = x_2.fq.gz
"""


def test_config(spark, tmp_path):
    (lib,) = config.parse_config(CONFIG)
    assert lib["max_rd_len"] == 250 and lib["files"] == ["x_1.fq.gz", "x_2.fq.gz"] and lib["asm_flag"] == 1
    assert config.parse_config(CONFIG, True)[0]["files"] == ["x_.Correct.fa.gz"]
    (tmp_path / "c").write_text(CONFIG)
    assert config.read_config(spark, str(tmp_path / "c")).first().avg_insert_len == 500
    try:
        config.parse_config("[LIB]\ncolour = 3")
        raise AssertionError("an unknown key passed")
    except ValueError:
        pass
    assert config.read_format("x.fastq.gz") == "fq" and config.read_format("y.fa") == "fa"


def test_reads_round_trip(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@1 left one\nACGTN\n+\nIIIII\n@2\nGGTT\n+\n@@@@\n")
    rows = {r.read_id: r for r in reads.read_records(spark, [str(tmp_path / "a.fq")]).collect()}
    assert rows[1].seq == "ACGT" and rows[1].annotation == "left one" and rows[2].qual == "@@@@"
    (tmp_path / "b.fa").write_text(">1\nACGTACGTACGTACGTACGTACGTACG\n>2\nAC")
    assert {r.seq for r in reads.scan_reads(spark, [str(tmp_path / "b.fa")], 5).collect()} == {"ACGTACGTACGTACGTACGTACGTACG"}
    p = [str(tmp_path / "b.fa")]
    assert reads.scan_pairs(spark, p, p, 5).count() == 1 and reads.unmatched_pairs(spark, p, p).count() == 0


def test_edges_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([(2, 3, 4, "0123", "5-6"), (3, 4, 0, "33", "")], "edge_id long, start_nid long, end_nid long, seq string, path string")
    sinks.write_text(sinks.edge_lines(edges), str(tmp_path / "e"))
    got = {r.edge_id: r for r in reads.read_edges(spark, [str(tmp_path / "e")]).collect()}
    assert got[2].seq == "CATG" and got[2].path == "5-6" and got[3].end_nid == 0
    lines = sinks.contig_lines(spark.createDataFrame([(1, "0" * 85, [2, 3], 7)], "contig_id long, seq string, path array<long>, freq long")).first().value
    assert lines == ">1\tpath: 2-3 Freq: 7\n" + "C" * 80 + "\n" + "C" * 5
    assert "3 -> 4" in sinks.dot_text(edges)
    assert sinks.split_edges(edges, 1).count() == 3


def test_alignments(spark, tmp_path):
    (tmp_path / "p.paf").write_text("r1\t100\t0\t90\t+\t2\t80\t1\t79\t70\t90\t60\n")
    assert alignments.read_paf(spark, [str(tmp_path / "p.paf")]).first().tname == 2
    row = "300 7 10 250 + 9 r/{} 0 250 {} 250"
    (tmp_path / "m.last").write_text("\n".join([row.format(1, "+"), row.format(2, "-"), row.format(2, "+"), "# end", row.format(1, "+"), "# end"]) + "\n")
    blocks = alignments.read_blocks(spark, [str(tmp_path / "m.last")])
    kept = alignments.pair_mappings(blocks, 203).collect()
    assert len(kept) == 3 and {(r.qstrand, r.start) for r in kept} == {("+", 10), ("-", 260)}
    assert alignments.single_mappings(blocks, 203).count() == 4
    (tmp_path / "x.la").write_text("1 2 200 95.0 0 5 205 1000 1 0 200 900\n1 2 100 95.0 0 5 105 1000 0 0 100 900\n")
    (la,) = alignments.read_local(spark, [str(tmp_path / "x.la")], 203).collect()
    assert la.minus and la["diff"] == 10 and abs(la.identity - 0.95) < 1e-9


def test_stream_counts(spark, tmp_path):
    from strandloom.streaming.kmer_stream import streaming_solid

    spark.createDataFrame([("01230123",), ("01230123",)], "seq string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq string").parquet(str(tmp_path / "in"))
    q = streaming_solid(stream, 4, 2).writeStream.outputMode("complete").format("memory").queryName("solid").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("solid").count() > 0


def test_fastmap_keeps_every_hit(spark, tmp_path):
    from strandloom.sources import alignments

    hits = [f"{i}:+{i}" for i in range(1500)]
    (tmp_path / "x.fastmap").write_text("SQ\tr1\t100\nEM\t0\t50\t1500\t" + "\t".join(hits) + "\nEM\t50\t100\t0\n//\n")
    got = {r.qstart: r for r in alignments.read_fastmap(spark, [str(tmp_path / "x.fastmap")]).collect()}
    assert got[0].hits == hits and got[50].hits == [] and got[0].read_name == "r1" and got[0].read_len == 100
