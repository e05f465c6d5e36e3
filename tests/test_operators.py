"""Hand-checkable cases: scores, windows, scans, readers and sinks."""

import random

import pytest
from pyspark.sql import functions as F

from regnet.functions import motif_math as mm
from regnet.functions.names import attribute, without_suffix
from regnet.functions.sequences import match_score
from regnet.operators import genes, intervals, network, scan, sites
from regnet.params import Params, preset
from regnet.plans import networks
from regnet.sources import annotation, motif_files, sinks, tables

SITE = "GAATTCGAATTC"


@pytest.fixture(scope="module")
def motif(spark):
    pwm = [[float(c == x) for x in "ACGT"] for c in SITE]
    return spark.createDataFrame([("EcoRI", "EcoRI", pwm, [0.25] * 4, None)], "motif_id string, motif_name string, pwm array<array<double>>, background array<double>, ln_odds double")


@pytest.fixture(scope="module")
def sequence(spark):
    rng = random.Random(3)
    s = "".join(rng.choice("AC") for _ in range(867))
    for at in (3, 35, 87, 199, 711):
        s = s[:at] + SITE + s[at + 12 :]
    return spark.createDataFrame([("seq1", s)], "seqname string, seq string")


def test_motif_properties(motif):
    r = mm.describe(motif).first()
    assert (r.information_content, r.consensus, r.length) == (24.0, SITE, 12)


@pytest.mark.parametrize("seq,score", [(SITE, 24.0), ("GAATTCGAATAC", 18.0), ("GAATTCGAATAA", 12.0), ("GAATTCGATACG", 0.0), ("GAATTCCTTAAG", 0.0), ("AAAAAAAAAAAA", 0.0), ("AAAAAACAAAAA", 0.0), ("GAATTC", None)])
def test_match_score(motif, seq, score):
    got = motif.select(match_score(mm.information_matrix(F.col("pwm")), F.col("pwm"), F.lit(seq))).first()[0]
    assert got == score


def test_shuffle_is_one_permutation(motif):
    a = motif.select(mm.shuffled(F.col("pwm"), 5).alias("p")).first().p
    assert all(sum(r) == 1 for r in a)
    assert len({(x, y) for x, y in zip(SITE, (r.index(1.0) for r in a), strict=True)}) == len(set(SITE))


def test_scan_finds_both_strands(motif, sequence):
    hits = scan.scored(scan.scan(sequence, motif, p_value=1e-4), motif).collect()
    assert sorted({h.start_pos for h in hits}) == [3, 35, 87, 199, 711]
    assert len(hits) == 10 and {h.score for h in hits} == {24.0}


def test_scan_across_tiles(motif, sequence, monkeypatch):
    monkeypatch.setattr(scan, "TILE", 40)
    small = scan.tiles(sequence, 11, 40).mapInArrow(scan._kernel([("EcoRI", [[float(c == x) for x in "ACGT"] for c in SITE], [0.25] * 4, None, None)], 1e-4, False, False), scan._HIT)
    assert sorted({h.start_pos for h in small.collect()}) == [3, 35, 87, 199, 711]


def _hits(spark, places, score=24.0):
    return spark.createDataFrame([("g", "t", a, a + 11, score, [2.0] * 12) for a in places], "target string, regulator string, start_pos bigint, stop_pos bigint, score double, per_base array<double>")


@pytest.mark.parametrize("places,gap,score,n", [([3], 0, 24.0, 1), ([3, 3, 35, 35], 50, 48.0, 2), ([3, 35, 87, 199], 50, 72.0, 3), ([3, 35, 87, 199], 0, 24.0, 1), ([3, 35], 0, 24.0, 1), ([3, 9], 0, 36.0, 1)])
def test_site_scores(spark, places, gap, score, n):
    r = sites.score_sites(_hits(spark, places), gap).first()
    assert (r.score, r.n_sites) == (score, n)


def test_per_base_takes_the_highest(spark):
    rows = [("g", "t", 1, 4, 4.0, [1.0, 1.0, 1.0, 1.0]), ("g", "t", 3, 6, 8.0, [2.0, 0.5, 3.0, 2.5])]
    df = spark.createDataFrame(rows, "target string, regulator string, start_pos bigint, stop_pos bigint, score double, per_base array<double>")
    r = sites.merge_islands(df).first()
    assert (r.start_pos, r.stop_pos, r.score) == (1, 6, 1 + 1 + 2 + 1 + 3 + 2.5)


def test_windows_clamp_and_revert(spark):
    g = spark.createDataFrame([("a", "c", 100, 200, "+"), ("b", "c", 260, 300, "-"), ("n", "c", 270, 280, "+")], "gene_name string, seqname string, start_pos bigint, end_pos bigint, strand string")
    w = {r.gene_name: (r.win_start, r.win_end) for r in genes.promoter_windows(g, (150, 10), intergenic=True).collect()}
    assert w["a"] == (1, 210) and w["n"] == (120, 290)
    with pytest.raises(ValueError):
        genes.promoter_windows(g, (1, 2, 3))


def test_interval_join_is_complete(spark):
    rng = random.Random(1)
    a = [(f"c{rng.randrange(2)}", s := rng.randrange(900), s + rng.randrange(1, 300)) for _ in range(120)]
    b = [(f"c{rng.randrange(2)}", s := rng.randrange(900), s + rng.randrange(1, 90)) for _ in range(120)]
    x = spark.createDataFrame(a, "seqname string, start_pos bigint, end_pos bigint")
    y = spark.createDataFrame(b, "seqname string, win_start bigint, win_end bigint")
    want = sorted((p, q) for p in a for q in b if p[0] == q[0] and p[2] >= q[1] and p[1] <= q[2])
    got = sorted(((r.seqname, r.start_pos, r.end_pos), (r.seqname, r.win_start, r.win_end)) for r in intervals.overlap_join(x, y, width=64).collect())
    assert got == want


def test_interval_pairs_come_in_order_of_place(spark):
    """Pairs that follow each other are alike, whatever the order of the tables, and many tasks make them."""
    rng = random.Random(5)
    a = [(f"c{rng.randrange(3)}", s := rng.randrange(2000), s + rng.randrange(1, 300)) for _ in range(300)]
    b = [(f"c{rng.randrange(3)}", s := rng.randrange(2000), s + rng.randrange(1, 90)) for _ in range(300)]
    x = spark.createDataFrame(a, "seqname string, start_pos bigint, end_pos bigint").coalesce(1)
    y = spark.createDataFrame(b, "seqname string, win_start bigint, win_end bigint").coalesce(1)
    got = {}
    for r in intervals.overlap_join(x, y, width=64).withColumn("task", F.spark_partition_id()).collect():
        got.setdefault(r.task, []).append((r.seqname, max(r.start_pos, r.win_start) // 64, r.start_pos, r.end_pos, r.win_start, r.win_end))
    assert len(got) > 3 and all(rows == sorted(rows) for rows in got.values())
    assert sorted(p for rows in got.values() for p in rows) == sorted((p[0], max(p[1], q[1]) // 64, *p[1:], *q[1:]) for p in a for q in b if p[0] == q[0] and p[2] >= q[1] and p[1] <= q[2])


@pytest.mark.parametrize("width", [7, 64, 256])
def test_pairs_are_told_by_whole_numbers(spark, width):
    """Places left of zero, ends on borders of bins, intervals over many bins; no division is made for two rows that meet."""
    rng = random.Random(width)
    a = [("c", s := rng.choice([-width, -1, 0, width, rng.randrange(-300, 300)]), s + rng.choice([0, 1, width, 3 * width])) for _ in range(150)]
    b = [("c", s := rng.choice([-width, -1, 0, width, rng.randrange(-300, 300)]), s + rng.choice([0, 1, width, 9 * width])) for _ in range(150)]
    x, y = spark.createDataFrame(a, "seqname string, start_pos bigint, end_pos bigint"), spark.createDataFrame(b, "seqname string, win_start bigint, win_end bigint")
    for closed in (True, False):
        df = intervals.overlap_join(x, y, width=width, closed=closed)
        want = sorted((p[1:], q[1:]) for p in a for q in b if (p[2] >= q[1] and p[1] <= q[2] if closed else p[2] > q[1] and p[1] < q[2]))
        assert sorted(((r.start_pos, r.end_pos), (r.win_start, r.win_end)) for r in df.collect()) == want
        joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in line]
        assert joins and not any("FLOOR" in line or "/" in line for line in joins)


def test_peaks_without_a_gene_are_found_without_pairs(spark):
    """Copies, peaks over several bins, peaks that only touch a window, and peaks on no sequence."""
    p = [("c", 0, 3000), ("c", 0, 3000), ("c", 5000, 5100), ("c", 5000, 5100), ("c", 2200, 2300), ("d", 10, 20), (None, 10, 20)]
    peaks = spark.createDataFrame([(*x, ".", i) for i, x in enumerate(p)], "chrom string, start_pos bigint, end_pos bigint, strand string, i int")
    w = spark.createDataFrame([("a", "c", "+", 2000, 2200, 2100), ("b", "c", "-", 2050, 2200, 2100)], "gene_name string, seqname string, strand string, win_start bigint, win_end bigint, tss bigint")
    df = intervals.link_peaks(peaks, w, intergenic=True)
    assert sorted((r.i, r.gene) for r in df.collect()) == [(0, "a"), (0, "b"), (1, "a"), (1, "b"), *[(i, "Intergenic") for i in range(2, 7)]]
    assert "LeftSemi" in df._jdf.queryExecution().optimizedPlan().toString()


def test_hits_are_held_against_genes_beside_them(spark):
    """Most of what shares a bin with a short hit touches it."""
    hits = spark.range(2000).selectExpr("concat('r', id % 3) AS regulator", "'c' AS seqname", "id * 37 % 20000 AS start_pos", "id * 37 % 20000 + 11 AS stop_pos", "1.0D AS score")
    windows = spark.range(200).selectExpr("cast(id AS string) AS gene_name", "'c' AS seqname", "id * 97 AS win_start", "id * 97 + 560 AS win_end")
    df = network.hits_near_genes(hits, windows)
    want = sorted((h.regulator, h.start_pos, g.gene_name) for g in windows.collect() for h in hits.collect() if h.stop_pos >= g.win_start and h.start_pos <= g.win_end)
    assert sorted((r.regulator, r.start_pos, r.target) for r in df.collect()) == want
    sides = [intervals._bins(t, lo, hi, network.SITE_BIN, "bin").groupBy("bin").count() for t, lo, hi in ((hits, "start_pos", "stop_pos"), (windows, "win_start", "win_end"))]
    met = sides[0].join(sides[1].withColumnRenamed("count", "other"), "bin").agg(F.sum(F.col("count") * F.col("other"))).first()[0]
    assert met < 2 * len(want)
    assert f"/ {network.SITE_BIN}.0" in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("rows,kept", [
    ([(float(i * 5), 1) for i in range(8)], "positive"), ([(float(i % 4), 6) for i in range(12)], "none"),
    ([(0.0, 400), (1.0, 20), (9.0, 12)], "top"), ([(0.0, 20), (5.0, 20), (9.0, 1)], "noise"),
])
def test_edge_selection_branches(spark, rows, kept):
    df = spark.createDataFrame([("t", f"g{i}_{j}", s) for i, (s, n) in enumerate(rows) for j in range(n)], "regulator string, target string, score double")
    got = {r.score for r in network.select_edges(df).filter("edge").collect()}
    want = {"positive": {s for s, _ in rows if s > 0}, "none": set(), "top": {9.0}, "noise": {9.0}}[kept]
    assert got == want


def test_names_and_errors(spark):
    df = spark.createDataFrame([("Abc",), ("dEf",)], "gene_name string")
    pick = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert [r[0] for r in genes.keep_named(df, pick("ABC", "zz"), "gene_name").collect()] == ["Abc"]
    assert genes.keep_named(df, None, "gene_name").count() == 2
    for bad in (pick("zz"), pick("")):
        with pytest.raises(ValueError):
            genes.keep_named(df, bad, "gene_name")
    row = spark.createDataFrame([('gene_id "g1"; x', "hum-human"), ('gene_id "g2"', "x")], "a string, t string")
    assert [r[0] for r in row.select(attribute(F.col("a"))).collect()] == ["g1", "g2"]
    assert [r[0] for r in row.select(without_suffix(F.col("t"), "-human")).collect()] == ["hum", "x"]
    with pytest.raises(ValueError):
        preset("martian")
    assert preset("Yeast").tandem == 25


def test_readers(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('#!x\nc\ts\tgene\t100\t500\t.\t+\t.\tgene_id "G1"; b\nc\ts\texon\t120\t510\t.\t+\t.\tgene_id "G1"\nc\ts\tgene\t.\t9\t.\t+\t.\tgene_id "G2"\n')
    r = annotation.read_genes(spark, str(tmp_path / "a.gtf")).collect()
    assert [(x.gene_name, x.start_pos, x.end_pos, x.tss) for x in r] == [("G1", 100, 510, 100)]
    (tmp_path / "a.bed").write_text("chrom\tstart\tend\nc\t1\t740\n")
    (tmp_path / "b.bed").write_text("c\t1\t740\nc\t5\t9\n")
    assert annotation.read_bed(spark, str(tmp_path / "a.bed")).select("chrom", "start_pos", "end_pos", "strand").first() == ("c", 1, 740, ".")
    assert annotation.read_bed(spark, str(tmp_path / "b.bed")).count() == 2
    (tmp_path / "a.fa").write_text(">s1 d\nACGT\nAC\n>s2\n#c\nGG\n")
    assert {(x.seqname, x.length) for x in annotation.fasta_lengths(annotation.read_fasta(spark, str(tmp_path / "a.fa"))).collect()} == {("s1", 6), ("s2", 2)}
    (tmp_path / "a.meme").write_text("MEME version 4\nALPHABET= ACGT\nBackground letter frequencies\nA 0.3 C 0.2 G 0.2 T 0.3\nMOTIF m1 N1\nletter-probability matrix: w= 2\n 1 0 0 0\n 0 0 0 1\nURL http://x\nMOTIF m2\n 0.5 0.5 0 0\n")
    m = {x.motif_id: x for x in motif_files.read_motifs(spark, str(tmp_path / "a.meme")).collect()}
    assert m["m1"].motif_name == "N1" and m["m1"].background == [0.3, 0.2, 0.2, 0.3] and m["m2"].motif_name == "m2"
    (tmp_path / "a.motif").write_text(">AT H1 5.4\n1\t0\t0\t0\n0\t0\t0\t1\n")
    assert motif_files.read_motifs(spark, str(tmp_path / "a.motif")).first().ln_odds == 5.4
    (tmp_path / "a.dat").write_text("AC A1\nID T1\nNA Name\nP0 A C G T\n01 1 1 2 0 N\n02 4 0 0 0 A\nBF sp\nXX\n//\n")
    t = motif_files.read_motifs(spark, str(tmp_path / "a.dat"), "transfac").first()
    assert t.pwm == [[0.25, 0.25, 0.5, 0.0], [1.0, 0.0, 0.0, 0.0]] and t.species == ["sp"]
    with pytest.raises(ValueError):
        motif_files.read_motifs(spark, "x", "other")
    pw = tmp_path / "pwm"
    pw.mkdir()
    (pw / "P1.txt").write_text("Pos\tA\tC\tG\tT\n1\t1\t0\t0\t0\n")
    (pw / "P2.txt").write_text("Pos\tA\tC\tG\tT\n")
    info = spark.createDataFrame([("P1", "B", "D"), ("P1", "A", "I"), ("P2", "C", "D")], "Motif_ID string, TF_Name string, TF_Status string")
    assert [tuple(x) for x in motif_files.read_pwm_files(spark, str(pw), info).collect()] == [("P1", "A/B", [[1.0, 0.0, 0.0, 0.0]])]
    found = spark.createDataFrame([("c:10-90", 5, "ACGT", "m", "-", 7.0)], "sequence_id string, offset bigint, matched string, motif_id string, strand string, odds double")
    assert tables.homer_places(found).select("seqname", "start_pos", "stop_pos").first() == ("c", 12, 16)


def test_network_over_a_genome_and_promoters(spark, motif, sequence, tmp_path):
    g = spark.createDataFrame([("T3ST", "seq1", 100, 500, "+"), ("FAR", "none", 5, 9, "+")], "gene_name string, seqname string, start_pos bigint, end_pos bigint, strand string")
    m = networks.prepare_motifs(motif)
    p = Params(window=(200, 200), tandem=50)
    found, scores, flags = networks.from_genome(g, sequence, m, p, hits_out=str(tmp_path / "hits"))
    assert [(r.regulator, r.target, r.score) for r in found.collect()] == [("EcoRI", "T3ST", 72.0)]
    assert scores.count() == 2
    networks.save(str(tmp_path / "n"), found, scores, flags, ["EcoRI"], flagged=True)
    assert {x.name for x in tmp_path.iterdir()} >= {"hits", "n_unfiltered_matrix.tsv.gz", "n_edge_matrix.tsv.gz", "n_tf_binding_locs_filtered.tsv"}
    found, _, _ = networks.from_promoters(sequence, m, p)
    assert [(r.regulator, r.target) for r in found.collect()] == [("EcoRI", "seq1")]


def test_meme_round_trip(spark, motif, tmp_path):
    sinks.write_meme(motif, str(tmp_path / "m.meme"))
    got = motif_files.read_motifs(spark, str(tmp_path / "m.meme"), "meme").first()
    assert got.pwm == motif.first().pwm
    with pytest.raises(RuntimeError):
        sinks.write_meme(motif.limit(0), str(tmp_path / "x"))


def test_stream_join(spark, tmp_path):
    from regnet.streaming.hits import stream_near_genes

    schema = "regulator string, seqname string, start_pos bigint, stop_pos bigint, score double"
    spark.createDataFrame([("t", "c", 5, 16, 1.0), ("t", "c", 900, 911, 1.0)], schema).write.parquet(str(tmp_path / "in"))
    w = spark.createDataFrame([("g", "c", 1, 50)], "gene_name string, seqname string, win_start bigint, win_end bigint")
    q = stream_near_genes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), w).writeStream.format("memory").queryName("near").start()
    q.processAllAvailable()
    q.stop()
    assert [r.target for r in spark.sql("SELECT * FROM near").collect()] == ["g"]


def test_fasta_headers_with_signs_and_stray_text(spark, tmp_path):
    import pytest

    from regnet.sources import annotation

    good = tmp_path / "good.fa"
    good.write_text("\n# a comment\n>s1 5->3 > x\nACGT\n# inside\nacg t\n\n>s2\r\nGG\r\nTT\r\n>s3\n")
    assert {r.seqname: r.seq for r in annotation.read_fasta(spark, str(good)).collect()} == {"s1": "ACGTacgt", "s2": "GGTT", "s3": ""}
    bad = tmp_path / "bad.fa"
    bad.write_text("ACGT\n>s1\nACGT\n")
    for path in (str(bad), [str(good), str(bad)]):
        with pytest.raises(ValueError):
            annotation.read_fasta(spark, path)


def test_extract_across_tiles(spark):
    from regnet.operators import intervals

    seq = "".join("ACGT"[(i * i) % 4] if i % 3 else "N" for i in range(100))
    s = spark.createDataFrame([("a", seq), ("b", "AC"), ("e", "")], "seqname string, seq string")
    rows = [("a", 0, 100), ("a", 5, 25), ("a", 5, 25), ("a", 10, 10), ("a", 95, 130), ("a", 200, 210), ("b", 0, 2), ("e", 0, 1), ("none", 0, 5)]
    bed = spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long")
    text = {"a": seq, "b": "AC", "e": ""}
    want = sorted((f"{c}:{a}-{b}", c, a, b, text[c][a:b]) for c, a, b in rows if c in text)
    for tile in (7, 10, 65536):
        assert sorted(tuple(r) for r in intervals.extract(s, bed, tile=tile).collect()) == want


def test_collapse_takes_the_smallest_of_equally_common_values(spark):
    from regnet.operators import genes

    rows = [("g", "chr2", "+", 5, 9, False), ("g", "chr1", "+", 2, 4, True), ("g", None, "-", 7, 12, False), ("h", None, None, 1, 2, False), (None, "chr1", "+", 1, 2, True), ("h", "x", "+", None, 2, True)]
    df = spark.createDataFrame(rows, "gene_name string, seqname string, strand string, start_pos long, end_pos long, coding boolean")
    got = genes.collapse(df, flags=("coding",)).select("gene_name", "seqname", "strand", "start_pos", "end_pos", "coding").collect()
    assert {tuple(r) for r in got} == {("g", "chr1", "+", 2, 12, True), ("h", None, None, 1, 2, False)}


def test_islands_with_lone_and_bare_hits(spark):
    from regnet.operators import sites

    rows = [("t", "r", 1, 3, 9.0, [1.0, 2.0, 3.0]), ("t", "r", 10, 12, 5.0, [1.0, 5.0, 1.0]), ("t", "r", 11, 13, 4.0, [2.0, 2.0, 9.0, 99.0]), ("t", "r", 30, 31, 7.0, None), ("t", "r", 40, 42, 6.0, [])]
    df = spark.createDataFrame(rows, "target string, regulator string, start_pos long, stop_pos long, score double, per_base array<double>")
    got = {(r.start_pos, r.stop_pos): r.score for r in sites.merge_islands(df).collect()}
    assert got == {(1, 3): 9.0, (10, 13): 1.0 + 5.0 + 2.0 + 9.0, (30, 31): 7.0, (40, 42): 6.0}
