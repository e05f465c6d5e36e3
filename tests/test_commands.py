"""Commands, readers and sinks by the contents of what they give."""

import pytest
from pyspark.sql import functions as F

from regnet.functions.motif_math import equal_motifs, has_species, same_motif
from regnet.operators.expression import complete_abundance
from regnet.params import Params
from regnet.plans import cli
from regnet.sources import annotation, motif_files, sinks, tables

GTF = 'c\ts\tgene\t6001\t7000\t.\t+\t.\tgene_id "G1"\nc\ts\texon\t6001\t6500\t.\t+\t.\tgene_id "G1"\nc\ts\texon\t6801\t7000\t.\t+\t.\tgene_id "G1"\nc\ts\texon\t20001\t21000\t.\t-\t.\tgene_id "G2"\n'


def lines(path):
    return [x for f in sorted(path.glob("part-*")) for x in f.read_text().splitlines()]


@pytest.fixture
def gtf(tmp_path):
    (tmp_path / "a.gtf").write_text(GTF)
    return str(tmp_path / "a.gtf")


def test_options_replace_presets():
    base = ["network", "--motifs", "m", "--out", "o", "--gtf", "g", "--fasta", "f", "--species", "yeast"]
    assert cli.params(cli.parser().parse_args(base)) == Params(window=(1000, 100), tandem=25)
    got = cli.params(cli.parser().parse_args([*base, "--window", "10", "20", "--tandem", "7", "--min-ic", "0", "--p-value", "0.01", "--no-tss", "--intergenic"]))
    assert got == Params(use_tss=False, window=(10, 20), tandem=7, min_ic=0.0, p_value=0.01, intergenic=True)


@pytest.mark.parametrize("scanner", ["p_value", "odds"])
def test_network_command(spark, tmp_path, gtf, scanner):
    site = "GAATTCGAATTC"
    (tmp_path / "a.fa").write_text(">c\n" + "AC" * 2950 + site + "AC" * 9000 + "\n")
    rows = {"G": " 0 0 1 0", "A": " 1 0 0 0", "T": " 0 0 0 1", "C": " 0 1 0 0"}
    (tmp_path / "m.meme").write_text("MEME version 4\nALPHABET= ACGT\nMOTIF m1 N1\nletter-probability matrix: w= 12\n" + "\n".join(rows[x] for x in site) + "\n")
    out = tmp_path / "net"
    cli.main(["network", "--motifs", str(tmp_path / "m.meme"), "--out", str(out), "--gtf", gtf, "--fasta", str(tmp_path / "a.fa"), "--scanner", scanner, "--window", "500", "100", "--save-hits", "--save-flagged"])
    hits = spark.read.option("sep", "\t").option("header", True).csv(f"{out}_tf_binding_locs.tsv").collect()
    assert {(r.seqname, int(r.start_pos), r.strand) for r in hits} == {("c", 5900, "+"), ("c", 5900, "-")}  # a palindrome
    got = spark.read.option("sep", "\t").option("header", True).csv(f"{out}_unfiltered_matrix.tsv.gz").collect()
    assert {r.target: float(r.N1) > 0 for r in got} == {"G1": True, "G2": False}
    assert (tmp_path / "net_tf_binding_locs_filtered.tsv").exists()


def test_expression_command(tmp_path, gtf):
    (tmp_path / "s1.tsv").write_text("G1\t7\nG2\t3\n__no_feature\t5\n")
    (tmp_path / "s2.tsv").write_text("G2\t10\n")
    out = tmp_path / "e"
    cli.main(["expression", "--counts", str(tmp_path / "s*.tsv"), "--gtf", gtf, "--out", str(out)])
    assert lines(tmp_path / "e_counts.tsv") == ["sample\tG1\tG2", "s1\t7\t3", "s2\t0\t10"]
    assert set(lines(tmp_path / "e_metadata.tsv")[1:]) == {"s1\tno_feature\t5", "s1\taligned\t10", "s2\taligned\t10"}
    s1 = [float(x) for x in lines(tmp_path / "e_fpkm.tsv")[1].split("\t")[1:]]
    assert s1 == pytest.approx([1e6, 3e5])  # G1 has 0.7 kb of exons, G2 has 1
    t1 = [float(x) for x in lines(tmp_path / "e_tpm.tsv")[1].split("\t")[1:]]
    assert t1 == pytest.approx([1e6 * 10 / 13, 1e6 * 3 / 13])
    (tmp_path / "s2.tsv").write_text("G2\t11\n")
    cli.main(["expression", "--counts", str(tmp_path / "s*.tsv"), "--out", str(out), "--resume"])
    assert lines(tmp_path / "e_counts.tsv")[2] == "s2\t0\t10"  # what is there stays
    with pytest.raises(ValueError):
        cli.main(["expression", "--counts", "x", "--lengths", "y", "--gtf", gtf, "--out", "z"])


def test_abundance_command(tmp_path):
    for s, (a, b) in {"r1": (5, 1.5), "r2": (7, 2.5)}.items():
        (tmp_path / s).mkdir()
        (tmp_path / s / "abundance.tsv").write_text(f"target_id\tlength\teff_length\test_counts\ttpm\nt1\t9\t9\t{a}\t{b}\nt2\t9\t9\t1\t1\n")
    (tmp_path / "t2g.tsv").write_text("t1\tG\nt2\tG\n")
    cli.main(["abundance", "--abundances", str(tmp_path / "r1/abundance.tsv"), str(tmp_path / "r2/abundance.tsv"), "--samples", "r1", "r2", "r3", "--t2g", str(tmp_path / "t2g.tsv"), "--out", str(tmp_path / "o")])
    assert lines(tmp_path / "o_tpm.tsv") == ["sample\tt1\tt2", "r1\t1.5\t1.0", "r2\t2.5\t1.0", "r3\t0.0\t0.0"]
    assert lines(tmp_path / "o_gene_tpm.tsv") == ["sample\tG", "r1\t2.5", "r2\t3.5", "r3\t0.0"]


def test_experiment_commands(spark, tmp_path, gtf):
    peak = "c\t{}\t{}\tn\t9\t.\t{}\t1\t1\t5\n"
    (tmp_path / "E1.bed.gz").write_bytes(__import__("gzip").compress((peak.format(5900, 5950, 2.5) + peak.format(5960, 5990, 4)).encode()))
    (tmp_path / "E2.bed.gz").write_bytes(__import__("gzip").compress(peak.format(5900, 5950, 8).encode()))
    (tmp_path / "m.tsv").write_text("File accession\tExperiment target\tAudit ERROR\tAudit WARNING\tAudit NOT_COMPLIANT\nE1\tTF1-human\t\t\tlow depth\nE2\tTF2-human\tbad\t\t\nE3\tTF3-human\t\t\t\n")
    linked = str(tmp_path / "linked")
    args = ["encode-link", "--metadata", str(tmp_path / "m.tsv"), "--beds", str(tmp_path / "E1.bed.gz"), str(tmp_path / "E2.bed.gz"), "--gtf", gtf, "--out", linked]
    cli.main(args)
    read = lambda: sorted((r.start, r.end, r.regulator, r.gene, r.accession) for r in spark.read.option("sep", "\t").option("header", True).csv(linked).collect())
    assert [r[2:] for r in read()] == [("TF1", "G1", "E1")] * 2
    cli.main([*args, "--skip-noncompliant", "--keep-errors"])
    assert [r[2:] for r in read()] == [("TF2", "G1", "E2")]
    cli.main([*args, "--keep-errors"])
    (tmp_path / "mask.bed").write_text("c\t5890\t5955\n")
    cli.main(["encode-prior", "--linked", linked, "--mask", str(tmp_path / "mask.bed"), "--out", str(tmp_path / "p")])
    long = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "p_long.tsv")).collect()
    assert {(r.target, r.regulator): float(r.score) for r in long} == {("G1", "TF1"): 2.5, ("G1", "TF2"): 8.0}


def test_tables_of_scanners_and_motifs(spark, tmp_path):
    (tmp_path / "f.tsv").write_text("motif_id\tmotif_alt_id\tsequence_name\tstart\tstop\tstrand\tscore\tp-value\tq-value\tmatched_sequence\nm\tM\tc\t5\t8\t+\t9\t0.01\t\tACGT\nm\tM\tc\t5\t8\t+\t9\t0.02\t\tACGT\nm\tM\tc\t\t\t\t\t\t\t\n")
    got = tables.read_fimo(spark, str(tmp_path / "f.tsv")).collect()
    assert [(r.motif_id, r.seqname, r.start_pos, r.stop_pos, r.matched) for r in got] == [("m", "c", 5, 8, "ACGT")]
    (tmp_path / "h.tsv").write_text("c:10-90\t5\tACGT\tm\t+\t7\n")
    assert tables.read_homer(spark, str(tmp_path / "h.tsv")).select("start_pos", "stop_pos", "odds").first() == (15, 19, 7.0)
    m = spark.createDataFrame([("a", "A", [[1.0, 0.0, 0.0, 0.0]], ["Mus musculus"]), ("a", "A", [[1.0, 0.0, 1e-12, 0.0]], None), ("b", "A", [[0.0, 1.0, 0.0, 0.0]], [])], "motif_id string, motif_name string, pwm array<array<double>>, species array<string>")
    m = m.select(F.struct("motif_id", "motif_name", "pwm").alias("m"), "species", F.lit(1).alias("one"))
    pairs = m.alias("x").join(m.alias("y"), "one").select(equal_motifs(F.col("x.m"), F.col("y.m")).alias("e"), same_motif(F.col("x.m.pwm"), F.col("y.m.pwm")).alias("s")).collect()
    assert sum(r.e for r in pairs) == 5 and sum(r.s for r in pairs) == 5
    assert [r[0] for r in m.select(has_species("species", "mus")).collect()] == [True, None, False]
    pw = tmp_path / "pwm"
    pw.mkdir()
    for name, text in {"P1": "Pos\tA\tC\tG\tT\n1\t1\t0\t0\t0\n", "P2": "Pos\tA\tC\tG\tT\n", "P3": "Pos\tA\tC\tG\tT\n1\t1\t0\t0\t0\n"}.items():
        (pw / f"{name}.txt").write_text(text)
    info = spark.createDataFrame([("P1",), ("P2",)], "Motif_ID string")
    assert tuple(motif_files.pwm_report(spark, str(pw), info).first()) == (3, 1, 1)
    renamed = motif_files.rename_motifs(spark.createDataFrame([("a", "x"), ("b", "y")], "motif_id string, motif_name string"), spark.createDataFrame([("a", "New"), ("b", None)], "Motif_ID string, Motif_Name string"))
    assert [tuple(r) for r in renamed.collect()] == [("a", "New")]


def test_sinks_by_content(spark, tmp_path):
    sinks.write_bed(spark.createDataFrame([("c", 9, 12), ("b", 5, 7)], "chrom string, start_pos long, end_pos long"), str(tmp_path / "b"))
    assert lines(tmp_path / "b") == ["b\t5\t7", "c\t9\t12"]
    motif = spark.createDataFrame([("m", "ACGT", "AC", [[1.0, 0.0, 0.0, 0.0]], list("ACGT"), 5.0)], "motif_id string, motif_name string, consensus string, pwm array<array<double>>, alphabet array<string>, ln_odds double")
    sinks.write_homer(motif, str(tmp_path / "h"))
    assert lines(tmp_path / "h")[:2] == [">AC\tm\t5.000000", "1.000000\t0.000000\t0.000000\t0.000000"]
    sinks.write_summary(motif.select("motif_id", "ln_odds"), str(tmp_path / "s"))
    assert lines(tmp_path / "s") == ["motif_id\tln_odds", "m\t5.000"]
    (tmp_path / "p.narrowPeak").write_text("c\t5\t9\tn\t100\t+\t2.5\t1\t0.5\t2\n")
    got = annotation.read_bed(spark, str(tmp_path / "p.narrowPeak"), narrow_peak=True).first()
    assert (got.chrom, got.start_pos, got.signal_value, got.peak) == ("c", 5, 2.5, 2)
    full = complete_abundance(spark.createDataFrame([("s", "t", 1.0)], "sample string, transcript string, tpm double"), spark.createDataFrame([("t",), ("u",)], "transcript string"), spark.createDataFrame([("s",), ("f",)], "sample string"))
    assert {tuple(r) for r in full.collect()} == {("s", "t", 1.0), ("s", "u", 0.0), ("f", "t", 0.0), ("f", "u", 0.0)}
