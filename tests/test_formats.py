"""FASTA by ranges, wide matrices, repeated edges, resuming, reports and the small commands."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from regnet.operators import intervals, network
from regnet.operators.reports import Reports
from regnet.params import Params
from regnet.plans import cli, networks
from regnet.sources import annotation, fasta, sinks

from .test_commands import GTF, lines


def brute_fasta(text):
    out = []
    for x in text.split("\n"):
        if x.startswith(">"):
            words = x[1:].split(None, 1)
            out.append([words[0] if words and x[1:2] not in " \t" else "", ""])
        elif not x.startswith("#") and x.strip():
            out[-1][1] += "".join(x.split())
    return sorted(map(tuple, out))


def drawn_fasta(rng, n):
    text = "\n#c > x\n"
    for i in range(n):
        text += rng.choice([f">s{i} a>b", f">s{i}", ">", "> odd", f">s{i}\r"]) + "\n"
        for _ in range(rng.randint(0, 4)):
            text += rng.choice(["ACGT" * rng.randint(1, 9), "acg>t", "AC GT\r", "", "# note >x", "A"]) + rng.choice(["\n", "\n", "\n\n"])
    return text + rng.choice([">last\nACG", ">last", ""])


def test_fasta_ranges_of_all_sizes(tmp_path, monkeypatch):
    """The reader by itself: wherever ranges and chunks of compressed files end, records are the same."""
    import json

    for seed in range(12):
        rng = random.Random(seed)
        text = drawn_fasta(rng, 6)
        plain, packed = tmp_path / f"{seed}.fa", tmp_path / f"{seed}.fa.gz"
        plain.write_bytes(text.encode())
        packed.write_bytes(gzip.compress(text.encode()))
        for size in [*range(1, 30), 1000]:
            monkeypatch.setattr(fasta, "RANGE", size)
            for file, ranges in ((plain, [(a, a + size) for a in range(0, len(text), size)]), (packed, [(0, -1)])):
                rows = [(str(file), a, min(b, len(text)), -1, None, 0) for a, b in ranges]
                read = lambda r, summary: [x for p in r for x in fasta._Reader({"ranges": json.dumps(r), "tile": "16", "summary": summary}).read(fasta.InputPartition(p))]  # noqa: E731, B023
                got = {}
                for _, record, name, place, tile, seq in read(fasta.carried(rows, read(rows, "true")), "false"):
                    assert place % 16 + len(seq) <= 16 and tile == place - place % 16
                    got.setdefault((record, name), []).append((place, seq))
                assert sorted((name, "".join(x for _, x in sorted(p))) for (_, name), p in got.items()) == brute_fasta(text), (seed, size)


def test_fasta_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fasta, "RANGE", 150)
    text = drawn_fasta(random.Random(1), 25)
    (tmp_path / "a.fa").write_bytes(text.encode())
    (tmp_path / "b.fa.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "c.fa").write_text(">one\n" + "ACGTTGCA" * 40)  # a sequence without a line end
    want = brute_fasta(text)
    assert sorted(map(tuple, fasta.read_records(spark, str(tmp_path / "a.fa")).collect())) == want
    assert sorted(map(tuple, fasta.read_records(spark, [str(tmp_path / "b.fa.gz"), str(tmp_path / "c.fa")]).collect())) == sorted([*want, ("one", "ACGTTGCA" * 40)])
    pieces = fasta.read_pieces(spark, str(tmp_path / "c.fa"), 16)
    assert pieces.filter("length(seq) > 16 OR place % 16 + length(seq) > 16").isEmpty()
    tiles = fasta.read_tiles(spark, str(tmp_path / "c.fa"), 16)
    assert sorted((r.tile_start, r.seq) for r in tiles.collect()) == [(16 * i, "ACGTTGCAACGTTGCA") for i in range(20)]
    assert tuple(fasta.tile_lengths(tiles).first()) == ("one", 320)
    bed = spark.createDataFrame([("one", 5, 40), ("one", 310, 400), ("one", 30, 30), ("two", 1, 2)], "chrom string, start_pos long, end_pos long")
    whole = fasta.read_records(spark, str(tmp_path / "c.fa"))
    assert sorted(map(tuple, intervals.extract(tiles, bed, 16).collect())) == sorted(map(tuple, intervals.extract(whole, bed, 16).collect()))


def test_stray_text_is_an_error(spark, tmp_path):
    for i, text in enumerate(["junk\n>s1\nACGT\n>\n", "ACGT\n", " x\n>s\n", "#c\nA\n>s\nA\n"]):
        (tmp_path / f"{i}.fa").write_text(text)
        with pytest.raises(ValueError):
            annotation.read_fasta(spark, str(tmp_path / f"{i}.fa"))
    (tmp_path / "none.fa").write_text("")
    assert annotation.read_fasta(spark, str(tmp_path / "none.fa")).count() == 0
    with pytest.raises(FileNotFoundError):
        annotation.read_fasta(spark, str(tmp_path / "missing.fa"))


def test_matrix_of_many_columns_by_many_tasks(spark, tmp_path):
    n, rows = 20_000, 24
    regulators = spark.range(n).select(F.format_string("TF%05d", "id").alias("regulator"))
    cells = spark.range(rows).select(F.format_string("g%02d", "id").alias("target"), F.format_string("TF%05d", F.col("id") * 7).alias("regulator"), (F.col("id") + 0.5).alias("score"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        full = network.complete(cells, cells, regulators)
        sinks.write_matrix(full, str(tmp_path / "m"), regulators)
        sinks.write_matrix(full.withColumn("edge", F.col("score") > 9), str(tmp_path / "e"), regulators, "edge")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "m").glob("part-*.gz"))
    assert len(parts) > 1
    text = [x for p in parts for x in gzip.open(p, "rt").read().splitlines()]
    assert text[0].split("\t") == ["target", *(f"TF{i:05d}" for i in range(n))] and len(text) == rows + 1
    for i, line in enumerate(text[1:]):
        got = line.split("\t")
        assert got[0] == f"g{i:02d}" and {j: float(x) for j, x in enumerate(got[1:]) if float(x)} == {7 * i: i + 0.5}
    edges = [x.split("\t") for p in sorted((tmp_path / "e").glob("part-*.gz")) for x in gzip.open(p, "rt").read().splitlines()]
    assert set(edges[1][1:]) == {"0"} and set(edges[24][1:]) == {"0", "1"}


def test_repeated_edges_are_an_error(spark, tmp_path):
    cells = spark.createDataFrame([("g", "t", 1.0), ("g", "t", 2.0), ("h", "t", 3.0)], "target string, regulator string, score double")
    with pytest.raises(Exception, match="repeated target and regulator"):
        network.wide(cells, ["t"]).collect()
    with pytest.raises(Exception, match="repeated column in row g"):
        sinks.write_matrix(cells, str(tmp_path / "m"), cells)
    fine = cells.filter("score <> 2")
    assert {tuple(r) for r in network.wide(fine, ["t", "u"]).collect()} == {("g", 1.0, 0.0), ("h", 3.0, 0.0)}


def test_resume_does_a_failed_write_again(spark, tmp_path):
    good = spark.createDataFrame([("r", "a", 1), ("r", "b", 2)], "row string, k string, v int")
    broken = good.withColumn("v", F.when(F.col("k") == "b", F.raise_error(F.lit("killed")).cast("int")).otherwise(F.col("v")))
    for write, name in ((lambda df, p: sinks.write_wide(df, p, "row", "k", "v", resume=True), "w"), (lambda df, p: sinks.write_table(df, p, resume=True), "t")):
        path = str(tmp_path / name)
        with pytest.raises(Exception, match="killed"):
            write(broken, path)
        (tmp_path / name / "_temporary" / "0").mkdir(parents=True, exist_ok=True)  # what a lost driver leaves behind
        assert not sinks.finished(spark, path)
        write(good, path)
        done = lines(tmp_path / name)
        assert sinks.finished(spark, path) and done[0] in ("row\ta\tb", "row\tk\tv")
        write(good.withColumn("v", F.lit(9)), path)
        assert lines(tmp_path / name) == done


def test_reports_are_counted_on_the_way(spark):
    genes = spark.createDataFrame([("a",), ("b",), (None,)], "seqname string")
    reports = Reports.of(genes)
    hits = spark.createDataFrame([("a", "x"), ("a", "y"), ("c", "x"), (None, None)], "seqname string, regulator string")
    jobs = spark.sparkContext.statusTracker()
    watched = reports.watch(hits, "hits", chromosome="seqname", names="regulator")
    spark.sparkContext.setJobGroup("watch", "one pass")
    assert watched.filter("seqname = 'a'").count() == 2
    ran = len(jobs.getJobIdsForGroup("watch"))
    assert reports.lines() == [("hits", "rows", 4), ("hits", "chromosome a", 2), ("hits", "chromosome b", 0), ("hits", "other chromosomes", 2), ("hits", "distinct names", 2)]
    assert len(jobs.getJobIdsForGroup("watch")) == ran
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


SITE = "GAATTCGAATTC"
MEME = "MEME version 4\nALPHABET= ACGT\nMOTIF m1 N1\nletter-probability matrix: w= 12\n" + "\n".join({"G": " 0 0 1 0", "A": " 1 0 0 0", "T": " 0 0 0 1", "C": " 0 1 0 0"}[x] for x in SITE) + "\n"


def test_network_in_a_constraint(spark, tmp_path):
    """Sites outside the constraint aren't found, and the report counts what was."""
    (tmp_path / "a.fa").write_text(">c\n" + "AC" * 2950 + SITE + "AC" * 7000 + SITE + "AC" * 2000 + "\n")
    (tmp_path / "a.gtf").write_text(GTF)
    (tmp_path / "m.meme").write_text(MEME)
    (tmp_path / "k.bed").write_text("c\t5800\t6000\nd\t1\t9\n")
    base = ["network", "--motifs", str(tmp_path / "m.meme"), "--gtf", str(tmp_path / "a.gtf"), "--fasta", str(tmp_path / "a.fa"), "--window", "2000", "2000"]
    cli.main([*base, "--out", str(tmp_path / "part"), "--report", "--bed", str(tmp_path / "k.bed")])
    edges = {r.target: float(r.N1) > 0 for r in spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/part_unfiltered_matrix.tsv.gz").collect()}
    assert edges == {"G1": True, "G2": False}  # the site near G2 lies outside
    counted = {tuple(x.split("\t")[:2]): int(x.split("\t")[2]) for x in lines(tmp_path / "part_report.tsv")[1:]}
    assert counted[("hits", "distinct names")] == 1 and counted[("hits", "rows")] == counted[("hits", "chromosome c")] == 2
    windows = spark.createDataFrame([("c", 10, 50)], "seqname string, win_start long, win_end long")
    inside = networks.regions(windows, spark.createDataFrame([("c", 0, 20), ("c", 40, 90), ("d", 0, 99)], "chrom string, start_pos long, end_pos long"))
    assert sorted(map(tuple, inside.select("chrom", "start_pos", "end_pos").collect())) == [("c", 10, 20), ("c", 40, 50)]
    assert networks.find_hits(fasta.read_tiles(spark, str(tmp_path / "a.fa")).select("seqname", "seq"), spark.createDataFrame([("m", "N", [[1.0, 0.0, 0.0, 0.0]] * 4, 2.0)], "motif_id string, motif_name string, pwm array<array<double>>, information_content double").withColumns({"background": F.lit(None).cast("array<double>"), "ln_odds": F.lit(None).cast("double")}), Params(min_ic=8.0)).count() == 0


def test_small_commands(spark, tmp_path):
    (tmp_path / "a.gtf").write_text(GTF)
    (tmp_path / "m.meme").write_text(MEME)
    cli.main(["windows", "--gtf", str(tmp_path / "a.gtf"), "--out", str(tmp_path / "w"), "--window", "500", "100"])
    assert lines(tmp_path / "w") == ["chrom\tstart\tend\tstrand\tgene_name", "c\t5501\t6101\t+\tG1", "c\t20900\t21500\t-\tG2"]
    cli.main(["motifs", "--motifs", str(tmp_path / "m.meme"), "--out", str(tmp_path / "s")])
    head, row = (x.split("\t") for x in lines(tmp_path / "s"))
    got = dict(zip(head, row))
    assert (got["motif_id"], got["motif_name"], got["information_content"], got["consensus"]) == ("m1", "N1", "24.000", SITE)
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "P1.txt").write_text("Pos\tA\tC\tG\tT\n1\t0.7\t0.1\t0.1\t0.1\n2\t0\t0\t0\t1\n")
    (tmp_path / "info.tsv").write_text("Motif_ID\tMotif_Name\tTF_Name\tTF_Status\nP1\tP1\tABC\tD\n")
    cli.main(["pwms", "--pwms", str(tmp_path / "p"), "--info", str(tmp_path / "info.tsv"), "--out", str(tmp_path / "out")])
    text = lines(tmp_path / "out")
    assert text[0] == "MEME version 4" and "MOTIF P1 ABC" in text and " 0.700000  0.100000  0.100000  0.100000" in text
