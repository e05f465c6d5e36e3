"""Command line: python -m regnet.plans.cli COMMAND ..."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.expression import complete_abundance, fpkm, gene_lengths, pileup, tpm, transcripts_to_genes
from ..operators.genes import promoter_windows
from ..operators.intervals import link_peaks
from ..operators.peaks import batch_link
from ..operators.reports import Reports
from ..params import Params, preset
from ..sources import annotation, fasta, motif_files, sinks, tables
from . import networks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="regnet")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *flags: [sub.choices[name].add_argument(f, **k) for f, k in flags] if name in sub.choices else None
    common = [("--motifs", {"required": True}), ("--format", {}), ("--species", {}), ("--out", {"required": True}), ("--genes", {}), ("--tfs", {}), ("--fuzzy", {"action": "store_true"})]
    common += [
        ("--scanner", {"choices": ["p_value", "odds"], "default": "p_value"}), ("--p-value", {"type": float}), ("--min-ic", {"type": float}), ("--tandem", {"type": int}),
        ("--info", {}), ("--shuffle", {"type": int}), ("--truncate", {"type": float, "default": 0.35}), ("--save-flagged", {"action": "store_true"}),
    ]
    for name, flags in {
        "network": [*common, ("--gtf", {"required": True}), ("--fasta", {"required": True}), ("--bed", {}), ("--window", {"type": int, "nargs": "+"}), ("--no-tss", {"action": "store_true"}), ("--intergenic", {"action": "store_true"}), ("--save-hits", {"action": "store_true"}), ("--report", {"action": "store_true"})],
        "promoters": [*common, ("--fasta", {"required": True})],
        "link": [("--gtf", {"required": True}), ("--bed", {"required": True}), ("--out", {"required": True}), ("--window", {"type": int, "nargs": "+", "default": [5000, 500]}), ("--intergenic", {"action": "store_true"}), ("--distance", {"action": "store_true"})],
        "windows": [("--gtf", {"required": True}), ("--out", {"required": True}), ("--window", {"type": int, "nargs": "+", "default": [5000, 500]})],
        "motifs": [("--motifs", {"required": True}), ("--format", {}), ("--out", {"required": True})],
        "pwms": [("--pwms", {"required": True}), ("--info", {"required": True}), ("--out", {"required": True})],
        "encode-link": [("--metadata", {"required": True}), ("--beds", {"required": True, "nargs": "+"}), ("--gtf", {"required": True}), ("--out", {"required": True}), ("--window", {"type": int, "nargs": "+", "default": [5000, 500]}), ("--keep-errors", {"action": "store_true"}), ("--skip-noncompliant", {"action": "store_true"}), ("--suffix", {"default": "-human"})],
        "encode-prior": [("--linked", {"required": True, "nargs": "+"}), ("--mask", {}), ("--fraction", {"type": float, "default": 0.75}), ("--out", {"required": True})],
        "expression": [("--counts", {"required": True}), ("--lengths", {}), ("--gtf", {}), ("--out", {"required": True}), ("--resume", {"action": "store_true"})],
        "abundance": [("--abundances", {"required": True, "nargs": "+"}), ("--t2g", {}), ("--samples", {"nargs": "+"}), ("--out", {"required": True}), ("--resume", {"action": "store_true"})],
    }.items():
        sub.add_parser(name)
        add(name, *flags)
    return p


def params(a: argparse.Namespace) -> Params:
    """The species' preset, with the options that are given in its place."""
    given = {"p_value": a.p_value, "min_ic": a.min_ic, "tandem": a.tandem}
    if a.command == "network":
        given |= {"window": tuple(a.window) if a.window else None, "use_tss": False if a.no_tss else None, "intergenic": True if a.intergenic else None}
    return replace(preset(a.species), **{k: v for k, v in given.items() if v is not None})


def make_network(spark: SparkSession, a: argparse.Namespace) -> None:
    names = lambda path: annotation.read_names(spark, path) if path else None
    p = params(a)
    info = motif_files.read_motif_info(spark, a.info) if a.info else None
    motifs = networks.prepare_motifs(motif_files.read_motifs(spark, a.motifs, a.format), fuzzy=a.fuzzy, shuffle_seed=a.shuffle, info=info, regulators=names(a.tfs), truncate=a.truncate)
    if a.command == "network":
        seqs = fasta.read_tiles(spark, a.fasta)
        bed = annotation.read_bed(spark, a.bed) if a.bed else None
        hits_out = f"{a.out}_tf_binding_locs.tsv" if a.save_hits else None
        genes = annotation.read_genes(spark, a.gtf)
        reports = Reports.of(genes) if a.report else None
        made = networks.from_genome(genes, seqs, motifs, p, lengths=fasta.tile_lengths(seqs), constraint=bed, gene_names=names(a.genes), scanner=a.scanner, hits_out=hits_out, reports=reports)
    else:
        reports = None
        made = networks.from_promoters(annotation.read_fasta(spark, a.fasta), motifs, p, gene_names=names(a.genes), scanner=a.scanner)
    networks.save(a.out, *made, motifs.select(F.col("motif_name").alias("regulator")), flagged=a.save_flagged)
    if reports is not None:
        lines = spark.createDataFrame(reports.lines(), "counted string, name string, n bigint")
        sinks.write_table(lines, f"{a.out}_report.tsv")


def make_expression(spark: SparkSession, a: argparse.Namespace) -> None:
    """Counts, the samples' metadata, and FPKM and TPM where lengths are given or made of the annotation's exons."""
    if a.lengths and a.gtf:
        raise ValueError("lengths come from a file or from an annotation, not from both")
    counts, meta = pileup(tables.read_counts(spark, a.counts))
    sinks.write_wide(counts, f"{a.out}_counts.tsv", "sample", "gene", "count", resume=a.resume)
    sinks.write_table(meta, f"{a.out}_metadata.tsv", resume=a.resume)
    if a.lengths:
        lengths = spark.read.schema("gene string, length double").option("sep", "\t").csv(a.lengths)
    elif a.gtf:
        exons = annotation.read_gtf(spark, a.gtf).filter("feature = 'exon'")
        lengths = gene_lengths(exons.withColumnRenamed("gene_name", "gene").na.drop(subset=["gene"]))
    else:
        return
    sinks.write_wide(fpkm(counts, lengths), f"{a.out}_fpkm.tsv", "sample", "gene", "fpkm", resume=a.resume)
    sinks.write_wide(tpm(counts, lengths), f"{a.out}_tpm.tsv", "sample", "gene", "tpm", resume=a.resume)


def make_abundance(spark: SparkSession, a: argparse.Namespace) -> None:
    """Samples by transcripts, 0 for the named samples without a file; by genes as well with t2g."""
    found = tables.read_abundance(spark, a.abundances)
    samples = spark.createDataFrame([(s,) for s in a.samples], "sample string") if a.samples else found.select("sample").distinct()
    full: DataFrame = complete_abundance(found, found.select("transcript").distinct(), samples)
    sinks.write_wide(full, f"{a.out}_counts.tsv", "sample", "transcript", "est_counts", resume=a.resume)
    sinks.write_wide(full, f"{a.out}_tpm.tsv", "sample", "transcript", "tpm", resume=a.resume)
    if a.t2g:
        sinks.write_wide(transcripts_to_genes(full, tables.read_t2g(spark, a.t2g)), f"{a.out}_gene_tpm.tsv", "sample", "gene", "tpm", resume=a.resume)


def link_experiments(spark: SparkSession, a: argparse.Namespace) -> None:
    """Peaks of the experiments that the metadata lets pass, linked to genes, with regulator and accession."""
    peaks = annotation.read_bed(spark, a.beds, narrow_peak=True).withColumn("file_name", tables.file_name())
    there = spark.createDataFrame([(b.rsplit("/", 1)[-1],) for b in a.beds], "file_name string")
    meta = tables.read_encode_metadata(spark, a.metadata, there, a.suffix)
    meta = meta.withColumn("error", F.lit(False)) if a.keep_errors else meta
    meta = meta if a.skip_noncompliant else meta.withColumn("noncompliant", F.lit(False))
    windows = promoter_windows(annotation.read_genes(spark, a.gtf), tuple(a.window), use_tss=True)
    linked = batch_link(peaks, meta, windows)
    sinks.write_table(linked.select("chrom", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), "strand", "regulator", "gene", "signal_value", "accession"), a.out, single=False)


def make_experiment_prior(spark: SparkSession, a: argparse.Namespace) -> None:
    linked = annotation.read_bed(spark, a.linked).withColumn("signal_value", F.col("signal_value").cast("double"))
    made = networks.from_peaks(linked, annotation.read_bed(spark, a.mask) if a.mask else None, a.fraction)
    sinks.write_table(made, f"{a.out}_long.tsv", single=False)
    sinks.write_matrix(made.withColumn("score", F.when(F.col("edge"), F.col("score")).otherwise(0.0)), f"{a.out}.tsv.gz", linked)


PLANS = {
    "network": make_network, "promoters": make_network, "expression": make_expression, "abundance": make_abundance, "encode-link": link_experiments, "encode-prior": make_experiment_prior,
}


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = networks.session()
    if a.command in PLANS:
        PLANS[a.command](spark, a)
    elif a.command in ("link", "windows"):
        w = promoter_windows(annotation.read_genes(spark, a.gtf), tuple(a.window), use_tss=True)
        if a.command == "windows":
            sinks.write_bed(w.selectExpr("seqname AS chrom", "win_start AS start", "win_end AS end", "strand", "gene_name"), a.out, header=True)
        else:
            sinks.write_bed(link_peaks(annotation.read_bed(spark, a.bed), w, intergenic=a.intergenic, distance=a.distance), a.out)
    elif a.command == "motifs":
        networks.summarize(motif_files.read_motifs(spark, a.motifs, a.format), a.out)
    else:
        sinks.write_meme(motif_files.read_pwm_files(spark, a.pwms, motif_files.read_motif_info(spark, a.info)), a.out)


if __name__ == "__main__":
    main()
