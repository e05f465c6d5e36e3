"""Networks from motifs: over a genome's promoters, over promoter sequences, over peaks."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.motif_math import describe, ic_or_more, shuffled, threshold_ln_odds, truncated
from ..functions.names import merge_names, name_or_id
from ..operators.genes import keep_named, promoter_windows, with_tss
from ..operators.intervals import extract, intersect
from ..operators.network import complete, edges, flag_edges, hits_near_genes, select_edges
from ..operators.peaks import peak_prior
from ..operators.reports import Reports
from ..operators.scan import place, scan_scored
from ..params import Params
from ..sources import sinks
from ..sources.motif_files import assert_unique_ids, rename_motifs


def prepare_motifs(motifs: DataFrame, *, fuzzy: bool = False, shuffle_seed: int | None = None, info: DataFrame | None = None, regulators: DataFrame | None = None, truncate: float | None = 0.35) -> DataFrame:
    """Motifs with names merged, letters shuffled, renamed, chosen and cut; information_content is that before the cut."""
    m = assert_unique_ids(motifs).withColumn("motif_name", name_or_id(F.col("motif_name"), F.col("motif_id")))
    if fuzzy:
        m = merge_names(m, "motif_name", remove_dimers=True)
    if shuffle_seed is not None:
        m = m.withColumn("pwm", shuffled(F.col("pwm"), shuffle_seed))
    if info is not None:
        m = rename_motifs(m, info)
    m = describe(keep_named(m, regulators, "motif_name"))
    return m if truncate is None else m.withColumn("pwm", truncated(F.col("pwm"), truncate))


def regions(windows: DataFrame, constraint: DataFrame | None = None) -> DataFrame:
    """The intervals to scan: promoters, or their parts inside the constraint."""
    bed = windows.select(F.col("seqname").alias("chrom"), F.col("win_start").alias("start_pos"), F.col("win_end").alias("end_pos"))
    return bed if constraint is None else intersect(constraint.select("chrom", "start_pos", "end_pos"), bed)


def find_hits(sequences: DataFrame, motifs: DataFrame, p: Params, scanner: str = "p_value") -> DataFrame:
    strong = ic_or_more(motifs, p.min_ic)
    odds = strong.select("motif_id", F.coalesce("ln_odds", threshold_ln_odds(F.col("pwm"))).alias("threshold")) if scanner == "odds" else None
    return scan_scored(sequences, strong, p_value=p.p_value, odds=odds)


def network(hits: DataFrame, genes: DataFrame, motifs: DataFrame, p: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, complete scores in long form, the same with edge flags) of hits that have their target."""
    ic = motifs.select(F.col("motif_name").alias("regulator"), "information_content")
    # all that follows asks for the edges, some of it several times: sequences are scanned once
    found = edges(hits, ic, max_gap=p.tandem, min_ic=p.min_ic).persist(StorageLevel.MEMORY_AND_DISK)
    scores = complete(found, genes.select(F.col("gene_name").alias("target")), ic)
    return found, scores, select_edges(scores).persist(StorageLevel.MEMORY_AND_DISK)


def from_genome(
    genes: DataFrame, sequences: DataFrame, motifs: DataFrame, p: Params = Params(), *, lengths: DataFrame | None = None, constraint: DataFrame | None = None,
    gene_names: DataFrame | None = None, scanner: str = "p_value", hits_out: str | None = None, reports: Reports | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """reports: counts hits by chromosome and motif names, and the intervals that are scanned."""
    chosen = keep_named(with_tss(genes), gene_names, "gene_name")
    windows = promoter_windows(chosen, p.window, use_tss=p.use_tss, lengths=lengths, intergenic=p.intergenic)
    bed = regions(windows, constraint)
    if reports is not None:
        bed = reports.watch(bed, "intervals", chromosome="chrom")
    hits = place(find_hits(extract(sequences, bed), motifs, p, scanner))
    if reports is not None:
        hits = reports.watch(hits, "hits", chromosome="seqname", names="regulator")
    if hits_out:
        sinks.write_hits(hits, hits_out)
    return network(hits_near_genes(hits, windows), windows, motifs, p)


def from_promoters(sequences: DataFrame, motifs: DataFrame, p: Params = Params(), *, gene_names: DataFrame | None = None, scanner: str = "p_value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each sequence is a gene's promoter: hits go to the gene of that name."""
    genes = keep_named(sequences.select(F.col("seqname").alias("gene_name")), gene_names, "gene_name")
    mine = sequences.join(genes, sequences["seqname"] == genes["gene_name"], "left_semi")
    hits = find_hits(mine, motifs, p, scanner).withColumn("target", F.col("seqname"))
    return network(hits, genes, motifs, p)


def from_peaks(linked: DataFrame, mask: DataFrame | None = None, fraction: float = 0.75, threshold: bool = True) -> DataFrame:
    """target, regulator, score, edge over all genes and regulators of linked peaks."""
    prior = peak_prior(linked, mask, fraction)
    scores = complete(prior, prior, prior)
    return select_edges(scores) if threshold else scores.withColumn("edge", F.col("score") != 0)


def save(prefix: str, found: DataFrame, scores: DataFrame, flags: DataFrame, regulators: DataFrame | list[str], flagged: bool = False) -> None:
    """regulators: regulator, the matrices' columns."""
    sinks.write_matrix(scores, f"{prefix}_unfiltered_matrix.tsv.gz", regulators)
    sinks.write_matrix(flags, f"{prefix}_edge_matrix.tsv.gz", regulators, "edge")
    if flagged:
        sinks.write_table(flag_edges(found, flags), f"{prefix}_tf_binding_locs_filtered.tsv")


def summarize(motifs: DataFrame, out: str) -> None:
    sinks.write_summary(describe(motifs), out)


def session(name: str = "regnet") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
