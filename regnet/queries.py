"""Each operator as a query over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import motif_math as mm
from .functions.names import attribute, fuzzy_key, is_dimer, merge_names
from .functions.sequences import match_score, reverse_complement
from .operators import expression, genes, intervals, near, network, peaks, ranges, scan, sites
from .plans import views as v
from .sources import annotation, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _near(s: SparkSession, d: str) -> DataFrame:
    return network.hits_near_genes(v.hits(s, d), v.bodies(s, d)).select("target", "regulator", "seqname", "start_pos", "stop_pos", "score", "per_base")


WINDOW = ["gene_name", "seqname", "strand", "win_start", "win_end"]
MOTIF = "GATTACACCTGAAGTC"
IC_MIN, GAP = 8.0, 50


@query
def jn_overlap(s, d):
    return _near(s, d).drop("per_base")


@query
def prj_tss(s, d):
    return genes.with_tss(v.genes(s, d)).select("gene_name", "seqname", "strand", "tss")


@query
def win_promoter(s, d):
    return genes.promoter_windows(v.genes(s, d), (500, 100), use_tss=True).select(*WINDOW)


@query
def win_gene_body(s, d):
    return genes.promoter_windows(v.genes(s, d), (500, 100), use_tss=True, gene_body=True).select(*WINDOW)


@query
def win_truncate(s, d):
    return genes.promoter_windows(v.genes(s, d), (500, 400), use_tss=True, truncate=True).select(*WINDOW)


@query
def win_intergenic(s, d):
    return genes.promoter_windows(v.genes(s, d), (500, 100), use_tss=False, intergenic=True).select(*WINDOW)


@query
def jn_clip(s, d):
    lengths = v.genes(s, d).groupBy("seqname").agg((F.max("end_pos") - 500).alias("length")).filter("seqname <> 'chr4'")
    return genes.promoter_windows(v.genes(s, d), 1000, lengths=lengths).select(*WINDOW)


@query
def agg_gene_collapse(s, d):
    rows = s.read.parquet(f"{d}/lineitem.parquet").selectExpr(
        "concat('gene_id \"g', CAST(l_partkey % 5000 AS STRING), '\"; n \"', CAST(l_linenumber AS STRING), '\";') AS attributes",
        "concat('chr', CAST(l_suppkey % 5 AS STRING)) AS seqname", "CASE WHEN l_orderkey % 3 = 0 THEN '-' ELSE '+' END AS strand",
        "l_orderkey AS start_pos", "l_orderkey + CAST(l_quantity AS BIGINT) AS end_pos", "l_returnflag = 'R' AS protein_coding",
    )
    return genes.collapse(rows.withColumn("gene_name", attribute(F.col("attributes"))), flags=("protein_coding",)).select("gene_name", "seqname", "strand", "start_pos", "end_pos", "protein_coding")


def _wanted(s, d):
    return s.read.parquet(f"{d}/supplier.parquet").selectExpr("concat('tf', CAST(s_suppkey % 7 AS STRING)) AS name")


@query
def flt_gene_list(s, d):
    names = s.read.parquet(f"{d}/customer.parquet").selectExpr("CAST(c_custkey * 3 AS STRING) AS name")
    return genes.keep_named(v.genes(s, d), names, "gene_name")


@query
def flt_tf_list(s, d):
    return genes.keep_named(v.motif_ic(s, d), _wanted(s, d), "regulator")


@query
def flt_min_ic(s, d):
    return mm.ic_or_more(v.motif_ic(s, d), IC_MIN)


@query
def flt_min_score(s, d):
    kept = mm.ic_or_more(v.motif_ic(s, d), 11.0).select("regulator")
    return v.hits(s, d).drop("per_base").filter(F.col("score") >= 40).join(kept, "regulator", "left_semi").select("regulator", "seqname", "start_pos", "stop_pos", "score")


def _names(s, d):
    return s.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) WHEN p_partkey % 4 = 1 THEN replace(p_name, ' ', '-') WHEN p_partkey % 7 = 0 THEN concat(p_name, ' (var.2)') WHEN p_partkey % 11 = 0 THEN concat(p_name, ':', p_name) ELSE p_name END AS name")


@query
def flt_dimers(s, d):
    return _names(s, d).filter(~is_dimer(F.col("name")))


@query
def mot_fuzzy(s, d):
    n = merge_names(_names(s, d), "name", remove_dimers=True)
    return n.select("id", "name", fuzzy_key(F.col("name")).alias("name_key"))


@query
def chr_check(s, d):
    right = v.peaks(s, d).filter("chrom <> 'chr1'").select(F.col("chrom").alias("seqname")).union(v.peaks(s, d).select(F.concat("file_name", F.lit("x"))))
    return genes.chromosome_report(v.genes(s, d), right)


@query
def flt_rename(s, d):
    m = s.createDataFrame([("chr0", "I"), ("chr1", "II"), ("chr3", "IV")], "old string, new string")
    return genes.rename_values(v.genes(s, d), "seqname", m, drop_unknown=True).select("gene_name", "seqname")


@query
def jn_bucket(s, d):
    h = v.hits(s, d).select(F.col("seqname").alias("target"), "regulator", "score")
    g = s.createDataFrame([("chr1",), ("chr3",), ("none",)], "target string")
    return h.join(g, "target").groupBy("target", "regulator").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))


@query
def jn_intersect(s, d):
    return intervals.intersect(v.peaks(s, d), v.mask(s, d)).select("chrom", "start_pos", "end_pos", "file_name")


@query
def jn_intersect_wb(s, d):
    return intervals.intersect(v.peaks(s, d), v.mask(s, d), keep_b=True).select("chrom", "start_pos", "end_pos", "b_start_pos", "b_end_pos")


@query
def jn_intersect_frac(s, d):
    return intervals.intersect(v.peaks(s, d), v.mask(s, d), keep_a=True, fraction=0.75).select("chrom", "start_pos", "end_pos", "file_name")


def _windows(s, d):
    return genes.promoter_windows(genes.with_tss(v.genes(s, d)), (500, 100), use_tss=True)


@query
def jn_link_intergenic(s, d):
    return intervals.link_peaks(v.peaks(s, d), _windows(s, d), intergenic=True).select("chrom", "start_pos", "end_pos", "strand", "gene", "file_name")


@query
def jn_link_distance(s, d):
    return intervals.link_peaks(v.peaks(s, d), _windows(s, d), distance=True).select("chrom", "start_pos", "end_pos", "gene", "distance")


# the same queries, by names under which they were registered while these were bound to a part of the genes
QUERIES["jn_link_intergenic_all"], QUERIES["jn_link_distance_all"] = jn_link_intergenic, jn_link_distance


@query
def seq_extract(s, d):
    bed = v.sequences(s, d).select(F.col("seqname").alias("chrom"), F.explode(F.array(*[F.lit(x).cast("bigint") for x in (0, 25, 60)])).alias("start_pos")).withColumn("end_pos", F.col("start_pos") + 30)
    return intervals.extract(v.sequences(s, d), bed)


@query
def seq_revcomp(s, d):
    return v.sequences(s, d).select("seqname", reverse_complement(F.col("seq")).alias("rc"))


@query
def fasta_lengths(s, d):
    return annotation.fasta_lengths(v.sequences(s, d))


@query
def seq_scan_exact(s, d):
    one = s.createDataFrame([("m", [[float(c == x) for x in "ACGT"] for c in "GATTA"], [0.25] * 4)], "motif_id string, pwm array<array<double>>, background array<double>")
    return scan.scan(v.sequences(s, d), one, p_value=0.001).select("seqname", "start_pos", "stop_pos", "strand", "matched")


_SCANNED = ["motif_id", "regulator", "seqname", "start_pos", "stop_pos", "strand"]


@query
def seq_scan_pvalue(s, d):
    m = v.motifs(s, d).withColumn("background", mm.uniform_background())
    return scan.scan_scored(v.sequences(s, d), m, p_value=1e-3, bases=False, digits=(9, 6)).select(*_SCANNED, "p_value", "matched", "score")


@query
def seq_scan_odds(s, d):
    m = v.motifs(s, d).withColumn("background", mm.uniform_background())
    odds = m.select("motif_id", mm.threshold_ln_odds(F.col("pwm")).alias("threshold"))
    return scan.scan_scored(v.sequences(s, d), m, odds=odds, bases=False, digits=(6, 6)).select(*_SCANNED, "odds", "matched", "score")


@query
def score_match(s, d):
    m = v.motifs(s, d)
    return m.select("motif_id", F.round(match_score(mm.information_matrix(F.col("pwm")), F.col("pwm"), F.lit(MOTIF)), 6).alias("score"))


@query
def win_islands(s, d):
    h = sites.islands(v.hits(s, d).drop("per_base"), ("seqname", "regulator"), width=ranges.WIDTH)
    return h.groupBy("seqname", "regulator", "island").agg(F.min("start_pos").alias("start_pos"), F.max("stop_pos").alias("stop_pos"), F.count(F.lit(1)).alias("n"))


@query
def agg_per_base(s, d):
    return near.sites_near(v.hits(s, d), v.bodies(s, d)).select("target", "regulator", "start_pos", "stop_pos", "score")


@query
def win_tandem(s, d):
    def arrays(merged, keys):
        t = sites.islands(merged, keys, gap=GAP, name="array")
        return t.groupBy(*keys, "array").agg(F.min("start_pos").alias("start_pos"), F.max("stop_pos").alias("stop_pos"), F.sum("score").alias("score"), F.count(F.lit(1)).alias("n_sites"))

    return near.sites_near(v.hits(s, d), v.bodies(s, d), arrays)


@query
def site_score(s, d):
    kept = v.hits(s, d).filter(F.col("score") >= 10.0)
    return near.sites_near(kept, v.bodies(s, d), lambda merged, keys: sites.best_arrays(merged, GAP, keys))


@query
def top_hit(s, d):
    return near.top_near(v.hits(s, d).drop("per_base"), v.bodies(s, d))


def _edges(s, d):
    return near.edges_near(v.hits(s, d), v.bodies(s, d), v.motif_ic(s, d), max_gap=GAP, min_ic=IC_MIN)


@query
def net_edges(s, d):
    return _edges(s, d).withColumn("motif_ic", F.round("motif_ic", 6))


def _grid(s, d):
    return network.complete(_edges(s, d), v.genes(s, d).select(F.col("gene_name").alias("target")), v.motif_ic(s, d))


@query
def net_complete(s, d):
    return _grid(s, d)


@query
def net_matrix_long(s, d):
    return network.wide(_grid(s, d), [f"TF{i}" for i in range(25)]).select("target", *[F.col(f"TF{i}").alias(f"tf_{i}") for i in range(25)])


@query
def net_unpivot(s, d):
    return network.melt(network.wide(_grid(s, d), [f"TF{i}" for i in range(25)])).filter("score > 0")


@query
def net_nonzero(s, d):
    return _grid(s, d).groupBy("regulator").agg(F.count_if(F.col("score") != 0).alias("n_nonzero"), F.count(F.lit(1)).alias("n"))


@query
def sel_dbscan(s, d):
    return network.clusters(_grid(s, d))


@query
def sel_edges(s, d):
    return network.select_edges(_grid(s, d)).select("target", "regulator", "score", "edge")


@query
def net_flagged(s, d):
    return network.flag_edges(_edges(s, d), network.select_edges(_grid(s, d)), only_kept=False).select("target", "regulator", "score", "filter_included")


@query
def mot_entropy(s, d):
    return v.motifs(s, d).select("motif_id", F.round(mm.entropy(F.col("pwm")), 6).alias("entropy"))


@query
def mot_ic(s, d):
    return v.motifs(s, d).select("motif_id", F.round(mm.information(F.col("pwm")), 6).alias("ic"))


@query
def mot_consensus(s, d):
    return v.motifs(s, d).select("motif_id", mm.consensus(F.col("pwm")).alias("consensus"))


@query
def mot_degenerate(s, d):
    return v.motifs(s, d).select("motif_id", mm.degenerate_consensus(F.col("pwm")).alias("consensus"))


@query
def mot_ln_odds(s, d):
    return v.motifs(s, d).select("motif_id", F.round(mm.max_ln_odds(F.col("pwm")), 6).alias("max_ln_odds"), F.round(mm.threshold_ln_odds(F.col("pwm")), 6).alias("threshold_ln_odds"))


@query
def mot_truncate(s, d):
    t = v.motifs(s, d).withColumn("pwm", mm.truncated(F.col("pwm"), 0.5))
    return t.select("motif_id", F.size("pwm").cast("bigint").alias("length"), mm.consensus(F.col("pwm")).alias("consensus"))


@query
def mot_summary(s, d):
    m = mm.describe(v.motifs(s, d))
    return m.select("motif_id", "motif_name", F.round("information_content", 6).alias("ic"), F.round("shannon_entropy", 6).alias("entropy"), "occurrence", F.col("length").cast("bigint").alias("length"), "consensus")


@query
def mot_shuffle(s, d):
    return v.motifs(s, d).select("motif_id", mm.consensus(mm.shuffled(F.col("pwm"), 7)).alias("consensus"))


@query
def exp_pileup(s, d):
    full, meta = expression.pileup(v.counts(s, d))
    return full.select("sample", "gene", "count").unionByName(meta.select("sample", F.concat(F.lit("meta:"), "meta_key").alias("gene"), F.col("value").alias("count")))


def _counted(s, d):
    return v.counts(s, d).filter("NOT startswith(gene, '__')")


@query
def exp_fpkm(s, d):
    return expression.fpkm(_counted(s, d), v.lengths(s, d)).select("sample", "gene", F.round("fpkm", 4).alias("fpkm"))


@query
def exp_tpm(s, d):
    return expression.tpm(_counted(s, d), v.lengths(s, d)).select("sample", "gene", F.round("tpm", 4).alias("tpm"))


@query
def exp_lengths(s, d):
    exons = v.hits(s, d).select(F.col("regulator").alias("gene"), "seqname", "start_pos", (F.col("stop_pos") + 40).alias("end_pos"))
    whole, merged = expression.gene_lengths(exons), expression.gene_lengths(exons, merged=True)
    return whole.join(merged.withColumnRenamed("length", "merged"), "gene").select("gene", F.round("length", 6).alias("length"), F.round("merged", 6).alias("merged"))


@query
def exp_t2g(s, d):
    t2g = s.read.parquet(f"{d}/part.parquet").selectExpr("CAST(p_partkey AS STRING) AS transcript", "p_brand AS gene")
    tpm = expression.tpm(_counted(s, d), v.lengths(s, d)).withColumnRenamed("gene", "transcript")
    return expression.transcripts_to_genes(tpm, t2g).select("sample", "gene", F.round("tpm", 4).alias("tpm"))


@query
def exp_unknown(s, d):
    return expression.unknown_lengths(_counted(s, d), v.lengths(s, d).filter("CAST(gene AS BIGINT) % 5 <> 0"))


def _metadata(s, d):
    """Metadata of every supplier. Files and audit flags recur with the row, without a bound on ids."""
    rows = s.read.parquet(f"{d}/supplier.parquet")
    raw = rows.selectExpr(
        "concat('EXP', CAST(s_suppkey AS STRING)) AS `File accession`", "concat(CASE WHEN s_suppkey % 2 = 0 THEN 'hum' ELSE 'MAX' END, CAST(s_suppkey % 3 AS STRING), '-human') AS `Experiment target`",
        "CASE WHEN s_suppkey % 8 = 3 THEN 'bad' END AS `Audit ERROR`", "CASE WHEN s_suppkey % 8 = 4 THEN 'hm' END AS `Audit WARNING`", "CASE WHEN s_suppkey % 8 = 5 THEN 'no' END AS `Audit NOT_COMPLIANT`")
    files = rows.filter("s_suppkey % 8 <> 7").selectExpr("concat('EXP', CAST(s_suppkey AS STRING), '.bed.gz') AS file_name")
    return tables.encode_metadata(raw, files)


@query
def enc_metadata(s, d):
    return _metadata(s, d).select("accession", "tf", "file_name", "file_exists", "error", "warning", "noncompliant")


def _experiments(s, d):
    n = s.read.parquet(f"{d}/supplier.parquet").agg(F.count(F.lit(1)).alias("_n"))
    return v.peaks_of(s, d, n), _metadata(s, d), genes.with_tss(v.bodies(s, d))


def _linked(s, d):
    return peaks.batch_link(*_experiments(s, d))


@query
def enc_batch_link(s, d):
    return _linked(s, d).select("chrom", "start_pos", "end_pos", "gene", "regulator", "accession", "signal_value")


@query
def enc_prior(s, d):
    return peaks.prior_near(*_experiments(s, d), v.mask(s, d), 0.5)


@query
def enc_quality(s, d):
    return peaks.quality_report(_metadata(s, d))


@query
def dst_peaks(s, d):
    return peaks.distinct_links(*_experiments(s, d))


# the same queries, by names under which they were registered while these were bound to a part of the metadata
QUERIES.update({f"{f.__name__}_all": f for f in (enc_metadata, enc_batch_link, enc_prior, enc_quality, dst_peaks)})


@query
def dst_hits(s, d):
    h = v.hits(s, d).withColumnRenamed("regulator", "motif_id").withColumn("strand", F.lit("+"))
    return sites.distinct_hits(h, order="score").select("motif_id", "seqname", "start_pos", "stop_pos", "score")


@query
def set_union(s, d):
    a = v.genes(s, d).select("seqname", "start_pos", "end_pos")
    b = v.mask(s, d).select(F.col("chrom").alias("seqname"), "start_pos", "end_pos", "strand")
    return a.unionByName(b, allowMissingColumns=True)


@query
def set_symdiff(s, d):
    a, b = v.genes(s, d).select("seqname", "start_pos"), v.peaks(s, d).select(F.col("chrom").alias("seqname"), "start_pos")
    return a.distinct().exceptAll(b.distinct()).union(b.distinct().exceptAll(a.distinct()))


@query
def set_shared(s, d):
    return genes.shared_chromosomes(v.genes(s, d), v.peaks(s, d).select(F.col("chrom").alias("seqname")))
