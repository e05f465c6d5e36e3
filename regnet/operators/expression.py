"""Counts per gene and sample: pile-up, FPKM, TPM, gene lengths, transcripts to genes. Long form throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pileup(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sample, gene, count of every gene in every sample with 0 for none; sample, meta_key, value of the "__" rows)."""
    meta = F.col("gene").startswith("__")
    own = counts.filter(~meta)
    grid = own.select("sample").distinct().crossJoin(own.select("gene").distinct())
    full = grid.join(own, ["sample", "gene"], "left").select("sample", "gene", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
    totals = own.groupBy("sample").agg(F.sum("count").alias("value")).select("sample", F.lit("aligned").alias("meta_key"), "value")
    named = counts.filter(meta).select("sample", F.regexp_replace("gene", "^__", "").alias("meta_key"), F.col("count").alias("value"))
    return full, named.unionByName(totals)


def _share(values: DataFrame, column: str) -> DataFrame:
    """values plus _total: the sample's sum of column. Sums are made in parts, and a row for each sample is joined; no sample is one task."""
    totals = values.groupBy(F.col("sample").alias("_sample")).agg(F.sum(column).alias("_total"))
    return values.join(totals, F.col("sample").eqNullSafe(F.col("_sample"))).drop("_sample")


def fpkm(counts: DataFrame, lengths: DataFrame) -> DataFrame:
    """sample, gene, fpkm of the genes with a length; library sizes are those of these genes."""
    df = _share(counts.join(lengths, "gene"), "count")
    return df.select("sample", "gene", (F.col("count") / F.col("_total") * 1e6 / F.col("length")).alias("fpkm"))


def tpm(counts: DataFrame, lengths: DataFrame) -> DataFrame:
    df = _share(counts.join(lengths, "gene").withColumn("_rate", F.col("count") / F.col("length")), "_rate")
    return df.select("sample", "gene", (F.col("_rate") / F.col("_total") * 1e6).alias("tpm"))


def unknown_lengths(counts: DataFrame, lengths: DataFrame) -> DataFrame:
    return counts.select("gene").distinct().join(lengths, "gene", "left_anti")


def gene_lengths(exons: DataFrame, per: float = 1000.0, merged: bool = False) -> DataFrame:
    """gene, length: exon lengths summed, in units of per bases; merged counts shared bases once."""
    e = exons.select("gene", "seqname", "start_pos", "end_pos")
    if merged:
        w = Window.partitionBy("gene", "seqname").orderBy("start_pos", "end_pos")
        reach = F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
        new = F.when(F.col("start_pos") <= reach, 0).otherwise(1)
        e = e.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        e = e.groupBy("gene", "seqname", "_run").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
    return e.groupBy("gene").agg((F.sum(F.abs(F.col("end_pos") - F.col("start_pos")) + 1) / per).alias("length"))


def transcripts_to_genes(values: DataFrame, t2g: DataFrame, value: str = "tpm") -> DataFrame:
    """sample, gene, the transcripts' values summed; transcripts without a gene go."""
    return values.join(t2g, "transcript").groupBy("sample", "gene").agg(F.sum(value).alias(value))


def complete_abundance(values: DataFrame, transcripts: DataFrame, samples: DataFrame) -> DataFrame:
    """Every sample and transcript; failed samples hold 0."""
    grid = samples.select("sample").crossJoin(transcripts.select("transcript"))
    return grid.join(values, ["sample", "transcript"], "left").na.fill(0)
