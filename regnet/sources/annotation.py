"""Readers of annotation, intervals and sequences. Compression goes by the file's extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.names import GENE_ID, attribute
from ..operators.genes import collapse, with_tss
from . import fasta

HEADER_NAMES = ("chrom", "start", "end", "strand")


def read_gtf(spark: SparkSession, path: str | list[str], gene_id: str = GENE_ID, extra: dict[str, str] | None = None, protein_coding: bool = False) -> DataFrame:
    """Annotation rows with gene_name and one column per extra pattern; rows without start or end go."""
    df = spark.read.schema(schemas.GTF).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)
    df = df.na.drop(subset=["start_pos", "end_pos"]).withColumn("gene_name", attribute(F.col("attributes"), gene_id))
    for name, pattern in (extra or {}).items():
        df = df.withColumn(name, attribute(F.col("attributes"), pattern))
    if protein_coding:
        df = df.withColumn("protein_coding", F.coalesce(F.contains("attributes", F.lit("protein_coding")), F.lit(False)))
    return df


def read_genes(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """One row per gene with its start site; raises where there is none."""
    rows = read_gtf(spark, path, **options)
    modes = ("seqname", "strand", *(options.get("extra") or {}))
    genes = with_tss(collapse(rows, modes=modes, flags=("protein_coding",) if options.get("protein_coding") else ()))
    if genes.isEmpty():
        raise ValueError(f"no gene in {path}")
    return genes


def read_bed(spark: SparkSession, path: str | list[str], narrow_peak: bool = False, has_name: bool = False) -> DataFrame:
    """chrom, start_pos, end_pos, strand and further columns. A first line with known names is a header; else the fourth
    column is the strand (has_name: the name, then the score and the strand)."""
    lines = spark.read.text(path).limit(2).collect()
    first = lines[0][0].lower().lstrip("#").split("\t") if lines else []
    if any(n in first for n in HEADER_NAMES):
        df = spark.read.option("sep", "\t").option("header", True).csv(path)
        renamed = {"start": "start_pos", "end": "end_pos", "seqname": "chrom"}
        df = df.toDF(*[renamed.get(c.lower().lstrip("#"), c.lstrip("#")) for c in df.columns])
        df = df.withColumn("start_pos", F.expr("try_cast(start_pos AS bigint)")).withColumn("end_pos", F.expr("try_cast(end_pos AS bigint)"))
    elif narrow_peak:
        df = spark.read.schema(schemas.NARROW_PEAK).option("sep", "\t").csv(path)
    else:
        names = ["chrom string", "start_pos bigint", "end_pos bigint", *(["name string", "score double"] if has_name else []), "strand string"]
        n = max(len(first), 3)
        names = (names + [f"`{i}` string" for i in range(max(0, n - len(names)))])[:n]
        df = spark.read.schema(", ".join(names)).option("sep", "\t").option("comment", "#").csv(path)
    return df if "strand" in df.columns else df.withColumn("strand", F.lit("."))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """seqname, seq per record. Records begin at a ">" at a line's start; lines with # are comments. Text before the first
    header of a file is an error. For genomes, fasta.read_tiles holds no sequence in one row."""
    return fasta.read_records(spark, path)


def fasta_lengths(sequences: DataFrame) -> DataFrame:
    return sequences.select("seqname", F.length("seq").cast("bigint").alias("length"))


def read_names(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The first column of a file without header, as name."""
    return spark.read.text(path).select(F.trim(F.split("value", sep)[0]).alias("name")).filter("name <> ''")
