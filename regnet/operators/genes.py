"""Genes: collapse of annotation rows, start sites, promoter windows, clamping between neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import neighbours


def collapse(annotation: DataFrame, name: str = "gene_name", modes: tuple[str, ...] = ("seqname", "strand"), flags: tuple[str, ...] = ()) -> DataFrame:
    """One row per gene: outermost start and end, most common seqname and strand (the smallest of equally common ones), any() of the flags."""
    rows = annotation.filter(F.col(name).isNotNull() & F.col("start_pos").isNotNull() & F.col("end_pos").isNotNull())
    most = [F.mode(c, deterministic=True).alias(c) for c in modes]
    return rows.groupBy(name).agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), *[F.bool_or(f).alias(f) for f in flags], *most)


def tss() -> Column:
    return F.when(F.col("strand") == "-", F.col("end_pos")).otherwise(F.col("start_pos"))


def with_tss(genes: DataFrame) -> DataFrame:
    return genes.withColumn("tss", tss())


def sides(window: int | tuple[int, ...]) -> tuple[int, int]:
    if isinstance(window, int):
        return window, window
    if len(window) not in (1, 2):
        raise ValueError("a window has one or two sizes")
    return window[0], window[-1]


def promoter_windows(
    genes: DataFrame, window: int | tuple[int, ...], *, use_tss: bool = False, gene_body: bool = False,
    truncate: bool = False, lengths: DataFrame | None = None, intergenic: bool = False,
) -> DataFrame:
    """genes plus win_start and win_end, upstream and downstream by strand. lengths: seqname, length."""
    up, down = sides(window)
    minus = F.col("strand") == "-"
    left = tss() if use_tss else F.col("start_pos")
    right = tss() if use_tss else F.col("end_pos")
    df = genes.withColumn("win_start", F.greatest(left - F.when(minus, down).otherwise(up), F.lit(1)))
    df = df.withColumn("win_end", right + F.when(minus, up).otherwise(down))
    if gene_body:
        df = df.withColumn("win_end", F.when(minus, F.col("win_end")).otherwise(F.greatest("win_end", "end_pos")))
        df = df.withColumn("win_start", F.when(minus, F.least("win_start", "start_pos")).otherwise(F.col("win_start")))
    if truncate:
        df = df.withColumn("win_end", F.when(minus, F.col("win_end")).otherwise(F.least("win_end", "end_pos")))
        df = df.withColumn("win_start", F.when(minus, F.greatest("win_start", "start_pos")).otherwise(F.col("win_start")))
    if lengths is not None:
        df = df.join(lengths.select("seqname", F.col("length").alias("_length")), "seqname", "left")
        df = df.withColumn("win_start", F.least("win_start", "_length")).withColumn("win_end", F.least("win_end", "_length")).drop("_length")
    return clamp(df) if intergenic else df


def clamp(windows: DataFrame) -> DataFrame:
    """Windows cut at the end of the gene before and the start of the gene after; left alone where that empties them."""
    df = neighbours(windows, ("seqname",), ("start_pos", "end_pos", "gene_name"), before={"_before": "end_pos"}, after={"_after": "start_pos"})
    # greatest and least pass over nulls, which stand for no neighbour
    a, b = F.greatest("win_start", "_before"), F.least("win_end", "_after")
    df = df.withColumn("_a", a).withColumn("_b", b)
    return df.withColumn("win_start", F.when(F.col("_a") < F.col("_b"), F.col("_a")).otherwise(F.col("win_start"))).withColumn(
        "win_end", F.when(F.col("_a") < F.col("_b"), F.col("_b")).otherwise(F.col("win_end"))
    ).drop("_before", "_after", "_a", "_b")


def keep_named(df: DataFrame, names: DataFrame | None, column: str, name: str = "name") -> DataFrame:
    """Rows whose column is among the names, whatever the case; no names: all rows. Raises on no overlap."""
    if names is None:
        return df
    wanted = names.select(F.upper(F.trim(name)).alias("_wanted")).filter("_wanted <> ''").distinct()
    if wanted.isEmpty():
        raise ValueError("the list of names is empty")
    out = df.join(wanted, F.upper(df[column]) == F.col("_wanted"), "left_semi")
    if out.isEmpty():
        raise ValueError(f"none of the names is a {column}")
    return out


def rename_values(df: DataFrame, column: str, mapping: DataFrame, drop_unknown: bool = False) -> DataFrame:
    """column's values replaced by mapping (old, new); unknown ones stay or their rows go."""
    m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    out = df.join(m, F.col(column) == F.col("_old"), "inner" if drop_unknown else "left")
    return out.withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def chromosome_report(left: DataFrame, right: DataFrame) -> DataFrame:
    """seqname and where it occurs: both, left or right."""
    a = left.select("seqname").distinct().withColumn("_l", F.lit(True))
    b = right.select("seqname").distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left").otherwise("right")
    return a.join(b, "seqname", "full").select("seqname", side.alias("side"))


def shared_chromosomes(left: DataFrame, right: DataFrame) -> DataFrame:
    # distinct before they meet: few names, and no task takes all rows of one name
    both = left.select("seqname").distinct().intersect(right.select("seqname").distinct())
    if both.isEmpty():
        raise ValueError("no sequence name is in both")
    return both
