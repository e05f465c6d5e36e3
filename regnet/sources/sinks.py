"""Sinks. Tables are made wide here alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.motif_math import LETTERS


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to path was committed: what a failed one has left behind has no marker."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def write_table(df: DataFrame, path: str, *, header: bool = True, gzip: bool = False, single: bool = True, resume: bool = False) -> None:
    """resume leaves a path whose write was finished as it is."""
    if resume and finished(df.sparkSession, path):
        return
    out = df.coalesce(1) if single else df
    out.write.mode("overwrite").option("sep", "\t").option("header", header).option("compression", "gzip" if gzip else "none").csv(path)


def write_matrix(long: DataFrame, path: str, regulators: DataFrame | list[str], value: str = "score", *, resume: bool = False) -> None:
    """Genes by regulators; booleans as 0 and 1. long holds every gene and regulator (network.complete), so regulators
    (regulator: the columns, or a list of them) tells the header without going over it."""
    if isinstance(regulators, list):
        regulators = long.sparkSession.createDataFrame([(r,) for r in regulators], "regulator string")
    kind = "int" if dict(long.dtypes)[value] == "boolean" else dict(long.dtypes)[value]
    cells = long.select("target", "regulator", F.col(value).cast(kind).alias("score"))
    write_wide(cells, path, "target", "regulator", "score", columns=regulators.select("regulator"), gzip=True, resume=resume)


def write_wide(long: DataFrame, path: str, row: str, column: str, value: str, *, columns: DataFrame | None = None, gzip: bool = False, resume: bool = False) -> None:
    """One line per row, its values in order of column; every row must hold every column. There is no limit of columns. Lines
    are written by ranges of row by many tasks; the part files in order of their names are one text with one header.
    A repeated row and column is an error."""
    if resume and finished(long.sparkSession, path):
        return
    cells = F.sort_array(F.collect_list(F.struct(F.col(column).alias("k"), F.col(value).cast("string").alias("v"))))
    lines = long.groupBy(F.col(row).alias("r")).agg(cells.alias("c"))
    n = F.size("c") - 1
    once = ~F.exists(F.zip_with(F.slice("c.k", F.lit(1), n), F.slice("c.k", F.lit(2), n), lambda a, b: a.eqNullSafe(b)), lambda same: same)  # in order, so repeated ones are side by side
    line = F.when(once, F.concat_ws("\t", "r", F.array_join("c.v", "\t", ""))).otherwise(F.raise_error(F.concat(F.lit("repeated column in row "), "r")).cast("string"))
    head = (long if columns is None else columns).select(F.col(column).alias("k")).distinct().agg(F.array_join(F.sort_array(F.collect_list("k")), "\t").alias("h")).select(F.lit(0).alias("i"), F.lit("").alias("r"), F.concat_ws("\t", F.lit(row), "h").alias("value"))
    body = lines.select(F.lit(1).alias("i"), "r", line.alias("value"))
    head.unionByName(body).orderBy("i", "r").select("value").write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(path)


def write_hits(hits: DataFrame, path: str) -> None:
    write_table(hits.drop("per_base"), path, single=False)


def write_bed(bed: DataFrame, path: str, header: bool = False) -> None:
    first = [c for c in ("chrom", "seqname") if c in bed.columns][0]
    write_table(bed.orderBy(first, bed.columns[1]), path, header=header)


def write_summary(described: DataFrame, path: str) -> None:
    rounded = [F.format_string("%.3f", c).alias(c) if k == "double" else F.col(c) for c, k in described.dtypes if not k.startswith("array")]
    write_table(described.select(*rounded), path)


def meme_lines(motifs: DataFrame) -> DataFrame:
    """The text of each motif in MEME form, in order of its id; background as in the header."""
    row = lambda r: F.array_join(F.transform(r, lambda p: F.format_string(" %.6f", p)), " ")
    body = F.array_join(F.transform("pwm", row), "\n")
    return motifs.orderBy("motif_id").select(F.concat(F.lit("MOTIF "), "motif_id", F.lit(" "), "motif_name", F.lit("\nletter-probability matrix: alength= 4 w= "), F.size("pwm").cast("string"), F.lit("\n"), body, F.lit("\n")).alias("value"))


def write_meme(motifs: DataFrame, path: str, background: tuple[float, ...] = (0.25,) * 4) -> None:
    if motifs.isEmpty():
        raise RuntimeError("there are no motifs to write")
    head = "MEME version 4\n\nALPHABET= ACGT\n\nstrands: + -\n\nBackground letter frequencies\n" + " ".join(f"{a} {p:.5f}" for a, p in zip(LETTERS, background, strict=True)) + "\n"
    spark = motifs.sparkSession
    lines = spark.createDataFrame([(0, head)], "_i int, value string").unionByName(meme_lines(motifs).withColumn("_i", F.lit(1)))
    lines.coalesce(1).sortWithinPartitions("_i").select("value").write.mode("overwrite").text(path)


def write_homer(motifs: DataFrame, path: str) -> None:
    if not motifs.filter(~F.forall("alphabet", lambda a: F.upper(a).isin(*LETTERS))).isEmpty():
        raise ValueError("this form has no letters but A, C, G and T")
    row = lambda r: F.array_join(F.transform(r, lambda p: F.format_string("%.6f", p)), "\t")
    text = F.concat(F.lit(">"), F.coalesce("consensus", F.lit("")), F.lit("\t"), "motif_id", F.lit("\t"), F.format_string("%.6f", F.coalesce("ln_odds", F.lit(0.0))), F.lit("\n"), F.array_join(F.transform("pwm", row), "\n"))
    motifs.orderBy("motif_id").select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)
