"""Interval joins. An inequality alone would compare all pairs of a sequence; here intervals are cut into bins of a
fixed width, bins are joined by equality, and a pair is kept in the bin where both have begun, so it comes once.
Pairs are many more than rows: bins are dealt to many tasks, and rows of a bin meet in order of place, so that pairs which
follow each other are alike and take little room where they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1024
#: Bases of a tile of a sequence.
TILE = 65536


def _bins(df: DataFrame, start: str, end: str, width: int, name: str) -> DataFrame:
    first, last = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    return df.withColumn(name, F.explode(F.when(last >= first, F.sequence(first, last))))


def _parts(df: DataFrame) -> int:
    s = df.sparkSession
    return max(int(s.conf.get("spark.sql.shuffle.partitions")), 4 * s.sparkContext.defaultParallelism)


def _ordered(df: DataFrame, parts: int, keys: tuple[str, str], span: tuple[str, str], name: str) -> DataFrame:
    """Rows dealt by keys, in order of span. A plain sort would be left out before a join, and so would numbers that nothing asks for."""
    return df.repartition(parts, *keys).withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*span))).filter(F.col(name) > 0)


def overlap_join(
    left: DataFrame, right: DataFrame, *, on: tuple[str, str] = ("seqname", "seqname"), left_span: tuple[str, str] = ("start_pos", "end_pos"),
    right_span: tuple[str, str] = ("win_start", "win_end"), closed: bool = True, width: int = BIN,
) -> DataFrame:
    """All pairs on one sequence that share a position (closed), or a base of half-open intervals. Column names must differ but for the key.
    Tables are ordered by place; streams, which can't be, meet as they come."""
    (la, lb), (ra, rb) = left_span, right_span
    a = _bins(left, la, lb, width, "_bin")
    b = _bins(right.withColumnRenamed(on[1], "_key") if on[0] == on[1] else right, ra, rb, width, "_rbin")
    right_key = "_key" if on[0] == on[1] else on[1]
    key = F.col(on[0]) == F.col(right_key)
    meets = (F.col(lb) >= F.col(ra)) & (F.col(la) <= F.col(rb)) if closed else (F.col(lb) > F.col(ra)) & (F.col(la) < F.col(rb))
    a = a.withColumn("_at", F.col("_bin") * width)
    first = (F.col(la) >= F.col("_at")) | (F.col(ra) >= F.col("_at"))  # what is asked of every two rows of a bin is whole numbers held against each other
    if not (a.isStreaming or b.isStreaming):
        n = _parts(a)
        a, b = _ordered(a, n, (on[0], "_bin"), left_span, "_n"), _ordered(b, n, (right_key, "_rbin"), right_span, "_rn").hint("merge")
    return a.join(b, key & (F.col("_bin") == F.col("_rbin")) & meets & first).drop("_bin", "_rbin", "_key", "_n", "_rn", "_at")


def intersect(a: DataFrame, b: DataFrame, *, keep_a: bool = False, keep_b: bool = False, fraction: float | None = None, width: int = BIN) -> DataFrame:
    """Half-open intersection of BED rows (chrom, start_pos, end_pos): the shared part of a per pair; with keep_a the whole
    row of a, with keep_b the columns of b as b_*, with fraction only pairs where b covers that share of a."""
    cols = a.columns
    other = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    pairs = overlap_join(a, other, on=("chrom", "b_chrom"), right_span=("b_start_pos", "b_end_pos"), closed=False, width=width)
    lo, hi = F.greatest("start_pos", "b_start_pos"), F.least("end_pos", "b_end_pos")
    if fraction is not None:
        pairs = pairs.filter(hi - lo >= fraction * (F.col("end_pos") - F.col("start_pos")))
    out = [F.col(c) if keep_a or c not in ("start_pos", "end_pos") else {"start_pos": lo, "end_pos": hi}[c].alias(c) for c in cols]
    return pairs.select(*out, *([c for c in other.columns] if keep_b else []))


def covered(a: DataFrame, b: DataFrame, fraction: float, width: int = BIN) -> DataFrame:
    """BED rows of a of which one interval of b covers that share; a row may come once for each bin it lies in."""
    other = b.select(F.col("chrom").alias("_key"), F.col("start_pos").alias("_ra"), F.col("end_pos").alias("_rb"))
    x, y = _bins(a, "start_pos", "end_pos", width, "_bin"), _bins(other, "_ra", "_rb", width, "_rbin")
    lo, hi = F.greatest("start_pos", "_ra"), F.least("end_pos", "_rb")
    meets = (F.col("end_pos") > F.col("_ra")) & (F.col("start_pos") < F.col("_rb")) & (hi - lo >= fraction * (F.col("end_pos") - F.col("start_pos")))
    return x.join(y, (F.col("chrom") == F.col("_key")) & (F.col("_bin") == F.col("_rbin")) & meets, "left_semi").drop("_bin")


def intersect_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    for x in others:
        first = intersect(first, x)
    return first


def extract(sequences: DataFrame, bed: DataFrame, tile: int = TILE) -> DataFrame:
    """seqname (chrom:start-end), chrom, start_pos, end_pos, seq of each interval; 0-based, half-open. Sequences are cut into
    tiles, or come in tiles of that width (tile_start), and an interval meets only its own ones, so that no row of the join
    holds a whole chromosome. Intervals of unknown sequences go; what lies past a sequence's end is left out; equal
    intervals stay as many as they are."""
    start = F.col("_tile") * tile
    if "tile_start" in sequences.columns:
        tiles = sequences.select(F.col("seqname").alias("chrom"), F.floor(F.col("tile_start") / tile).alias("_tile"), F.col("seq").alias("_part"))
    else:
        seqs = sequences.select(F.col("seqname").alias("chrom"), F.col("seq").cast("binary").alias("_seq"))  # places are bytes: no walk from the start
        tiles = seqs.withColumn("_tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.greatest(F.octet_length("_seq") - 1, F.lit(0)) / tile))))
        tiles = tiles.select("chrom", "_tile", F.substring("_seq", (start + 1).cast("int"), F.lit(tile)).cast("string").alias("_part"))
    own = bed.groupBy("chrom", "start_pos", "end_pos").agg(F.count(F.lit(1)).alias("_n"))
    first = F.floor(F.col("start_pos") / tile)
    asked = own.withColumn("_tile", F.explode(F.sequence(first, F.greatest(F.floor((F.col("end_pos") - 1) / tile), first))))
    lo, hi = F.greatest("start_pos", start), F.least("end_pos", start + tile)
    got = asked.join(tiles, ["chrom", "_tile"], "left")
    part = F.substring("_part", (lo - start + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
    got = got.groupBy("chrom", "start_pos", "end_pos", "_n").agg(F.sort_array(F.collect_list(F.struct("_tile", part.alias("p")))).alias("_p"))
    got = got.join(sequences.select(F.col("seqname").alias("chrom")).distinct(), "chrom", "left_semi")
    name = F.concat("chrom", F.lit(":"), F.col("start_pos").cast("string"), F.lit("-"), F.col("end_pos").cast("string"))
    seq = F.array_join(F.transform("_p", lambda x: F.coalesce(x["p"], F.lit(""))), "")
    return got.withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int")))).select(name.alias("seqname"), "chrom", "start_pos", "end_pos", seq.alias("seq"))


def link_peaks(peaks: DataFrame, windows: DataFrame, *, intergenic: bool = False, distance: bool = False, width: int = BIN) -> DataFrame:
    """peaks (chrom, start_pos, end_pos, strand, ...) linked to genes (gene_name, seqname, win_start, win_end, tss) by their windows.
    A row is the part of a window that a peak covers, with the peak's place; intergenic adds peaks without a gene."""
    g = windows.select(F.col("gene_name").alias("gene"), F.col("seqname").alias("_seq"), F.col("strand").alias("_strand"), "win_start", "win_end", "tss")
    pairs = overlap_join(peaks, g, on=("chrom", "_seq"), closed=False, width=width)
    if intergenic:
        keys = ["chrom", "start_pos", "end_pos"]
        none = peaks.join(_touched(peaks.select(*keys), g, width), keys, "left_anti").withColumns({"gene": F.lit("Intergenic"), "_strand": F.lit("."), "tss": F.lit(None).cast("bigint")})
        pairs = pairs.drop("_seq", "win_start", "win_end").unionByName(none)
    out = pairs.select(*[F.col(c) for c in peaks.columns if c != "strand"], F.col("_strand").alias("strand"), "gene", "tss")
    return out.withColumn("distance", tss_distance()) if distance else out.drop("tss")


def _touched(peaks: DataFrame, g: DataFrame, width: int) -> DataFrame:
    """Distinct places of peaks that lie in a window: each is looked up in its bins up to the first window that it meets, without pairs."""
    x = _bins(peaks.distinct(), "start_pos", "end_pos", width, "_bin")
    y = _bins(g.select("_seq", "win_start", "win_end"), "win_start", "win_end", width, "_rbin")
    n = _parts(x)
    x, y = x.repartition(n, "chrom", "_bin"), y.repartition(n, "_seq", "_rbin")
    meets = (F.col("end_pos") > F.col("win_start")) & (F.col("start_pos") < F.col("win_end"))
    return x.join(y.hint("merge"), (F.col("chrom") == F.col("_seq")) & (F.col("_bin") == F.col("_rbin")) & meets, "left_semi").drop("_bin").distinct()


def tss_distance() -> Column:
    """From a peak to a start site: 0 when the site is strictly inside, null without a gene."""
    a, b = F.col("start_pos") - F.col("tss"), F.col("end_pos") - F.col("tss")
    return F.when(a.isNull(), None).when((a < 0) & (b > 0), 0).otherwise(F.least(F.abs(a), F.abs(b))).cast("bigint")
