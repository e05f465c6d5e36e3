"""Binding sites near genes: overlap islands, per-base aggregation, tandem arrays, scores per gene and regulator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import neighbours, running

KEYS = ("target", "regulator")
#: Bases of an island that are folded at once.
RANGE = 4096


def islands(hits: DataFrame, keys: tuple[str, ...] = KEYS, gap: int | None = None, name: str = "island", width: int | None = None) -> DataFrame:
    """hits plus a number per run of hits that overlap the one before (start < its stop), or start within gap of its stop.
    width: for few keys with many hits, which are then dealt to tasks by ranges of so many bases."""
    order = ("start_pos", "stop_pos")
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag("stop_pos").over(w) if width is None else F.col("_before")
    joins = F.col("start_pos") < before if gap is None else F.col("start_pos") - before <= gap
    new = F.when(joins, 0).otherwise(1)
    if width is not None:
        return running(neighbours(hits, keys, order, before={"_before": "stop_pos"}, width=width), keys, order, new, name, width).drop("_before")
    return hits.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _highest(pieces: Column) -> Column:
    """pieces: (at, per) by rising at, numbers of the bases from at on. The sum over bases of the highest number of each base."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))

    def step(a: Column, x: Column) -> Column:
        past = F.least(x["at"] - a["at"], F.size(a["open"]).cast("bigint")).cast("int")  # bases that no later piece holds
        return F.struct(
            x["at"].alias("at"), F.zip_with(F.slice(a["open"], past + 1, F.greatest(F.size(a["open"]) - past, F.lit(0))), x["per"], lambda b, c: F.greatest(b, c)).alias("open"),
            (a["sum"] + total(F.slice(a["open"], F.lit(1), past))).alias("sum"),
        )

    start = F.struct(F.get(pieces, F.lit(0))["at"].alias("at"), F.array().cast("array<double>").alias("open"), F.lit(0.0).alias("sum"))
    return F.aggregate(pieces, start, step, lambda a: a["sum"] + total(a["open"]))


def merge_islands(hits: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One site per island: outer bounds; the score of a lone hit, else the sum over bases of the highest per-base score.
    per_base is laid on the bases from start_pos on, as given."""
    near = Window.partitionBy(*keys).orderBy("start_pos", "stop_pos")
    lone = ~F.coalesce(F.col("start_pos") < F.lag("stop_pos").over(near), F.lit(False)) & ~F.coalesce(F.lead("start_pos").over(near) < F.col("stop_pos"), F.lit(False))
    marked = islands(hits, keys).withColumn("_lone", lone)
    # the bases of an island are folded in ranges, so that a long island is no single row; all stays in the partition of the keys
    ends = F.greatest("start_pos", "stop_pos")
    ranges = F.when(F.col("_lone"), F.array(F.floor(F.col("start_pos") / RANGE))).otherwise(F.sequence(F.floor(F.col("start_pos") / RANGE), F.floor(ends / RANGE)))
    at = F.greatest("start_pos", F.col("_range") * RANGE)
    last = F.least("stop_pos", F.col("_range") * RANGE + RANGE - 1)
    per = F.slice(F.transform("per_base", lambda x: x.cast("double")), (at - F.col("start_pos") + 1).cast("int"), F.greatest(last - at + 1, F.lit(0)).cast("int"))
    pieces = marked.select(*keys, "island", "start_pos", "stop_pos", "score", "_lone", "per_base", F.explode(ranges).alias("_range"))
    bounds = [F.min("start_pos").alias("start_pos"), F.max("stop_pos").alias("stop_pos")]
    parts = pieces.groupBy(*keys, "island", "_range").agg(
        *bounds, F.max(F.when(F.col("_lone"), F.col("score").cast("double"))).alias("_score"), F.collect_list(F.when(~F.col("_lone"), F.struct(at.cast("bigint").alias("at"), per.alias("per")))).alias("_per"),
    )
    parts = parts.withColumn("score", F.coalesce("_score", _highest(F.sort_array("_per"))))
    return parts.groupBy(*keys, "island").agg(*bounds, F.sum("score").alias("score")).drop("island")


def score_sites(hits: DataFrame, max_gap: int = 100, min_score: float | None = None, keys: tuple[str, ...] = KEYS, always_pair: bool = False) -> DataFrame:
    """Per gene and regulator: score, n_sites, start_pos, stop_pos of the best tandem array of merged sites, or of the
    best site where there is no array. Arrays are sites that follow within max_gap. always_pair: two sites always make an array."""
    kept = hits if min_score is None else hits.filter(F.col("score") >= min_score)
    return best_arrays(merge_islands(kept, keys), max_gap, keys, always_pair)


def best_arrays(merged: DataFrame, max_gap: int, keys: tuple[str, ...] = KEYS, always_pair: bool = False) -> DataFrame:
    """What score_sites says of merged sites."""
    sites = islands(merged, keys, gap=max_gap, name="array")
    if always_pair:
        sites = sites.withColumn("array", F.when(F.count(F.lit(1)).over(Window.partitionBy(*keys)) == 2, 1).otherwise(F.col("array")))
    arrays = sites.groupBy(*keys, "array").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n_sites"), F.min("start_pos").alias("start_pos"), F.max("stop_pos").alias("stop_pos"))
    # arrays of several sites come first; of equal scores, the leftmost
    best = Window.partitionBy(*keys).orderBy((F.col("n_sites") > 1).desc(), F.col("score").desc(), "start_pos")
    return arrays.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select(*keys, "score", "n_sites", "start_pos", "stop_pos")


def top_hits(hits: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The best hit per key, the leftmost of equal ones."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "start_pos", "stop_pos")
    return hits.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def distinct_hits(hits: DataFrame, keys: tuple[str, ...] = ("motif_id", "start_pos", "stop_pos", "seqname", "strand"), order: str = "p_value") -> DataFrame:
    """One hit per place: the one with the smallest value of order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return hits.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
