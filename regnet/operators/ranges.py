"""Windows over few keys: rows are ordered in ranges of a number, and what passes a border is carried by a row for each range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bases of a range.
WIDTH = 1 << 16


def neighbours(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], *, before: dict[str, str] | None = None, after: dict[str, str] | None = None, width: int = WIDTH) -> DataFrame:
    """df with columns of the row before (new name: column) and of the row after in order, by keys; the first of order is a whole number.
    Rows are ordered by key and range; of each range the first and the last row go on to the ranges beside it."""
    before, after = before or {}, after or {}
    spread = df.withColumn("_range", F.floor(F.col(order[0]) / width))
    near = Window.partitionBy(*keys, "_range").orderBy(*order)
    # first and last in the order of the window, in which nulls come first
    place = F.struct(*[x for c in order for x in (F.col(c).isNotNull().alias(f"_has_{c}"), F.col(c).alias(f"_at_{c}"))])
    last = [F.max_by(c, place).alias(f"_last_{n}") for n, c in before.items()]
    first = [F.min_by(c, place).alias(f"_first_{n}") for n, c in after.items()]
    line = Window.partitionBy(*keys).orderBy("_range")
    borders = spread.groupBy(*keys, "_range").agg(*last, *first)
    borders = borders.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_range").alias("_border"), *[F.lag(f"_last_{n}").over(line).alias(f"_last_{n}") for n in before], *[F.lead(f"_first_{n}").over(line).alias(f"_first_{n}") for n in after])
    same = F.col("_range").eqNullSafe(F.col("_border"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    n_before, n_after = F.lag(F.lit(True)).over(near).isNotNull(), F.lead(F.lit(True)).over(near).isNotNull()
    out = spread.withColumns({"_is_before": n_before, "_is_after": n_after} | {n: F.lag(c).over(near) for n, c in before.items()} | {n: F.lead(c).over(near) for n, c in after.items()})
    out = out.join(borders, same, "left")
    out = out.withColumns({n: F.when(F.col("_is_before"), F.col(n)).otherwise(F.col(f"_last_{n}")) for n in before} | {n: F.when(F.col("_is_after"), F.col(n)).otherwise(F.col(f"_first_{n}")) for n in after})
    return out.select(*df.columns, *before, *after)


def running(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], amount: Column, name: str, width: int = WIDTH) -> DataFrame:
    """df with the sum of amount over the rows up to each one in order, by keys; ranges hand on their totals.
    Of rows that are equal in order, those with the largest amount come first: amount may stem from a window whose order
    among them is lost by now, and a row that opens a run has to stay before those that go on with it."""
    spread = df.withColumns({"_range": F.floor(F.col(order[0]) / width), "_amount": amount})
    near = Window.partitionBy(*keys, "_range").orderBy(*order, F.col("_amount").desc()).rowsBetween(Window.unboundedPreceding, 0)
    line = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = spread.groupBy(*keys, "_range").agg(F.sum("_amount").alias("_total"))
    totals = totals.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_range").alias("_border"), F.coalesce(F.sum("_total").over(line), F.lit(0)).alias("_carried"))
    same = F.col("_range").eqNullSafe(F.col("_border"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return spread.withColumn("_sum", F.sum("_amount").over(near)).join(totals, same, "left").select(*df.columns, (F.col("_sum") + F.col("_carried")).alias(name))
