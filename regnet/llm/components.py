"""Connected components by minimum labels and pointer jumping, as joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, label: the smallest node that each node reaches. Only nodes with edges."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    both = stored(both.filter("u <> v").distinct(), "edges")
    labels = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("x")), "v").groupBy("u").agg(F.min("x").alias("x"))
        step = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.least("label", "x").alias("next"), "label")
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        step = stored(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), F.col("label").alias("old")), "labels")
        labels = step.select("node", "label")
        if step.filter("label <> old").isEmpty():
            return labels
    raise RuntimeError("the components didn't settle")
