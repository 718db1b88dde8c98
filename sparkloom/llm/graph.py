"""Connected components by alternating large and small stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One star round over edges (a, b), a > b: each node's neighbours hang on its least neighbour (or itself)."""
    if small:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(least, "a")
        moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a").filter("b > a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of each node of edges (a, b: long); root is its component's least id.

    Nodes without an edge are absent; loops and repeated edges change nothing. Minima are taken on each task before
    the shuffle, and a hub's edges are joined to its one minimum, which Spark may split; no
    component is gathered. Every round is written out, so a lost executor costs one round at most.
    """
    kept = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    kept = stage(kept, "cc-edges")
    seen = None
    while True:
        kept = stage(_stars(_stars(kept, False), True), "cc-edges")
        now = kept.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    return kept.select(F.col("a").alias("id"), F.col("b").alias("root")).union(kept.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()
