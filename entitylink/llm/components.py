"""Connected components without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, join_one, materialize, parts_for


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).head()
    return tuple(row)


def _to_least(edges: DataFrame, larger_only: bool, parts: int, hot: dict[int, int]) -> DataFrame:
    """Tie the neighbours of each a (those above it if larger_only) to the least one of all."""
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    tied = join_one(edges, least, "a", hot)
    if larger_only:
        tied = tied.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        tied = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return tied.filter("a <> b").coalesce(parts).distinct().coalesce(parts)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for all nodes of the edges (a, b).

    Alternating large-star and small-star steps (Kiveris et al., 2014); every step is a grouping
    with partial sums and a join, and rounds go with the logarithm of the longest path.  The centre
    of a large star, which large-star steps make larger, is joined by broadcast.  The number of
    tasks follows the number of edges, so that small graphs don't leave many small files.
    """
    downward = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    parts = parts_for(edges, edges.count())
    now = materialize(downward.coalesce(parts).distinct().coalesce(parts))
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_least(both, True, parts, hot_keys(now, "a", "b")[1])
        now = materialize(_to_least(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False, parts, {}))
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def merge_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, component) with the components tied that edges (a, b) between components join."""
    if not edges.take(1):
        return labels
    count, hot = hot_keys(labels, "component")
    tied = components(edges).select(F.col("node").alias("component"), F.col("component").alias("_to"))
    merged = join_one(labels, tied, "component", hot, "left").select("node", F.coalesce("_to", "component").alias("component"))
    return materialize(merged.coalesce(parts_for(labels, count)))
