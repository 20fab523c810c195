"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", "m")).distinct()


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that each of n positions reaches by the pairs (i, j), within one task."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        after = root.copy()
        np.minimum.at(after, i, least)
        np.minimum.at(after, j, least)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def components(edges: DataFrame) -> DataFrame:
    """``u, v long`` links in any direction to ``node, component``: the smallest node that each node
    with a link reaches. Nodes that are smallest themselves, and those without a link, have no row.

    Links with a null end and self links count for nothing. Each round's edges are written to the shared
    folder, so that the plan stays small and lost executors repeat one round at most. Only two sums a round
    reach the driver.
    """
    u, v = (F.col(c).cast("long") for c in edges.columns[:2])
    current = common.stored(edges.select(u.alias("u"), v.alias("v")).where("u <> v").distinct())

    def state(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = None
    while True:
        following = common.stored(_small_star(_large_star(current)))
        after = state(following)
        common.forget(current)
        if after == before or after[0] == 0:
            out = following.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out.stored_at = following.stored_at
            return out
        current, before = following, after
