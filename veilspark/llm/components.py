"""Connected components: union-find inside partitions, then alternating large and small stars between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, release

LINK = "u long, v long"
LINKS_A_TASK = 1 << 18


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links that are not their own root, and their roots (the smallest node reachable)."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = np.arange(len(names))
    a, b = at[: len(u)], at[len(u) :]
    while len(a):
        ra, rb = parent[a], parent[b]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(jump := parent[parent], parent):
            parent = jump
        open_ = parent[a] != parent[b]
        a, b = a[open_], b[open_]
    moved = parent != np.arange(len(names))
    return names[moved], names[parent[moved]]


def _contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for f in frames:
        u, v = union_find(np.concatenate([u, f["u"].to_numpy(np.int64)]), np.concatenate([v, f["v"].to_numpy(np.int64)]))
    yield pd.DataFrame({"u": u, "v": v})
    release()


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _round(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    small = down.join(_least(down), "u")
    return small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _open_nodes(links: DataFrame) -> tuple[int, int]:
    """Number of links, and of nodes that keep them from being stars: those with two links down, or with links both down and up."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(links.select("v", F.lit(0), F.lit(1)))
    by_node = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return tuple(by_node.agg(F.coalesce(F.sum("down"), F.lit(0)), F.count_if(F.expr("down > 1 or (down > 0 and up > 0)"))).collect()[0])


def components(links: DataFrame) -> DataFrame:
    """``u, v`` for every node of ``links`` (u long, v long) that is not the smallest of its component: v is the smallest.

    Loops and repeated links do no harm; an empty table gives no rows. No step gathers more than a partition in one place: a round
    ends in two tasks for each core, or more where there are over ``LINKS_A_TASK`` links for each.
    """
    now = materialize(links.select("u", "v").filter("u <> v").mapInPandas(_contract, LINK), "links")
    n, open_ = _open_nodes(now)
    while open_:
        tasks = max(2 * now.sparkSession.sparkContext.defaultParallelism, 2 * n // LINKS_A_TASK)
        before, now = now, materialize(_round(now).coalesce(tasks).mapInPandas(_contract, LINK), "links")
        discard(before)
        n, open_ = _open_nodes(now)
    return now
