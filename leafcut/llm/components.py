"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is two aggregations with partial sums and two joins; no group is gathered in a task, and nothing is
collected to the driver but the number of links and a checksum. Once ``ONE_TASK`` links or fewer are left (16 MB), one task
solves them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafcut.llm.shared import Scratch

ONE_TASK = 1 << 20


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all links of a partition."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not held:
        return
    u, v = (np.concatenate(c) for c in zip(*held, strict=True))
    nodes, at = np.unique(np.r_[u, v], return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    top = np.arange(len(nodes))
    while True:
        a, b = top[u], top[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while (top[top] != top).any():
            top = top[top]
    moved = top != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[top[moved]])], ["node", "root"])


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = down.join(_least(down), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(_least(down).select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links``: columns ``u, v`` (long). Returns ``node, root`` for every node but the roots; root: the smallest node.

    Links of a node with itself and repeated links are ignored; null ends must not occur.
    """
    edges = scratch.keep(links.where("u != v").select("u", "v").distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if 0 < state[0] <= ONE_TASK:
            return scratch.keep(edges.coalesce(1).mapInArrow(_solve, "node long, root long"))
        if not state[0] or state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        after = scratch.keep(_small(_large(edges).where("u != v").distinct()).where("u != v").distinct())
        scratch.drop(edges)
        edges = after
