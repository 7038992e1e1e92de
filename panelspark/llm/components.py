"""Connected components: links are contracted within tasks, then by alternating large and small stars between tasks.

A task takes at most about `TASK_LINKS` links and replaces them by a spanning star for each part that they connect, so few
links and short paths are left for the stars. Where all links fit into one task nothing is left to do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from panelspark.session import Owned

#: Links of one task: two longs each, and as much again while it works.
TASK_LINKS = 1 << 20


def _contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the smallest of its part, with that one."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, other = at[: len(a)], at[len(a) :]
    root = np.arange(len(node))
    while True:
        low = np.minimum(root[one], root[other])
        new = root.copy()
        np.minimum.at(new, root[one], low)
        np.minimum.at(new, root[other], low)
        while True:  # every node points at its root directly
            further = new[new]
            if np.array_equal(further, new):
                break
            new = further
        if np.array_equal(new, root):
            moved = np.flatnonzero(root != np.arange(len(node)))
            return node[moved], node[root[moved]]
        root = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
    if held:
        a, b = _contracted(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges come with a > b."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, root) for every node with a link, from links (a, b) of longs; root is the smallest node reached.

    Minima come from combining aggregates and joins, so a node with very many links is never one task's group. Each round
    is one written table. Null ends and links of a node to itself are ignored; no links give an empty table.
    """
    table = Owned(edges.sparkSession, "components")

    def put(links: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        mark = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")]
        return table.write(links.observe(seen, *mark)), seen.get

    links, mark = put(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        tasks, before = max(1, -(-mark["n"] // task_links)), mark
        stars = links.coalesce(tasks).mapInArrow(_contract, "a long, b long")
        links, mark = put(_small_star(_large_star(stars)) if tasks > 1 else stars)
        if tasks == 1 or mark == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
