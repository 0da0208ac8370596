"""Connected components of a link table, by alternating star contraction.

Large star: every node links its larger neighbours to the smallest node it
knows; small star: its smaller ones. Each step is an aggregate (combined before
the shuffle) and a join, so a node with very many links is split by the skew
join. Steps are written as tables; nothing is collected but two sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precedent.llm.common import save


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component), for nodes that aren't it."""
    root: dict[int, int] = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    pairs = [(x, r) for x in list(root) if (r := find(x)) != x]
    return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)


def _contract(batches):
    """Each task replaces its links by a forest of their components."""
    a = b = np.zeros(0, np.int64)
    for x in batches:
        a, b = forest(np.concatenate([a, np.asarray(x.column(0))]), np.concatenate([b, np.asarray(x.column(1))]))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(links: DataFrame, max_steps: int = 60) -> DataFrame:
    """``links`` (a long, b long, without nulls; order and repeats don't matter)
    -> (node, component): every node that has a link to another, with the
    smallest node reachable from it."""
    schema = "a long, b long"
    at = save(links.select("a", "b").where("a <> b").mapInArrow(_contract, schema), "links")
    before = None
    for _ in range(max_steps):
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = save(large.where("a <> b").distinct(), "large-star")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b")))
        at = save(small.where("a <> b").distinct(), "small-star")
        now = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        # a forest in which every node points at its root no longer changes
        if tuple(now) == before:
            return at.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = tuple(now)
    raise RuntimeError(f"components did not settle in {max_steps} steps")
