"""Connected components by alternating star contractions; every step is a bounded aggregate and an equi-join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm._spark import cut, drop_cut, per_key


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each node of an edge between two nodes the least node that it is connected with.

    ``edges`` has two long columns; loops and repeated edges don't matter. Rounds are written to the shared
    folder, so lineage stays short and a lost executor costs one round. The least neighbour of a hub is
    broadcast (a bounded number of hubs, see :func:`per_key`), so neither its edges nor its neighbours meet in a task.
    """
    now = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == mark:
            break
        before = mark
        both = now.union(now.select("b", "a"))  # large star
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "least")
        large = per_key(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = cut(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "down")  # small star
        drop_cut(least)
        least = cut(down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        joined = per_key(down, least, "a")
        small = joined.select("a", F.col("m").alias("b")).union(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        fresh = cut(small.distinct(), "edges")
        for done in (now, down, least):
            drop_cut(done)
        now = fresh
    return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least position that each of n positions is connected with through the pairs (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        fresh = label.copy()
        np.minimum.at(fresh, i, low)
        np.minimum.at(fresh, j, low)
        np.minimum.at(fresh, label[i], low)
        np.minimum.at(fresh, label[j], low)
        fresh = fresh[fresh]
        if np.array_equal(fresh, label):
            return label
        label = fresh
