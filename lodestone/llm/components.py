"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.state import checkpoint

#: Edges that one task settles by itself; more are settled in rounds.
ONE_TASK = 1 << 20


class Forest:
    """Which of the numbers below size are connected."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def roots(self) -> np.ndarray:
        """The least number that each is connected with."""
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return self.root
            self.root = up

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        """Connects x[i] and y[i]."""
        while len(x):
            r = self.roots()
            a, b = r[x], r[y]
            apart = a != b
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of all edges at once."""
    got = list(batches)
    if not got:
        return
    u, v = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in (0, 1))
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    forest = Forest(len(ids))
    forest.join(at[: len(u)], at[len(u) :])
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[forest.roots()])], names=["id", "component"])


def components(edges: DataFrame, most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component) of every id in edges(a, b); component is the least id reached.

    So many edges as one task can hold are settled in one. More of them are settled in rounds: each joins every id to the least id
    of its neighbourhood, first from the larger side and then from the smaller one; the number of rounds grows with the logarithm
    of the longest path. Each round is written to the shared checkpoint folder. Rows with a null end and loops are
    ignored; repeated edges count once.
    """
    now = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if now.count() <= one_task:
        return now.coalesce(1).mapInArrow(_settle, "id long, component long")
    size = None
    for _ in range(most_rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = checkpoint(small)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == size:
            break
        size = tuple(seen)
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
