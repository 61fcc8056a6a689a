"""Traversals, one job for each level; every level is written to the shared folder, so lineage stays short.

The edges are neither copied nor shuffled as long as frontiers are small: a level is a scan of the columns and types it needs, joined to
the broadcast frontier, and only what the frontier reaches is aggregated. A frontier that is too large to broadcast is joined by a shuffle.
How large it is, the write of the level counts. Of several shortest paths to a unit, the lexicographically least array of ids stands.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import TYPES
from lodestone.state import BROADCAST_BYTES, checkpoint, counted

#: Levels after which what has been reached is written as one table.
COMPACT = 8


def steps(edges: DataFrame, types: Sequence[str] = (), direction: str = "forward") -> list[DataFrame]:
    """(s, t) of the edges of the types (none: all), as they are walked: a scan for each way, repeated edges included."""
    e = edges.where(F.col("edge_type").isin(*types)) if types else edges
    ahead, back = e.select(F.col("source_id").alias("s"), F.col("target_id").alias("t")), e.select(F.col("target_id").alias("s"), F.col("source_id").alias("t"))
    return {"forward": [ahead], "backward": [back], "both": [ahead, back]}[direction]


def _reach(ways: list[DataFrame], frontier: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """The frontier's columns (s, ...) beside each t that an edge leads to."""
    near = F.broadcast(frontier) if rows * row_bytes <= BROADCAST_BYTES else frontier
    out = ways[0].join(near, "s")
    for w in ways[1:]:
        out = out.unionByName(w.join(near, "s"))
    return out


def _without(reached: DataFrame, seen: DataFrame, rows: int) -> DataFrame:
    """Rows of reached whose id hasn't been seen."""
    return reached.join(F.broadcast(seen) if rows * 8 <= BROADCAST_BYTES else seen, "id", "left_anti")


def bfs(edges: DataFrame, start: DataFrame, depth: int = -1, types: Sequence[str] = (), direction: str = "forward") -> DataFrame:
    """(id, depth, path) of all units within reach of start(id), start included at depth 0; depth -1 is without bound."""
    ways = steps(edges, types, direction)
    frontier, rows = counted(start.select("id", F.lit(0).alias("depth"), F.array("id").alias("path")).distinct())
    seen, level, total = frontier, 0, rows
    while rows and (depth < 0 or level < depth):
        level += 1
        reached = _reach(ways, frontier.select(F.col("id").alias("s"), "path"), rows, 16 + 8 * (level + 1))
        least = reached.groupBy(F.col("t").alias("id")).agg(F.min(F.concat("path", F.array("t"))).alias("path"))
        frontier, rows = counted(_without(least, seen.select("id"), total).select("id", F.lit(level).alias("depth"), "path"))
        seen, total = seen.unionAll(frontier), total + rows
        if level % COMPACT == 0:
            seen = checkpoint(seen)
    return seen


def closure(edges: DataFrame, start: DataFrame, types: Sequence[str] = (), direction: str = "forward") -> DataFrame:
    """(id) of everything within reach of start(id), without paths."""
    ways = steps(edges, types, direction)
    frontier, rows = counted(start.select("id").distinct())
    seen, level, total = frontier, 0, rows
    while rows:
        level += 1
        reached = _reach(ways, frontier.select(F.col("id").alias("s")), rows, 16).select(F.col("t").alias("id")).distinct()
        frontier, rows = counted(_without(reached, seen, total))
        seen, total = seen.unionAll(frontier), total + rows
        if level % COMPACT == 0:
            seen = checkpoint(seen)
    return seen


def simple_paths(edges: DataFrame, start: int, end: int, most: int, types: Sequence[str] = ()) -> DataFrame:
    """(path, length) of all simple paths of at most so many edges; from a unit to itself there is none."""
    spark = edges.sparkSession
    ways = steps(edges, types)
    now, rows = spark.createDataFrame([(start, [start])], "id long, path array<long>"), 1
    found = spark.createDataFrame([], "path array<long>, length int")
    for k in range(1, most + 1):
        reached = _reach(ways, now.withColumnRenamed("id", "s"), rows, 32 + 8 * k).where(~F.array_contains("path", F.col("t")))
        now, rows = counted(reached.select(F.col("t").alias("id"), F.concat("path", F.array("t")).alias("path")).distinct())
        found = found.unionAll(now.where(F.col("id") == end).select("path", F.lit(k).alias("length")))
        now = now.where(F.col("id") != end)
        if not rows:
            break
    return found


def shortest_path(edges: DataFrame, start: int, end: int, types: Sequence[str] = (), most: int = -1) -> DataFrame:
    """(found, path, length, edge_types): the least of the shortest paths of at most so many edges (-1: of any length), and of each hop the type that comes first in TYPES."""
    spark = edges.sparkSession
    ways = steps(edges, types)
    frontier, rows, total = spark.createDataFrame([(start, [start])], "id long, path array<long>"), 1, 1
    seen = frontier.select("id")
    hit, level = None, 0
    while rows:
        if got := frontier.where(F.col("id") == end).select("path").first():
            hit = got["path"]
            break
        if level == most:
            break
        level += 1
        reached = _reach(ways, frontier.withColumnRenamed("id", "s"), rows, 64).groupBy(F.col("t").alias("id")).agg(F.min(F.concat("path", F.array("t"))).alias("path"))
        frontier, rows = counted(_without(reached, seen, total))
        seen, total = seen.unionAll(frontier.select("id")), total + rows
    if hit is None:
        return spark.createDataFrame([(False, [], 0, [])], "found boolean, path array<long>, length int, edge_types array<string>")
    hops = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(hit, hit[1:]))], "k int, s long, t long")
    e = edges.where(F.col("edge_type").isin(*types)) if types else edges
    code = F.array_position(F.lit(list(TYPES)), F.col("edge_type"))
    kinds = e.join(F.broadcast(hops), (F.col("source_id") == F.col("s")) & (F.col("target_id") == F.col("t"))).groupBy("k").agg(F.min(F.struct(F.when(code > 0, code).otherwise(len(TYPES) + 1), "edge_type"))["edge_type"].alias("kind"))  # a path's hops
    return kinds.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "kind"))), lambda x: x["kind"]).alias("edge_types")).select(
        F.lit(True).alias("found"), F.array(*map(F.lit, hit)).cast("array<bigint>").alias("path"), F.lit(len(hit) - 1).alias("length"), "edge_types"
    )


def dfs(edges: DataFrame, start: int, depth: int, types: Sequence[str] = ()) -> DataFrame:
    """(id, depth, place): preorder of a depth-limited search, targets in ascending order.

    The order depends on all that was visited before, so the neighbourhood within the depth, which ``bfs`` finds, is walked
    in one task.
    """
    reach = bfs(edges, edges.sparkSession.createDataFrame([(start,)], "id long"), depth, types).select("id")
    near = steps(edges, types)[0].join(reach.select(F.col("id").alias("s")), "s", "left_semi").join(reach.select(F.col("id").alias("t")), "t", "left_semi").distinct()

    def walk(frames):
        import pandas as pd

        out: dict[int, list[int]] = {}
        for f in frames:
            for s, t in zip(f["s"].tolist(), f["t"].tolist()):
                out.setdefault(s, []).append(t)
        seen: dict[int, int] = {}
        todo = [(start, 0)]
        while todo:
            i, d = todo.pop()
            if i in seen:
                continue
            seen[i] = d
            if d < depth:
                todo += [(t, d + 1) for t in sorted(out.get(i, ()), reverse=True) if t not in seen]
        yield pd.DataFrame({"id": list(seen), "depth": list(seen.values()), "place": range(len(seen))})

    return near.select("s", "t").coalesce(1).mapInPandas(walk, "id long, depth int, place long")


def on_cycles(edges: DataFrame, types: Sequence[str]) -> DataFrame:
    """(id) of units that lie between cycles: those without a way in or out are trimmed until none is left."""
    now, rows = counted(steps(edges, types)[0].where("s <> t").distinct())
    while rows:
        kept = now.join(now.select(F.col("t").alias("s")).distinct(), "s", "left_semi").join(now.select(F.col("s").alias("t")).distinct(), "t", "left_semi").select("s", "t")
        now, left = counted(kept)
        if left == rows:
            break
        rows = left
    return now.select(F.col("s").alias("id")).unionAll(now.select(F.col("t").alias("id"))).distinct()


def need(units: DataFrame, *ids: int) -> None:
    """Raises if a unit isn't there."""
    have = {r["id"] for r in units.where(F.col("id").isin(*ids)).select("id").collect()}
    for i in ids:
        if i not in have:
            raise LookupError(f"unit {i} isn't in the graph")


def one(units: DataFrame, i: int) -> DataFrame:
    """(id) of a unit that must be there."""
    need(units, i)
    return units.where(F.col("id") == i).select("id")
