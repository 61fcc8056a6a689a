"""Queries of a graph's structure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import DEPS
from lodestone.graph import Graph
from lodestone.operators.traverse import bfs, closure, one, shortest_path


def dependencies(g: Graph, unit: int, depth: int, types: Sequence[str] = DEPS, transitive: bool = True, direction: str = "forward") -> DataFrame:
    """(id, depth, path) of what a unit depends on, or backward of what depends on it; without the unit."""
    return bfs(g.edges, one(g.units, unit), depth if transitive else 1, types, direction).where("depth > 0")


def call_graph(g: Graph, unit: int, direction: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, depth), and call sites (caller, callee, line) of all nodes above the last level. direction: callers, callees or both."""
    calls = g.edges.where("edge_type = 'calls'")
    nodes, sites = [], []
    for k, (name, way, end) in enumerate((("callees", "forward", "source_id"), ("callers", "backward", "target_id"))):
        if direction in (name, "both"):
            found = bfs(g.edges, one(g.units, unit), depth, ["calls"], way)
            nodes.append(found.select("id", "depth", F.lit(k).alias("rank")))
            inner = found.where(F.col("depth") < depth).select(F.col("id").alias(end))
            sites.append(calls.join(inner, end, "left_semi").select(F.col("source_id").alias("caller"), F.col("target_id").alias("callee"), F.col("context").alias("line")))
    all_nodes, all_sites = nodes[0], sites[0]
    for n, s in zip(nodes[1:], sites[1:]):
        all_nodes, all_sites = all_nodes.unionAll(n), all_sites.unionAll(s)
    return all_nodes.groupBy("id").agg(F.min_by("depth", "rank").alias("depth")), all_sites


def type_hierarchy(g: Graph, unit: int) -> DataFrame:
    """(id, depth, relation): ancestors at positive depths, descendants at negative ones; relation is the edge to the path's last hop."""
    out = None
    for way, sign in (("forward", 1), ("backward", -1)):
        found = bfs(g.edges, one(g.units, unit), -1, ["inherits", "implements"], way).where("depth > 0").select("id", (F.col("depth") * sign).alias("depth"), F.element_at("path", -2).alias("from_id"))
        s, t = ("source_id", "target_id") if sign > 0 else ("target_id", "source_id")
        e = g.edges.where(F.col("edge_type").isin("inherits", "implements")).groupBy(F.col(s).alias("from_id"), F.col(t).alias("id")).agg(F.max("edge_type").alias("relation"))
        part = found.join(e, ["from_id", "id"]).select("id", "depth", "relation")
        out = part if out is None else out.unionAll(part)
    return out


def containment(g: Graph, unit: int) -> DataFrame:
    """(id): all that a unit contains, at any depth."""
    return closure(g.edges, one(g.units, unit), ["contains"]).where(F.col("id") != unit)


def language_trace(g: Graph, unit: int, hops: int) -> DataFrame:
    """(id, depth, language, first_seen): walk of foreign-function edges in both directions; first_seen ranks languages by their first unit."""
    found = bfs(g.edges, one(g.units, unit), hops, ["ffi_binds"], "both").join(g.units.select("id", "language"), "id")
    first = found.groupBy("language").agg(F.min(F.struct("depth", "id")).alias("at"))
    ranked = first.select("language", F.row_number().over(Window.orderBy("at")).alias("first_seen"))  # one row for each language
    return found.join(F.broadcast(ranked), "language").select("id", "depth", "language", "first_seen")


def dead_code(g: Graph, types: Sequence[str] = ()) -> DataFrame:
    """(id, name) of units that no root reaches, nor any of them reaches a root, over all edges."""
    u = g.units
    public = F.col("visibility") == "public"
    root = F.when(F.col("unit_type") == "function", (F.col("name") == "main") | F.col("name").startswith("test_") | public).when(F.col("unit_type") == "test", True).otherwise(public)
    roots = u.where(root).select("id")
    alive = closure(g.edges, roots).unionAll(closure(g.edges, roots, direction="backward"))
    dead = u.join(alive.distinct(), "id", "left_anti")
    return (dead.where(F.col("unit_type").isin(*types)) if types else dead).select("id", "name")


def path_between(g: Graph, a: int, b: int, types: Sequence[str] = (), most: int = -1) -> DataFrame:
    one(g.units, a)
    one(g.units, b)
    return shortest_path(g.edges, a, b, types, most)
