"""Scans, point lookups, adjacency and indexes of a graph's tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.state import numbered

MOST_OUT = 16384


def valid_edges(units: DataFrame, edges: DataFrame, most: int = MOST_OUT) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with a reason): edges onto themselves, of missing units, or beyond so many of one source, checked in this order."""
    have = units.select("id")
    sides = edges.join(have.select(F.col("id").alias("source_id"), F.lit(True).alias("s_ok")), "source_id", "left").join(have.select(F.col("id").alias("target_id"), F.lit(True).alias("t_ok")), "target_id", "left")
    error = F.when(F.col("source_id") == F.col("target_id"), "self_edge").when(F.col("s_ok").isNull(), "unit_not_found").when(F.col("t_ok").isNull(), "invalid_edge_target")
    marked = sides.withColumn("error", error).drop("s_ok", "t_ok")
    nth = F.row_number().over(Window.partitionBy("source_id", F.col("error").isNull()).orderBy("target_id", "edge_type"))
    judged = marked.withColumn("error", F.when(F.col("error").isNull() & (nth > most), "too_many_edges").otherwise(F.col("error")))
    return judged.where("error is null").drop("error"), judged.where("error is not null")


def build(units: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges; raises if any of them is bad."""
    kept, bad = valid_edges(units, edges)
    if first := bad.first():
        raise ValueError(f"{first['error']}: {first['source_id']} -> {first['target_id']}")
    return kept


def add_units(units: DataFrame, more: DataFrame) -> DataFrame:
    """More units after the others, with ids that go on from the greatest, in the order of place."""
    top = units.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))
    placed = numbered(more, "place", "file_path", "start_line", "qualified_name")
    return units.unionByName(placed.crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + 1 + F.col("place")).drop("top", "place"), allowMissingColumns=True)  # one row


def by_name(units: DataFrame, name: str, mode: str = "exact", types: Sequence[str] = (), languages: Sequence[str] = (), limit: int = 0, distance: int = 2) -> DataFrame:
    """Units by name: exact minds case; prefix, contains and fuzzy (by Levenshtein distance) don't. Empty filters let all pass; limit 0 is none."""
    n, low = F.lower("name"), name.lower()
    hit = {"exact": F.col("name") == name, "prefix": n.startswith(low), "contains": n.contains(low), "fuzzy": F.levenshtein(n, F.lit(low)) <= distance}[mode]
    if mode == "fuzzy":
        hit = F.length("name").between(len(low) - distance, len(low) + distance) & hit
    out = units.where(hit)
    out = out.where(F.col("unit_type").isin(*types)) if types else out
    out = out.where(F.col("language").isin(*languages)) if languages else out
    return out.orderBy("id").limit(limit) if limit else out


def adjacent(edges: DataFrame, unit: int, direction: str = "from", edge_type: str | None = None) -> DataFrame:
    """The edges that leave or enter a unit."""
    out = edges.where(F.col("source_id" if direction == "from" else "target_id") == unit)
    return out.where(F.col("edge_type") == edge_type) if edge_type else out


def has_edge(edges: DataFrame, source: int, target: int, edge_type: str) -> DataFrame:
    return edges.where((F.col("source_id") == source) & (F.col("target_id") == target) & (F.col("edge_type") == edge_type)).limit(1).agg((F.count("*") > 0).alias("found"))


def sizes(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(unit_count, edge_count, languages)."""
    return units.agg(F.count("*").alias("unit_count"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages")).crossJoin(edges.agg(F.count("*").alias("edge_count")))


def stats(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, value, n): counts by unit type, language and edge type; the units are read once."""
    by = units.groupingSets([["unit_type"], ["language"]], "unit_type", "language").agg(F.count("*").alias("n"), F.grouping("unit_type").alias("g"))
    of_units = by.select(F.when(F.col("g") == 0, "unit_type").otherwise("language").alias("kind"), F.when(F.col("g") == 0, F.col("unit_type")).otherwise(F.col("language")).alias("value"), "n")
    return of_units.unionAll(edges.groupBy("edge_type").count().select(F.lit("edge_type"), "edge_type", "count"))


def page(units: DataFrame, unit_type: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of units in the order of ids."""
    out = units.where(F.col("unit_type") == unit_type) if unit_type else units
    return out.orderBy("id").offset(offset).limit(limit)


def with_edges(units: DataFrame, edges: DataFrame, unit: int) -> DataFrame:
    """(id, name, side, other_id, other_name, edge_type): a unit with its neighbours."""
    mine = edges.where((F.col("source_id") == unit) | (F.col("target_id") == unit))
    ends = mine.select(F.lit(unit).cast("long").alias("id"), F.when(F.col("source_id") == unit, "out").otherwise("in").alias("side"), F.when(F.col("source_id") == unit, F.col("target_id")).otherwise(F.col("source_id")).alias("other_id"), "edge_type")
    return ends.join(units.select(F.col("id").alias("other_id"), F.col("name").alias("other_name")), "other_id").select("id", "side", "other_id", "other_name", "edge_type")


def files(units: DataFrame) -> DataFrame:
    """(file_path, n): the path index."""
    return units.groupBy("file_path").agg(F.count("*").alias("n"))
