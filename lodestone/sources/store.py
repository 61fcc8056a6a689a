"""A graph on disk: Parquet folders, units by language and edges by type, so that filters on them read less; and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.graph import Graph


def write(g: Graph, path: str) -> None:
    g.units.write.mode("overwrite").partitionBy("language").parquet(f"{path}/units")
    g.edges.write.mode("overwrite").partitionBy("edge_type").parquet(f"{path}/edges")
    g.changes.write.mode("overwrite").parquet(f"{path}/changes")


def read(spark: SparkSession, path: str) -> Graph:
    return Graph(*(spark.read.parquet(f"{path}/{t}") for t in ("units", "edges", "changes")))


def as_json(g: Graph) -> DataFrame:
    """(kind, json): one row for each unit and edge."""
    units = g.units.select(F.lit("unit").alias("kind"), F.to_json(F.struct(*sorted(g.units.columns))).alias("json"))
    return units.unionAll(g.edges.select(F.lit("edge"), F.to_json(F.struct(*sorted(g.edges.columns)))))


def from_json(rows: DataFrame, units: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Units and edges of rows (kind, json), with the schemas given; what doesn't parse is left out."""
    part = lambda k, s: rows.where(F.col("kind") == k).select(F.from_json("json", s).alias("x")).where("x is not null").select("x.*")
    return part("unit", units), part("edge", edges)


def checksum(g: Graph) -> DataFrame:
    """(sum): the same for the same rows in any order."""
    return as_json(g).agg(F.sum(F.xxhash64("kind", "json").cast("decimal(38,0)")).cast("string").alias("sum"))
