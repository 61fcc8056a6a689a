"""From raw units to a graph: ids, resolution of references, edges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.graph import Graph
from lodestone.operators.concepts import design_patterns
from lodestone.state import checkpoint

STDLIB = {
    "Python": ("os", "sys", "re", "json", "typing", "collections", "itertools", "functools", "math", "time", "datetime", "pathlib", "logging", "unittest", "asyncio", "abc", "dataclasses", "enum", "io", "random", "print", "len", "range", "str", "int"),
    "Rust": ("std", "core", "alloc"),
    "TypeScript": ("fs", "path", "http", "util", "events", "react", "console"),
    "JavaScript": ("fs", "path", "http", "util", "events", "react", "console"),
    "Go": ("fmt", "os", "strings", "errors", "context", "sync", "time", "net/http"),
}
KINDS = {"call": "calls", "import": "imports", "type_use": "uses_type", "inherit": "inherits", "implement": "implements", "access": "references"}


def number(raw: DataFrame) -> DataFrame:
    """Raw units with an id that no two of them share, by file and place: a hash, so nothing has to be gathered to count."""
    key = F.xxhash64("path", "qualified_name", "unit_type", "start_line")
    nth = F.row_number().over(Window.partitionBy("path", "qualified_name", "unit_type", "start_line").orderBy("end_line"))
    return raw.withColumn("nth", nth).withColumn("id", F.when(F.col("nth") == 1, key).otherwise(F.xxhash64(key, "nth"))).drop("nth")


def _two_least(targets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t1, t2): the two least ids t of targets, both the same if there is one."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("t"))
    return targets.withColumn("nth", nth).where("nth <= 2").groupBy(*keys).agg(F.min("t").alias("t1"), F.max("t").alias("t2"))


def resolve(units: DataFrame) -> DataFrame:
    """(id, name, kind, line, target_id, how) of every reference: local by the qualified name, then by name in the file, then by name anywhere; imported
    by an import of the file that ends with it; external by the language's library; else unresolved.

    Each way is an equality join; the best way of a reference wins, then the least id. A name that many units share would make the product of them and
    their references, so only two of its units are joined: the least, and the next for the reference that is in the least itself.
    """
    refs = units.select("id", "path", "language", F.posexplode("refs").alias("k", "r")).select("id", "path", "language", "k", "r.*").where("kind <> 'pymodule'")
    last = F.regexp_extract("name", r"([A-Za-z0-9_]+)$", 1)
    targets = units.where("unit_type not in ('import', 'module')")
    asked = refs.withColumn("last", last)
    head = F.regexp_extract("name", r"^([A-Za-z0-9_]+)", 1)
    imports = units.where("unit_type = 'import'").select(F.col("id").alias("t"), "path", F.explode(F.array_distinct(F.array(F.regexp_extract("name", r"([A-Za-z0-9_]+)$", 1), head))).alias("tk"))
    ways = [
        (asked.withColumn("tk", F.col("name")), targets.select(F.col("id").alias("t"), F.col("qualified_name").alias("tk")), ["tk"]),
        (asked.withColumn("tk", F.col("last")), targets.select(F.col("id").alias("t"), "path", F.col("name").alias("tk")), ["path", "tk"]),
        (asked.withColumn("tk", F.col("last")), targets.select(F.col("id").alias("t"), F.col("name").alias("tk")), ["tk"]),
        (asked.where("kind <> 'import'").withColumn("tk", head), imports, ["path", "tk"]),
    ]
    found = reduce(DataFrame.unionAll, (a.join(_two_least(t, keys), keys).select("id", "k", F.when(F.col("t1") != F.col("id"), F.col("t1")).when(F.col("t2") != F.col("id"), F.col("t2")).alias("t"), F.lit(rank).alias("rank")) for rank, (a, t, keys) in enumerate(ways, 1)))
    best = found.where("t is not null").groupBy("id", "k").agg(F.min(F.struct("rank", "t")).alias("b"))
    known = units.sparkSession.createDataFrame([(lang, n) for lang, ns in STDLIB.items() for n in ns], "language string, head string").withColumn("std", F.lit(True))
    j = refs.withColumn("head", head).join(best, ["id", "k"], "left").join(F.broadcast(known), ["language", "head"], "left")  # known is a constant
    how = F.when(F.col("b.rank") <= 3, "local").when(F.col("b.rank") == 4, "imported").when(F.col("std"), "external").otherwise("unresolved")
    return j.select("id", "name", "kind", "line", F.col("b.t").alias("target_id"), how.alias("how"))


def compile_graph(raw: DataFrame, changes: DataFrame | None = None, languages: Sequence[str] = (), exclude: Sequence[str] = (), include_tests: bool = True, detect_patterns: bool = False, ffi: bool = False) -> Graph:
    """The graph of raw units: containment by each file's module, and an edge for each resolved reference.

    Of all, those of the languages and of paths that hold none of the excluded texts; on demand without tests, with a pattern unit and an edge for
    each design pattern found, and with edges to the native modules that Python imports.
    """
    raw = raw.where(F.col("language").isin(*languages)) if languages else raw
    for part in exclude:
        raw = raw.where(~F.col("path").contains(part))
    raw = raw if include_tests else raw.where("unit_type <> 'test'")
    units = checkpoint(number(raw.where("error is null")))
    found = resolve(units).where("target_id is not null")
    pairs = F.create_map(*(F.lit(x) for p in KINDS.items() for x in p))
    edges = found.select(F.col("id").alias("source_id"), "target_id", F.when(F.col("how") == "imported", "imports").otherwise(pairs[F.col("kind")]).alias("edge_type"), F.lit(1.0).alias("weight"), F.col("line").alias("context"))
    modules = units.where("unit_type = 'module'").select("path", F.col("id").alias("source_id"))
    inside = units.where("unit_type not in ('module', 'import')").join(modules, "path").select("source_id", F.col("id").alias("target_id"), F.lit("contains").alias("edge_type"), F.lit(1.0).alias("weight"), F.lit(0).alias("context"))
    shape = units.select(
        "id", "unit_type", "language", "name", "qualified_name", F.col("path").alias("file_path"), "start_line", "end_line", "signature", F.col("doc").alias("doc_summary"), "visibility", "complexity", "is_async", "is_generator",
        F.lit(0).alias("change_count"), F.lit(1.0).alias("stability_score"), F.lit(0).cast("long").alias("collective_usage"),
    )
    none = units.sparkSession.createDataFrame([], "path string, commit_id long, ts long, author string, is_bugfix boolean, lines_added int, lines_deleted int, change_type string")
    every = edges.where("source_id <> target_id").unionByName(inside)
    if ffi:
        native = trace_ffi(units).where("target_id is not null").select(F.col("id").alias("source_id"), "target_id")
        every = every.unionByName(native.select("source_id", "target_id", F.lit("ffi_binds").alias("edge_type"), F.lit(1.0).alias("weight"), F.lit(0).alias("context")))
    if detect_patterns:
        found = design_patterns(Graph(shape, every, none)).select(F.xxhash64("pattern", "id").alias("p"), "pattern", "id", "score")
        of = shape.select("id", "language", "file_path", "qualified_name", "start_line", "end_line").join(found, "id")
        own = of.select(F.col("p").alias("id"), F.lit("pattern").alias("unit_type"), "language", F.col("pattern").alias("name"), F.concat("qualified_name", F.lit("#"), "pattern").alias("qualified_name"), "file_path", "start_line", "end_line")
        every = every.unionByName(found.select(F.col("p").alias("source_id"), F.col("id").alias("target_id"), F.lit("pattern_of").alias("edge_type"), F.col("score").alias("weight"), F.lit(0).alias("context")))
        shape = shape.unionByName(own, allowMissingColumns=True)
    return Graph(shape, every, changes if changes is not None else none)


def trace_ffi(units: DataFrame) -> DataFrame:
    """(id, kind, target_id) of units whose references lead into another language: ctypes or cffi, HTTP clients, and imports of a native module, whose unit is the target."""
    refs = units.select("id", "language", F.explode("refs").alias("r")).select("id", "language", "r.*")
    n = F.lower("name")
    kind = F.when(n.rlike(r"\b(ctypes|cffi|cdll|dlopen)\b"), "ctypes").when(n.rlike(r"\b(requests|fetch|axios|httpx|reqwest)\b"), "http").when(n.rlike("pyo3|pyfunction"), "pyo3")
    plain = refs.where("kind <> 'pymodule'").select("id", kind.alias("kind"), F.lit(None).cast("long").alias("target_id")).where("kind is not null")
    native = refs.where("kind = 'pymodule'").select(F.col("name").alias("head"), F.col("id").alias("target_id"))
    imports = refs.where("language = 'Python' and kind = 'import'").withColumn("head", F.regexp_extract("name", r"^([A-Za-z0-9_]+)", 1))
    return plain.unionAll(imports.join(native, "head").select("id", F.lit("pyo3"), "target_id")).distinct()
