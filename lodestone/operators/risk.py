"""Risk, impact, coupling and migration queries. Degrees come from one aggregation of the edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import case, is_dependency, parent_module, r6, reasons
from lodestone.graph import Graph
from lodestone.operators.structure import dependencies
from lodestone.operators.traverse import bfs, one

IMPACT_TYPES = ("calls", "imports", "inherits", "implements", "uses_type", "references", "returns", "param_type", "overrides")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, tests_in, couples, breaks, n_in, n_out) of every unit with an edge: one shuffle of the edges' ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("out")), F.struct(F.col("target_id").alias("id"), F.lit(0).alias("out")))).alias("x"), "edge_type").select("x.*", "edge_type")
    n = lambda c: F.count(F.when(c, 1))
    kind, out = F.col("edge_type"), F.col("out") == 1
    return ends.groupBy("id").agg(n((kind == "tests") & ~out).alias("tests_in"), n(kind == "couples_with").alias("couples"), n((kind == "breaks_with")).alias("breaks"), n(~out).alias("n_in"), n(out).alias("n_out"))


def with_degrees(g: Graph, units: DataFrame | None = None) -> DataFrame:
    u = g.units if units is None else units
    return u.join(degrees(g.edges), "id", "left").na.fill(0, ["tests_in", "couples", "breaks", "n_in", "n_out"])


def impact(g: Graph, unit: int, depth: int, types: Sequence[str] | None = None) -> DataFrame:
    """(id, depth, has_tests, risk) of what depends on a unit."""
    found = dependencies(g, unit, depth, **({"types": types} if types else {}), direction="backward").select("id", "depth")
    d = with_degrees(g, found)
    tested = F.col("tests_in") > 0
    risk = F.least(F.lit(1.0), F.lit(0.4) / (1 + F.col("depth")) + F.when(tested, 0.2).otherwise(0.6) + F.least(F.lit(0.3), 0.05 * F.col("couples")))
    return d.select("id", "depth", tested.alias("has_tests"), r6(risk).alias("risk"))


def impact_summary(impacted: DataFrame) -> DataFrame:
    """(impacted, untested, overall_risk, recommendations)."""
    a = impacted.agg(F.count("*").alias("impacted"), F.count(F.when(~F.col("has_tests"), 1)).alias("untested"), r6(F.least(F.lit(1.0), F.coalesce(F.avg("risk"), F.lit(0.0)))).alias("overall_risk"))
    return a.withColumn("recommendations", reasons([(F.col("untested") > 0, "add tests"), (F.col("impacted") > 10, "split the change"), (F.col("overall_risk") > 0.7, "review with care")]))


def gate(impacted: DataFrame, most: float = 0.6) -> DataFrame:
    """(passed): no more risk than allowed, and nothing untested."""
    return impact_summary(impacted).select(((F.col("overall_risk") <= most) & (F.col("untested") == 0)).alias("passed"), "overall_risk", "untested")


def test_coverage(g: Graph, unit: int) -> DataFrame:
    """(direct, indirect, ratio): tests of a unit, and of its callers that aren't its own."""
    one(g.units, unit)
    tests = g.edges.where("edge_type = 'tests'").select("source_id", "target_id")
    direct = tests.where(F.col("target_id") == unit).select(F.col("source_id").alias("t")).distinct()
    callers = g.edges.where((F.col("edge_type") == "calls") & (F.col("target_id") == unit)).select(F.col("source_id").alias("target_id")).distinct()
    indirect = tests.join(callers, "target_id", "left_semi").select(F.col("source_id").alias("t")).distinct().join(direct, "t", "left_anti")
    e = F.col("direct") + 0.5 * F.col("indirect")
    return direct.agg(F.count("*").alias("direct")).crossJoin(indirect.agg(F.count("*").alias("indirect"))).select("direct", "indirect", r6(F.when(e > 0, e / (e + 1)).otherwise(0.0)).alias("ratio"))


def trend(stability: Column) -> Column:
    return case([(stability > 0.8, "Stable"), (stability > 0.5, "Moderate"), (stability > 0.2, "Volatile")], "Highly volatile")


def stability(g: Graph, units: DataFrame | None = None) -> DataFrame:
    """(id, change_factor, test_factor, complexity_factor, coupling_factor, overall, advice)."""
    d = with_degrees(g, units)
    f = d.select(
        "id", (1 / (1 + 0.1 * F.col("change_count"))).alias("change_factor"), F.least(F.lit(1.0), 0.3 * F.col("tests_in")).alias("test_factor"), (1 / (1 + 0.05 * F.col("complexity"))).alias("complexity_factor"), (1 / (1 + 0.2 * F.col("couples"))).alias("coupling_factor")
    )
    overall = 0.3 * F.col("change_factor") + 0.25 * F.col("test_factor") + 0.25 * F.col("complexity_factor") + 0.2 * F.col("coupling_factor")
    out = f.withColumn("overall", r6(overall))
    return out.select("id", *(r6(F.col(c)).alias(c) for c in f.columns[1:]), "overall", case([(F.col("overall") > 0.7, "stable"), (F.col("overall") > 0.4, "watch")], "unstable").alias("advice"))


def couplings(g: Graph, least: float, unit: int | None = None) -> DataFrame:
    """(unit_a, unit_b, strength, kind): of several couplings of a pair the one found first, unit by unit, explicit before temporal before hidden."""
    e = g.edges.where(F.col("weight") >= least)
    explicit = e.where(is_dependency()).select(F.col("source_id").alias("at"), "source_id", "target_id", "weight", F.lit(0).alias("rank"))
    both = e.where("edge_type = 'couples_with'")
    temporal = both.select(F.col("source_id").alias("at"), "source_id", "target_id", "weight", F.lit(1).alias("rank")).unionAll(both.select(F.col("target_id").alias("at"), "source_id", "target_id", "weight", F.lit(2).alias("rank")))
    rows = explicit.unionAll(temporal)
    if unit is not None:
        one(g.units, unit)
        rows = rows.where(F.col("at") == unit)
        targets = g.edges.where(is_dependency()).select("source_id", "target_id").distinct()
        mine = targets.where(F.col("source_id") == unit).select("target_id")
        size = targets.groupBy("source_id").agg(F.count("*").alias("n"))
        shared = targets.join(mine, "target_id").where(F.col("source_id") != unit).groupBy("source_id").agg(F.count("*").alias("both")).join(size, "source_id")
        own = mine.agg(F.count("*").alias("own"))
        jaccard = F.col("both") / (F.col("n") + F.col("own") - F.col("both"))
        rows = rows.unionAll(shared.crossJoin(F.broadcast(own)).where(jaccard >= least).select(F.lit(unit).cast("long"), F.lit(unit).cast("long"), "source_id", jaccard, F.lit(3)))  # own is one row
    pair = rows.select(F.least("source_id", "target_id").alias("unit_a"), F.greatest("source_id", "target_id").alias("unit_b"), F.struct("at", "rank", (-F.col("weight")).alias("w")).alias("k"))
    kinds = F.array(*map(F.lit, ("explicit", "temporal", "temporal", "hidden")))
    return pair.groupBy("unit_a", "unit_b").agg(F.min("k").alias("k")).select("unit_a", "unit_b", r6(-F.col("k.w")).alias("strength"), F.get(kinds, F.col("k.rank")).alias("kind"))


def prophecy(g: Graph, top: int, least: float) -> DataFrame:
    """(id, risk, reasons) of the riskiest units."""
    s, x, c, b = F.col("stability_score"), F.col("complexity"), F.col("change_count"), F.col("breaks_out")
    broken = g.edges.where("edge_type = 'breaks_with'").select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("breaks_out"))
    u = with_degrees(g).join(broken, "id", "left").na.fill(0, ["breaks_out"])
    untested = (F.col("unit_type") == "function") & (F.col("tests_in") == 0)
    risk = case([(s < 0.3, 0.4), (s < 0.6, 0.2)], 0.0) + case([(x > 20, 0.3), (x > 10, 0.15)], 0.0) + case([(c > 50, 0.2), (c > 20, 0.1)], 0.0) + 0.2 * F.least(b, F.lit(3)) / 3 + F.when(untested, 0.1).otherwise(0.0)
    why = reasons([(s < 0.3, "very low stability"), ((s >= 0.3) & (s < 0.6), "low stability"), (x > 20, "very complex"), ((x > 10) & (x <= 20), "complex"), (c > 20, "changed often"), (b > 0, "breaks with others"), (untested, "no tests")])
    out = u.select("id", r6(F.least(F.lit(1.0), risk)).alias("risk"), why.alias("reasons")).where(F.col("risk") >= least)
    return out.orderBy(F.desc("risk"), "id").limit(top) if top else out


def migration(g: Graph, old: int, new: int) -> DataFrame:
    """(step, id, safety, description): the new unit, what depends on the old one (tested first), the old one."""
    one(g.units, new)
    d = dependencies(g, old, 1, ("calls", "imports", "uses_type", "inherits", "implements"), direction="backward").select("id")
    tested = g.edges.where("edge_type = 'tests'").select(F.col("target_id").alias("id")).distinct()
    calls = g.edges.where("edge_type = 'calls'").select(F.col("source_id").alias("id"), "target_id").join(tested, "id", "left_semi").select(F.col("target_id").alias("id")).distinct()
    rank = F.when(F.col("t"), 0).when(F.col("c"), 1).otherwise(2)
    marked = d.join(tested.withColumn("t", F.lit(True)), "id", "left").join(calls.withColumn("c", F.lit(True)), "id", "left").select("id", rank.alias("rank"))
    spark = g.units.sparkSession
    ends = spark.createDataFrame([(new, -1, "safe"), (old, 9, "caution")], "id long, rank int, safety string")
    names = F.array(*map(F.lit, ("safe", "caution", "risky")))
    every = ends.unionAll(marked.select("id", "rank", F.get(names, F.col("rank"))))
    what = case([(F.col("rank") == -1, "bring in the new unit"), (F.col("rank") == 9, "take out the old unit"), (F.col("rank") == 0, "switch, its tests tell"), (F.col("rank") == 1, "switch, tests of a caller tell")], "switch, and add tests")
    return every.select((F.row_number().over(Window.orderBy("rank", "id")) - 1).alias("step"), "id", "safety", what.alias("description"))  # the direct dependents of one unit


def test_gap(g: Graph, changes: int, complexity: int, types: Sequence[str] = ("function",)) -> DataFrame:
    """(id, priority) of untested units that change much or are complex."""
    tested = g.edges.where("edge_type = 'tests'").select(F.col("target_id").alias("id"))
    u = g.units.where(F.col("unit_type").isin(*types) & ((F.col("change_count") >= changes) | (F.col("complexity") >= complexity))).join(tested, "id", "left_anti")
    half = lambda c, least: 0.5 * F.least(F.lit(2.0), F.col(c) / float(max(1, least)))
    return u.select("id", r6(F.least(F.lit(1.0), half("change_count", changes) + half("complexity", complexity))).alias("priority"))


def hotspots(g: Graph, top: int, least: float, types: Sequence[str] = ()) -> DataFrame:
    """(id, name, score, change, instability, complexity, coupling) of the units of highest score."""
    u = g.units.where(F.col("unit_type").isin(*types)) if types else g.units
    one_of = lambda c, by: F.least(F.lit(1.0), c / float(by))
    d = with_degrees(g, u).select("id", "name", one_of(F.col("change_count"), 50).alias("change"), (1 - F.col("stability_score")).alias("instability"), one_of(F.col("complexity"), 30).alias("complexity"), one_of(F.col("n_in") + F.col("n_out"), 20).alias("coupling"))
    score = 0.35 * F.col("change") + 0.25 * F.col("instability") + 0.25 * F.col("complexity") + 0.15 * F.col("coupling")
    out = d.select("id", "name", r6(score).alias("score"), *(r6(F.col(c)).alias(c) for c in ("change", "instability", "complexity", "coupling"))).where(F.col("score") >= least)
    return out.orderBy(F.desc("score"), "id").limit(top) if top else out


def analyze_change(g: Graph, unit: int, kind: str, depth: int) -> DataFrame:
    """(id, depth, impact, probability) of a deletion, signature, rename, behavior or move."""
    found = bfs(g.edges, one(g.units, unit), depth, IMPACT_TYPES, "backward").where("depth > 0").select("id", "depth")
    near, tested = F.col("depth") == 1, F.col("tests_in") > 0
    impact_of = {
        "deletion": F.when(near, "will_break").otherwise("might_break"),
        "signature": F.when(near, "will_break").otherwise("needs_review"),
        "rename": F.when(near, "will_break").otherwise("needs_review"),
        "behavior": F.when(tested, "needs_review").otherwise("might_break"),
        "move": F.when(near, "might_break").otherwise("safe"),
    }[kind]
    base = {"deletion": 0.95, "signature": 0.85, "rename": 0.80, "behavior": 0.50, "move": 0.40}[kind]
    return with_degrees(g, found).select("id", "depth", impact_of.alias("impact"), r6(F.least(F.lit(1.0), base / (1 + 0.5 * F.col("depth")))).alias("probability"))


def blast_radius(g: Graph, hit: DataFrame) -> DataFrame:
    """(files, functions, modules, lines, tests, total, will_break, risk_level) of analyze_change's rows."""
    u = hit.join(g.units, "id")
    n = lambda c: F.count(F.when(c, 1))
    a = u.agg(F.countDistinct("file_path").alias("files"), n(F.col("unit_type") == "function").alias("functions"), F.countDistinct(parent_module(F.col("qualified_name"))).alias("modules"), F.coalesce(F.sum(F.greatest(F.col("end_line") - F.col("start_line"), F.lit(1))), F.lit(0)).alias("lines"), n(F.col("unit_type") == "test").alias("tests"), F.count("*").alias("total"), n(F.col("impact") == "will_break").alias("will_break"))
    level = case([((F.col("will_break") > 10) | (F.col("files") > 20), "critical"), ((F.col("will_break") > 3) | (F.col("files") > 10) | (F.col("total") > 30), "high"), ((F.col("will_break") > 0) | (F.col("total") > 10), "medium")], "low")
    return a.withColumn("risk_level", level)


def impact_paths(g: Graph, unit: int, depth: int) -> DataFrame:
    """(id, depth, path): how a change of a unit reaches each other, by the same edges as the analysis."""
    return bfs(g.edges, one(g.units, unit), depth, IMPACT_TYPES, "backward").where("depth > 0")


def mitigations(kind: str, radius: DataFrame) -> DataFrame:
    """(description, effort, reduction) by the kind of change, the risk level and the tests affected."""
    own = {
        "signature": [("keep the old signature as a wrapper", "low", 0.7), ("deprecate the old signature for a while", "medium", 0.9)],
        "deletion": [("warn of the deprecation first", "low", 0.5)],
        "rename": [("leave an alias under the old name", "low", 0.8)],
    }.get(kind, [])
    rows = [*((*r, "true") for r in own), ("release step by step behind a flag", "medium", 0.6, "risk_level in ('high', 'critical')"), ("add tests before the change", "medium", 0.4, "tests = 0")]
    some = F.array(*(F.when(F.expr(c), F.struct(F.lit(d).alias("description"), F.lit(e).alias("effort"), F.lit(x).alias("reduction"))) for d, e, x, c in rows))
    return radius.select(F.explode(F.filter(some, lambda x: x.isNotNull())).alias("x")).select("x.*")


def as_json(g: Graph, unit: int, hit: DataFrame, radius: DataFrame, paths: DataFrame) -> DataFrame:
    """(json): nodes, edges (the last hops of paths) and blast radius of a change, for a display."""
    names = g.units.select("id", "name")
    root = names.where(F.col("id") == unit).select(F.struct("id", "name", F.lit("change_target").alias("type"), F.lit(0).alias("distance"), F.lit(1.0).alias("probability")).alias("x"))
    reached = hit.join(names, "id").select(F.struct("id", "name", F.col("impact").alias("type"), F.col("depth").alias("distance"), "probability").alias("x"))
    nodes = root.unionAll(reached).agg(F.array_sort(F.collect_list("x")).alias("nodes"))
    edges = paths.agg(F.array_sort(F.collect_list(F.struct(F.element_at("path", -2).alias("from"), F.col("id").alias("to")))).alias("edges"))
    return nodes.crossJoin(edges).crossJoin(radius).select(F.to_json(F.struct("nodes", "edges", F.struct("files", "functions", "modules", "tests").alias("blast_radius"), "risk_level")).alias("json"))  # one row each


def regression(g: Graph, unit: int, depth: int) -> DataFrame:
    """(id, verdict, probability) of every test: likely, recommended or skip; minimal tells the least set to run."""
    tests = g.units.where("unit_type = 'test'").select("id")
    direct = g.edges.where((F.col("edge_type") == "tests") & (F.col("target_id") == unit)).select(F.col("source_id").alias("id"), F.lit(True).alias("direct")).distinct()
    found = bfs(g.edges, one(g.units, unit), depth, ["calls", "imports", "tests", "references", "uses_type"], "backward").select("id", "depth")
    p = 0.6 / (1 + 0.3 * F.col("depth"))
    m = tests.join(direct, "id", "left").join(found, "id", "left")
    out = m.select("id", F.when(F.col("direct"), "likely").when(p > 0.3, "recommended").otherwise("skip").alias("verdict"), r6(F.when(F.col("direct"), 0.85).when(p > 0.3, p).otherwise(0.0)).alias("probability"))
    return out.withColumn("minimal", (F.col("verdict") == "likely") | (F.col("probability") > 0.4))


def health(g: Graph, dead: DataFrame) -> DataFrame:
    """(risks, high_risks, gaps, hotspots, dead, status): the composite report."""
    p = prophecy(g, 0, 0.45).agg(F.count("*").alias("risks"), F.count(F.when(F.col("risk") >= 0.7, 1)).alias("high_risks"))
    n = lambda df, c: df.agg(F.count("*").alias(c))
    a = p.crossJoin(n(test_gap(g, 5, 10), "gaps")).crossJoin(n(hotspots(g, 0, 0.55), "hotspots")).crossJoin(n(dead, "dead"))  # one row each
    status = case([((F.col("high_risks") >= 3) | (F.col("gaps") >= 8), "fail"), ((F.col("risks") + F.col("gaps") + F.col("hotspots") + F.col("dead")) > 0, "warn")], "pass")
    return a.withColumn("status", status)
