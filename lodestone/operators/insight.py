"""Composite reports on units, for tools that act on a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import case, r6, reasons
from lodestone.graph import Graph
from lodestone.operators.risk import degrees, with_degrees
from lodestone.operators.traverse import bfs, one

RISKY = ("password", "secret", "eval", "exec", "unsafe", "sql", "token")


def resurrect(g: Graph, text: str) -> DataFrame:
    """(id, deprecated, evidence, confidence) of units by name or words; evidence counts tests, a document line and a signature."""
    w = text.lower()
    d = F.lower(F.coalesce("doc_summary", F.lit("")))
    hit = g.units.where(F.lower("name").contains(w) | d.contains(w))
    e = F.col("tests_in") + F.col("doc_summary").isNotNull().cast("int") + F.col("signature").isNotNull().cast("int")
    return with_degrees(g, hit).select("id", d.contains("deprecated").alias("deprecated"), e.alias("evidence"), case([(e > 5, "high"), (e > 2, "medium")], "low").alias("confidence"))


def versions(g: Graph) -> DataFrame:
    """(id, old_id, name, old_name): version_of pairs."""
    n = g.units.select("id", "name")
    e = g.edges.where("edge_type = 'version_of'").select(F.col("source_id").alias("id"), F.col("target_id").alias("old_id"))
    return e.join(n, "id").join(n.select(F.col("id").alias("old_id"), F.col("name").alias("old_name")), "old_id").select("id", "old_id", "name", "old_name")


def dna(g: Graph) -> DataFrame:
    """(id, out_types, in_types, style): the kinds of edges of a unit and the style of its name."""
    ends = g.edges.select(F.col("source_id").alias("id"), F.col("edge_type").alias("o"), F.lit(None).cast("string").alias("i")).unionAll(g.edges.select("target_id", F.lit(None).cast("string"), "edge_type"))
    by = ends.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("o")), ",").alias("out_types"), F.array_join(F.array_sort(F.collect_set("i")), ",").alias("in_types"))
    n = F.col("name")
    style = case([(n.contains("_") & (F.upper(n) == n), "screaming"), (n.contains("_"), "snake"), (n.rlike("^[A-Z]"), "camel")], "other")
    return g.units.join(by, "id", "left").na.fill("", ["out_types", "in_types"]).select("id", "out_types", "in_types", style.alias("style"))


def lineage(g: Graph, unit: int, depth: int = 10) -> DataFrame:
    """(id, depth): what a unit comes from, by edges of contents, inheritance and versions."""
    return bfs(g.edges, one(g.units, unit), depth, ("contains", "inherits", "version_of", "implements"), "backward").where("depth > 0").select("id", "depth")


def mutations(g: Graph) -> DataFrame:
    """(id, signs) of units that stand out."""
    breaks = g.edges.where("edge_type = 'breaks_with'").select(F.col("source_id").alias("id")).distinct().withColumn("b", F.lit(True))
    signs = reasons([(F.col("complexity") > 20, "complex"), ((F.col("stability_score") < 0.3) & (F.col("change_count") > 5), "unstable"), (F.coalesce("b", F.lit(False)), "breaks")])
    return g.units.join(breaks, "id", "left").select("id", signs.alias("signs")).where("signs <> ''")


def diseases(g: Graph) -> DataFrame:
    """(id, disease): god objects, feature envy, untested functions, orphans, and units in mutual dependence."""
    kind = g.edges.groupBy(F.col("source_id").alias("id")).agg(F.count_if(F.col("edge_type") == "calls").alias("calls_out"))
    back = g.edges.groupBy(F.col("target_id").alias("id")).agg(F.count_if(F.col("edge_type") == "calls").alias("calls_in"))
    u = with_degrees(g).join(kind, "id", "left").join(back, "id", "left").na.fill(0, ["calls_out", "calls_in"])
    parts = [
        F.when(F.col("n_out") > 20, "god_object"),
        F.when((F.col("calls_out") > 10) & (F.col("calls_out") > 3 * F.col("calls_in")), "feature_envy"),
        F.when((F.col("unit_type") == "function") & (F.col("tests_in") == 0), "untested"),
        F.when(F.col("n_in") + F.col("n_out") == 0, "orphan"),
    ]
    single = u.select("id", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("disease"))
    e = g.edges.where("edge_type = 'calls' and source_id <> target_id").select("source_id", "target_id").distinct()
    mutual = e.join(e.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")), ["source_id", "target_id"], "left_semi")
    return single.unionAll(mutual.select("source_id", F.lit("circular")).distinct())


def consensus(ws: DataFrame) -> DataFrame:
    """(name, contexts, verdict) of names over the contexts of a workspace."""
    n = ws.select("context_id").distinct().agg(F.count("*").alias("all"))
    by = ws.groupBy(F.lower("name").alias("name")).agg(F.countDistinct("context_id").alias("contexts")).crossJoin(F.broadcast(n))  # one row
    c, a = F.col("contexts"), F.col("all")
    return by.select("name", "contexts", case([(c == a, "universal"), (2 * c > a, "majority")], "minority").alias("verdict"))


def broadcast_report(ws: DataFrame) -> DataFrame:
    """(context_id, units, complex, test_ratio)."""
    t, f = F.count_if(F.col("unit_type") == "test"), F.count_if(F.col("unit_type") == "function")
    return ws.groupBy("context_id").agg(F.count("*").alias("units"), F.count_if(F.col("complexity") > 15).alias("complex"), r6(t / F.greatest(f, F.lit(1))).alias("test_ratio"))


def soul_compare(g: Graph, unit: int) -> DataFrame:
    """(id, similarity) of functions to one of them: type, asynchrony, complexity and kinds of edges."""
    one(g.units, unit)
    kinds = g.edges.groupBy(F.col("source_id").alias("id")).agg(F.collect_set("edge_type").alias("k"))
    u = g.units.join(kinds, "id", "left").select("id", "unit_type", "is_async", "complexity", F.coalesce("k", F.array().cast("array<string>")).alias("k"))
    me = u.where(F.col("id") == unit).select(*(F.col(c).alias(f"m_{c}") for c in ("unit_type", "is_async", "complexity", "k")))
    both = u.where(F.col("id") != unit).crossJoin(F.broadcast(me))  # one row
    most = F.greatest(F.size("k"), F.size("m_k"))
    s = F.when(F.col("unit_type") == F.col("m_unit_type"), 0.3).otherwise(0.0) + F.when(F.col("is_async") == F.col("m_is_async"), 0.1).otherwise(0.0) + F.when(F.abs(F.col("complexity") - F.col("m_complexity")) < 5, 0.2).otherwise(0.0) + F.when(most > 0, 0.4 * F.size(F.array_intersect("k", "m_k")) / F.greatest(most, F.lit(1))).otherwise(0.0)
    return both.select("id", r6(s).alias("similarity"))


def karma(g: Graph) -> DataFrame:
    """(id, karma): good deeds less bad ones."""
    d = with_degrees(g)
    broken = g.edges.where("edge_type = 'breaks_with'").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("out_breaks"))
    k = 10 * F.col("tests_in") + F.when(F.col("doc_summary").isNotNull(), 5).otherwise(0) + F.when(F.col("stability_score") > 0.8, 15).otherwise(0) + F.when(F.col("complexity") < 10, 10).otherwise(0) - 20 * F.coalesce("out_breaks", F.lit(0)) - F.when(F.col("stability_score") < 0.3, 15).otherwise(0) - F.when(F.col("complexity") > 20, 10).otherwise(0) - F.when(F.col("change_count") > 50, 10).otherwise(0)
    return d.join(broken, "id", "left").select("id", k.cast("long").alias("karma"))


def soul_risk(g: Graph) -> DataFrame:
    """(id, risk) of moving a unit, by what it needs."""
    return with_degrees(g).select("id", case([(F.col("n_out") > 10, "high"), (F.col("n_out") > 5, "medium")], "low").alias("risk"))


def best(g: Graph, text: str, top: int = 5) -> DataFrame:
    """(id, score) of the best examples of a name."""
    hit = with_degrees(g, g.units.where(F.lower("name").contains(text.lower())))
    s = 0.15 + F.when(F.col("tests_in") > 0, 0.3).otherwise(0.0) + F.when(F.col("doc_summary").isNotNull(), 0.2).otherwise(0.0) + F.when(F.col("stability_score") > 0.7, 0.2).otherwise(0.0) + F.when(F.col("complexity") < 15, 0.15).otherwise(0.0)
    return hit.select("id", r6(s).alias("score")).orderBy(F.desc("score"), "id").limit(top)


def census(units: DataFrame) -> DataFrame:
    """(language, unit_type, n) by both, by each and in all (null)."""
    return units.cube("language", "unit_type").agg(F.count("*").alias("n"))


def vulnerable(units: DataFrame) -> DataFrame:
    """(id, word): the first risky word of a name or document line."""
    t = F.lower(F.concat_ws(" ", "name", "doc_summary"))
    return units.select("id", case([(t.contains(w), w) for w in RISKY]).alias("word")).where("word is not null")


def trend(units: DataFrame) -> DataFrame:
    """(language, stability, changes, complexity, verdict)."""
    a = units.groupBy("language").agg(r6(F.avg("stability_score")).alias("stability"), r6(F.avg("change_count")).alias("changes"), r6(F.avg("complexity")).alias("complexity"))
    return a.withColumn("verdict", case([((F.col("stability") < 0.5) & (F.col("complexity") > 15), "declining"), (F.col("stability") > 0.7, "stable")], "emerging"))


def scorecard(g: Graph) -> DataFrame:
    """(score, grade) of a graph out of 100."""
    d = degrees(g.edges)
    f = g.units.where("unit_type = 'function'").join(d, "id", "left").na.fill(0)
    a = f.agg((F.count_if(F.col("tests_in") > 0) / F.count("*")).alias("t"), (F.count_if(F.col("doc_summary").isNotNull()) / F.count("*")).alias("d"), F.avg("stability_score").alias("s"), (F.count_if(F.col("complexity") < 15) / F.count("*")).alias("c"))
    score = r6(100 * (0.3 * F.col("t") + 0.2 * F.col("d") + 0.3 * F.col("s") + 0.2 * F.col("c")))
    return a.select(score.alias("score"), case([(score >= 80, "A"), (score >= 60, "B"), (score >= 40, "C")], "D").alias("grade"))


def projection(sizes: DataFrame, days: int, budget: int) -> DataFrame:
    """(growth_per_day, projected, over): straight line through the first and last of (ts, bytes); none without two samples or growth."""
    a = sizes.agg(F.min_by("bytes", "ts").alias("b0"), F.max_by("bytes", "ts").alias("b1"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    rate = (F.col("b1") - F.col("b0")) * 86400.0 / (F.col("t1") - F.col("t0"))
    return a.where("t1 > t0 and b1 > b0").select(r6(rate).alias("growth_per_day"), r6(F.col("b1") + rate * days).alias("projected"), (F.col("b1") + rate * days > budget).alias("over"))


def log_operation(log: DataFrame, session: str, operation: str, at: int) -> DataFrame:
    """An operation log with one more row; sessions begin with ``start`` and may end with ``end``."""
    return log.unionByName(log.sparkSession.createDataFrame([(session, operation, at)], "session string, operation string, at long"))


def sessions(log: DataFrame) -> DataFrame:
    """(session, started, last, operations, is_open) of an operation log."""
    a = log.groupBy("session").agg(F.min("at").alias("started"), F.max("at").alias("last"), F.count("*").alias("operations"), F.max(F.when(F.col("operation") == "end", F.col("at"))).alias("ended"))
    return a.select("session", "started", "last", "operations", (F.col("ended").isNull() | (F.col("ended") < F.col("last"))).alias("is_open"))


def resume(log: DataFrame, session: str, most: int = 20) -> DataFrame:
    """(operation, at): the last operations of a session, the latest first."""
    return log.where(F.col("session") == session).select("operation", "at").orderBy(F.desc("at"), "operation").limit(most)


def attempt(g: Graph, unit: int) -> DataFrame:
    """(id, uses, used_by, evidence, confidence): what is known about a unit that is to be brought back."""
    one(g.units, unit)
    d = with_degrees(g, g.units.where(F.col("id") == unit))
    e = F.col("tests_in") + F.col("doc_summary").isNotNull().cast("int") + F.col("signature").isNotNull().cast("int")
    return d.select("id", F.col("n_out").alias("uses"), F.col("n_in").alias("used_by"), e.alias("evidence"), case([(e > 5, "high"), (e > 2, "medium")], "low").alias("confidence"))


def verify(g: Graph, name: str) -> DataFrame:
    """(found, referenced, tested): whether a unit of that name is there again, and is used and tested."""
    hit = with_degrees(g, g.units.where(F.col("name") == name))
    return hit.agg((F.count("*") > 0).alias("found"), F.coalesce(F.bool_or(F.col("n_in") > 0), F.lit(False)).alias("referenced"), F.coalesce(F.bool_or(F.col("tests_in") > 0), F.lit(False)).alias("tested"))


def preserve(g: Graph) -> DataFrame:
    """(id, soul): name, type, language and traits of every unit as JSON."""
    return soul(g).join(g.units.select("id", "name", "unit_type", "language"), "id").select("id", F.to_json(F.struct("name", "unit_type", "language", "traits")).alias("soul"))


def reincarnate(souls: DataFrame, language: str) -> DataFrame:
    """(id, name, language, effort) of preserved units in another language: none for their own, less for those that are tested."""
    x = F.from_json("soul", "name string, unit_type string, language string, traits string")
    effort = case([(F.col("x.language") == language, "none"), (F.col("x.traits").contains("tested"), "low")], "high")
    return souls.withColumn("x", x).select("id", "x.name", F.lit(language).alias("language"), effort.alias("effort"))


def api_usage(g: Graph, text: str) -> DataFrame:
    """(id, callers, files): how widely units of a name are called."""
    hit = g.units.where(F.lower("name").contains(text.lower())).select("id")
    calls = g.edges.where("edge_type = 'calls'").select(F.col("target_id").alias("id"), "source_id").join(g.units.select(F.col("id").alias("source_id"), "file_path"), "source_id")
    by = calls.groupBy("id").agg(F.countDistinct("source_id").alias("callers"), F.countDistinct("file_path").alias("files"))
    return hit.join(by, "id", "left").na.fill(0)


def solve(units: DataFrame, problem: str) -> DataFrame:
    """(id, relevance): the share of a problem's words that a unit's name or document line holds."""
    words = sorted({w for w in problem.lower().split() if len(w) > 2})
    t = F.lower(F.concat_ws(" ", "name", "doc_summary"))
    hits = F.lit(0)
    for w in words:
        hits = hits + t.contains(w).cast("int")
    return units.select("id", r6(hits / F.lit(float(max(1, len(words))))).alias("relevance")).where("relevance > 0")


def soul(g: Graph) -> DataFrame:
    """(id, traits) of units by thresholds."""
    traits = F.concat_ws(",", F.when(F.col("tests_in") > 0, "tested"), F.when(F.col("doc_summary").isNotNull(), "documented"), F.when(F.col("stability_score") > 0.8, "stable"), F.when(F.col("complexity") < 10, "simple"), F.when(F.col("is_async"), "asynchronous"))
    return with_degrees(g).select("id", traits.alias("traits"))
