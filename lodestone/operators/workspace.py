"""Several graphs side by side: units with a context_id, comparison of two graphs, translation maps, deltas."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import looks_like_credentials, r6
from lodestone.state import numbered


def workspace(contexts: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """Units of (context_id, role, units) as one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (u.withColumns({"context_id": F.lit(c), "role": F.lit(r)}) for c, r, u in contexts))


def find(ws: DataFrame, text: str, roles: Sequence[str] = ()) -> DataFrame:
    """(context_id, id, name) of units whose name holds a text."""
    hit = ws.where(F.lower("name").contains(text.lower()))
    return (hit.where(F.col("role").isin(*roles)) if roles else hit).select("context_id", "id", "name")


def compare_symbol(ws: DataFrame, symbol: str) -> DataFrame:
    """(context_id, found, id, same_signature, same_type): the first of that name in each context, against the first context that has it."""
    first = ws.where(F.lower("name") == symbol.lower()).withColumn("k", F.row_number().over(Window.partitionBy("context_id").orderBy("id"))).where("k = 1").select("context_id", "id", "signature", "unit_type")
    lead = first.orderBy("context_id").limit(1).select(F.col("signature").alias("s0"), F.col("unit_type").alias("t0"))
    have = ws.select("context_id").distinct().join(first, "context_id", "left").crossJoin(F.broadcast(lead))  # one row
    return have.select("context_id", F.col("id").isNotNull().alias("found"), "id", (F.col("id").isNotNull() & F.col("signature").eqNullSafe(F.col("s0"))).alias("same_signature"), F.col("unit_type").eqNullSafe(F.col("t0")).alias("same_type"))


def connect(ws: DataFrame) -> DataFrame:
    """(context_id, role, units, languages) of what a workspace joins."""
    return ws.groupBy("context_id", "role").agg(F.count("*").alias("units"), F.countDistinct("language").alias("languages"))


def listen(ws: DataFrame, topic: str) -> DataFrame:
    """(context_id, hits, functions, tests) for a topic: how much each context has to say about it; contexts with nothing have no row."""
    t = topic.lower()
    hit = ws.where(F.lower("name").contains(t) | F.lower(F.coalesce("doc_summary", F.lit(""))).contains(t))
    return hit.groupBy("context_id").agg(F.count("*").alias("hits"), F.count_if(F.col("unit_type") == "function").alias("functions"), F.count_if(F.col("unit_type") == "test").alias("tests"))


def contrast(ws: DataFrame, text: str) -> DataFrame:
    """(context_id, n, complexity, documented) of the units of a name in each context."""
    hit = ws.where(F.lower("name").contains(text.lower()))
    return hit.groupBy("context_id").agg(F.count("*").alias("n"), r6(F.avg("complexity")).alias("complexity"), r6(F.count("doc_summary") / F.count("*")).alias("documented"))


def cross_reference(ws: DataFrame, symbol: str) -> DataFrame:
    """(context_id, found)."""
    return ws.groupBy("context_id").agg(F.coalesce(F.bool_or(F.lower("name") == symbol.lower()), F.lit(False)).alias("found"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(common, only_a, only_b, similarity): names of two graphs in any case, and their Dice similarity."""
    names = lambda u: u.select(F.lower("name").alias("n")).distinct()
    j = names(a).withColumn("a", F.lit(1)).join(names(b).withColumn("b", F.lit(1)), "n", "full_outer")
    c = j.agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("common"), F.count(F.when(F.col("b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_b"))
    total = 2 * F.col("common") + F.col("only_a") + F.col("only_b")
    return c.withColumn("similarity", r6(F.when(total > 0, 2 * F.col("common") / F.when(total > 0, total)).otherwise(1.0)))


def directories(a: DataFrame, b: DataFrame) -> DataFrame:
    """(directory, n_a, n_b): where two graphs differ in their numbers of units."""
    n = lambda u, c: u.groupBy(F.regexp_extract("file_path", "^(.*)/", 1).alias("directory")).agg(F.count("*").alias(c))
    return n(a, "n_a").join(n(b, "n_b"), "directory", "full_outer").na.fill(0).where("n_a <> n_b")


def migration_plan(a: DataFrame, b: DataFrame) -> DataFrame:
    """(step, name, kind, after): names that b lacks, types before functions, tests and the rest; each step but the first comes after the one before."""
    missing = a.join(b.select("name").distinct(), "name", "left_anti").groupBy("name").agg(F.min("unit_type").alias("kind"))
    rank = F.when(F.col("kind") == "type", 0).when(F.col("kind") == "function", 1).when(F.col("kind") == "test", 2).otherwise(3)
    steps = numbered(missing.withColumn("rank", rank), "at", "rank", "name")
    return steps.select((F.col("at") + 1).alias("step"), "name", "kind", F.when(F.col("at") > 0, F.col("at")).alias("after"))


def translations(log: DataFrame) -> DataFrame:
    """The last record (by seq) of each source_symbol."""
    return log.withColumn("k", F.row_number().over(Window.partitionBy("source_symbol").orderBy(F.desc("seq")))).where("k = 1").drop("k")


def progress(log: DataFrame) -> DataFrame:
    """(total, done, remaining, percent): ported, verified and skipped symbols are done."""
    done = F.count_if(F.col("status").isin("ported", "verified", "skipped"))
    a = translations(log).agg(F.count("*").alias("total"), done.alias("done"))
    return a.select("total", "done", (F.col("total") - F.col("done")).alias("remaining"), r6(F.when(F.col("total") > 0, 100.0 * F.col("done") / F.col("total")).otherwise(0.0)).alias("percent"))


def delta(events: DataFrame) -> DataFrame:
    """(json, delta_id) of events that may be shared: identifying kinds and texts that look like credentials stay out."""
    kept = events.where(~F.col("kind").isin("source_code", "file_path", "author", "identity") & ((F.col("kind") != "raw_text") | ~looks_like_credentials(F.col("text"))))
    j = F.to_json(F.struct("kind", "text"))
    return kept.select(j.alias("json"), F.sha2(j, 256).alias("delta_id"))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, modified and removed files of two listings (path, content) by content hash."""
    h = lambda f, c: f.select("path", F.sha2("content", 256).alias(c))
    j = h(old, "o").join(h(new, "n"), "path", "full_outer")
    return j.withColumn("change", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "modified")).where("change is not null").select("path", "change")


def suffix_patterns(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pattern, n_a, n_b): how often two graphs use six customary endings of names."""
    ends = ("service", "controller", "repository", "handler", "factory", "test")
    n = lambda u, c: u.select(F.explode(F.array(*(F.when(F.lower("name").endswith(e), F.lit(e)) for e in ends))).alias("pattern")).where("pattern is not null").groupBy("pattern").agg(F.count("*").alias(c))
    every = a.sparkSession.createDataFrame([(e,) for e in ends], "pattern string")
    return every.join(n(a, "n_a"), "pattern", "left").join(n(b, "n_b"), "pattern", "left").na.fill(0)


def concept_differences(found_a: DataFrame, found_b: DataFrame) -> DataFrame:
    """(concept, n_a, n_b) of concepts (concept, id) that two graphs hold differently often."""
    n = lambda f, c: f.groupBy("concept").agg(F.count("*").alias(c))
    return n(found_a, "n_a").join(n(found_b, "n_b"), "concept", "full_outer").na.fill(0).where("n_a <> n_b")
