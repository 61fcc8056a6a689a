"""Queries of a commit history: changes(path, commit_id, ts in seconds, author, is_bugfix, lines_added, lines_deleted, change_type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import case, r6, reasons

DAY = 86400


def within(changes: DataFrame, since: int | None = None, until: int | None = None, prefix: str | None = None, most_commits: int = 0) -> DataFrame:
    """Changes of a time, of paths with a prefix, and of the latest commits."""
    out = changes.where(F.col("ts") >= since) if since is not None else changes
    out = out.where(F.col("ts") <= until) if until is not None else out
    out = out.where(F.col("path").startswith(prefix)) if prefix else out
    if most_commits:
        latest = out.groupBy("commit_id").agg(F.max("ts").alias("m")).orderBy(F.desc("m"), "commit_id").limit(most_commits).select("commit_id")
        out = out.join(latest, "commit_id", "left_semi")
    return out


def history(changes: DataFrame, now: int, window_days: int = 30) -> DataFrame:
    """One row for each path. Changes are aggregated by path and author first, so a hot path is spread over its authors, and these needn't be collected to be counted."""
    recent = F.col("ts") >= now - window_days * DAY
    by = changes.groupBy("path", "author").agg(
        F.count("*").alias("n"), F.count_if("is_bugfix").alias("bugfixes"), F.sum("lines_added").alias("added"), F.sum("lines_deleted").alias("deleted"),
        F.max("ts").alias("latest"), F.min("ts").alias("oldest"), F.count_if(recent).alias("recent"), F.count_if(recent & F.col("is_bugfix")).alias("recent_bugfixes"),
    )
    total = [F.sum(c).alias(c) for c in ("n", "bugfixes", "added", "deleted", "recent", "recent_bugfixes")]
    out = by.groupBy("path").agg(*total, F.count("author").alias("n_authors"), F.max("latest").alias("latest"), F.min("oldest").alias("oldest"))
    return out.select("path", "n", "bugfixes", "n_authors", "added", "deleted", (F.col("added") + F.col("deleted")).alias("churn"), "latest", "oldest", "recent", "recent_bugfixes")


def authors(changes: DataFrame) -> DataFrame:
    """(path, author, n) of everyone who changed a path."""
    return changes.where("author is not null").groupBy("path", "author").agg(F.count("*").alias("n"))


def stability(h: DataFrame) -> DataFrame:
    """(path, frequency, bugfix, recency, author, churn_score, score, advice) of history's rows."""
    f = h.select(
        "path", "n", "bugfixes", "recent", "n_authors",
        (1 / (1 + F.log2("n"))).alias("frequency"),
        (1 - F.col("bugfixes") / F.col("n")).alias("bugfix"),
        (1 - F.col("recent") / F.col("n")).alias("recency"),
        (1 / F.greatest(F.lit(1), F.col("n_authors"))).alias("author"),
        (1 / (1 + F.greatest(F.lit(0.0), F.coalesce(F.log2("churn"), F.lit(0.0))))).alias("churn_score"),
    )
    score = 0.25 * F.col("frequency") + 0.25 * F.col("bugfix") + 0.2 * F.col("recency") + 0.15 * F.col("author") + 0.15 * F.col("churn_score")
    advice = reasons([(F.col("bugfixes") / F.col("n") > 0.5, "many bugfixes"), (F.col("recent") > 5, "changed lately"), (F.col("n_authors") > 5, "many authors")])
    return f.select("path", *(r6(F.col(c)).alias(c) for c in ("frequency", "bugfix", "recency", "author", "churn_score")), r6(score).alias("score"), advice.alias("advice"))


def cochange(changes: DataFrame, least: int = 3, strength: float = 0.5, edges: DataFrame | None = None) -> DataFrame:
    """(path_a, path_b, together, strength, kind): paths that commits change together, against the more changed one's changes.

    Pairs are built within commits, the paths of which are distinct first. edges(path_a, path_b) mark explicit couplings.
    """
    rows = changes.groupBy("path").agg(F.count("*").alias("n"))
    often = rows.where(F.col("n") >= least).select("path")  # a path of fewer changes is in no pair
    touched = changes.select("commit_id", "path").distinct().join(often, "path", "left_semi")
    a, b = touched.withColumnRenamed("path", "path_a"), touched.withColumnRenamed("path", "path_b")
    pair = a.join(b, "commit_id").where("path_a < path_b").groupBy("path_a", "path_b").agg(F.count("*").alias("together")).where(F.col("together") >= least)
    n = pair.join(rows.select(F.col("path").alias("path_a"), F.col("n").alias("n_a")), "path_a").join(rows.select(F.col("path").alias("path_b"), F.col("n").alias("n_b")), "path_b")
    out = n.select("path_a", "path_b", "together", r6(F.least(F.lit(1.0), F.col("together") / F.greatest("n_a", "n_b"))).alias("strength")).where(F.col("strength") >= strength)
    if edges is None:
        return out.withColumn("kind", F.lit("co_change"))
    e = edges.select("path_a", "path_b").distinct().withColumn("e", F.lit(True))
    return out.join(e, ["path_a", "path_b"], "left").withColumn("kind", F.when(F.col("e"), "explicit_edge").otherwise("co_change")).drop("e")


def predict(h: DataFrame, pairs: DataFrame) -> DataFrame:
    """(path, velocity, bugfix_trend, growth, coupling, risk, kind) of every path."""
    near = pairs.select(F.explode(F.array("path_a", "path_b")).alias("path"), "strength").groupBy("path").agg(F.avg("strength").alias("s"), F.count("*").alias("k"))
    net = F.greatest(F.lit(0), F.col("added") - F.col("deleted"))
    f = h.join(near, "path", "left").select(
        "path",
        F.least(F.lit(1.0), 0.5 * F.col("recent") / F.col("n") + 0.5 * F.least(F.lit(1.0), F.col("recent") / 5)).alias("velocity"),
        F.least(F.lit(1.0), 0.4 * F.col("bugfixes") / F.col("n") + 0.6 * F.when(F.col("recent") > 0, F.col("recent_bugfixes") / F.when(F.col("recent") > 0, F.col("recent"))).otherwise(0.0)).alias("bugfix_trend"),
        (net / (net + 100)).alias("growth"),
        F.when(F.col("k").isNull(), 0.0).otherwise(F.least(F.lit(1.0), 0.6 * F.col("s") + 0.4 * F.least(F.lit(1.0), F.sqrt("k") / 3))).alias("coupling"),
    )
    v, b, g, c = (F.col(x) for x in ("velocity", "bugfix_trend", "growth", "coupling"))
    kind = case([((b >= v) & (b >= g) & (b >= c), "bug_risk"), ((c >= v) & (c >= g), "coupling_risk"), (g >= v, "complexity_growth")], "change_velocity")
    return f.select("path", *(r6(F.col(x)).alias(x) for x in ("velocity", "bugfix_trend", "growth", "coupling")), r6(0.3 * v + 0.3 * b + 0.15 * g + 0.25 * c).alias("risk"), kind.alias("kind"))


def top_predictions(predicted: DataFrame, top: int = 20, least: float = 0.3) -> DataFrame:
    return predicted.where(F.col("risk") >= least).orderBy(F.desc("risk"), "path").limit(top)


def alerts(predicted: DataFrame, top: int = 20, least: float = 0.3, hotspot: float = 0.7, systemic: float = 0.6) -> DataFrame:
    """(kind, path, risk): hotspots among the top predictions; the systemic alert names the first five if all paths' average is high."""
    best = top_predictions(predicted, top, least)
    average = predicted.agg(F.avg("risk").alias("average"))
    first = best.withColumn("k", F.row_number().over(Window.orderBy(F.desc("risk"), "path"))).where("k <= 5").crossJoin(F.broadcast(average)).where(F.col("average") > systemic)  # one row
    return best.where(F.col("risk") > hotspot).select(F.lit("hotspot").alias("kind"), "path", "risk").unionAll(first.select(F.lit("systemic"), "path", "risk"))


def evidence(units: DataFrame, scenario: str = "") -> DataFrame:
    """(id, predictions, confidence) by thresholds of units with their in-degree n_in; a scenario adds a prediction, not evidence."""
    rules = [(F.col("complexity") > 15, "bugs by complexity", 0.8), (F.col("change_count") > 10, "needs refactoring", 0.7), (F.col("stability_score") < 0.3, "more changes", 0.8), (F.col("n_in") > 10, "wide impact", 0.9)]
    hit = F.filter(F.array(*(F.when(c, F.struct(F.lit(t).alias("outcome"), F.lit(w).alias("weight"))) for c, t, w in rules)), lambda x: x.isNotNull())
    mean = F.aggregate(F.col("hit"), F.lit(0.0), lambda s, x: s + x["weight"]) / F.greatest(F.size("hit"), F.lit(1))
    return units.withColumn("hit", hit).select("id", F.concat_ws("; ", F.when(F.size("hit") > 0, F.array_join(F.transform("hit", lambda x: x["outcome"]), "; ")).otherwise("stable"), F.lit(f"if {scenario}: more changes" if scenario else None)).alias("predictions"), r6(F.when(F.size("hit") > 0, F.least(F.lit(1.0), mean)).otherwise(0.3)).alias("confidence"))


def evidence_compare(units: DataFrame, a: int, b: int) -> DataFrame:
    """(side, id, predictions, confidence) of two units."""
    found = evidence(units.where(F.col("id").isin(a, b)))
    return found.select(F.when(F.col("id") == a, "a").otherwise("b").alias("side"), "id", "predictions", "confidence")


def pattern_evidence(spark: SparkSession, pattern: str) -> DataFrame:
    """(pattern, predictions, confidence): nothing can be said of a pattern without its history."""
    return spark.createDataFrame([(pattern, "needs more data", 0.3)], "pattern string, predictions string, confidence double")


def module_evidence(units: DataFrame, prefix: str) -> DataFrame:
    """(units, complexity, changes, verdict) of a module."""
    a = units.where(F.col("qualified_name").startswith(prefix)).agg(F.count("*").alias("units"), r6(F.coalesce(F.avg("complexity"), F.lit(0.0))).alias("complexity"), F.coalesce(F.sum("change_count"), F.lit(0)).alias("changes"))
    return a.withColumn("verdict", reasons([(F.col("complexity") > 10, "complex module"), (F.col("changes") > 50, "volatile module")]))


def investigate(units: DataFrame, h: DataFrame) -> DataFrame:
    """(id, changes, bugfixes, age_days, phase, explanation) of units(id, path, stability_score)."""
    j = units.join(h, "path", "left")
    n, age = F.coalesce("n", F.lit(0)), F.coalesce(F.expr("(latest - oldest) div 86400"), F.lit(0))
    ratio = F.col("bugfixes") / F.col("changes")
    x = j.select("id", "stability_score", n.alias("changes"), F.coalesce("bugfixes", F.lit(0)).alias("bugfixes"), F.coalesce("n_authors", F.lit(0)).alias("n_authors"), F.coalesce("churn", F.lit(0)).alias("churn"), age.alias("age_days"))
    some = F.col("changes") > 0
    ratio = F.when(some, F.col("bugfixes") / F.when(some, F.col("changes")))
    phase = case([(~some, "unknown"), ((F.col("stability_score") > 0.8) & (F.col("age_days") > 180), "stable"), ((ratio > 0.6) & (F.col("age_days") > 90), "decaying"), ((F.col("age_days") < 30) | (F.col("changes") > 10), "active")], "maturing")
    why = reasons([(F.col("age_days") > 365, "mature"), (F.col("age_days") < 30, "new"), (ratio > 0.5, "problematic"), (F.col("n_authors") > 3, "many hands"), (F.col("n_authors") == 1, "one owner"), (F.col("churn") > 500, "reworked"), (F.col("stability_score") < 0.3, "volatile"), (F.col("stability_score") > 0.8, "settled")])
    why = F.when(~some, "no history").when(why == "", "typical").otherwise(why)
    return x.select("id", "changes", "bugfixes", "age_days", phase.alias("phase"), why.alias("explanation"))


def when_changed(units: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, ts, author, kind, description) of every change of the files of units(id, path)."""
    kind = F.when(F.col("is_bugfix"), "bugfix").otherwise("unknown")
    text = F.concat("change_type", F.lit(" by "), "author", F.lit(" (+"), F.col("lines_added").cast("string"), F.lit(" -"), F.col("lines_deleted").cast("string"), F.lit(")"))
    return units.select("id", "path").join(changes, "path").select("id", "ts", "author", kind.alias("kind"), text.alias("description"))
