"""Patterns, rules, concepts, architecture and keyword search over units and edges."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import case, glob, is_dependency, r6, total
from lodestone.graph import Graph
from lodestone.operators.traverse import on_cycles

CONCEPTS = {
    "authentication": ("auth", "login", "logout", "token", "jwt", "oauth", "password", "session", "credential"),
    "payment": ("payment", "charge", "stripe", "paypal", "billing", "checkout", "invoice", "refund"),
    "user_management": ("user", "account", "profile", "registration", "signup", "onboard"),
    "database": ("database", "db", "query", "sql", "migration", "schema", "repository", "orm", "model"),
    "api": ("api", "endpoint", "route", "handler", "controller", "rest", "graphql", "grpc"),
    "logging": ("log", "logger", "trace", "debug", "warn", "error", "metric", "telemetry", "monitor"),
    "configuration": ("config", "setting", "env", "environment", "option", "feature_flag"),
    "testing": ("test", "mock", "stub", "fixture", "assert", "spec", "bench", "integration_test"),
    "error_handling": ("error", "exception", "retry", "fallback", "panic", "throw", "recover", "result"),
    "caching": ("cache", "memoize", "lru", "ttl", "redis", "memcached", "invalidate"),
    "rate_limiting": ("rate_limit", "throttle", "backoff", "quota", "bucket"),
    "security": ("security", "encrypt", "decrypt", "hash", "sanitize", "xss", "csrf", "cors"),
}
ROLES = (
    ("controller", "controller|handler|view|endpoint"), ("service", "service|usecase|interactor"), ("repository", "repository|repo|dao|store|adapter"), ("model", "model|entity|schema|dto"), ("configuration", "config|setting|env"),
)
ENTRY = "main|app|server|cli|entry"
STOP = {"the", "a", "an", "is", "are", "in", "of", "for", "to", "and", "or", "that", "this", "with", "how", "what", "where", "find", "all", "me", "show", "does", "do", "function", "functions", "type", "types", "test", "tests"}


def match_pattern(g: Graph, pattern: str) -> DataFrame:
    """(id, name) by one of four forms: async function, function { calls: [A, B] }, class { inherits: Base }, function { complexity: >N }."""
    p = pattern.strip()
    over = re.search(r"complexity:\s*>\s*(\d+)", p)
    u = g.units.where(F.col("unit_type") == "function")
    above = u.where(F.col("complexity") > int(over[1])) if over else u
    if p.startswith(("async function", "async_function")):
        return above.where("is_async").select("id", "name")
    if p.startswith("function") and (calls := re.search(r"calls:\s*\[([^\]]*)\]", p)):
        names = sorted({n.strip() for n in calls[1].split(",") if n.strip()})
        called = g.edges.where("edge_type = 'calls'").join(g.units.where(F.col("name").isin(*names)).select(F.col("id").alias("target_id"), F.col("name").alias("callee")), "target_id")
        every = called.groupBy(F.col("source_id").alias("id")).agg(F.countDistinct("callee").alias("k")).where(F.col("k") == len(names))
        return above.join(every, "id", "left_semi").select("id", "name")
    if p.startswith("class") and (base := re.search(r"inherits:\s*(\w+)", p)):
        of = g.units.where(F.col("name") == base[1]).select(F.col("id").alias("target_id"))
        heirs = g.edges.where("edge_type = 'inherits'").join(of, "target_id", "left_semi").select(F.col("source_id").alias("id"))
        return g.units.where("unit_type = 'type'").join(heirs, "id", "left_semi").select("id", "name")
    if p.startswith("function") and over:
        return above.select("id", "name")
    raise ValueError(f"unrecognized pattern: {pattern}")


def drift(g: Graph, rules: Sequence[tuple]) -> DataFrame:
    """(rule, source_id, target_id) of violations. Rules: (layer, upper, lower), (boundary, module), (naming, prefix, glob), (cyclic, scope)."""
    named = g.units.select("id", "qualified_name")
    e = g.edges.where(is_dependency()).select("source_id", "target_id").join(named.select(F.col("id").alias("source_id"), F.col("qualified_name").alias("s")), "source_id").join(named.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("t")), "target_id")
    out = g.units.sparkSession.createDataFrame([], "rule int, source_id long, target_id long")
    for k, (kind, *args) in enumerate(rules):
        if kind == "layer":
            bad = e.where(F.col("s").startswith(args[1]) & F.col("t").startswith(args[0])).select("source_id", "target_id")
        elif kind == "boundary":
            bad = e.where(F.col("s").startswith(args[0]) & ~F.col("t").startswith(args[0])).select("source_id", "target_id")
        elif kind == "naming":
            bad = g.units.where(F.col("qualified_name").startswith(args[0]) & ~glob(F.col("name"), args[1])).select(F.col("id").alias("source_id"), F.lit(None).cast("long").alias("target_id"))
        elif kind == "cyclic":
            inside = e.where(F.col("s").startswith(args[0]) & F.col("t").startswith(args[0])).select("source_id", "target_id", F.lit("x").alias("edge_type"))
            bad = on_cycles(inside, ()).select(F.col("id").alias("source_id"), F.lit(None).cast("long").alias("target_id"))
        else:
            raise ValueError(kind)
        out = out.unionAll(bad.select(F.lit(k).alias("rule"), "source_id", "target_id"))
    return out


def conformance(violations: DataFrame, rules: int) -> DataFrame:
    share = F.lit(1.0) if not rules else 1 - F.col("broken") / rules
    return violations.agg(F.countDistinct("rule").alias("broken"), F.count("*").alias("violations")).select(r6(share).alias("conformance"), "violations")


def popular(units: DataFrame, least: int, unit_type: str | None = None) -> DataFrame:
    """(id, usage, confidence) of units that others use."""
    u = units.where(F.col("unit_type") == unit_type) if unit_type else units
    c = F.when(F.col("collective_usage") > 0, F.least(F.lit(1.0), F.ln("collective_usage"))).otherwise(0.0)
    return u.where(F.col("collective_usage") >= least).select("id", F.col("collective_usage").alias("usage"), r6(c).alias("confidence"))


def map_concept(g: Graph, concept: str) -> DataFrame:
    """(id, role, relevance) of units that mention a word."""
    w = concept.lower()
    n, q, d = F.lower("name"), F.lower("qualified_name"), F.lower(F.coalesce("doc_summary", F.lit("")))
    of = g.units.where(n.contains(w)).select(F.col("id").alias("target_id"))
    heirs = g.edges.where("edge_type = 'inherits'").join(of, "target_id", "left_semi").select(F.col("source_id").alias("id")).distinct().withColumn("heir", F.lit(True))
    u = g.units.where(n.contains(w) | q.contains(w) | d.contains(w)).join(heirs, "id", "left")
    role = case([(F.col("unit_type").isin("type", "trait", "module"), "definition"), (F.col("unit_type") == "test", "test"), (F.col("unit_type") == "impl", "extension"), (F.col("heir"), "extension")], "usage")
    score = F.when(n == w, 1.0).otherwise(F.least(F.lit(1.0), F.when(n.contains(w) | q.contains(w), 0.7).otherwise(0.0) + F.when(d.contains(w), 0.3).otherwise(0.0)))
    return u.select("id", role.alias("role"), r6(score).alias("relevance"))


def _score(keywords: Sequence[str]) -> Column:
    n, q, d = F.lower("name"), F.lower("qualified_name"), F.lower(F.coalesce("doc_summary", F.lit("")))
    return total([F.when(n.contains(k), 0.4).otherwise(0.0) + F.when(q.contains(k), 0.2).otherwise(0.0) + F.when(d.contains(k), 0.15).otherwise(0.0) for k in keywords])


def concepts(units: DataFrame, only: str | None = None) -> DataFrame:
    """(concept, id, strength) of units that score 0.3 or more: one pass, no join."""
    bonus = F.when(F.col("unit_type").isin("function", "type"), 0.05).otherwise(0.0)
    parts = [F.struct(F.lit(c).alias("concept"), (_score(k) + bonus).alias("score")) for c, k in CONCEPTS.items() if only in (None, c)]
    x = units.select("id", F.explode(F.array(*parts)).alias("x")).where(F.col("x.score") >= 0.3 - 1e-9)
    return x.select("x.concept", "id", r6(F.least(F.lit(1.0), F.col("x.score"))).alias("strength"))


def explain_concepts(found: DataFrame) -> DataFrame:
    """(concept, units, confidence)."""
    a = found.groupBy("concept").agg(F.count("*").alias("units"), F.max("strength").alias("top"))
    return a.select("concept", "units", r6(F.least(F.lit(1.0), 0.6 * F.col("top") + F.least(F.lit(0.4), 0.1 * F.col("units")))).alias("confidence"))


def parse_question(text: str) -> tuple[str, list[str], str]:
    """(intent, keywords, scope) of a question in words."""
    q = text.lower()
    has = lambda *ws: any(w in q for w in ws)
    if has("test", "spec") or q.startswith("how is"):
        intent = "test"
    elif has("function", "method", "fn ") or q.startswith("def "):
        intent = "function"
    elif has("type", "struct", "class", "enum", "interface"):
        intent = "type"
    elif has("usage", "call", "who uses", "where is"):
        intent = "usage"
    else:
        intent = "implementation" if has("implement", "how does", "logic for") else "general"
    keywords = [w for w in re.split(r"[^\w]+", q) if len(w) >= 2 and w not in STOP]
    scope = "file" if re.search(r"\.(rs|py|ts|js)\b", q) else "module" if "in module " in q else "all"
    return intent, keywords, scope


def parse_questions(texts: DataFrame) -> DataFrame:
    """The rows of texts(text, ...) with intent, keywords (joined by commas) and scope: ``parse_question`` as expressions."""
    q = F.lower("text")
    has = lambda *ws: q.rlike("|".join(ws))
    intent = case([(has("test", "spec") | q.startswith("how is"), "test"), (has("function", "method", "fn ") | q.startswith("def "), "function"), (has("type", "struct", "class", "enum", "interface"), "type"), (has("usage", "call", "who uses", "where is"), "usage"), (has("implement", "how does", "logic for"), "implementation")], "general")
    keywords = F.filter(F.split(q, r"[^\p{L}\p{N}_]+"), lambda w: (F.length(w) >= 2) & ~w.isin(*sorted(STOP)))
    scope = case([(q.rlike(r"\.(rs|py|ts|js)\b"), "file"), (q.contains("in module "), "module")], "all")
    return texts.withColumns({"intent": intent, "keywords": F.array_join(keywords, ","), "scope": scope})


def ask(units: DataFrame, question: str) -> DataFrame:
    """(id, relevance, explanation) by the question's intent and keywords."""
    intent, keywords, _ = parse_question(question)
    n, q = F.lower("name"), F.lower("qualified_name")
    score = total([case([(n == k, 0.5), (n.contains(k), 0.3), (q.contains(k), 0.15)], 0.0) for k in keywords] or [F.lit(0.0)])
    bonus = F.when(F.col("unit_type") == intent, 0.15).otherwise(0.0)
    why = F.concat_ws("; ", *(case([(n == k, f"exact name match '{k}'"), (n.contains(k), f"name contains '{k}'"), (q.contains(k), f"qualified name contains '{k}'")]) for k in keywords))
    out = units.select("id", F.least(F.lit(1.0), score + bonus).alias("s"), F.when(why == "", F.lit(f"intent match: {intent}")).otherwise(why).alias("explanation"))
    return out.where("s > 0.1").select("id", r6(F.col("s")).alias("relevance"), "explanation")


def roles(units: DataFrame) -> DataFrame:
    """(id, role) by what names and paths hold."""
    t = F.lower(F.concat_ws(" ", "name", "qualified_name", "file_path"))
    return units.select("id", case([*((t.rlike(p), r) for r, p in ROLES), (F.col("unit_type") == "test", "test"), (t.rlike(ENTRY), "entrypoint")], "utility").alias("role"))


def architecture(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Roles (role, n), flows (from_role, to_role, calls) and anomalies (source_id, target_id): repositories that call controllers."""
    r = roles(g.units)
    e = g.edges.where("edge_type = 'calls'").join(r.select(F.col("id").alias("source_id"), F.col("role").alias("from_role")), "source_id").join(r.select(F.col("id").alias("target_id"), F.col("role").alias("to_role")), "target_id")
    flows = e.where("from_role <> to_role").groupBy("from_role", "to_role").agg(F.count("*").alias("calls"))
    return r.groupBy("role").agg(F.count("*").alias("n")), flows, e.where("from_role = 'repository' and to_role = 'controller'").select("source_id", "target_id")


def infer_architecture(counts: DataFrame) -> DataFrame:
    """(pattern, layers, confidence) from the counts of roles: the first rule that holds, of mvc, layered, hexagonal, and monolith for two kinds of parts at most."""
    has = lambda r: F.coalesce(F.max(F.when(F.col("role") == r, F.lit(True))), F.lit(False))
    a = counts.agg(
        has("controller").alias("c"), has("service").alias("s"), has("repository").alias("r"), has("model").alias("m"), F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("role") != "utility", F.col("n"))), F.lit(0)).alias("k"), F.countDistinct(F.when(~F.col("role").isin("utility", "test"), F.col("role"))).alias("kinds"),
    )
    c, s, r, m = (F.col(x) for x in "csrm")
    pattern = case([(c & m & ~r, "mvc"), (c & s & r, "layered"), (s & r & ~c, "hexagonal"), (F.col("kinds") <= 2, "monolith")], "unknown")
    layers = c.cast("int") + s.cast("int") + r.cast("int")
    share = F.when(F.col("n") > 0, F.col("k") / F.when(F.col("n") > 0, F.col("n"))).otherwise(0.0)
    return a.select(pattern.alias("pattern"), layers.alias("layers"), r6(F.least(F.lit(1.0), 0.7 * share + F.least(F.lit(0.3), 0.1 * layers))).alias("confidence"))


def validate_architecture(g: Graph, expected: str) -> DataFrame:
    """(kind, source_id, target_id, expected, actual): calls from repositories to controllers, and the pattern if it isn't the expected one."""
    counts, _, wrong = architecture(g)
    none = lambda t: F.lit(None).cast(t)
    calls = wrong.select(F.lit("layer").alias("kind"), "source_id", "target_id", none("string").alias("expected"), none("string").alias("actual"))
    return calls.unionAll(infer_architecture(counts).where(F.col("pattern") != expected).select(F.lit("pattern"), none("long"), none("long"), F.lit(expected), "pattern"))


def diagram(g: Graph) -> DataFrame:
    """(json): pattern, components and flows of an architecture, for a display. There are few roles, so these are short lists."""
    counts, flows, _ = architecture(g)
    one = infer_architecture(counts).select("pattern", "layers")
    parts = counts.agg(F.array_sort(F.collect_list(F.struct("role", F.col("n").alias("size")))).alias("components"))
    ways = flows.agg(F.array_sort(F.collect_list(F.struct(F.col("from_role").alias("from"), F.col("to_role").alias("to"), "calls"))).alias("flows"))
    return one.crossJoin(parts).crossJoin(ways).select(F.to_json(F.struct("pattern", "layers", "components", "flows")).alias("json"))  # one row each


def naming_patterns(units: DataFrame, least: int = 3) -> DataFrame:
    """(pattern, n, confidence): prefixes before the first underscore and suffixes after the last one that several names share."""
    n = F.col("name")
    u = units.where(n.contains("_"))
    first, last = F.substring_index(n, "_", 1), F.substring_index(n, "_", -1)
    p = u.where(F.length(first) >= 3).select(F.concat(first, F.lit("_*")).alias("pattern")).unionAll(u.where(F.length(last) >= 4).select(F.concat(F.lit("*_"), last)))
    return p.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("pattern", "n", r6(F.least(F.lit(0.95), 0.15 * F.col("n"))).alias("confidence"))


def _directory(path: str = "file_path") -> Column:
    return F.regexp_extract(path, "^(.*)/", 1)


def directory_patterns(units: DataFrame, least: int = 3, share: float = 0.7) -> DataFrame:
    """(directory, unit_type, n, share): the type that dominates a directory."""
    by = units.groupBy(_directory().alias("directory"), "unit_type").agg(F.count("*").alias("k"))
    a = by.groupBy("directory").agg(F.sum("k").alias("n"), F.max(F.struct("k", "unit_type")).alias("top"))
    s = F.col("top.k") / F.col("n")
    return a.where((F.col("n") >= least) & (s > share)).select("directory", F.col("top.unit_type").alias("unit_type"), "n", r6(F.least(F.lit(0.9), s)).alias("share"))


def _instances(units: DataFrame) -> DataFrame:
    """(pattern, id, file_path): members of naming patterns with their files, and of directory patterns with their directories."""
    n = F.col("name")
    u = units.where(n.contains("_"))
    first, last = F.substring_index(n, "_", 1), F.substring_index(n, "_", -1)
    named = u.where(F.length(first) >= 3).select(F.concat(first, F.lit("_*")).alias("pattern"), "id", "file_path").unionAll(u.where(F.length(last) >= 4).select(F.concat(F.lit("*_"), last), "id", "file_path"))
    named = named.join(naming_patterns(units).select("pattern"), "pattern", "left_semi")
    top = directory_patterns(units).where("directory <> ''").select("directory", "unit_type")
    placed = units.withColumn("directory", _directory()).join(top, ["directory", "unit_type"])
    return named.unionAll(placed.select(F.concat(F.lit("dir:"), "directory", F.lit(":"), "unit_type"), "id", F.col("directory")))


def check_patterns(units: DataFrame, unit: int) -> DataFrame:
    """(pattern): those that others in or below the unit's directory follow, and it doesn't."""
    every = _instances(units)
    at = units.where(F.col("id") == unit).select(_directory().alias("at"))
    near = every.crossJoin(F.broadcast(at)).where(F.col("file_path").startswith(F.col("at")) & (F.col("at") != "")).select("pattern").distinct()  # one row
    return near.join(every.where(F.col("id") == unit).select("pattern"), "pattern", "left_anti")


def suggest_patterns(units: DataFrame, path: str) -> DataFrame:
    """(pattern, n): patterns that units in or below a new file's directory follow, and how many of them do."""
    at = path.rpartition("/")[0]
    return _instances(units).where(F.col("file_path").startswith(at) if at else F.lit(False)).groupBy("pattern").agg(F.count("*").alias("n"))


def design_patterns(g: Graph) -> DataFrame:
    """(pattern, id, score): factories, repositories, decorators and singletons.

    Members are found by the parent of their qualified name, an equality, so no all-pairs join is needed.
    """
    n = F.lower("name")
    types = g.units.where(F.col("unit_type") == "type")
    functions = g.units.where(F.col("unit_type") == "function")
    factory = functions.where(n.rlike("^(create|make|build|new)_") | n.contains("factory")).select(F.lit("factory").alias("pattern"), "id", F.when(n.contains("factory"), 0.9).otherwise(0.5).alias("score"))
    decorator = functions.where(n.contains("decorator") | n.contains("wrapper")).select(F.lit("decorator"), "id", F.when(n.contains("decorator"), 0.8).otherwise(0.5))
    parent = F.lower(F.regexp_extract("qualified_name", r"^(.*)(::|\.)", 1))
    crud = functions.where(n.rlike("^(get|find|create|save|update|delete|insert)")).groupBy(parent.alias("owner")).agg(F.count("*").alias("crud"))
    owned = types.where(n.contains("repository") | n.contains("repo")).select("id", F.lower("qualified_name").alias("owner")).join(crud, "owner", "left")
    repository = owned.select(F.lit("repository"), "id", F.when(F.col("crud") >= 3, 0.9).when(F.col("crud") >= 1, 0.6).otherwise(0.4))
    access = n.contains("instance") | n.contains("shared") | (n == "default")
    hidden = n.isin("__init__", "new", "constructor") & (F.col("visibility") == "private")
    marks = functions.where(access | hidden).groupBy(parent.alias("owner")).agg(F.max(access.cast("int")).alias("i"), F.max(hidden.cast("int")).alias("c"))
    single = types.select("id", F.lower("qualified_name").alias("owner")).join(marks, "owner").select(F.lit("singleton"), "id", (0.5 * (F.col("i") + F.col("c"))).alias("score"))
    return factory.unionAll(repository).unionAll(decorator).unionAll(single)


def extract_concepts(units: DataFrame) -> DataFrame:
    """(concept, id, score) as a compiler scores them: for each keyword the name, else the qualified name; a document line once; typical unit types; above 0.3."""
    n, q, d = F.lower("name"), F.lower("qualified_name"), F.lower(F.coalesce("doc_summary", F.lit("")))
    parts = []
    for c, ks in list(CONCEPTS.items())[:10]:
        per = total([case([(n.contains(k), 0.4), (q.contains(k), 0.2)], 0.0) for k in ks])
        doc = F.when(d.rlike("|".join(ks)), 0.15).otherwise(0.0)
        typical = F.when(F.col("unit_type").isin(*(("test",) if c == "testing" else ("function", "type"))), 0.1).otherwise(0.0)
        parts.append(F.struct(F.lit(c).alias("concept"), (per + doc + typical).alias("score")))
    x = units.select("id", F.explode(F.array(*parts)).alias("x")).where(F.col("x.score") > 0.3 + 1e-9)
    return x.select("x.concept", "id", r6(F.least(F.lit(1.0), F.col("x.score"))).alias("score"))
