"""Column expressions shared by operators; all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Edge types in the order of their codes.
TYPES = ("calls", "imports", "inherits", "implements", "overrides", "contains", "references", "tests", "documents", "configures", "couples_with", "breaks_with", "pattern_of", "version_of", "ffi_binds", "uses_type", "returns", "param_type")
DEPS = ("calls", "imports", "inherits", "implements", "uses_type", "ffi_binds")


def is_dependency(column: str = "edge_type") -> Column:
    return F.col(column).isin(*DEPS)


def glob(value: Column, pattern: str) -> Column:
    """A pattern with a leading or trailing ``*``, in any case; without one, equality."""
    p, v = pattern.lower(), F.lower(value)
    body = p.strip("*") if len(p) > 1 else ""
    if p.startswith("*") and p.endswith("*"):
        return v.contains(body)
    if p.startswith("*"):
        return v.endswith(p[1:])
    return v.startswith(p[:-1]) if p.endswith("*") else v == p


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in doubles: 0 where a norm is 0 or lengths differ."""
    d = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = F.aggregate(F.zip_with(d(a), d(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(F.aggregate(d(x), F.lit(0.0), lambda s, v: s + v * v))
    ok = (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(ok, dot / F.when(ok, norm(a) * norm(b))).otherwise(F.lit(0.0))


def parent_module(qualified: Column) -> Column:
    """The qualified name before its last ``::``, else before its last dot; null for neither."""
    return F.when(qualified.contains("::"), F.regexp_extract(qualified, r"^(.*)::", 1)).when(qualified.contains("."), F.regexp_extract(qualified, r"^(.*)\.", 1))


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def case(pairs: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    out = reduce(lambda c, p: c.when(*p), pairs[1:], F.when(*pairs[0]))
    return out.otherwise(otherwise) if otherwise is not None else out


def r6(c: Column) -> Column:
    return F.round(c, 6)


def reasons(parts: list[tuple[Column, str]]) -> Column:
    """The texts whose conditions hold, joined."""
    return F.concat_ws("; ", *(F.when(c, F.lit(t)) for c, t in parts))


def change_kind(message: Column) -> Column:
    """What a commit message says that it did: the first of these words decides."""
    m = F.lower(message)
    return case([(m.rlike("fix|bug|patch|hotfix"), "bugfix"), (m.rlike("refactor|cleanup|reorganize|restructure"), "refactor"), (m.rlike("perf|optimiz|speed|fast"), "performance"), (m.rlike("feat|add|implement|new"), "feature")], "unknown")


def complexity_bucket(c: Column) -> Column:
    return case([(c <= 5, "low"), (c <= 15, "medium"), (c <= 30, "high")], "very_high")


def looks_like_credentials(text: Column) -> Column:
    return F.lower(text).rlike("password|passwd|secret|api_key|apikey|token|credential|private_key|auth|bearer|access_key")
