"""Source code as rows of raw units: one task reads many files, and a file that can't be parsed is a row with its error.

Python is parsed by the standard library's syntax tree. Of Rust, TypeScript, JavaScript, Go, C++, Java and C#, declarations
are recognised line by line by regular expressions, and blocks are followed by their braces.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = {"py": "Python", "rs": "Rust", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "go": "Go", "cpp": "Cpp", "cc": "Cpp", "h": "Cpp", "hpp": "Cpp", "java": "Java", "cs": "CSharp"}
EXCLUDE = ("node_modules", "target", ".git", "__pycache__", "venv", ".venv", "dist", "build")
MOST_BYTES = 10 << 20
RAW = "path string, language string, unit_type string, name string, qualified_name string, start_line int, end_line int, signature string, doc string, visibility string, complexity int, is_async boolean, is_generator boolean, refs array<struct<name:string,kind:string,line:int>>, error string"
_ARROW = pa.schema([(n, {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}.get(t) or pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("line", pa.int32())]))) for n, t in (c.split(" ", 1) for c in RAW.split(", "))])
#: Rows of a batch.
BATCH = 4096
_WORD = r"[A-Za-z_]\w*"
_DECLARATIONS = {
    "Rust": [("function", rf"^\s*(?P<v>pub(?:\([a-z]+\))?\s+)?(?P<a>async\s+)?(?:unsafe\s+)?fn\s+(?P<n>{_WORD})"), ("type", rf"^\s*(?P<v>pub(?:\([a-z]+\))?\s+)?(?:struct|enum)\s+(?P<n>{_WORD})"), ("trait", rf"^\s*(?P<v>pub(?:\([a-z]+\))?\s+)?trait\s+(?P<n>{_WORD})"), ("impl", rf"^\s*impl(?:<[^>]*>)?\s+(?:(?P<i>{_WORD})(?:<[^>]*>)?\s+for\s+)?(?P<n>{_WORD})"), ("macro", rf"^\s*macro_rules!\s+(?P<n>{_WORD})"), ("import", r"^\s*use\s+(?P<n>[\w:]+)")],
    "TypeScript": [("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?P<a>async\s+)?function\s*\*?\s*(?P<n>{_WORD})"), ("type", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|enum)\s+(?P<n>{_WORD})(?:\s+extends\s+(?P<b>{_WORD}))?"), ("trait", rf"^\s*(?:export\s+)?interface\s+(?P<n>{_WORD})(?:\s+extends\s+(?P<b>{_WORD}))?"), ("function", rf"^\s*(?:export\s+)?const\s+(?P<n>{_WORD})\s*=\s*(?P<a>async\s*)?(?:\([^)]*\)|{_WORD})\s*=>"), ("import", r"^\s*import\b.*?from\s+['\"](?P<n>[^'\"]+)"), ("method", rf"^\s+(?:(?:public|private|protected|static|readonly|get|set)\s+)*(?P<a>async\s+)?\*?(?P<n>{_WORD})\s*\([^;]*\)\s*(?::[^{{;]+)?\{{")],
    "Go": [("function", rf"^func\s+(?:\([^)]*\)\s*)?(?P<n>{_WORD})"), ("trait", rf"^type\s+(?P<n>{_WORD})\s+interface"), ("type", rf"^type\s+(?P<n>{_WORD})"), ("import", r"^\s*(?:import\s+)?\"(?P<n>[\w./-]+)\"")],
    "Cpp": [("type", rf"^\s*(?:class|struct|enum)\s+(?P<n>{_WORD})(?:\s*:\s*(?:public|private|protected)?\s*(?P<b>{_WORD}))?[^;]*$"), ("module", rf"^\s*namespace\s+(?P<n>{_WORD})"), ("import", r"^\s*#include\s+[<\"](?P<n>[^>\"]+)"), ("function", rf"^\s*[\w:<>,&*\s]+?\s[*&]?(?:{_WORD}::)?(?P<n>{_WORD})\s*\([^;]*\)\s*(?:const\s*)?\{{?\s*$")],
    "Java": [("trait", rf"^\s*(?P<v>public|private|protected)?\s*interface\s+(?P<n>{_WORD})"), ("type", rf"^\s*(?P<v>public|private|protected)?\s*(?:abstract\s+|final\s+)*(?:class|enum|record)\s+(?P<n>{_WORD})(?:\s+extends\s+(?P<b>{_WORD}))?"), ("import", r"^\s*import\s+(?P<n>[\w.]+)"), ("function", rf"^\s*(?P<v>public|private|protected)\s+(?:static\s+|final\s+)*[\w<>\[\],\s]+\s(?P<n>{_WORD})\s*\([^;]*\{{?\s*$")],
}
_DECLARATIONS["JavaScript"] = _DECLARATIONS["TypeScript"]
_DECLARATIONS["CSharp"] = [(k, p.replace("import", "using", 1) if k == "import" else p.replace("private|protected", "private|protected|internal").replace(r"\s+extends\s+", r"\s*:\s*")) for k, p in _DECLARATIONS["Java"]]
_COMPILED = {lang: [(k, re.compile(p)) for k, p in ps] for lang, ps in _DECLARATIONS.items()}


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(regular expression of a path below the root, whether it takes files in again) of the lines of an ignore file."""
    out = []
    for line in text.splitlines():
        p = line.rstrip()
        if not p or p.startswith("#"):
            continue
        again, p = p.startswith("!"), p.removeprefix("!")
        anchored, folder, p = "/" in p.rstrip("/"), p.endswith("/"), p.strip("/")
        body = "".join({"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.split(r"(\*\*/|/\*\*|\*\*|\*|\?)", p) if x)
        out.append((("^" if anchored else "^(?:.*/)?") + body + ("/.*$" if folder else "(?:/.*)?$"), again))
    return out


def scan(spark: SparkSession, root: str, languages: tuple[str, ...] = (), exclude: tuple[str, ...] = EXCLUDE, ignore: str = "", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, length, language, reason) of all files; reason is null for those that are parsed. ignore: the text of an ignore file.

    Files and folders whose names begin with a dot aren't listed by the source, so they are left out without a row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    language = F.create_map(*(F.lit(x) for p in EXTENSIONS.items() for x in p))[ext]
    left_out = F.exists(F.array(*map(F.lit, exclude)), lambda x: F.col("path").contains(x)) if exclude else F.lit(False)
    below = F.substring("path", F.instr("path", root.rstrip("/").rsplit("/", 1)[-1] + "/") + len(root.rstrip("/").rsplit("/", 1)[-1]) + 1, 1 << 20)
    hidden = F.lit(False)
    for pattern, again in ignore_rules(ignore):  # the last rule that fits decides
        hidden = F.when(below.rlike(pattern), not again).otherwise(hidden)
    reason = F.when(hidden, "ignored").when(F.col("language").isNull(), "unknown_language").when(~F.col("language").isin(*languages) if languages else F.lit(False), "language_filter").when(left_out, "excluded").when(F.col("length") > most_bytes, "too_large")
    return files.withColumn("language", language).withColumn("reason", reason)


def coverage(scanned: DataFrame) -> DataFrame:
    """(reason, n): how many files were taken or left out, and why."""
    return scanned.groupBy(F.coalesce("reason", F.lit("parsed")).alias("reason")).agg(F.count("*").alias("n"))


def read(spark: SparkSession, root: str, **options) -> DataFrame:
    """The raw units of all source files below a folder."""
    wanted = scan(spark, root, **options).where("reason is null").select("path")
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    return parse(content.join(wanted, "path", "left_semi"))


def parse(files: DataFrame) -> DataFrame:
    """The raw units of files (path, content). The rows of many files leave Python in one batch, as each batch has a cost of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                rows += parse_file(path.as_py(), (content.as_py() or b"").decode("utf-8", "replace"))
                if len(rows) >= BATCH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    return files.select("path", "content").mapInArrow(run, RAW)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def parse_file(path: str, text: str) -> list[tuple]:
    language = EXTENSIONS.get(path.rsplit(".", 1)[-1].lower(), "Unknown")
    module = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    whole = (path, language, "module", module, module, 1, text.count("\n") + 1, None, None, "public", 0, False, False, [], None)
    try:
        return [whole, *(_python(path, module, text) if language == "Python" else _braces(path, language, module, text) if language in _COMPILED else [])]
    except (SyntaxError, ValueError, RecursionError) as e:
        return [(*whole[:-1], f"{type(e).__name__}: {e}"[:200])]


def visibility(language: str, name: str, mark: str | None) -> str:
    """How visible a declaration is, by its language's custom."""
    mark = (mark or "").strip()
    if language == "Python":
        return "private" if name.startswith("__") and not name.endswith("__") else "internal" if name.startswith("_") else "public"
    if language == "Rust":
        return "private" if not mark else "public" if mark == "pub" else "internal"
    if language == "Go":
        return "public" if name[:1].isupper() else "private"
    if language in ("Java", "CSharp"):
        return "private" if mark == "private" or (language == "CSharp" and not mark) else "public"
    return "public"


_DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.IfExp)


def complexity(node: ast.AST) -> int:
    """One more than the decisions below a node; a chain of and, or counts each operator."""
    return 1 + sum(len(x.values) - 1 if isinstance(x, ast.BoolOp) else isinstance(x, _DECISIONS) for x in ast.walk(node))


def _name(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = _name(node.value)
        return f"{base}.{node.attr}" if base else node.attr
    return None


def _python(path: str, module: str, text: str) -> list[tuple]:
    out = []

    def visit(body: list[ast.stmt], prefix: str) -> None:
        for node in body:
            if isinstance(node, ast.Import | ast.ImportFrom):
                base = f"{node.module}." if isinstance(node, ast.ImportFrom) and node.module else ""
                for a in node.names:
                    full = base + a.name
                    out.append((path, "Python", "import", full, f"{prefix}.{full}", node.lineno, node.end_lineno, None, None, "public", 0, False, False, [(full, "import", node.lineno)], None))
            elif isinstance(node, ast.ClassDef):
                bases = [(n, "inherit", node.lineno) for b in node.bases if (n := _name(b))]
                out.append((path, "Python", "type", node.name, f"{prefix}.{node.name}", node.lineno, node.end_lineno, None, _doc(node), visibility("Python", node.name, None), 0, False, False, bases, None))
                visit(node.body, f"{prefix}.{node.name}")
            elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                calls = [(n, "call", c.lineno) for c in ast.walk(node) if isinstance(c, ast.Call) and (n := _name(c.func))]
                signature = f"({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
                generator = any(isinstance(x, ast.Yield | ast.YieldFrom) for x in ast.walk(node))
                kind = "test" if node.name.startswith("test") else "function"
                out.append((path, "Python", kind, node.name, f"{prefix}.{node.name}", node.lineno, node.end_lineno, signature, _doc(node), visibility("Python", node.name, None), complexity(node), isinstance(node, ast.AsyncFunctionDef), generator, calls, None))
                visit(node.body, f"{prefix}.{node.name}")
            elif isinstance(node, ast.If | ast.Try):
                visit(node.body, prefix)

    visit(ast.parse(text).body, module)
    return out


def _doc(node: ast.AST) -> str | None:
    d = ast.get_docstring(node)
    return d.strip().split("\n")[0].strip() if d else None


_RUST_DECISIONS = re.compile(r"\b(?:if|match|while|for|loop)\b|&&|\|\|")


def _braces(path: str, language: str, module: str, text: str) -> list[tuple]:
    out, lines = [], text.split("\n")
    owners: list[tuple[int, str]] = []  # depth of the block, and its name
    depth, doc, marked, module_mark = 0, None, False, False
    sep = "::" if language in ("Rust", "Cpp") else "."
    for k, line in enumerate(lines, 1):
        plain = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'|//.*", lambda m: m[0] if m[0][0] != "/" and ("import" in line or "include" in line or language == "Go") else '""', line)
        comment = re.match(r"\s*(?:///|//!?|/\*\*?|\*)\s*(.*?)(?:\*/)?\s*$", line)
        for kind, pattern in _COMPILED[language]:
            m = pattern.match(plain)
            if not m or (kind == "method" and not owners) or m["n"] in ("if", "for", "while", "switch", "return", "catch", "else", "new"):
                continue
            got = m.groupdict()
            kind = "function" if kind == "method" else kind
            name, unit = m["n"], kind
            test = marked or (language == "Go" and name.startswith("Test")) or (language in ("TypeScript", "JavaScript") and re.search(r"\.(?:test|spec)\.", path) is not None)
            if kind == "function" and test:
                unit = "test"
            end = k
            if kind != "import":
                level = 0
                for j in range(k - 1, len(lines)):
                    level += lines[j].count("{") - lines[j].count("}")
                    end = j + 1
                    if (level <= 0 and "{" in "".join(lines[k - 1 : j + 1])) or (level == 0 and lines[j].rstrip().endswith(";")):
                        break
            refs = [(name, "import", k)] if kind == "import" and language in ("Rust", "TypeScript", "JavaScript") else []
            refs += [(got.get("b"), "inherit", k)] * bool(got.get("b") and language in ("TypeScript", "JavaScript")) + [(got.get("i"), "implement", k)] * bool(got.get("i")) + [(name, "pymodule", k)] * module_mark
            cx = 1 + len(_RUST_DECISIONS.findall("\n".join(lines[k - 1 : end]))) if kind == "function" and language == "Rust" else 0
            prefix = sep.join([module, *(o for _, o in owners)])
            out.append((path, language, unit, name, f"{prefix}{sep}{name}", k, end, line.strip().rstrip("{").strip() if kind == "function" else None, doc, visibility(language, name, got.get("v")), cx, bool(got.get("a")), False, refs, None))
            if kind in ("type", "impl", "trait", "module") and "{" in plain and end > k:
                owners.append((depth, name))
            break
        depth += plain.count("{") - plain.count("}")
        while owners and depth <= owners[-1][0]:
            owners.pop()
        marked = bool(re.match(r"\s*(?:#\[(?:\w+::)?test\]|@Test|\[(?:Test|Fact|Theory)\])", line))
        module_mark = bool(re.match(r"\s*#\[pymodule\b", line))
        doc = comment[1].strip() or None if comment else (doc if marked else None)
    return out
